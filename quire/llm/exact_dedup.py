"""Exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.shared import SPACE, stored, table

#: Runs that meet in one merge: 2 ** FAN_BITS.
FAN_BITS = 4
KEY = ["sha", "check", "size"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, sha, check, size, run): a row per document, null text counting as empty.

    sha is SHA-256 of the text without white space; check (a second hash) and size (bytes) verify it, so that texts of
    equal digest but other content would stay apart. run is the input partition the row was read in.
    """
    bare = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+", "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"), bare.alias("bare"))
    return rows.select(
        "doc_id", "n_chars", F.unhex(F.sha2("bare", 256)).alias("sha"), F.xxhash64("bare").alias("check"), F.octet_length("bare").alias("size"), F.spark_partition_id().alias("run")
    )


def tree_merge(rows: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """(sha, check, size, best, n): the row that stays of each text and how many rows have it.

    Round k clears the low bits of a run's number, so that 2**fan_bits runs meet in the one whose number has those bits
    at zero (a binomial tree). Every round sorts what it has by digest before it is sent and merges the sorted runs after;
    min() of a struct is done by Spark's sort aggregate on both sides. A digest leaves each round once per run, with the
    best row so far, so no key's rows ever meet in one task unmerged.
    """
    best = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    runs, shift, last = rows.select("run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("n")), 0, rows.agg(F.max("run")).first()[0] or 0
    while True:
        shift += fan_bits
        done = last >> shift == 0
        keys = KEY if done else [F.shiftleft(F.shiftright("run", shift), shift).alias("run"), *KEY]
        runs = runs.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        if done:
            return runs.select(*KEY, F.col("best.doc_id").alias("keep_id"), "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_bits: int = FAN_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Equal texts: identical after deleting white space. Most code points stay, then the smallest id; a null id comes after
    every other. Null text is empty, and empty texts are one group. Rows repeated with one id count each in group_size,
    and each is marked kept if the id is the one that stays. Empty table: no rows. Extra columns are ignored.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    groups = stored(tree_merge(rows, fan_bits).filter("n > 1"), "groups")
    out = rows.select("doc_id", *KEY).join(groups, KEY, "left")
    many = F.col("n").isNotNull()
    return out.select(
        "doc_id",
        F.when(many, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(many, F.col("keep_id").eqNullSafe(F.col("doc_id"))).otherwise(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_bits: int = FAN_BITS) -> DataFrame:
    """The documents that stay, with their own columns, whatever their names: exactly one row for each text, also where a
    row is repeated.

    Null texts are empty and equal to blank ones; a null id stays only if no row of its text has one. Empty table: no rows.
    """
    bare = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE + "+", "")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(bare, 256)).alias("sha"))
    best = tree_merge(stored(digests(docs, id_col, text_col), "digests"), fan_bits).select("sha", F.col("keep_id").alias("doc_id"))
    both = (rows["sha"] == best["sha"]) & rows["doc_id"].eqNullSafe(best["doc_id"])
    one = W.partitionBy("sha", "doc_id").orderBy(-F.length(F.col("row").getField(text_col)))
    met = rows.join(best, both).select(rows["row"], rows["sha"], rows["doc_id"])
    return met.withColumn("nth", F.row_number().over(one)).filter("nth = 1").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
h AS (SELECT doc_id, n_chars, sha256(bare) AS text_sha256 FROM d),
w AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
