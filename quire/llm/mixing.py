"""Mixing of sources: temperature weights to a target entropy or repetition limit, realised by budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.shared import SPACE, stored, table

#: Share of the largest possible entropy that the weights shall have, passes over a source at most, seed of permutations.
ENTROPY, PASSES, SEED = 0.95, 2.0, 17
#: Exponents looked at in one round, and rounds: brackets shrink by GRID - 1 each time.
GRID, ROUNDS = 33, 5
#: Bits of a permutation's place that one level of blocks resolves, and levels.
BITS, LEVELS = 10, 3


def words_in(text: Column) -> Column:
    """Tokens of a text for the budget: its white-space words, by the spaces that end them."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.regexp_replace(bare, SPACE + "+", "")).cast("long")


def exponent(shares: DataFrame, entropy: float = ENTROPY, passes: float = PASSES, grid: int = GRID, rounds: int = ROUNDS) -> float:
    """The largest exponent in 0 to 1 whose weights (share ** exponent, normalised) have the target entropy, kept large
    enough that no source is read more than passes times where the budget is all tokens.

    Both grow or fall monotonically with the exponent; each round evaluates a grid of exponents in one aggregation over the
    sources and keeps the bracket in which the answer changes. shares: (source, share), share > 0.
    """
    n = shares.count()
    if n < 2:
        return 1.0

    def bracket(good) -> tuple[float, float]:
        """Two neighbouring exponents: good holds up to the first and not at the second; (0, 0) if it never holds."""
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            step = (hi - lo) / (grid - 1)
            tried = shares.select("share", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("k")).withColumn("e", F.lit(lo) + F.col("k") * step).withColumn("w", F.pow("share", F.col("e")))
            sums = tried.groupBy("k", "e").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wlw"), F.max(F.col("w") / F.col("share")).alias("most"))
            last = sums.filter(good).agg(F.max("k")).first()[0]
            if last is None:
                return 0.0, 0.0
            lo, hi = lo + last * step, min(hi, lo + (last + 1) * step)
        return lo, hi

    wanted, _ = bracket(F.log("z") - F.col("wlw") / F.col("z") >= entropy * math.log(n))
    # reading a source of share p at the weight w / z takes w / (z p) passes
    _, enough = bracket(F.col("most") / F.col("z") > passes)
    return max(wanted, enough)


def place(salt: Column, *cols: str) -> Column:
    """The place of a row in its source's permutation: BITS * LEVELS bits of a seeded hash."""
    return F.pmod(F.xxhash64(salt, *cols), F.lit(1 << BITS * LEVELS))


def cuts(rows: DataFrame, entropy: float = ENTROPY, passes: float = PASSES, budget: int | None = None) -> DataFrame:
    """(of, whole, low): for each source the whole passes, and the place before which a document has one more copy.

    rows: (source, tokens, place). The place is found by blocks of the permutation: sums per block of the widest kind, then
    within the one block where the quota ends, and so on down to single places, so no source is ever sorted in one task.
    """
    totals = stored(rows.groupBy("source").agg(F.sum("tokens").alias("total")), "totals")
    every = totals.agg(F.sum("total")).first()[0] or 0
    share = F.col("total") / F.lit(max(every, 1))
    shares = totals.filter("total > 0").select("source", share.alias("share"))
    e = exponent(shares, entropy, passes)
    z = shares.agg(F.sum(F.pow("share", F.lit(e)))).first()[0] or 1.0
    quota = F.floor(F.pow(share, F.lit(e)) / F.lit(z) * F.lit(every if budget is None else budget))
    has = F.col("total") > 0
    cut = totals.select("source", "total", F.when(has, quota).otherwise(0).alias("quota")).select(
        F.col("source").alias("of"),
        F.when(has, F.floor(F.try_divide("quota", "total"))).otherwise(1).cast("long").alias("whole"),
        F.when(has, F.try_mod("quota", "total")).otherwise(0).cast("long").alias("left"),
        F.lit(0).cast("long").alias("low"),
    )
    cut = stored(cut, "quotas")
    for level in range(LEVELS):
        width = 1 << BITS * (LEVELS - 1 - level)
        # a row for each source: small, but without a bound, so Spark chooses the join by its measured size
        near = rows.join(cut, F.col("source").eqNullSafe(F.col("of"))).filter((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width * (1 << BITS)))
        blocks = near.groupBy("of", "left", F.floor((F.col("place") - F.col("low")) / width).alias("block")).agg(F.sum("tokens").alias("sum"))
        upto = F.sum("sum").over(W.partitionBy("of").orderBy("block"))  # at most 2 ** BITS rows for a source
        first = blocks.withColumn("upto", upto).filter(F.col("upto") > F.col("left")).groupBy("of").agg(F.min(F.struct("block", (F.col("upto") - F.col("sum")).alias("before"))).alias("at"))
        first = first.select(F.col("of").alias("at_of"), (F.col("at.block") * width).alias("on"), F.col("at.before").alias("before"))
        cut = cut.join(first, F.col("of").eqNullSafe(F.col("at_of")), "left")
        cut = stored(cut.select("of", "whole", (F.col("left") - F.coalesce("before", F.lit(0))).alias("left"), (F.col("low") + F.coalesce("on", F.lit(0))).alias("low")), "cut")
    return cut.select("of", "whole", "low")


def copies(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """rows with the number of copies that the cuts give each."""
    met = rows.join(ends, F.col("source").eqNullSafe(F.col("of")))
    return met.withColumn("copies", (F.col("whole") + F.when(F.col("place") < F.col("low"), 1).otherwise(0)).cast("int")).drop("of", "whole", "low")


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    return own.withColumn("place", place(F.lit(seed), "doc_id", "text"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = ENTROPY, passes: float = PASSES, budget: int | None = None, seed: int = SEED
) -> DataFrame:
    """(doc_id, source, tokens, place, copies): one row per input row; copies may be 0.

    A source's quota is its weight times the budget (all tokens unless given). Its documents stand in a permutation, by a
    seeded hash of id and text; whole passes are taken as often as the quota allows, and of one more pass the longest
    beginning that stays within what is left; documents of one place go in together or not. Tokens are white-space words;
    documents without any cost nothing. A source without tokens is taken once. A null source is a source of its own, rows
    may repeat, null texts are empty, and an empty table gives no rows.
    """
    rows = placed(docs, id_col, text_col, source_col, seed).select("doc_id", "source", words_in(F.col("text")).alias("tokens"), "place")
    rows = stored(rows, "places")
    return copies(rows, cuts(rows, entropy, passes, budget))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = ENTROPY, passes: float = PASSES, budget: int | None = None, seed: int = SEED
) -> DataFrame:
    """The documents as often as the mixture takes them, with their own columns, whatever their names.

    Rows are taken as by mix(): repeated rows each, null texts as empty ones, a null source as a source of its own. Empty
    table: no rows.
    """
    rows = placed(docs, id_col, text_col, source_col, seed).select("source", words_in(F.col("text")).alias("tokens"), "place")
    ends = cuts(stored(rows, "places"), entropy, passes, budget)
    held = placed(docs, id_col, text_col, source_col, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("source", "place", "row")
    taken = copies(held, ends).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
