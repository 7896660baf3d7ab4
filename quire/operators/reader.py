"""Reading: pages by capacity, offsets, search, active chapter, sentence spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

CAPACITY = 1200


def offsets(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, lo, hi): places of each line's characters, white space not counted, in its document."""
    n = F.length(F.regexp_replace("line", "\\s", ""))
    upto = F.sum("n").over(W.partitionBy("doc_id").orderBy("line_no"))
    return lines.withColumn("n", n).select("doc_id", "line_no", (upto - F.col("n")).alias("lo"), upto.alias("hi"))


def pages(lines: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, line_no, page): the page on which a line's first character falls, at so many characters a page."""
    return offsets(lines).select("doc_id", "line_no", F.floor(F.col("lo") / capacity).cast("int").alias("page"))


def packed_pages(blocks: DataFrame, rows: int = 30, columns: int = 60) -> DataFrame:
    """(doc_id, pos, page): greedy pages of so many text rows; headings stay with the block after, chapters begin a page.

    Where a block goes depends on all before it, so the sizes and kinds of a document's blocks, in order, are folded as one
    array, with many documents in an Arrow batch; texts stay where they are.
    """
    import pandas as pd

    def pages_of(doc: list) -> list[int]:
        out, page, used = [], 1, 0
        for i, block in enumerate(doc):
            size = block["need"] + (doc[i + 1]["need"] if block["is_heading"] and i + 1 < len(doc) else 0)
            if used and (block["is_chapter_start"] or used + size > rows):
                page, used = page + 1, 0
            out.append(page)
            used += block["need"]
            while used > rows:
                page, used = page + 1, used - rows
        return out

    def fold(docs: pd.Series) -> pd.Series:
        return docs.map(pages_of)

    need = F.ceil(F.greatest(F.lit(1), F.length(F.coalesce("text", F.lit("")))) / columns).cast("int")
    block = F.struct(F.col("pos").cast("long").alias("pos"), need.alias("need"), "is_heading", "is_chapter_start")
    held = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    folded = F.pandas_udf(fold, "array<int>", F.PandasUDFType.SCALAR)
    places = held.withColumn("pages", folded("blocks")).select("doc_id", F.explode(F.arrays_zip(F.col("blocks.pos").alias("pos"), F.col("pages").alias("page"))).alias("p"))
    return places.select("doc_id", "p.pos", "p.page")


def search(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, hits): how often a text occurs, without regard to case and without overlaps."""
    text, find = F.lower(F.coalesce("text", F.lit(""))), needle.lower()
    hits = ((F.length(text) - F.length(F.replace(text, F.lit(find), F.lit("")))) / len(find)).cast("int")
    return docs.select("doc_id", hits.alias("hits")).filter("hits > 0")


def occurrences(docs: DataFrame, needle: str) -> DataFrame:
    """(doc_id, ordinal, before): each hit with up to 20 characters before it."""
    parts = F.split(F.lower(F.coalesce("text", F.lit(""))), "\\Q" + needle.lower().replace("\\E", "") + "\\E", -1)
    each = docs.select("doc_id", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("at", "piece")).filter("at >= 0")
    return each.select("doc_id", (F.col("at") + 1).alias("ordinal"), F.right("piece", F.lit(20)).alias("before"))


def asof(rows: DataFrame, marks: DataFrame, key: str, order: str, mark: str, tie: str) -> DataFrame:
    """rows with the latest mark of their key at or before them: a union and a running last value, one shuffle, no pairs."""
    both = rows.select(key, order, tie, F.lit(None).cast(marks.schema[mark].dataType).alias(mark), F.lit(1).alias("is_row")).unionByName(marks.select(key, order, F.lit(None).cast(rows.schema[tie].dataType).alias(tie), mark, F.lit(0).alias("is_row")))
    upto = W.partitionBy(key).orderBy(order, "is_row", tie).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(mark, F.last(mark, ignorenulls=True).over(upto)).filter("is_row = 1").drop("is_row")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, start, size): spans of sentences, a sentence ending with its mark and the white space after it."""
    parts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^.!?]+[.!?]*\\s*|[.!?]+\\s*"), 0)
    each = docs.select("doc_id", F.posexplode(parts).alias("nth", "part")).select("doc_id", "nth", F.length("part").alias("size"))
    upto = F.sum("size").over(W.partitionBy("doc_id").orderBy("nth"))
    return each.select("doc_id", "nth", (upto - F.col("size")).alias("start"), "size")


def contents(text_entries: DataFrame, image_entries: DataFrame) -> DataFrame:
    """Entries (doc_id, page, block, title) of both kinds, once each by page and title key, in reading order."""
    both = text_entries.withColumn("rank", F.lit(0)).unionByName(image_entries.withColumn("rank", F.lit(1)))
    nth = F.row_number().over(W.partitionBy("doc_id", "page", T.title_key(F.col("title"))).orderBy("rank", F.desc(F.length("title")), "title"))
    kept = both.withColumn("nth", nth).filter("nth = 1").drop("nth", "rank")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("page") * 100000 + F.col("block"), "title")))
