"""Chapters and printed contents: forward fill, dedupe, reading order, lookups, the contents' row machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

#: Fewest rows of printed contents that count.
ENTRIES = 5


def forward_fill(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """rows with the last value that isn't null so far."""
    upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(upto))


def detect(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, pos, text, is_heading) with chapter_id, chapter_title and is_chapter_start.

    Headings with a label open chapters; parts give a prefix to the chapters that follow. A label that was there before opens
    nothing, so later rows stay in the chapter they were in.
    """
    page = W.partitionBy("doc_id").orderBy("pos")
    label = F.when(F.col("is_heading"), T.chapter_label(F.col("text")))
    rows = blocks.withColumn("label", label).withColumn("part", F.when(F.col("label.kind") == "part", T.slug(F.col("text"))))
    rows = rows.withColumn("in_part", F.last("part", ignorenulls=True).over(page.rowsBetween(W.unboundedPreceding, 0)))
    own = F.when(F.col("label.kind") == "part", F.col("part")).otherwise(F.concat_ws("-", "in_part", T.slug(F.col("text"))))
    rows = rows.withColumn("id", F.when(F.col("label").isNotNull(), own))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "id").orderBy("pos")))
    starts = F.col("id").isNotNull() & (F.col("nth") == 1)
    rows = rows.withColumn("start_id", F.when(starts, F.col("id"))).withColumn("start_title", F.when(starts, F.col("text")))
    rows = forward_fill(forward_fill(rows, "doc_id", "pos", "start_id", "chapter_id"), "doc_id", "pos", "start_title", "chapter_title")
    return rows.select("doc_id", "pos", "text", "is_heading", "chapter_id", "chapter_title", F.col("start_id").isNotNull().alias("is_chapter_start"))


def arabic_numbering(blocks: DataFrame) -> DataFrame:
    """(doc_id, arabic, roman, established): whether chapter numbers are arabic: two at least, and more than roman ones."""
    style = T.numeral_style(F.col("text"))
    found = blocks.groupBy("doc_id").agg(F.sum(F.when(style == "arabic", 1).otherwise(0)).alias("arabic"), F.sum(F.when(style == "roman", 1).otherwise(0)).alias("roman"))
    return found.withColumn("established", (F.col("arabic") >= 2) & (F.col("arabic") > F.col("roman")))


def reading_order(entries: DataFrame) -> DataFrame:
    """entries (doc_id, page_index, block_index, seq) with their place in reading order; unknown pages come last."""
    order = W.partitionBy("doc_id").orderBy(F.coalesce("page_index", F.lit(2**31 - 1)), F.coalesce("block_index", F.lit(2**31 - 1)), "seq")
    return entries.withColumn("place", F.row_number().over(order))


def with_unseen(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first chapters, and those of the second with an id that the first has not."""
    return first.unionByName(second.join(first.select("doc_id", "id"), ["doc_id", "id"], "left_anti"))


def contents_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, key, title): lines shaped like rows of printed contents: label or title, dots, a page."""
    p = "^\\s*(?:(chapter|part)\\s+)?([0-9]{1,3}|[ivxlc]{1,4})?[.:)]?\\s*(.+?)\\s*(?:\\.{2,}|\\s{2,})\\s*([0-9]{1,4})$"
    c = F.lower("line")
    return lines.filter(c.rlike(p)).select(
        "doc_id", "line_no", F.when(F.regexp_extract(c, p, 1) == "part", "part").when(F.regexp_extract(c, p, 2) != "", "chapter").otherwise("section").alias("kind"),
        F.regexp_extract(c, p, 2).alias("key"), F.regexp_extract("line", "(?i)" + p, 3).alias("title"),
    )


def printed_contents(rows: DataFrame, least: int = ENTRIES) -> DataFrame:
    """(doc_id, pos, kind, key, title) of documents with enough contents rows."""
    enough = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("doc_id")
    pos = F.row_number().over(W.partitionBy("doc_id").orderBy("line_no"))
    return rows.join(enough, "doc_id").select("doc_id", pos.alias("pos"), "kind", "key", "title")


def ingest_contents(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, key, title): contents whose label and title may stand on two lines.

    A label alone waits for the next line's title; that is a small state per document, so each is folded in order.
    """
    import re

    import pandas as pd

    label = re.compile(r"^(chapter|part|interlude)\s+([0-9]{1,3}|[ivxlc]{1,4})[.:]?\s*(.*?)(?:[\s.]+(\d{1,4}))?$", re.I)

    def fold(doc: pd.DataFrame) -> pd.DataFrame:
        out, inside, pending = [], False, None
        for line in doc.sort_values("line_no")["line"]:
            text = line.strip()
            if re.fullmatch(r"(table of )?contents", text, re.I):
                inside = True
                continue
            if not inside or not text:
                continue
            found = label.match(text)
            if found:
                if found[3]:
                    out.append((found[1].lower(), found[2].lower(), found[3]))
                    pending = None
                else:
                    pending = (found[1].lower(), found[2].lower())
            elif pending:
                out.append((*pending, re.sub(r"[\s.]+\d{1,4}$", "", text)))
                pending = None
            elif len(text) > 120:
                inside = False
        doc_id = doc["doc_id"].iloc[0]
        return pd.DataFrame([(doc_id, i + 1, *row) for i, row in enumerate(out if len(out) >= ENTRIES else [])], columns=["doc_id", "pos", "kind", "key", "title"])

    return lines.groupBy("doc_id").applyInPandas(fold, "doc_id long, pos int, kind string, key string, title string")


def lookup(asked: DataFrame, contents: DataFrame) -> DataFrame:
    """asked (doc_id, kind, key, nth) with the title by kind and key, or else that of the nth entry of the kind."""
    exact = contents.groupBy("doc_id", "kind", "key").agg(F.max_by("title", "pos").alias("by_key"))
    nth = F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("pos"))
    place = contents.select("doc_id", "kind", nth.alias("nth"), F.col("title").alias("by_place"))
    return asked.join(exact, ["doc_id", "kind", "key"], "left").join(place, ["doc_id", "kind", "nth"], "left").withColumn("title", F.coalesce("by_key", "by_place")).drop("by_key", "by_place")


def page_ranges(starts: DataFrame, key: str, order: str, page: str) -> DataFrame:
    """(key, chapter, lo, hi, ok): pages from each start to before the next, and whether starts never go back."""
    w = W.partitionBy(key).orderBy(order)
    return starts.select(key, F.col(order).alias("chapter"), F.col(page).alias("lo"), (F.lead(page).over(w) - 1).alias("hi"), F.coalesce(F.col(page) >= F.lag(page).over(w), F.lit(True)).alias("ok"))
