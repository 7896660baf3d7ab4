"""Lines: statistics over a book, reasons to drop, echoes on neighbouring pages, gaps, clusters and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.drops import explained

#: Pages on which a line makes it a running header.
RECURRING = 3


def recurring(lines: DataFrame, least: int = RECURRING) -> DataFrame:
    """(source, line, pages, first_page): lines that stand on at least so many pages of their book."""
    return lines.groupBy("source", "line").agg(F.countDistinct("doc_id").alias("pages"), F.min("doc_id").alias("first_page")).filter(F.col("pages") >= least)


def drops(lines: DataFrame) -> DataFrame:
    """The trace of dropped lines, with the lines around each on its page."""
    page = W.partitionBy("doc_id").orderBy("line_no")
    near = explained(lines).withColumn("prev", F.lag("line").over(page)).withColumn("next", F.lead("line").over(page))
    return near.filter(F.col("reason").startswith("drop-")).select("doc_id", "line_no", "reason", "line", "prev", "next")


def page_ranks(lines: DataFrame) -> DataFrame:
    """(source, doc_id, page): the place of each document in its book, counted without sorting a book in one task.

    Ids are cut into ranges of a fixed width; ids in a range are numbered in it, and ranges get the sum of those before.
    """
    ids = lines.select("source", "doc_id").distinct().withColumn("range", F.floor(F.col("doc_id") / 4096))
    sizes = ids.groupBy("source", "range").agg(F.count("*").alias("n"))
    base = sizes.select("source", "range", (F.sum("n").over(W.partitionBy("source").orderBy("range")) - F.col("n")).alias("base"))
    nth = F.row_number().over(W.partitionBy("source", "range").orderBy("doc_id"))
    return ids.withColumn("nth", nth).join(base, ["source", "range"]).select("source", "doc_id", (F.col("base") + F.col("nth")).alias("page"))


def echoes(pieces: DataFrame, low: int = 12, high: int = 96, longer: int = 8) -> DataFrame:
    """(source, doc_id, piece_no, piece): pieces that don't end a sentence and that a piece on the page before or after, longer
    by more than so many characters, contains.

    A piece meets each neighbouring page as one row with all its pieces. Whether the page's whole text has it comes first;
    only then its pieces are looked at one by one. With columns centred and heading, such pieces take no part.
    """
    ranks = page_ranks(pieces)
    placed = pieces.join(ranks, ["source", "doc_id"])
    whole = placed.groupBy("source", F.col("page").alias("near")).agg(F.collect_list("piece").alias("others"))
    whole = whole.withColumn("text", F.array_join("others", "\n"))
    short = placed.filter(F.length("piece").between(low, high) & ~F.col("piece").rlike("[.!?][”\"’']?\\s*$"))
    for flag in ("centred", "heading"):
        short = short.filter(~F.coalesce(F.col(flag), F.lit(False))) if flag in pieces.columns else short
    short = short.withColumn("near", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)))
    holds = F.exists("others", lambda o: (F.length(o) > F.length("piece") + longer) & F.contains(o, F.col("piece")))
    return short.join(whole, ["source", "near"]).filter(F.contains("text", "piece")).filter(holds).select("source", "doc_id", "piece_no", "piece").distinct()


def pieces(docs: DataFrame) -> DataFrame:
    """(source, doc_id, piece_no, piece): sentences of a document, cut after a full stop, mark or line end."""
    marked = F.regexp_replace("text", "([.!?])\\s+", "$1\n")
    return docs.select("source", "doc_id", F.posexplode(F.split(marked, "\n+")).alias("piece_no", "piece"))


def gaps(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, gap_above, gap_below): here the length differences to the lines around."""
    page, n = W.partitionBy("doc_id").orderBy("line_no"), F.length("line")
    return lines.select("doc_id", "line_no", (n - F.lag(n).over(page)).alias("gap_above"), (F.lead(n).over(page) - n).alias("gap_below"))


def median_lengths(lines: DataFrame) -> DataFrame:
    """(doc_id, n, median): the upper median of each page's line lengths."""
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), T.upper_median(F.collect_list(F.length("line"))).alias("median"))


def clusters(values: DataFrame, key: str, value: str, reach: float) -> DataFrame:
    """(key, cluster, members, lo, hi, mean): one-dimensional clusters, a gap beyond reach between two of them."""
    order = W.partitionBy(key).orderBy(value)
    marked = values.select(key, value).withColumn("new", F.when(F.col(value) - F.lag(value).over(order) <= reach, 0).otherwise(1))
    numbered = marked.withColumn("cluster", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "cluster").agg(F.count("*").alias("members"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def islands(rows: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """(key, first, last, length): runs of rows of a key, one after the other, whose flag holds."""
    number = F.row_number().over(W.partitionBy(key).orderBy(order))
    held = rows.withColumn("nth", number).filter(flag)
    run = held.withColumn("run", F.col("nth") - F.row_number().over(W.partitionBy(key).orderBy(order)))
    return run.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("run")


def items_to_lines(items: DataFrame, near: float = 3.0) -> DataFrame:
    """(doc_id, page_index, line_no, text, x, right_edge, y, font_size) from positioned items.

    Items join a line while their y is within near of the line's mean so far; this depends on what came before, so each
    page is folded by itself, with Arrow batches.
    """
    import pandas as pd

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        rows, held, total = [], [], 0.0
        for item in page[page["str"].str.strip() != ""].sort_values(["y", "x"], ascending=[False, True]).to_dict("records"):
            if held and abs(item["y"] - total / len(held)) > near:
                rows.append(held)
                held, total = [], 0.0
            held.append(item)
            total += item["y"]
        rows += [held] if held else []
        out = []
        for n, row in enumerate(rows):
            row.sort(key=lambda i: i["x"])
            text = " ".join(i["str"].strip() for i in row)
            out.append((row[0]["doc_id"], row[0]["page_index"], n, text, row[0]["x"], max(i["x"] + i["width"] for i in row), sum(i["y"] for i in row) / len(row), max(i["font_size"] for i in row)))
        return pd.DataFrame(out, columns=["doc_id", "page_index", "line_no", "text", "x", "right_edge", "y", "font_size"])

    schema = "doc_id long, page_index int, line_no int, text string, x double, right_edge double, y double, font_size double"
    return items.groupBy("doc_id", "page_index").applyInPandas(fold, schema)


def page_metrics(lines: DataFrame) -> DataFrame:
    """(doc_id, page_index, body_font, line_height, gap_threshold) from positioned lines."""
    page = W.partitionBy("doc_id", "page_index").orderBy(F.desc("y"))
    gap = F.lag("y").over(page) - F.col("y")
    seen = lines.withColumn("gap", gap)
    fonts = T.upper_median(F.collect_list(F.when(F.col("font_size").between(9, 16), F.col("font_size"))))
    small = T.upper_median(F.collect_list(F.when((F.col("gap") > 0) & (F.col("gap") < 20), F.col("gap"))))
    found = seen.groupBy("doc_id", "page_index").agg(fonts.alias("f"), small.alias("g"))
    font = F.when(F.col("f") == 0, F.lit(12.0)).otherwise(F.col("f"))
    height = F.when(F.col("g") == 0, font * 1.2).otherwise(F.col("g"))
    return found.select("doc_id", "page_index", font.alias("body_font"), height.alias("line_height"), (height * 1.25).alias("gap_threshold"))
