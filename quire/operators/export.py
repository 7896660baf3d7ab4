"""Export: documents as HTML and as plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def block_html(text: Column, is_heading: Column, font: Column, centred: Column, after_heading: Column) -> Column:
    """A block as HTML: h1 for headings in a font of 18 or more, else h2; centred, first and other paragraphs."""
    safe = T.html_text(text)
    wrap = lambda tag, kind: F.concat(F.lit(f"<{tag}{kind}>"), safe, F.lit(f"</{tag}>"))
    return (
        F.when(is_heading & (font >= 18), wrap("h1", "")).when(is_heading, wrap("h2", "")).when(centred, wrap("p", ' class="center"'))
        .when(after_heading, wrap("p", ' class="first"')).otherwise(wrap("p", ' class="body"'))
    )


def conversations_html(turns: DataFrame) -> DataFrame:
    """(conv_id, html): each conversation as paragraphs in order."""
    line = F.concat(F.lit('<p class="'), T.html_attribute(F.col("role")), F.lit('">'), T.html_text(F.coalesce("text", F.lit(""))), F.lit("</p>"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("html")))), lambda x: x["html"])
    return turns.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("html"))


def runs_html(runs: Column) -> Column:
    """array<struct<text,bold,italic>> as HTML."""
    one = lambda r: F.when(r["bold"], F.concat(F.lit("<strong>"), T.html_text(r["text"]), F.lit("</strong>"))).when(r["italic"], F.concat(F.lit("<em>"), T.html_text(r["text"]), F.lit("</em>"))).otherwise(T.html_text(r["text"]))
    return F.array_join(F.transform(runs, one), "")


def save(pages: DataFrame, path: str) -> None:
    """A table of (id, html), in as many files as it has partitions."""
    pages.write.mode("overwrite").parquet(path)
