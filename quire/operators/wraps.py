"""Ends of paragraphs among dropped lines: short last lines that the line rules took for something else.

Rules are said once over columns t (the line), p (the line before it) and reason, and rendered for Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.drops import SPARK, Dialect

# Reasons that never cost a paragraph its end, the most characters and words of such an end.
NEVER = (
    "standalone-page-number", "standalone-page-number-normalized", "standalone-roman-page-marker", "roman-page-marker-cluster", "standalone-running-head", "header-page-marker", "toc-listing", "toc-header",
    "running-header-merged", "story-section-running-head", "scanner-watermark", "production-slug", "chapter-placeholder", "letter-spaced-artifact", "spaced-running-header", "roman-section-running-head",
    "collapsed-running-header", "glossary-sidebar", "url", "www", "repeated-section-label-same-page", "repeated-section-label-other-page", "scene-break-not-centered", "empty",
)
CHARS, WORDS, BEFORE = 52, 9, 20


def folded(c: Column) -> Column:
    """Straight quotes and single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "“”‘’", "\"\"''"), r"\s+", " "))


def folded_sql(x: str) -> str:
    """The same in DuckDB."""
    return f"trim(regexp_replace(translate(coalesce({x}, ''), '“”‘’', '\"\"'''''), '\\s+', ' ', 'g'))"


def wrap(d: Dialect = SPARK) -> str:
    """Whether t, folded, looks like the end of the paragraph of p, folded."""
    ended = lambda x: d.has(x, r"[.!?][\"')]*$")
    words, small = d.count("t", r"\S+"), d.has("t", "^[a-z(]")
    never = ", ".join(f"'{r}'" for r in NEVER)
    alone = f"{small} AND {ended('t')} AND {words} >= 2"
    behind = f"NOT {ended('p')} AND {d.has('p', '[a-z]')} AND length(p) >= {BEFORE} AND ({small} OR {ended('t')})"
    short = f"length(t) <= {CHARS} AND {words} <= {WORDS} AND NOT {d.has('t', r'(?i)^https?://|^www\.|ebook no|gutenberg')}"
    return f"(t <> '' AND reason NOT IN ({never}) AND {short} AND CASE WHEN p = '' THEN {alone} ELSE {behind} END)"


#: What became of a dropped line, from t, p, wrap and hay, the folded text that was kept.
FATE = (
    "CASE WHEN length(t) >= 2 AND contains(hay, CASE WHEN p <> '' THEN p || ' ' || t ELSE t END) THEN 'relocated-or-merged' "
    "WHEN length(t) < 2 OR NOT contains(hay, t) THEN CASE WHEN wrap THEN 'wrap-tail-deleted' ELSE 'absent-not-wrap' END "
    "WHEN wrap THEN 'wrap-tail-token-elsewhere' ELSE 'echo-or-duplicate-token' END"
)


def judged(rows: DataFrame) -> DataFrame:
    """rows (text, prev, hay), hay folded, with wrap and fate instead of hay."""
    rows = rows.withColumns({"t": folded(F.col("text")), "p": folded(F.col("prev"))})
    return rows.withColumn("wrap", F.expr(wrap())).withColumn("fate", F.expr(FATE)).drop("t", "p", "hay")


def fates(drops: DataFrame, kept: DataFrame) -> DataFrame:
    """drops (doc_id, stage, reason, text, prev) with wrap and fate, held against kept (doc_id, text), one row a document."""
    hay = kept.select("doc_id", folded(F.col("text")).alias("hay"))
    return judged(drops.join(hay, "doc_id", "left").fillna("", ["hay"]))


def line_fates(found: DataFrame) -> DataFrame:
    """fates() of the lines that go, against those that stay, from found (doc_id, line_no, line, reason).

    The lines of a document meet as one array, so the reason of each is worked out once. Without an id nothing is held
    against, as a join on it would have it.
    """
    gone = lambda x: x["reason"].startswith("drop-")
    docs = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "reason"))).alias("all"))
    each = F.transform("all", lambda x, i: F.struct(x["line_no"].alias("line_no"), x["line"].alias("text"), F.get("all", i - 1)["line"].alias("prev"), x["reason"].alias("reason")))
    text = F.array_join(F.transform(F.filter("all", lambda x: ~gone(x)), lambda x: x["line"]), "\n")
    rows = docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), folded(text)).otherwise("").alias("hay"), F.filter(each, gone).alias("gone")).select("doc_id", "hay", F.inline("gone"))
    return judged(rows.withColumns({"stage": F.lit("lines"), "reason": F.substr("reason", F.lit(6))}))


def mechanisms(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, stage, reason, n): how many ends of paragraphs each rule cost."""
    lost = found.filter(F.col("wrap") & F.col("fate").isin("wrap-tail-deleted", "wrap-tail-token-elsewhere"))
    return lost.groupBy(*keys, "stage", "reason").agg(F.count("*").alias("n"))


def against_baseline(counts: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """(key, n, known, verdict) for every key of either side: worse than the count known, better, same, or unmeasured."""
    now = counts.groupBy(key).agg(F.sum("n").alias("n"))
    both = now.join(baseline.select(key, F.col("n").alias("known")), key, "full").fillna(0, ["n"])
    verdict = F.when(F.col("known").isNull(), "unmeasured").when(F.col("n") > F.col("known"), "worse").when(F.col("n") < F.col("known"), "better").otherwise("same")
    return both.select(key, "n", "known", verdict.alias("verdict"))
