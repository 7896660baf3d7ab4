"""Where lines stand on a page: centred ones, notes beside the column, large first letters.

Lines are (doc_id, page_index, line_no, text, x, right_edge, font_size). Text rules are said once, as in drops.py, over t (the
trimmed line) and p (the one before), with numbers of the page beside them, and rendered for Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.drops import CHAPTER, DANGLING, DUCKDB, NUMBERS, ROMAN, SPARK, Dialect, contents_listing, letter_line, subtitle

# Fixed values, in points, shares of the column, characters and lines: centred lines.
SIDE, NEAR, NEAR_SHARE, NARROW, TWICE_CHARS = 20, 50, 0.12, 0.55, 80
# Notes beside the column, and what keeps a line from being one.
NOTE_CHARS, NOTE_WORDS, LONGER, LEFT, RIGHT, TOGETHER, REACH, HEADING_FONT, DISPLAY_FONT = 52, 9, 12, 16, 48, 2, 60, 16, 20
# Words that open a clause, go on with one, or begin a sentence.
JOINING = "and|but|or|then|who|which|that|as|if|like|for"
OPENING = "We|I|He|She|They|It|The|My|Our|His|Her|Their|This|That|There|When|As|But|And|Now|Then|So|Yet|For|In|On|At|By|A|An"
_PART = rf"(?i)^part(?:\s+(?:\d+|{ROMAN}+|one|two|three|four|five|six)\.?|\s*(?:i{{1,3}}|iv|v|vi{{0,3}}|ix|x)\s*:?)$"
_LABEL = rf"(?i)^(?:chapter|letter)\s+(?:\d{{1,3}}|{ROMAN}+|{NUMBERS})\.?$"
_ENDED = r"[.!?][\"'”]?\s*$"
_BEGUN = "^[a-z(“']"


def attribution(d: Dialect) -> str:
    """A name by itself, as after speech; nothing in capitals."""
    person = r"(?i)^(?:Mr\.|Mrs\.|Miss|Ms\.|Dr\.|Sir|Lady|Colonel|Captain|Professor)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?[.!?]?[“”\"']?\s*$"
    name = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?[.!?]?[“”\"']?\s*$"
    shouted = f"({d.count('t', '[A-Za-z]')} >= 4 AND {d.count('t', '[a-z]')} = 0)"
    return f"(length(t) <= 40 AND NOT {shouted} AND NOT {d.has('t', r'(?i)^(?:the|an?)\s+end\.?$')} AND ({d.has('t', person)} OR {d.has('t', name)}))"


def speech(d: Dialect) -> str:
    quoted = r"^['‘“][^'\"]{0,40}['’”]?\.?$"
    return f"(t <> '' AND length(t) <= 48 AND ({attribution(d)} OR {d.has('t', quoted)} OR {d.has('t', r'(?i)^[' + chr(39) + r'‘]?\s*(?:yes|no|ok|okay)\.?\s*[' + chr(39) + r'’]?\.?$')}))"


def capitals(d: Dialect, share: float, least: int) -> str:
    return f"({d.count('t', '[A-Za-z]')} >= {least} AND {d.count('t', '[A-Z]')} >= {share} * {d.count('t', '[A-Za-z]')})"


def title_in_capitals(d: Dialect) -> str:
    return (
        f"({d.count('t', '[A-Za-z]')} >= 3 AND {d.count('t', '[a-z]')} = 0 AND {d.count('t', r'\S+')} BETWEEN 1 AND 14 AND {d.count('t', ',')} < 2 "
        f"AND NOT {d.has('t', r'[.!?][”\"’' + chr(39) + r']?\s*$')} AND NOT {contents_listing(d)} AND NOT {d.has('t', rf'(?i)\b(?:{DANGLING})\s*$')})"
    )


def goes_on(d: Dialect) -> str:
    """A line of the paragraph whose line stands before it."""
    open_ = rf"(?i)\b(?:{DANGLING})\s*$|(?:^|[^'‘’ʼ`\w])if\s*$"
    return (
        f"(t <> '' AND p <> '' AND NOT {d.has('p', _ENDED)} AND ({d.has('t', _BEGUN)} OR {d.has('t', rf'(?i)^(?:{JOINING}|of|to|in|at|on|with|from|by|the|a|an|apples|out)\s')} OR {d.has('p', open_)} "
        f"OR ({capitals(d, 0.85, 8)} AND NOT {title_in_capitals(d)}) OR ({d.has('t', _ENDED)} AND {d.count('t', r'\S+')} <= 15)))"
    )


def callout(d: Dialect) -> str:
    """A whole sentence in capitals."""
    return f"(length(t) BETWEEN 20 AND 220 AND {capitals(d, 0.85, 16)} AND {d.has('t', r'[.!?:][”\"’' + chr(39) + r']?\s*$')})"


def fragment(d: Dialect) -> str:
    """Part of a sentence in prose."""
    words, letters = d.count("t", r"\S+"), d.count("t", "[A-Za-z]")
    unended = f"(NOT {d.has('t', r'[.!?:][”\"' + chr(39) + r']?\s*$')} AND NOT {subtitle(d)} AND NOT {d.has('t', r'^[“\"' + chr(39) + ']')} AND {words} BETWEEN 3 AND 14 AND {d.has('t', rf'(?i)^(?:{OPENING})\b')})"
    ended = f"({d.has('t', _ENDED)} AND {words} <= 20 AND ({letters} < 12 OR {d.count('t', '[A-Z]')} < 0.75 * {letters}))"
    return f"(t <> '' AND NOT {d.has('t', _PART)} AND ({d.has('t', _BEGUN)} OR {d.has('t', rf'(?i)^(?:{JOINING})\s')} OR {unended} OR {ended}))"


_NARROW = f"(hi > lo AND r > l AND r - l <= {NARROW} * (hi - lo))"
_MIDDLE = f"(abs((l + r) / 2.0 - (lo + hi) / 2.0) <= greatest({NEAR}, {NEAR_SHARE} * (hi - lo)))"
_EVEN = f"(l - lo >= {SIDE} AND hi - r >= {SIDE} AND abs((l - lo) - (hi - r)) <= greatest({NEAR}, {NEAR_SHARE} * (hi - lo)))"


def centre(d: Dialect = SPARK) -> str:
    """Whether a line is centred, from t, p, its edges l and r, those of the page lo and hi, and times, its copies there."""
    shown = f"(t <> '' AND length(t) <= {TWICE_CHARS} AND times >= 2)"
    return f"CASE WHEN {speech(d)} OR {goes_on(d)} THEN false WHEN {callout(d)} THEN {_NARROW} WHEN {fragment(d)} THEN false ELSE {_NARROW} AND ({_EVEN} OR {_MIDDLE} OR {shown}) END"


def placed(lines: DataFrame) -> DataFrame:
    """lines with t, p, l, r, lo, hi and times."""
    page = W.partitionBy("doc_id", "page_index")
    left = F.coalesce("x", F.lit(0.0))
    rows = lines.withColumns({"t": T.trimmed(F.coalesce("text", F.lit(""))), "l": left, "r": F.coalesce("right_edge", left)})
    before = F.coalesce(F.lag("t").over(page.orderBy("line_no")), F.lit(""))
    return rows.withColumns({"p": before, "lo": F.min("l").over(page), "hi": F.max("r").over(page), "times": F.count("*").over(W.partitionBy("doc_id", "page_index", "t"))})


def with_centred(lines: DataFrame) -> DataFrame:
    """lines with centred."""
    return placed(lines).withColumn("centred", F.expr(centre())).drop("t", "p", "l", "r", "lo", "hi", "times")


def note(d: Dialect = SPARK) -> str:
    """Why a line stays or goes as a note beside the column, from the columns of noted()."""
    words = d.count("t", r"\S+")
    capital_title = f"({d.count('t', '[A-Za-z]')} >= 3 AND {d.count('t', '[a-z]')} = 0 AND {words} <= 22 AND length(t) <= 120)"
    ornament = f"(length(t) BETWEEN 2 AND 5 AND {d.has('t', r'^[\x{E000}-\x{F8FF}]+$')} AND length(replace(t, left(t, 1), '')) = 0)"
    shown = f"({d.has('t', '^[A-Z][A-Za-z’' + chr(39) + '-]{2,}$')} AND {d.has('t', '[a-z]')} AND NOT {d.has('t', '(?i)^(?:and|or|but|the|a|an)$')} AND font >= {HEADING_FONT} AND font >= 1.2 * usual AND {_NARROW} AND {_MIDDLE})"
    spoken = f"({d.has('t', r'^[' + chr(39) + r'‘“\"]')} OR {d.has('t', r'[—–-]{2,}\s*[’\"' + chr(39) + r']?\s*$')} OR {d.has('t', r'^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\s*[—–-]{1,2}')})"
    aside_left, aside_right = f"coalesce(x, body) < flush - {LEFT}", f"coalesce(x, body) > body + {RIGHT}"
    cases = [
        (f"{d.has('p', _LABEL)} AND ({subtitle(d)} OR {capital_title})", "keep-chapter-subtitle-after-heading"), ("centred", "keep-centered"), (ornament, "keep-scene-break"),
        (f"{d.has('t', r'^[A-Z][A-Z' + chr(39) + r'-]{1,18}\.?$')} AND font >= {HEADING_FONT}", "keep-chapter-title-tail"), (f"{d.has('t', CHAPTER)} OR {d.has('t', _PART)}", "keep-structural-heading"), (letter_line(d), "keep-epistolary"),
        (f"{words} >= 2 AND font >= {HEADING_FONT}", "keep-large-font-short-line"), (shown, "keep-prominent-centered-title-word"), (f"length(t) > {NOTE_CHARS} OR {words} > {NOTE_WORDS}", "keep-not-short"),
        (f"inside AND {subtitle(d)}", "keep-substring-chapter-subtitle"), ("inside", "drop-substring-of-longer-line"), (f"NOT ({aside_left}) AND NOT ({aside_right})", "keep-body-column-aligned"), (spoken, "keep-dialogue-continuation"),
        (f"dropped_cap AND {aside_right}", "keep-drop-cap-continuation"), (aside_left, "drop-margin-callout-displaced-left"),
    ]
    return "CASE WHEN body IS NULL THEN 'keep-no-column' " + " ".join(f"WHEN {sql} THEN '{why}'" for sql, why in cases) + " ELSE 'drop-margin-callout-displaced-right' END"


def noted(lines: DataFrame) -> DataFrame:
    """lines that aren't empty, with verdict: drop- or keep- and why.

    The column of a page begins at the upper median of its lines that aren't centred; its flush edge is the leftmost cluster
    of two such lines or more near that. Numbers of a page are windows over it, so that a line is judged once and dealt once;
    its long lines, over 64 characters, come as an array, for short lines alone.
    """
    key = ["doc_id", "page_index"]
    page, order = W.partitionBy(*key), W.partitionBy(*key).orderBy("edge")
    rows = placed(lines).withColumn("centred", F.expr(centre())).filter("t <> ''").withColumn("font", F.coalesce("font_size", F.lit(0.0)))
    rows = rows.withColumn("edge", F.when(~F.col("centred") & F.col("x").isNotNull(), F.col("x").cast("double")))
    rows = rows.withColumn("new", F.when(F.col("edge") - F.lag("edge").over(order) <= TOGETHER, 0).otherwise(1)).withColumn("cluster", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    same = W.partitionBy(*key, "cluster")
    rows = rows.withColumns({"at": F.avg("edge").over(same), "n": F.count("edge").over(same)})
    small = F.when((F.col("font") > 0) & (F.col("font") <= HEADING_FONT + 2), F.col("font"))
    median = lambda c: F.get(F.sort_array(F.collect_list(c).over(page)), F.floor(F.count(c).over(page) / 2).cast("int"))
    rows = rows.withColumns(
        {
            "body": median(F.col("edge")), "usual": F.coalesce(median(F.when(F.col("font") > 0, F.col("font"))), F.lit(0.0)), "small": F.coalesce(median(small), F.lit(10.5)),
            "letter": F.max(F.when(F.col("t").rlike("^[A-Z]$"), F.col("font"))).over(page), "long": F.collect_list(F.when(F.length("t") > NOTE_CHARS + LONGER, F.col("t"))).over(page),
        }
    )
    near = F.when((F.col("n") >= 2) & F.col("at").between(F.col("body") - REACH, F.col("body") + TOGETHER), F.col("at"))
    held = rows.withColumn("flush", F.min(near).over(page)).withColumn("flush", F.least(F.coalesce("flush", "body"), "body"))
    inside = (F.length("t") <= NOTE_CHARS) & F.exists("long", lambda o: F.contains(o, F.col("t")))
    held = held.withColumn("inside", inside).withColumn("dropped_cap", F.coalesce(F.col("letter") >= 3 * F.col("small"), F.lit(False)))
    return held.withColumn("verdict", F.expr(note())).select(*lines.columns, "verdict")


#: The same in DuckDB, after lines g of these columns: v (doc_id, page_index, line_no, centred), then n with verdict.
CENTRED_SQL = (
    "q AS (SELECT *, trim(coalesce(text, '')) AS t, coalesce(x, 0.0) AS l, coalesce(right_edge, x, 0.0) AS r FROM g), "
    "w AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY doc_id, page_index ORDER BY line_no), '') AS p, min(l) OVER (PARTITION BY doc_id, page_index) AS lo, max(r) OVER (PARTITION BY doc_id, page_index) AS hi, "
    "count(*) OVER (PARTITION BY doc_id, page_index, t) AS times FROM q), "
    f"v AS (SELECT *, {centre(DUCKDB)} AS centred, coalesce(font_size, 0.0) AS font FROM w)"
)
NOTED_SQL = (
    ", e AS (SELECT * FROM v WHERE t <> ''), k AS (SELECT doc_id, page_index, list_sort(list(x) FILTER (NOT centred AND x IS NOT NULL)) AS xs, list_sort(list(font) FILTER (font > 0)) AS fs, "
    f"list_sort(list(font) FILTER (font > 0 AND font <= {HEADING_FONT + 2})) AS ss, max(font) FILTER (regexp_matches(t, '^[A-Z]$')) AS letter, list(t) FILTER (length(t) > {NOTE_CHARS + LONGER}) AS long FROM e GROUP BY ALL), "
    "m AS (SELECT doc_id, page_index, long, letter, xs[len(xs) // 2 + 1] AS body, coalesce(fs[len(fs) // 2 + 1], 0.0) AS usual, coalesce(ss[len(ss) // 2 + 1], 10.5) AS small FROM k), "
    f"c1 AS (SELECT doc_id, page_index, x AS edge, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page_index ORDER BY x) <= {TOGETHER} THEN 0 ELSE 1 END AS new FROM e WHERE NOT centred AND x IS NOT NULL), "
    "c2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index ORDER BY edge ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM c1), c3 AS (SELECT doc_id, page_index, cluster, avg(edge) AS spot FROM c2 GROUP BY ALL HAVING count(*) >= 2), "
    f"c4 AS (SELECT doc_id, page_index, min(spot) AS spot FROM c3 JOIN m USING (doc_id, page_index) WHERE spot BETWEEN body - {REACH} AND body + {TOGETHER} GROUP BY ALL), "
    "h AS (SELECT e.*, m.body, m.usual, least(coalesce(c4.spot, m.body), m.body) AS flush, len(list_filter(coalesce(m.long, []), lambda o: contains(o, e.t))) > 0 AS inside, coalesce(m.letter >= 3 * m.small, false) AS dropped_cap "
    "FROM e JOIN m USING (doc_id, page_index) LEFT JOIN c4 USING (doc_id, page_index)), "
    f"n AS (SELECT *, {note(DUCKDB)} AS verdict FROM h)"
)


def without_drop_caps(lines: DataFrame) -> DataFrame:
    """(doc_id, page_index, line_no, text, y, font_size, continued): a page's large first letters put before the lines they open.

    A letter three times the size of the text goes to the topmost line above it that begins small; one that stood alone goes
    as a line. Which line is free depends on the letters before, so each page is folded by itself, with Arrow batches.
    """
    import pandas as pd

    out = ["doc_id", "page_index", "line_no", "text", "y", "font_size", "continued"]

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "line_no"], ascending=[False, True]).reset_index(drop=True)
        page["text"], page["font_size"], page["continued"] = page["text"].fillna("").str.strip(), page["font_size"].fillna(0.0), False
        usual = sorted(page["font_size"][page["font_size"].between(9, 16)])
        size = usual[len(usual) // 2] if usual else 12.0
        alone = page["text"].str.fullmatch("[A-Z]")
        opened = page["text"].str.extract(r"^([A-Z])\s+(.{3,})$")
        gone = []
        for i in page.index[(page["font_size"] >= 3 * size) & (alone | opened[0].notna())]:
            letter = page.at[i, "text"][0]
            if alone[i]:
                gone.append(i)
            else:
                page.loc[i, ["text", "font_size"]] = [opened.at[i, 1], size]
            above = page.loc[: i - 1] if i else page.iloc[:0]
            free = above.index[(above["font_size"] < min(3 * size, DISPLAY_FONT)) & above["text"].str.match("[a-z]") & ~above.index.isin(gone)]
            if len(free):
                page.at[free[0], "text"] = letter + page.at[free[0], "text"]
                page.at[free[0], "continued"] = True
        return page.drop(index=gone)[out]

    return lines.groupBy("doc_id", "page_index").applyInPandas(fold, "doc_id long, page_index int, line_no int, text string, y double, font_size double, continued boolean")
