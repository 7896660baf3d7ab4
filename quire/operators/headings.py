"""Headings of blocks: titles gathered from what follows a label, parts promoted, blocks of an export merged.

Blocks are (doc_id, pos, text, is_heading). Rules over t, the trimmed text, are said once and rendered for Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.drops import CHAPTER, NUMBERS, ROMAN, SPARK, Dialect, letter_spaced, subtitle, watermark

# A chapter's label before its title, size of its type, reach of a plate, how long a title in capitals or a sentence is.
POINTED, DASHED = rf"(?i)^(chapter|letter)\s+([ivxlcdm\d]+)\.\s+(.+)$", rf"(?i)^(chapter|letter)\s+(\S+)\s*-\s*(.*)$"
SUBTITLED = rf"(?i)^(?:chapter|letter)\s+(?:\d{{1,3}}|{ROMAN}+|{NUMBERS})\s*-\s+\S"
BARE = rf"(?i)^(?:chapter|letter)\s+(?:\d{{1,3}}|{ROMAN}+|{NUMBERS})\.?\s*$"
PART = rf"(?i)^part\s+(\d+|{ROMAN}+|one|two|three|four|five|six)\.?$"
SIZE, PLATE, CAPITAL_WORDS, CAPITAL_CHARS = 15, 23, 22, 120


def narrative(d: Dialect) -> str:
    """A sentence rather than a title."""
    words, marks = d.count("t", r"\S+"), d.count("t", "[.!?]")
    return f"({words} >= 4 AND {d.has('t', r'[.!?][”\"’' + chr(39) + r']?\s*$')} AND NOT {d.has('t', CHAPTER)} AND ({marks} < 2 OR ({words} >= 6 AND {d.has('t', '[a-z]')})))"


def shown(d: Dialect) -> str:
    """A title by its form: few words, not a label nor a sentence; a few small ones also count."""
    words, small = d.count("t", r"\S+"), d.has("t", "^[a-z]")
    none = f"{d.has('t', SUBTITLED)} OR {d.has('t', BARE)} OR {watermark(d)} OR {letter_spaced(d)} OR {narrative(d)} OR ({words} >= 5 AND {d.has('t', '[.!?]')})"
    return f"({words} BETWEEN 1 AND 8 AND length(t) <= 90 AND NOT ({none}) AND CASE WHEN {small} THEN {words} <= 6 AND length(t) <= 48 ELSE {subtitle(d)} END)"


def tail(d: Dialect = SPARK) -> str:
    """A block that goes on with the title before it: shown(), or in capitals; from t and is_heading."""
    letters = d.count("t", "[A-Za-z]")
    loud = f"({letters} >= 3 AND {d.count('t', '[a-z]')} = 0 AND length(t) <= {CAPITAL_CHARS} AND NOT {d.has('t', SUBTITLED)} AND NOT {d.has('t', BARE)})"
    titled = f"({loud} AND {d.count('t', r'\S+')} <= {CAPITAL_WORDS} AND NOT {d.has('t', CHAPTER)} AND NOT {watermark(d)})"
    return f"(t <> '' AND ({titled} OR {shown(d)} OR (coalesce(is_heading, false) AND {loud} AND {letters} >= 4 AND NOT {narrative(d)})))"


def gathered(blocks: DataFrame, pattern: str = POINTED) -> DataFrame:
    """blocks (doc_id, pos, text, is_heading) with is_chapter_start, where a heading 'Chapter 5. The Fox' (or, with DASHED,
    'Chapter 5 - The Fox') and the titles right after it are one heading 'Chapter 5 - The Fox and ...'.

    Every block that is no such title, and every such heading, begins a run; a run whose first block is such a heading is
    joined, the blocks of others stay as they are. A heading with nothing behind it is only put into form by POINTED.
    """
    order = W.partitionBy("doc_id").orderBy("pos")
    rows = blocks.withColumn("t", T.trimmed(F.coalesce("text", F.lit("")))).withColumn("opens", F.coalesce("is_heading", F.lit(False)) & F.col("t").rlike(pattern))
    rows = rows.withColumn("first", F.col("opens") | ~F.expr(tail())).withColumn("run", F.sum(F.col("first").cast("int")).over(order))
    rows = rows.withColumn("joins", F.max(F.col("opens").cast("int")).over(W.partitionBy("doc_id", "run")) == 1).withColumn("alone", F.when(~F.col("joins"), F.col("pos")))
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"])  # rows that aren't joined are groups of one
    kept = rows.groupBy("doc_id", "run", "alone").agg(F.min_by("text", "pos").alias("text"), F.min_by("is_heading", "pos").alias("is_heading"), said.alias("said"), F.min("pos").alias("pos"), F.max("opens").alias("opens"))
    kept = kept.withColumn("t", F.col("said")[0])
    rest = F.slice("said", 2, F.greatest(F.size("said") - 1, F.lit(0)))
    whole = T.squeezed(F.concat_ws(" ", F.regexp_extract("t", pattern, 3), F.array_join(rest, " ")))
    loud = (F.length(F.regexp_replace(whole, "[^A-Za-z]", "")) >= 4) & ~whole.rlike("[a-z]")
    title = F.regexp_replace(F.when(loud, T.book_cased(F.lower(whole))).otherwise(whole), r"\.+\s*$", "")
    label = F.concat(F.initcap(F.lower(F.regexp_extract("t", pattern, 1))), F.lit(" "), F.regexp_extract("t", pattern, 2), F.lit(" - "), title)
    changes = F.col("opens") & ((F.size(rest) > 0) | F.lit(pattern == POINTED))
    return kept.select("doc_id", "pos", F.when(changes, label).otherwise(F.col("text")).alias("text"), "is_heading", changes.alias("is_chapter_start"))


def promoted(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, pos, text, is_heading, is_chapter_start, font_size) where a part's label by itself is a heading that
    opens a chapter, and headings that do have the size of chapters."""
    t = T.squeezed(F.coalesce("text", F.lit("")))
    part, word = t.rlike(PART), F.regexp_extract(t, PART, 1)
    spelled = word.rlike("(?i)^(one|two|three|four|five|six)$")
    prefix, cased = F.when(t.startswith("PART"), "PART ").otherwise("Part "), F.when(word.rlike("^[A-Z]+$"), word).otherwise(F.initcap(F.lower(word)))
    label = F.when(spelled, F.concat(prefix, cased)).otherwise(F.concat(F.lit("Part "), F.upper(word)))
    opens = part | F.coalesce("is_chapter_start", F.lit(False))
    heading = part | F.coalesce("is_heading", F.lit(False))
    size = F.when(heading & opens, F.lit(float(SIZE))).otherwise(F.col("font_size"))
    return blocks.select("doc_id", "pos", F.when(part, label).otherwise(F.col("text")).alias("text"), heading.alias("is_heading"), opens.alias("is_chapter_start"), size.alias("font_size"))


def before_plates(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos): labels of parts in blocks (doc_id, pos, text, plate) that a plate of a part or of interludes, within the
    next 23 blocks, says again; plate is the kind of boundary of an image, else null."""
    reach = W.partitionBy("doc_id").orderBy("pos").rowsBetween(1, PLATE)
    again = F.max(F.col("plate").isin("part", "interlude_divider").cast("int")).over(reach)
    return blocks.withColumn("again", again).filter(T.trimmed(F.col("text")).rlike(PART) & (F.col("again") == 1)).select("doc_id", "pos")


def with_headings(blocks: DataFrame) -> DataFrame:
    """(doc_id, chapters, any): chapter headings of each document."""
    heading = T.chapter_label(F.col("text")).isNotNull() | T.trimmed(F.col("text")).rlike(r"(?i)^(?:prologue|epilogue):\s+\S") | T.trimmed(F.col("text")).rlike(CHAPTER)
    n = F.sum(F.when(F.coalesce(heading, F.lit(False)), 1).otherwise(0))
    return blocks.groupBy("doc_id").agg(n.alias("chapters"), (n > 0).alias("any"))


def exported(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, is_image, text) of blocks (doc_id, pos, text, is_image, is_continuation): empty texts go, and a text that
    goes on with the text before it, no image between, is joined to it."""
    order = W.partitionBy("doc_id").orderBy("pos")
    rows = blocks.withColumns({"is_image": F.coalesce("is_image", F.lit(False)), "text": T.trimmed(F.coalesce("text", F.lit("")))}).filter("is_image OR text <> ''")
    joins = ~F.col("is_image") & F.coalesce("is_continuation", F.lit(False)) & (F.lag("is_image").over(order) == F.lit(False))
    runs = rows.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(order))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return runs.groupBy("doc_id", "run").agg(F.min("pos").alias("pos"), F.first("is_image").alias("is_image"), F.array_join(parts, " ").alias("text")).drop("run")


def marked(text: Column, find: str) -> Column:
    """array<struct<text,hit>>: a text cut around each occurrence of another, without regard to case; one piece without any."""
    find = find.strip()
    text = F.coalesce(text, F.lit(""))
    if not find:
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("hit")))
    pattern = "(?i)\\Q" + find.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    cut = F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x01"), "\x01")
    return F.filter(F.transform(cut, lambda t, i: F.struct(t.alias("text"), (i % 2 == 1).alias("hit"))), lambda p: p["text"] != "")


def plate_title(kind: Column, number: Column, title: Column, raw: Column) -> Column:
    """What the contents call an image that bounds a chapter, by its kind, number and title."""
    number, title, raw = (T.trimmed(F.coalesce(c, F.lit(""))) for c in (number, title, raw))
    either = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    both, pair = (number != "") & (title != ""), F.concat_ws(": ", number, title)
    apart = ~F.contains(F.lower(number), F.lower(title)) & ~F.contains(F.lower(title), F.lower(number))
    read = F.when(raw.rlike(r"(?i)^Chapter\s+\d{1,3}(?::\s+[A-Za-z][A-Za-z\s'\-]{3,})?$"), raw)
    return (
        F.when(kind.isin("prelude", "prologue", "epilogue"), F.when(both, pair).otherwise(either(title, number, F.initcap(kind))))
        .when(kind == "interlude_divider", either(number, title, F.lit("Interludes"))).when(kind.isin("part", "interlude"), F.when(both, pair).otherwise(either(number, title, F.initcap(kind))))
        .when(kind == "flashback", either(title, number, F.lit("Flashback"))).when(both, F.when(apart, pair).otherwise(number)).otherwise(F.coalesce(either(title, number), read, F.lit("Chapter")))
    )


def plate_entries(images: DataFrame) -> DataFrame:
    """(doc_id, page, block, title): contents entries of images (doc_id, page, block, kind, number, title, raw, include); those
    excluded, or known by nothing but being a chapter, have none."""
    named = images.withColumn("title", plate_title(*map(F.col, ("kind", "number", "title", "raw"))))
    return named.filter(F.coalesce("include", F.lit(True)) & (F.col("title") != "Chapter")).select("doc_id", "page", "block", "title")
