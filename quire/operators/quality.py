"""Checks of a structured book: each is a query that returns what is wrong or how much."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.drops import LABELS, NUMBERS, SECTIONS


def density(rows: DataFrame, key: str, order: str, flag: str, width: int = 20, most: int = 3) -> DataFrame:
    """(key, order, n): windows of so many rows with more flagged ones than allowed."""
    frame = W.partitionBy(key).orderBy(order).rowsBetween(0, width - 1)
    return rows.withColumn("n", F.sum(F.when(F.expr(flag), 1).otherwise(0)).over(frame)).filter(F.col("n") > most).select(key, order, "n")


def continuity(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no): lines that begin small after one that does not end a sentence."""
    before = F.lag("line").over(W.partitionBy("doc_id").orderBy("line_no"))
    return lines.withColumn("before", before).filter(F.col("before").isNotNull() & ~F.col("before").rlike("[.!?]$") & F.col("line").rlike("^[a-z]")).select("doc_id", "line_no")


def orphans(lines: DataFrame, most: int = 55) -> DataFrame:
    """(doc_id, line_no, line): short lines without a full stop."""
    return lines.filter((F.length("line") > 0) & (F.length("line") <= most) & ~F.col("line").rlike("[.!?]$")).select("doc_id", "line_no", "line")


def watermarks(lines: DataFrame) -> DataFrame:
    """(doc_id, n): lines with web or mail addresses."""
    return lines.filter(F.lower("line").rlike("https?://|www\\.|@[a-z0-9-]+\\.")).groupBy("doc_id").agg(F.count("*").alias("n"))


# Words that leave a heading or sentence open, ends of a sentence, opening quotes.
DANGLING = "of|the|a|an|and|but|or|nor|for|yet|so|left|fell|was|be|in|to|with|from|at|by|on|as|into|upon|about|over|after|before|through"
PRONOUNS = "he|she|it|they|his|her|its|their|who|which"
ENDED, QUOTED, OPEN = r"[.!?][”\"’']?\s*$", r"^[“‘\"']", r"[,;:—–…-]\s*$"
_NUMBER = f"(?:\\d{{1,3}}|[ivxlcdm]+|{NUMBERS})"
STRUCTURAL = rf"(?i)^(?:(?:{SECTIONS})\s+{_NUMBER}(?:\.?\s*$|\s*[-—–]\s+\S)|(?:{LABELS}|dedication|contents)\.?$)"


def false_headings(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, pos, text, is_heading) whose heading can't be one: it breaks off, begins or goes on a sentence, or is
    too long. Structural labels and lines of credit are none of these."""
    rows = blocks.filter("is_heading").withColumn("t", T.trimmed(F.coalesce("text", F.lit("")))).filter("t <> ''")
    t, words = F.col("t"), F.size(F.split("t", r"\s+"))
    bare = F.filter(F.transform(F.split("t", r"\s+"), lambda w: F.regexp_replace(w, "[^A-Za-z]", "")), lambda w: F.length(w) > 0)
    titled = F.forall(bare, lambda w: w.rlike("^[A-Z]"))
    fine = t.rlike(STRUCTURAL) | t.rlike(r"(?i)^To\s+.+\s+And$") | t.rlike(r"^by\s+[A-Z]")
    broken = (t.rlike(OPEN) | t.rlike(rf"(?i)\b(?:{DANGLING})\s*$")) & ~(titled & (words == 1))
    begun = t.rlike("^[a-z]") & ~t.rlike(ENDED) & ~t.rlike(r"[”\"’']\s*$")
    goes_on = t.rlike(rf"(?i)^(?:{PRONOUNS})\b") & ~titled
    return rows.filter(~fine & (broken | begun | (F.length("t") > 120) | goes_on)).select("doc_id", "pos", "text")


def chapter_faults(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, pos, fault) from chapters (doc_id, pos, title) and pages (doc_id, pages): none, empty, short, long, sentence
    or repeated titles; a book of over 50 pages without a chapter has a row without pos."""
    t = F.col("t")
    rows = chapters.withColumn("t", T.trimmed(F.coalesce("title", F.lit(""))))
    roman = t.rlike(r"(?i)^(?:Part\s+)?[IVXLCDM]{1,6}\.?$")
    fine = roman | t.rlike(rf"(?i)^chapter\s+{_NUMBER}(?:\.?$|\s*[-—–]\s+\S)") | t.rlike(r"(?i)—\s*Chapter\s+\d+\.?\s*$") | t.rlike(r"^(?:VOLUME|Volume|BOOK|Book|PART|Part)\b")
    short_form = t.rlike(r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|St|Jr|Sr|Prof)\.|\b[A-Z]\.)\s*$")
    n = F.length("t")
    fault = F.when(n == 0, "empty").when((n < 2) & ~roman, "short").when((n > 400) | ((n > 150) & ~fine), "long").when(t.rlike(r"\.\s*$") & ~fine & ~short_form, "sentence")
    named = rows.select("doc_id", "pos", fault.alias("fault")).filter("fault IS NOT NULL")
    again = rows.withColumn("before", F.lag("t").over(W.partitionBy("doc_id").orderBy("pos"))).filter("t <> '' AND t = before").select("doc_id", "pos", F.lit("repeated").alias("fault"))
    none = pages.filter("pages > 50").join(chapters, "doc_id", "left_anti").select("doc_id", F.lit(None).cast(chapters.schema["pos"].dataType).alias("pos"), F.lit("none").alias("fault"))
    return named.unionByName(again).unionByName(none)


def split_dialogue(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, pos, text, is_heading) of short speech that stand apart from prose which does not end before them."""
    before = W.partitionBy("doc_id").orderBy("pos")
    rows = blocks.withColumn("t", T.trimmed(F.coalesce("text", F.lit("")))).withColumn("b", F.lag("t").over(before)).withColumn("head", F.lag("is_heading").over(before))
    t, b = F.col("t"), F.col("b")
    open_ = (b != "") & ~F.coalesce("head", F.lit(False)) & ~b.rlike(QUOTED) & ~b.rlike(ENDED) & ~b.rlike(r"[,;:—–-]\s*$")
    return rows.filter(t.rlike(QUOTED) & (F.length("t") < 80) & open_).select("doc_id", "pos", "text")


def word_ratio(parsed: DataFrame, raw: DataFrame, least: float = 0.9) -> DataFrame:
    """(doc_id, ratio, ok): words that parsing kept."""
    a, b = (d.select("doc_id", T.word_count(F.col("text")).alias(n)) for d, n in ((parsed, "a"), (raw, "b")))
    ratio = F.round(F.col("a") / F.greatest(F.col("b"), F.lit(1)), 6)
    return a.join(b, "doc_id").select("doc_id", ratio.alias("ratio"), (ratio >= least).alias("ok"))


def needle(words: str) -> str:
    """A pattern for a text with any case and any white space between its words."""
    return r"(?i)" + r"\s+".join("\\Q" + w.replace("\\E", "") + "\\E" for w in words.split())


def body(c, start: str, end: str, stop: str | None = None):
    """struct(text, fault): a text from one anchor on, past another, and up to a third if that is there; fault is start or end
    where that anchor is missing."""
    c, (first, last) = F.coalesce(c, F.lit("")), (needle(start), needle(end))
    rest = F.substr(c, F.regexp_instr(c, F.lit(first)))
    past = F.regexp_instr(rest, F.lit(last)) + F.length(F.regexp_extract(rest, last, 0))
    cut = F.regexp_instr(F.substr(rest, past), F.lit(needle(stop))) if stop else F.lit(0)
    window = F.when(cut > 0, F.left(rest, past + cut - 2)).otherwise(rest)
    fault = F.when(~c.rlike(first), "start").when(~rest.rlike(last), "end")
    return F.struct(F.when(fault.isNull(), window).otherwise("").alias("text"), fault.alias("fault"))


def book_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, changes) of books in either of two profiles (doc_id, words, headings, chapters, titles, first, last): removed,
    added, or what changed by more than it may: words by 2 %, headings by 10 %, the rest at all."""
    held = ("words", "headings", "chapters", "titles", "first", "last")
    both = old.select("doc_id", F.struct(*held).alias("a")).join(new.select("doc_id", F.struct(*held).alias("b")), "doc_id", "full")
    a, b = (lambda n, s=s: F.col(f"{s}.{n}") for s in "ab")
    off = lambda n, share: F.when(a(n) > 0, F.abs(b(n) - a(n)) / a(n) > share)
    differs = {"words": F.coalesce(off("words", 0.02), F.lit(False)), "headings": F.coalesce(off("headings", 0.1), ~a("headings").eqNullSafe(b("headings")))}
    each = [F.when(differs.get(n, ~a(n).eqNullSafe(b(n))), n) for n in held]
    changes = F.when(F.col("b").isNull(), F.array(F.lit("removed"))).when(F.col("a").isNull(), F.array(F.lit("added"))).otherwise(F.array_compact(F.array(*each)))
    return both.select("doc_id", changes.alias("changes"))


def page_in_provenance(blocks: DataFrame) -> DataFrame:
    """blocks (page, provenance) with ok, merge, or exempt where there is no provenance."""
    return blocks.withColumn("verdict", F.when(F.size("provenance") == 0, "exempt").when(F.array_contains("provenance", F.col("page")), "ok").otherwise("merge"))


def contiguous(numbers: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ok): whether the numbers of a key are 1 to their count, each there."""
    found = numbers.groupBy(key).agg(F.countDistinct(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return found.select(key, ((F.col("lo") == 1) & (F.col("hi") == F.col("n"))).alias("ok"))


def sampled(rows: DataFrame, key, n: int, seed: int = 1) -> DataFrame:
    """n rows by a seeded hash of their key: the same rows in every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def profile(lines: DataFrame) -> DataFrame:
    """(doc_id, blocks, first, last, print): what a snapshot keeps of a document."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    made = lines.groupBy("doc_id").agg(F.count("*").cast("long").alias("blocks"), texts.alias("t"))
    return made.select("doc_id", "blocks", F.left(F.element_at("t", 1), F.lit(40)).alias("first"), F.left(F.element_at("t", -1), F.lit(40)).alias("last"), F.left(F.sha2(F.array_join("t", "\n"), 256), F.lit(12)).alias("print"))


def profile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, verdict): added, removed, changed or same."""
    a, b = old.select("doc_id", F.col("print").alias("a")), new.select("doc_id", F.col("print").alias("b"))
    verdict = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "doc_id", "full").select("doc_id", verdict.alias("verdict"))


def alike_titles(titles: DataFrame) -> DataFrame:
    """(a, b), a < b: different titles that T.fuzzy_title() takes for one, both with a key of nine characters or more.

    Such a pair differs in at most d places, where d grows with the length up to four. So of d + 1 parts of one key one is as
    it was in the other, moved by d places at most, and the lengths differ by no more: keys meet by the length of one, the
    number of a part, and its text. Parts are as long as d allows, which keeps the rows for a part few. No pair is lost.
    """
    rows = titles.select("title", T.title_key(F.col("title")).alias("key")).distinct().withColumn("n", F.length("key")).filter("n >= 9")
    most = F.least(F.lit(4), F.floor(0.12 * (F.col("m") + 4) + 1e-9)).cast("int")  # the other key has up to m + 4 characters
    part = F.explode(F.sequence(F.lit(0), F.col("d"))).alias("i")
    lo, hi = (F.floor(F.col("m") * (F.col("i") + k) / (F.col("d") + 1)).cast("int") for k in (0, 1))
    left = rows.select("title", F.col("n").alias("m"), "key").withColumn("d", most).select("title", "m", "key", "d", part).select(F.col("title").alias("a"), "m", "i", F.substr("key", lo + 1, hi - lo).alias("text"))
    spots = rows.select("title", "key", "n", F.explode(F.sequence(F.col("n") - 4, F.col("n") + 4)).alias("m")).filter("m >= 9").withColumn("d", most).filter(F.abs(F.col("n") - F.col("m")) <= F.col("d"))
    spots = spots.select("title", "key", "m", "d", part).select("title", "key", "m", "i", "d", F.explode(F.sequence(-F.col("d"), F.col("d"))).alias("by"))
    right = spots.filter(lo + F.col("by") >= 0).select(F.col("title").alias("b"), "m", "i", F.substr("key", lo + F.col("by") + 1, hi - lo).alias("text"))
    return left.join(right, ["m", "i", "text"]).filter("a < b").select("a", "b").distinct().filter(T.fuzzy_title(F.col("a"), F.col("b")))
