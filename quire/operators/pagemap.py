"""Pages of the reader: which page a chapter is on, titles in the margin, places kept when pages change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

# Labels of volumes and parts, characters that make a title worth finding in another, of a place's text, of a page too short to stand alone.
PART = r"(?i)\b(volume|part|book)\s+(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|\d+|[ivxlcdm]+)\b"
WITHIN, PREFIX, SHORT_LIST, SHORT_PAGE = 16, 40, 30, 50
LONE = "(?i)^(and|or|but|the|a|an)$"


def part_key(c: Column) -> Column:
    """'part ii' of a title; null without such a label."""
    return F.when(c.rlike(PART), F.lower(F.concat_ws(" ", F.regexp_extract(c, PART, 1), F.regexp_extract(c, PART, 2))))


def chapter_key(c: Column) -> Column:
    """The number, arabic or roman, that follows the word chapter; null without one."""
    digits, roman = r"(?i)\bchapter\s+(\d{1,3})\b", r"(?i)\bchapter\s+([ivxlcdm]+)\b"
    return F.when(c.rlike(digits), F.regexp_extract(c, digits, 1)).when(c.rlike(roman), F.lower(F.regexp_extract(c, roman, 1)))


def same_chapter(a: Column, b: Column) -> Column:
    """Whether two titles mean one chapter: equal, or of equal number, or of equal part and section; a long one may be in the other."""
    a, b = (T.trimmed(F.coalesce(c, F.lit(""))) for c in (a, b))
    low_a, low_b, part_a, part_b, no_a, no_b = F.lower(a), F.lower(b), part_key(a), part_key(b), chapter_key(a), chapter_key(b)
    named_a, named_b = (c.rlike(r"(?i)\bchapter\s+") for c in (a, b))
    counted = a.rlike(r"(?i)\bchapter\s+\d") & b.rlike(r"(?i)\bchapter\s+\d")
    at = lambda c, key: F.position(key, c)
    section = lambda c, key: F.when(at(c, key) == 0, c).otherwise(F.trim(F.regexp_replace(F.substr(c, at(c, key) + F.length(key)), r"[\s\xA0—–-]+", " ")))
    inside = ((F.length(a) >= WITHIN) & F.contains(low_b, low_a)) | ((F.length(b) >= WITHIN) & F.contains(low_a, low_b))
    return (
        F.when((a == "") | (b == ""), False).when(a == b, True).when(part_a != part_b, False).when(no_a.isNotNull() & no_b.isNotNull(), (no_a == no_b) & counted)
        .when(part_a.isNotNull() & part_b.isNull(), False).when(no_a.isNotNull() | no_b.isNotNull(), False).when(named_a != named_b, False)
        .when(named_a, (low_a == low_b) | inside).when(part_a.isNotNull(), section(low_a, part_a) == section(low_b, part_b)).otherwise(low_a == low_b)
    )


def chapter_pages(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_id, seq, id, page): the first page, not before that of the chapter before, with a chapter's id or title.

    pages (doc_id, page, titles, ids) have the titles that a page opens and the ids of boundaries on it; chapters are (doc_id,
    seq, id, title). Pages that open nothing go first; the rest of a book and its chapters are two arrays, and one fold over
    the chapters carries the least page. A chapter that is nowhere has no row.
    """
    opening = pages.filter((F.size(F.coalesce("titles", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("ids", F.array().cast("array<string>"))) > 0))
    held = opening.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("long").alias("page"), "titles", "ids"))).alias("pages"))
    asked = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.col("id").cast("string").alias("id"), F.col("title").cast("string").alias("title")))).alias("chapters"))
    fits = lambda p, c: F.coalesce(F.array_contains(p["ids"], c["id"]), F.lit(False)) | F.coalesce(F.exists(p["titles"], lambda t: same_chapter(c["title"], t)), F.lit(False))
    first = lambda s, c: F.array_min(F.transform(F.filter("pages", lambda p: (p["page"] >= s["low"]) & fits(p, c)), lambda p: p["page"]))
    put = lambda s, c, hit: F.struct(F.coalesce(hit, s["low"]).alias("low"), F.concat(s["found"], F.array(F.struct(c["seq"].alias("seq"), c["id"].alias("id"), hit.alias("page")))).alias("found"))
    start = F.struct(F.lit(1).cast("long").alias("low"), F.array().cast("array<struct<seq:bigint,id:string,page:bigint>>").alias("found"))
    walked = F.aggregate("chapters", start, lambda s, c: F.get(F.transform(F.array(first(s, c)), lambda hit: put(s, c, hit)), F.lit(0)))
    return asked.join(held, "doc_id").select("doc_id", F.inline(walked["found"])).filter("page IS NOT NULL")


def first_pages(items: DataFrame) -> DataFrame:
    """(doc_id, id, page): where each id first stands."""
    return items.filter("id IS NOT NULL").groupBy("doc_id", "id").agg(F.min("page").alias("page"))


def page_texts(items: DataFrame) -> DataFrame:
    """(doc_id, page, text) from items (doc_id, page, seq, text): a page's texts in order, in small letters, for searching."""
    rows = items.withColumn("text", T.trimmed(F.col("text"))).filter("text <> ''")
    return rows.groupBy("doc_id", "page").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")).alias("text"))


def margin_titles(pages: DataFrame, entries: DataFrame, spread: bool = False) -> DataFrame:
    """(doc_id, page, title) from pages (doc_id, page, titles, is_title_page) and contents (doc_id, page, title).

    A page has its own titles, or those of the nearest page before that isn't a title page and has some, or the last contents
    entry up to it. In a spread the next page's titles follow. A connecting word by itself is no title.
    """
    upto = W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    own = F.when(~F.coalesce("is_title_page", F.lit(False)) & (F.size(F.coalesce("titles", F.array().cast("array<string>"))) > 0), F.col("titles"))
    both = pages.select("doc_id", "page", own.alias("own"), F.lit(None).cast("string").alias("entry"), F.lit(1).alias("is_page")).unionByName(entries.select("doc_id", "page", F.lit(None).cast("array<string>").alias("own"), F.col("title").alias("entry"), F.lit(0).alias("is_page")))
    entry = W.partitionBy("doc_id").orderBy("page", "is_page", "entry").rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumn("entry", F.last("entry", ignorenulls=True).over(entry)).filter("is_page = 1").withColumn("now", F.last("own", ignorenulls=True).over(upto))
    following = W.partitionBy("doc_id").orderBy("page")
    none = F.array().cast("array<string>")
    said = lambda c, after: F.array_join(F.array_distinct(F.filter(F.concat(F.coalesce(c, none), F.coalesce(after, none)), lambda t: t != "")), " · ")
    titles = said(F.col("now"), F.lead("now").over(following) if spread else none)
    contents = said(F.array("entry"), F.array(F.lead("entry").over(following)) if spread else none)
    shown = F.trim(F.when(titles == "", contents).otherwise(titles))
    return rows.withColumn("shown", shown).select("doc_id", "page", F.when(F.col("shown").rlike(LONE), "").otherwise(F.col("shown")).alias("title"))


def page_after(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """anchors with page, the place in new pages: (doc_id, offset, prefix, old_page, old_total) and (doc_id, page, items).

    First by the characters, without white space, before the place; then by the first 40 characters of an item; then in
    proportion. Each anchor meets the pages of its book once and is aggregated before anything else.
    """
    texts = F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")))
    sized = pages.select("doc_id", F.col("page").alias("at"), F.transform(texts, lambda t: F.lower(T.trimmed(t))).alias("starts"), F.length(F.regexp_replace(F.array_join(texts, " "), r"\s+", "")).alias("n"))
    sized = sized.withColumn("hi", F.sum("n").over(W.partitionBy("doc_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    rows = anchors.withColumn("key", F.lower(F.left(T.trimmed(F.coalesce("prefix", F.lit(""))), F.lit(PREFIX))))
    begins = (F.col("key") != "") & F.exists("starts", lambda t: F.startswith(t, F.col("key")))
    met = rows.join(sized, "doc_id", "left").groupBy(*anchors.columns).agg(F.min(F.when(F.col("offset") < F.col("hi"), F.col("at"))).alias("by_offset"), F.max("at").alias("last"), F.min(F.when(begins, F.col("at"))).alias("by_text"), F.count("at").alias("total"))
    share = F.floor(F.col("old_page") / F.col("old_total") * F.col("total") + 0.5)
    found = F.when((F.col("offset") > 0) & (F.col("total") > 0), F.coalesce("by_offset", "last")).when(F.col("by_text").isNotNull(), F.col("by_text")).when((F.col("old_total") > 0) & (F.col("total") > 0), share).otherwise(1)
    return met.select(*anchors.columns, F.greatest(F.lit(1), F.least(found, F.greatest("total", F.lit(1)))).cast("int").alias("page"))


def tidied(pages: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, page, items) of pages whose items are (type, text): empty pages and lists of one short entry go, a last page of
    one short paragraph joins the page before where that has room for so many characters, and pages are numbered anew."""
    size = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda n, i: n + F.length(F.coalesce(i["text"], F.lit("")))), F.lit(0))
    lone = F.size("items") == 1
    kept = pages.filter(F.size("items") > 0).filter(~(lone & (F.col("items")[0]["type"] == "list") & (size(F.col("items")) < SHORT_LIST)))
    order = W.partitionBy("doc_id").orderBy("page")
    rows = kept.withColumn("after", F.lead("items").over(order)).withColumn("end", F.lead("page", 2).over(order).isNull()).withColumn("before", F.lag("items").over(order))
    joins = lambda a, b: b.isNotNull() & a.isNotNull() & (F.size(b) == 1) & (b[0]["type"] == "prose") & (size(b) < SHORT_PAGE) & (size(a) + size(b) <= capacity)
    takes = F.coalesce(F.col("end") & joins(F.col("items"), F.col("after")), F.lit(False))
    goes = F.coalesce(F.col("after").isNull() & joins(F.col("before"), F.col("items")), F.lit(False))
    merged = rows.withColumn("goes", goes).withColumn("items", F.when(takes, F.concat("items", "after")).otherwise(F.col("items"))).filter(~F.col("goes"))
    return merged.select("doc_id", F.row_number().over(order).alias("page"), "items")
