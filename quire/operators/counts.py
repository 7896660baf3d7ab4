"""Words and phrases: counts, n-grams, coverage of one text by another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Words that say little in a phrase, and numerals that number pages.
STOP = tuple(
    (
        "a an the and or but if in on at to for of by with from as is was were be been am are has have had do does did will would could should may might must shall can it its he she they we you i me my "
        "his her their our your this that these those not no nor so than then there here when where who whom what which while up down out into over under again further once"
    ).split()
)
NUMERALS = tuple("i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split())


def tokens(c: Column) -> Column:
    """Lower-case words of ASCII letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), 0)


def words_by_document(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", T.word_count(F.col("text")).cast("long").alias("words"))


def words_by_source(docs: DataFrame) -> DataFrame:
    return words_by_document(docs).groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("docs"), F.max("words").alias("longest"))


def frequencies(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def words_and_numbers(c: Column) -> Column:
    """Lower-case words of ASCII letters, and runs of digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+|[0-9]+"), 0)


def ngrams(docs: DataFrame, n: int = 4, least: int = 2, stops: float = 0.55, longest: int | None = None, words=tokens) -> DataFrame:
    """(phrase, n): phrases of n to longest words that occur often enough, are 12 characters long and aren't mostly stop words
    and numbers. Without longest, of n words."""
    upto = longest or n
    held = docs.select(F.explode(F.array(words(F.col("text")))).alias("t")).filter(F.size("t") >= n)  # a step of its own, so words are found once
    shifted = [F.slice("t", k + 1, F.greatest(F.size("t") - k, F.lit(0))).alias(f"w{k}") for k in range(upto)]  # a slice for each word of a phrase, not one for each place
    grams = held.select(F.explode(F.arrays_zip(*shifted)).alias("g"))  # past the end of a text, words are null
    each = grams.select(F.explode(F.array(*[F.array(*[f"g.w{k}" for k in range(size)]) for size in range(n, upto + 1)])).alias("g")).filter(F.element_at("g", -1).isNotNull())
    share = F.size(F.filter("g", lambda w: w.isin(*STOP) | w.rlike("^[0-9]+$"))) / F.size("g")
    counted = each.filter(share <= stops).groupBy(F.array_join("g", " ").alias("phrase")).agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= least) & (F.length("phrase") >= 12))


def coverage(docs: DataFrame, other: DataFrame) -> DataFrame:
    """One row: how much of other's vocabulary and of its running words occurs in docs."""
    have, asked = frequencies(docs).select("word").withColumn("hit", F.lit(1)), frequencies(other)
    met = asked.join(have, "word", "left")
    hit = F.coalesce("hit", F.lit(0))
    return met.agg(F.count("*").alias("words"), F.sum(hit).alias("found"), F.round(F.sum(hit) / F.count("*"), 6).alias("share"), F.round(F.sum(hit * F.col("n")) / F.sum("n"), 6).alias("token_share"))


def missing(docs: DataFrame, other: DataFrame, k: int = 20) -> DataFrame:
    """(word, n, impact): the words of docs that other lacks, by how often and how long they are; the k with most. Single
    letters, words that say little and numerals of pages don't count."""
    lost = frequencies(docs).filter((F.length("word") > 1) & ~F.col("word").isin(*STOP, *NUMERALS)).join(frequencies(other).select("word"), "word", "left_anti")
    impact = F.col("n") * F.least(F.length("word"), F.lit(12))
    return lost.withColumn("impact", impact).orderBy(F.desc("impact"), "word").limit(k)


def lost_phrases(raw: DataFrame, parsed: DataFrame, least: int = 2, most: int = 35, k: int = 25) -> DataFrame:
    """(phrase, n, score): phrases of four to six words that occur least to most times in raw and nowhere in parsed, whole words
    compared; by occurrences times words, the first k of which none holds another.

    Which phrase is kept depends on the better ones, so the sorted phrases come to the driver one partition at a time, only
    until k are kept; no more than these k are held.
    """
    found = ngrams(raw, least=least, longest=6, words=words_and_numbers).filter(F.col("n") <= most)
    there = ngrams(parsed, least=1, longest=6, words=words_and_numbers).select("phrase")
    scored = found.join(there, "phrase", "left_anti").withColumn("score", F.col("n") * F.size(F.split("phrase", " "))).orderBy(F.desc("score"), "phrase")
    kept: list[tuple] = []
    for row in scored.toLocalIterator():
        if not any(row["phrase"] in other or other in row["phrase"] for other, _, _ in kept):
            kept.append((row["phrase"], row["n"], row["score"]))
            if len(kept) == k:
                break
    return raw.sparkSession.createDataFrame(kept, "phrase string, n long, score long")
