"""The library: listings, the oldest outdated rows, status, conditional updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listing(rows: DataFrame, user: Column, created: Column) -> DataFrame:
    """The rows of one user, latest first."""
    return rows.filter(user).orderBy(created.desc())


def outdated(rows: DataFrame, version: str, created: str, current: int, k: int) -> DataFrame:
    """The k oldest rows that were derived by an older version or none."""
    return rows.filter(F.col(version).isNull() | (F.col(version) < current)).orderBy(created).limit(k)


def needs_work(status: Column, version: Column, current: int, stale: Column) -> Column:
    """Whether a stored row is to be derived anew."""
    return (status == "ready") & (version.isNull() | (version != current) | F.coalesce(stale, F.lit(False)))


def percent(status: Column, live: Column, kept: Column) -> Column:
    return F.when(status == "ready", 100.0).otherwise(F.greatest(F.coalesce(live, F.lit(0.0)), F.coalesce(kept, F.lit(0.0))))


def renamed(rows: DataFrame, changes: DataFrame, key: str, name: str) -> DataFrame:
    """rows with new names for the keys that changes has; a name of blanks changes nothing."""
    new = changes.select(key, F.trim("name").alias("new")).filter("new <> ''").groupBy(key).agg(F.max("new").alias("new"))
    return rows.join(new, key, "left").withColumn(name, F.coalesce("new", name)).drop("new")


def deleted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key of a log of changes."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), at).alias("last")).select(key, "last.*")


def named(rows: DataFrame, name: str, find: str) -> DataFrame:
    """The rows whose name has a text in it, without regard to case; all for a text of blanks."""
    return rows.filter(F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(find.strip().lower())))


def asset_path(book: Column, block: Column) -> Column:
    """Where the image of a block is stored."""
    return F.concat(F.lit("books/"), book.cast("string"), F.lit("/images/"), block.cast("string"), F.lit(".jpg"))


def opened(rows: DataFrame, content: DataFrame, chapters: DataFrame, version: int) -> DataFrame:
    """(id, name, total_pages, parser_version, content, chapters): a library row with its pages, from content (id, page, blocks),
    and chapters (id, seq, title), in order; pages counted where they are there, version where the row has none."""
    pages = content.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "blocks"))), lambda p: p["blocks"]).alias("content"), F.count("*").alias("n"))
    titles = chapters.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))), lambda c: c["title"]).alias("chapters"))
    held = rows.join(pages, "id", "left").join(titles, "id", "left")
    return held.select("id", "name", F.coalesce("n", "total_pages").alias("total_pages"), F.coalesce("parser_version", F.lit(version)).alias("parser_version"), "content", "chapters")


def without_binaries(blocks: DataFrame) -> DataFrame:
    """blocks without the bytes of their images."""
    return blocks.drop("buffer", "img_data")
