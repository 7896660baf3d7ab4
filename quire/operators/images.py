"""Images: roles from geometry, decorative pages, interleaving with text, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Least width, heights and shapes of arches and strips over a chapter, of full pages, of spreads, all as shares.
WIDTH, FULL_HEIGHT, SPREAD_HEIGHT, MOST_SHAPE = 0.33, 0.58, 0.72, 1.35
ARCH_HEIGHT, ARCH_SHAPE, PLATE_SHAPE, PLATE_HEIGHT = (0.28, 0.57), (0.55, 1.35), 1.05, 0.42
STRIP_HEIGHT, STRIP_SHAPE, HEADING_PX = (0.10, 0.28), 1.45, 36

#: Roles from w and h (shares of the page), shape (width by height) and height (pixels), in SQL that Spark and DuckDB share.
_STRIP = f"(h BETWEEN {STRIP_HEIGHT[0]} AND {STRIP_HEIGHT[1]} AND shape >= {STRIP_SHAPE})"
_ARCH = f"(w >= 0.45 AND h BETWEEN {ARCH_HEIGHT[0]} AND {ARCH_HEIGHT[1]} AND shape BETWEEN {ARCH_SHAPE[0]} AND {ARCH_SHAPE[1]})"
_SQUARE = f"(w >= 0.55 AND shape BETWEEN 0.95 AND {MOST_SHAPE})"
_BANNER = f"(h >= 0.06 AND h < {FULL_HEIGHT} AND NOT (shape < {PLATE_SHAPE} AND h >= {PLATE_HEIGHT}) AND ({_STRIP} OR {_ARCH} OR {_SQUARE}))"
ROLE_SQL = (
    f"CASE WHEN w IS NULL OR h IS NULL OR w <= 0 OR h <= 0 OR w < {WIDTH} THEN NULL WHEN {_BANNER} THEN 'chapter_heading' WHEN h >= {FULL_HEIGHT} THEN 'full_page_illustration' "
    f"WHEN height >= {HEADING_PX} AND w >= 0.55 AND h >= 0.06 AND shape BETWEEN 1.05 AND {MOST_SHAPE} THEN 'chapter_heading' WHEN w >= 0.45 OR w * h >= 0.12 THEN 'illustration' END"
)


def shares(images: DataFrame) -> DataFrame:
    """images (width, height, page_width, page_height) with w, h and shape; null where a side is missing or zero."""
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return images.withColumn("w", part("width", "page_width")).withColumn("h", part("height", "page_height")).withColumn("shape", part("width", "height"))


def with_roles(images: DataFrame) -> DataFrame:
    """images with role: chapter_heading for arches, strips and wide squares over a chapter, full_page_illustration for tall
    ones, illustration for others of some size, else null."""
    return shares(images).withColumn("role", F.expr(ROLE_SQL)).drop("w", "h", "shape")


def spread_halves(images: DataFrame, order: str = "seq") -> DataFrame:
    """images (doc_id, page, order, role, height, page_height) that are the right half of a spread: a full page of nearly the
    whole height right after such a one on the page before."""
    tall = F.coalesce((F.col("role") == "full_page_illustration") & (F.try_divide("height", "page_height") >= SPREAD_HEIGHT), F.lit(False))
    before = W.partitionBy("doc_id").orderBy("page", order)
    met = images.withColumn("tall", tall).withColumn("was", F.lag("tall").over(before)).withColumn("on", F.lag("page").over(before))
    return met.filter(F.col("tall") & F.col("was") & (F.col("on") == F.col("page") - 1)).drop("tall", "was", "on")


def decorative_documents(images: DataFrame, text_chars: DataFrame, pages: int = 20, share: float = 0.85, chars: int = 120) -> DataFrame:
    """(doc_id, pages, near_full): documents whose pages nearly all have one near-full-page image and plenty of text."""
    one = images.groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.max(F.col("width") * F.col("height") / (F.col("page_width") * F.col("page_height"))).alias("cover"))
    one = one.join(text_chars, ["doc_id", "page_index"], "left")
    full = (F.col("n") == 1) & (F.col("cover") >= 0.8) & (F.coalesce("chars", F.lit(0)) >= chars)
    return one.groupBy("doc_id").agg(F.count("*").alias("pages"), F.avg(full.cast("int")).alias("near_full")).filter((F.col("pages") >= pages) & (F.col("near_full") >= share))


def interleaved(text: DataFrame, images: DataFrame) -> DataFrame:
    """(key, page, kind, seq, pos): per page all images, then all text blocks, numbered through the document."""
    both = images.select("key", "page", F.lit("image").alias("kind"), "seq", F.lit(0).alias("first")).unionByName(text.select("key", "page", F.lit("text").alias("kind"), "seq", F.lit(1).alias("first")))
    return both.withColumn("pos", F.row_number().over(W.partitionBy("key").orderBy("page", "first", "seq"))).drop("first")


def nearest(rows: DataFrame, reach: int = 2) -> DataFrame:
    """rows (doc_id, pos, page, is_image) with the page of the nearest image before and after, at most reach pages off."""
    order = W.partitionBy("doc_id").orderBy("page")
    shown = F.when(F.col("is_image"), F.col("page"))
    before = F.last(shown, ignorenulls=True).over(order.rangeBetween(-reach, -1))
    after = F.first(shown, ignorenulls=True).over(order.rangeBetween(1, reach))
    return rows.withColumn("image_before", before).withColumn("image_after", after)


def assign_contents(banners: DataFrame, contents: DataFrame) -> DataFrame:
    """banners (doc_id, pos) with the title of the contents row of the same place, parts and preludes left out."""
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    rows = contents.filter(~F.col("kind").isin("part", "prelude", "prologue")).select("doc_id", nth.alias("nth"), "title")
    return banners.withColumn("nth", nth).join(rows, ["doc_id", "nth"], "left")


def anchored(banners: DataFrame, contents: DataFrame, ahead: int = 12) -> DataFrame:
    """(doc_id, pos, entry): contents rows given to banners by a cursor that a read number may move ahead a little.

    A banner with a number that stands within ahead rows of the cursor moves it there, any other takes the next row, and a
    number given before is passed over. The cursor depends on all before it, so each document is folded in order.
    """
    import pandas as pd

    def fold(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = list(right.sort_values("pos")["key"])
        cursor, given, out = 0, set(), []
        for pos, number in left.sort_values("pos")[["pos", "number"]].itertuples(index=False):
            at = next((i for i in range(cursor, min(len(keys), cursor + ahead)) if number and keys[i] == number), cursor)
            if at < len(keys) and at not in given:
                given.add(at)
                out.append((key[0], pos, at + 1))
                cursor = at + 1
        return pd.DataFrame(out, columns=["doc_id", "pos", "entry"])

    return banners.groupBy("doc_id").cogroup(contents.groupBy("doc_id")).applyInPandas(fold, "doc_id long, pos long, entry int")
