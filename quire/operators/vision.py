"""Images before recognition: luma, the threshold between ink and paper, and what was read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue; the mean below which an image is turned; the threshold for a flat one.
LUMA, DARK, FLAT = (0.299, 0.587, 0.114), 132, 168


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(float) @ np.array(LUMA)


def threshold(grey: np.ndarray) -> int:
    """The level that parts grey values into two classes with the largest variance between them."""
    n = np.bincount(np.clip(grey, 0, 255).astype(np.int64).reshape(-1), minlength=256).astype(float)
    below, sums = np.cumsum(n), np.cumsum(n * np.arange(256))
    above, total = below[-1] - below, sums[-1]
    both = (below > 0) & (above > 0)
    if not both.any():
        return FLAT
    between = np.zeros(256)
    between[both] = below[both] * above[both] * (sums[both] / below[both] - (total - sums[both]) / above[both]) ** 2
    return int(between.argmax())


def binary(rgb: np.ndarray) -> np.ndarray:
    """Black ink on white, dark images turned first."""
    grey = luma(rgb)
    if grey.size and grey.mean() < DARK:
        grey = 255 - grey
    return np.where(grey > threshold(grey), 255, 0).astype(np.uint8)


def chapter_number(read: Column, most: int = 75) -> Column:
    """A chapter's number in recognised text, 1 to most; the longest run of digits."""
    runs = F.regexp_extract_all(F.coalesce(read, F.lit("")), F.lit("[0-9]+"), 0)
    best = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), (-F.coalesce(r.try_cast("int"), F.lit(2**30))).alias("small"))))
    number = -best["small"]
    return F.when(number.between(1, most), number)


def plausible_title(read: Column) -> Column:
    """Whether recognised text is a title: mostly letters, few single ones."""
    n = F.length(F.regexp_replace(read, "\\s", ""))
    letters = F.length(F.regexp_replace(read, "[^\\p{L}]", ""))
    return (n >= 3) & (letters / F.greatest(n, F.lit(1)) >= 0.7)
