"""A training corpus from documents: quality, exact and near dedup, mixing, packing. Part of the subpackage llm.

Every stage gets the documents that the one before it kept, as Parquet read again, and works on all of them. So when a stage
begins, the result of the one before has been written, and the tables in between that it was made of are removed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, minhash, mixing, packing, quality
from quire.llm.shared import forget, scratch, stored, table
from quire.session import ship

#: By application, what the last stage left in the shared folder.
_left: dict[str, list[DataFrame]] = {}


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the stage before it left."""

    @functools.wraps(f)
    def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        forget(*_left.pop(spark.sparkContext.applicationId, []))
        with scratch() as made:
            out = f(spark, docs, sf_dir)
        _left[spark.sparkContext.applicationId] = made
        return out

    return clean


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the corpus.

    Null texts are empty, repeated rows are judged each, without labels all stay. Empty table: no rows.
    """
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


@stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the longest as written, then that with the smallest id.

    Null and blank texts are one text, of repeated rows one stays, a null id comes last. Empty table: no rows.
    """
    return exact_dedup.kept_documents(docs)


@stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Null and blank texts have no near copies and stay. Rows repeated with one id stay or go together. Empty table: no rows.
    """
    return minhash.kept_documents(docs)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture takes them.

    A null source is a source of its own, documents without words cost nothing, repeated rows count each. Empty table: no rows.
    """
    return mixing.mixed_documents(docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null or empty text is its end token alone, repeated rows are packed each. Empty table: no rows.
    """
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: A discriminant and near dedup over sketches aren't SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, held = table(spark, sf_dir, "documents"), []
    for k, (name, make) in enumerate(STAGES):
        docs = make(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
            forget(*held)
            held = [docs]
    return docs
