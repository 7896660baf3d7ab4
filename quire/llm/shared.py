"""What the operators share: the shared folder for cut lineage, and the words of the contracts."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship

#: The white space of every contract here: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset and there is no executor but this
    machine's own (tests), a temporary one; on a cluster, tables there would be lost, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: it survives lost executors and can be read by column.
    forget() removes it."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quire_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that stored() makes within, for forget() once the result that reads them is written."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        _scratch.pop()


def forget(*tables: DataFrame) -> None:
    """Remove tables that stored() made, once nothing that is still to run reads them."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__.get("quire_path")
        if path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[str, object] = {}


def keep_only(key: str, make=None):
    """A worker's one cache that outlives a task: asking for another drops it, so operators that take turns in a worker
    don't add up there. Without make, only the others are dropped."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            try:  # give what was freed back to the machine, where the C library can
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass
        _kept[key] = make() if make else None
    return _kept.get(key)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 marks the rows that are held out of every fit."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
