"""Tables of a data set, and documents read as books: a source is a book, a document a page, a text line a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship

#: Rows of a table of positioned text items, the input that a decoder of page files hands over.
TEXT_ITEMS = "doc_id long, page_index int, seq int, str string, x double, y double, width double, font_size double, font_name string, transform array<double>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of stored files; content is read only where a plan uses it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def file_kind(content):
    """Kind of a binary by its leading bytes: pdf, jpeg, png, gif, webp or null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("255044462D"), "pdf").when(head.startswith("FFD8"), "jpeg").when(head.startswith("89504E47"), "png").when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    )


def raw_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole text files, the independent second scan of a book."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def lines(docs: DataFrame) -> DataFrame:
    """(source, doc_id, line_no, line) from documents; null texts give no line."""
    return docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


#: The same in DuckDB, to be put after WITH.
LINES_SQL = "l AS (SELECT source, doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS line_no, unnest(p) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS p FROM documents) t)"
