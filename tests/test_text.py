"""The fixtures of the text rules, each a literal input with its result."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "a, b, joined", [("simulta-", "neously", "simultaneously"), ("CIGA-", "RETTES", "CIGARETTES"), ("Anti-", "Sex", "Anti-Sex"), ("a", "b", "a b"), ("", "b", "b")]
)
def test_joined_wrap(spark, a, b, joined):
    assert one(spark, T.joined_wrap(F.col("a"), F.col("b")), a=a, b=b) == joined


@pytest.mark.parametrize("text, plain", [("c h a p t e r 7", "chapter 7"), ("T R E A S U R E I S L A N D", "TREASUREISLAND"), ("A normal line", "A normal line"), ("", "")])
def test_unspaced(spark, text, plain):
    assert one(spark, T.unspaced(F.col("a")), a=text) == plain


@pytest.mark.parametrize("text, slug", [("Chapter 5 - The Fox!", "chapter-5---the-fox"), ("  ", "")])
def test_slug(spark, text, slug):
    assert one(spark, T.slug(F.col("a")), a=text) == slug


@pytest.mark.parametrize("text, numeral", [("IV.", "IV"), ("XVIII", None), ("IIII", None), ("ix", "IX"), ("", None)])
def test_roman(spark, text, numeral):
    assert one(spark, T.roman(F.col("a")), a=text) == numeral


@pytest.mark.parametrize("text, value", [("iv", 4), ("XC", 90), ("12", 12), ("twenty-one", 21), ("one hundred", 101), ("fox", None)])
def test_ordinal_value(spark, text, value):
    assert one(spark, T.ordinal_value(F.col("a")), a=text) == value


@pytest.mark.parametrize("text, n", [("  a  b\u00adc ", 2), ("", 0), (None, 0)])
def test_word_count(spark, text, n):
    assert one(spark, T.word_count(F.coalesce(F.col("a"), F.lit(""))), a=text) == n


def test_upper_median(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4],), ([5, 1, 3],), ([],)], "a array<int>").select(T.upper_median(F.col("a")).alias("m")).collect()
    assert [r["m"] for r in rows] == [3, 3, 0]


@pytest.mark.parametrize("a, b, alike", [("the fox", "the f0x", False), ("the adventures of tom", "the adventurse of tom", True), ("a short title", "a shrot titel", False), ("the adventures of tom sawyer", "the adventures of tom sawyr", True)])
def test_fuzzy_title(spark, a, b, alike):
    assert one(spark, T.fuzzy_title(F.col("a"), F.col("b")), a=a, b=b) == alike


def test_chapter_label(spark):
    got = one(spark, T.chapter_label(F.col("a")), a="Chapter IV - The Fox")
    assert (got["kind"], got["number"], got["subtitle"]) == ("chapter", 4, "The Fox")
    assert one(spark, T.chapter_label(F.col("a")), a="Chapters are long") is None


@pytest.mark.parametrize("text, cased", [("THE END OF PART IV", "The End of Part IV"), ("As it is", "As it is")])
def test_title_cased(spark, text, cased):
    assert one(spark, T.title_cased(F.col("a")), a=text) == cased


def test_repaired(spark):
    assert one(spark, T.repaired(F.col("a")), a="of\ufb01ce  so\u00adft hy- phen\x00") == "office soft hyphen"


def test_affine(spark):
    row = spark.sql("SELECT array(2.0,0.0,0.0,3.0,5.0,7.0) a, array(1.0,0.0,0.0,1.0,10.0,20.0) b").select(T.affine(F.col("a"), F.col("b")).alias("m"), T.font_size(F.col("a")).alias("f")).first()
    assert [float(x) for x in row["m"]] == [2, 0, 0, 3, 25, 67] and float(row["f"]) == 3


@pytest.mark.parametrize("text, divider", [("* * *", True), ("\ue001\ue001", True), ("*-*", False), ("*", False)])
def test_scene_break(spark, text, divider):
    assert one(spark, T.scene_break(F.col("a")), a=text) == divider
