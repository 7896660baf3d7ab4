"""Lines far longer than printed ones: rules over them must not run out of stack, and must still agree with their SQL."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import layout, wraps
from quire.operators import lines as L
from quire.operators.drops import DUCKDB, REASONS_SQL, SPARK, explained, subtitle, trimmed
from quire.plans.catalogue import ORACLE_SQL, QUERIES

#: Documents with titles of 20,000 words, letters set apart for as long, and an end of a paragraph that recurs like a head.
LONG = ["The Old Man of Hill and Sea " * 3000 + "Ends", "Of the Sea " * 9000 + "Ends", "C H A P T E R " * 3000 + "X"]
TEXTS = [f"It was a long day on the wide sea and\n{LONG[i % 3]}\nand so it was.\nA Short Title\n{i} {LONG[0]}" for i in range(6)]


@pytest.mark.parametrize("name", ["centred_lines", "line_drop_trace", "wrap_tail_mechanisms", "line_drop_reasons", "wrap_tail_fates", "margin_notes"])
def test_queries_on_long_lines(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
    assert got and sorted(got, key=str) == sorted(want.fetchall(), key=str)


def test_a_long_title_can_be_centred(spark):
    rows = [(1, 0, 0, "Old Hill " * 10_000, 200.0, 400.0, 12.0), (1, 0, 1, "A line.", 0.0, 600.0, 12.0)]
    got = layout.with_centred(spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, text string, x double, right_edge double, font_size double"))
    assert [r["centred"] for r in got.orderBy("line_no").collect()] == [True, False]


def test_notes_read_and_deal_their_lines_once(spark, tmp_path):
    rows = [(1, 0, i, t, 60.0 if i else 4.0, 300.0, 12.0) for i, t in enumerate(["a note", "It was a long day on the wide sea, and nobody had seen the hills for a week.", "And so it was again.", " "])]
    spark.createDataFrame(rows, "doc_id long, page_index int, line_no int, text string, x double, right_edge double, font_size double").write.parquet(f"{tmp_path}/lines")
    got = layout.noted(spark.read.parquet(f"{tmp_path}/lines"))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Aggregate" not in plan
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [r["line_no"] for r in got.filter("verdict LIKE 'drop-%'").collect()] == [0] and got.count() == 3


def test_fates_ask_for_a_reason_once(spark, tmp_path):
    """And say what the operator says that gets dropped and kept lines apart; documents without an id have nothing that stays."""
    again, end = "and so it was.", "and nobody had seen the hills for a long week"
    rows = [("s", i, 0, "A word of it") for i in (7, None)] + [("s", i, n, t) for i in (0, 1, 2, 3, None) for n, t in enumerate([end, again, "12", None, "", end, f"{i} It ended, and so it was. The end"])]
    spark.createDataFrame(rows, "source string, doc_id long, line_no int, line string").filter("doc_id IS NOT NULL OR line_no < 1").write.parquet(f"{tmp_path}/lines")
    held = spark.read.parquet(f"{tmp_path}/lines")
    found = explained(held)
    got = wraps.line_fates(found)
    assert got._jdf.queryExecution().sparkPlan().toString().count("indd") == 1
    kept = found.filter("reason NOT LIKE 'drop-%'").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    drops = L.drops(held).select("doc_id", "line_no", F.lit("lines").alias("stage"), F.substr("reason", F.lit(6)).alias("reason"), F.col("line").alias("text"), "prev")
    want = wraps.fates(drops, kept)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "line_no", "stage", "reason", "text", "prev", "wrap", "fate").collect()), key=str)
    assert rows(got) == rows(want) and len({r[-1] for r in rows(got)}) > 1


@pytest.mark.parametrize("name", ["wrap_tail_fates", "wrap_tail_mechanisms"])
def test_queries_of_fates_ask_for_a_reason_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("indd") == 1


def test_letters_set_apart_without_end(spark):
    texts = ["C H A P T E R " * 3000 + "X", "A B  C\tD " * 5000 + "E", "HERE", "C H A P", "C H A", "C H A PT E R"]
    got = L.drops(spark.createDataFrame([("s", 1, i, t) for i, t in enumerate(texts)], "source string, doc_id long, line_no int, line string"))
    assert [(r["line_no"], r["reason"]) for r in got.filter("reason LIKE '%artifact'").collect()] == [(0, "drop-letter-spaced-artifact")]


def test_words_of_a_subtitle(spark):
    """A word held as it is makes the same subtitles as one that can be given back."""
    duckdb = pytest.importorskip("duckdb")
    words = ["The", "the", "and", "anda", "an", "a", "of", "m.", "m", "M.", "l'Été", "d’Arc", "dArc", "dar", "l'", "7", "7b", "—", "-", "--", "Élan", "élan", "when", "whenever", "Sea,", "Sea"]
    dice = random.Random(7)
    texts = [dice.choice((" ", "  ", "\t")).join(dice.choices(words, k=dice.randint(1, 6))) for _ in range(2000)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").selectExpr("i", f"{subtitle(SPARK)} AS s").orderBy("i").select("s").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE l AS SELECT unnest(range(len(x))) AS i, unnest(x) AS t FROM (SELECT ? AS x)", [texts])
    want = [r[0] for r in con.execute(f"SELECT {subtitle(DUCKDB)} FROM l ORDER BY i").fetchall()]
    assert got == want and 100 < sum(got) < 1900


def test_reasons_deal_their_lines_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["line_drop_reasons"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("ReusedExchange") == 1 and plan.count("FileScan") == 1


def dealt(plan):
    """Bytes of rows that the exchanges of a finished plan dealt out."""
    below = plan.children()
    return (plan.metrics().apply("dataSize").value() if plan.nodeName() == "Exchange" else 0) + sum(dealt(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("name", ["wrap_tail_fates", "wrap_tail_mechanisms"])
def test_queries_of_fates_deal_whole_lines_once(spark, tmp_path, name):
    dice = random.Random(3)
    texts = ["\n".join(" ".join(f"{dice.random()} it was" for _ in range(40)) for _ in range(20)) + "\nand nobody\nhad seen it." for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = QUERIES[name](spark, str(tmp_path))
        assert len(got.collect()) == (1 if name == "wrap_tail_mechanisms" else 60)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(map(len, texts)) < dealt(got._jdf.queryExecution().executedPlan()) < 2 * sum(map(len, texts))


def test_pages_explain_as_lines_do(spark):
    """With copies on a page, labels on several, pages and books without an id, blanks and lines about as long as a digest."""
    texts = ["preface", " Preface\u00a0", "preface", "and so it was.", "and so it was.", "", " ", None, "x" * 31, "x" * 32, "x" * 33, "é" * 16 + "a long line that stays", "CHAPTER", "IV", "A Short Title", "7", "he went on and on, and nobody had seen it before"]
    dice = random.Random(5)
    rows = [(s, d, n, t, dice.random() < 0.2) for s in ("a", "b", None) for d in (1, 2, 3, 4, None) for n, t in enumerate(dice.choices(texts, k=14))]
    lines = spark.createDataFrame(rows + [("c", None, 0, "he went", False), ("c", 9, 0, "he went", False), ("c", 8, 0, "he went", False)], "source string, doc_id long, line_no int, line string, mid boolean")
    for more in ({}, {"centred": F.col("mid"), "font": F.col("line_no").cast("double")}):
        want, got = explained(lines, **more), explained(lines, **more, by_page=True)
        want = want.select(*got.columns)  # in another order
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and 6 < got.select("reason").distinct().count()
    assert got.filter("source = 'c'").select("pages").distinct().collect() == [(3,)]


def test_blanks_around_a_line_are_those_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    blanks = [" ", "\t", "\r", "\f", "\n", "\x0b", "\u00a0", "\u0085", "\u2028", "\u3000", "x", "é"]
    dice = random.Random(11)
    texts = [None, ""] + ["".join(dice.choices(blanks, k=dice.randint(1, 6))) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(trimmed(F.col("x"))).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE l AS SELECT unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT ? AS x)", [texts])
    want = con.execute(r"SELECT regexp_replace(coalesce(line, ''), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g') FROM l ORDER BY i").fetchall()
    assert got == [r[0] for r in want]


#: Lines with letters beyond ASCII at the edge of a word that a rule asks for, and signs that only Java takes for blanks or line ends.
EDGES = ["La Monta\u00f1a", "El \u00d1of", "Die \u00d6ebook", "The Sea", "The Sea of", "Book of the Caf\u00e9a", "By the\u00e9 Sea", "yours sincerely\u00e9", "Chapter 1 \u00e9chapter 2", "chapter 2 chapter 3", "www.\u00e9a.com", "IV preface\u00f1", "x.indd\u00fc", "a free ebook\u00df"]
SIGNS = ["The\x0bSea", "The\x85Sea 12", "The House\u2028of 12", "Sea 7\x85", "HOUSE\u2028"]


def test_edges_of_words_are_those_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [("s", i, 0, t) for i, t in enumerate(EDGES + SIGNS)]
    got = explained(spark.createDataFrame(rows, "source string, doc_id long, line_no int, line string")).select("line", "reason").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE l AS SELECT 's' AS source, unnest(range(len(x))) AS doc_id, 0 AS line_no, unnest(x) AS line FROM (SELECT ? AS x)", [EDGES + SIGNS])
    want = con.execute(f"WITH {REASONS_SQL} SELECT line, reason FROM r").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and dict(want)["La Monta\u00f1a"] == "keep-keep-default"


@pytest.mark.parametrize("name", ["margin_notes", "centred_lines"])
def test_places_of_words_with_such_edges(spark, tmp_path, name):
    """Against one thread of DuckDB: with more, the SQL of notes can number clusters of equal places otherwise."""
    duckdb = pytest.importorskip("duckdb")
    dice = random.Random(13)
    docs = [(i, "\n".join(dice.choices(EDGES, k=30)), f"s{i % 2}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE_SQL[name]).fetchall())
