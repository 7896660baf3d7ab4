"""Book operators on small fixtures, for what the driver's tables don't have."""

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, chapters, counts, export, images, quality, reader
from quire.operators import lines as L
from quire.streaming import progress


REASONS = [
    ("", "drop-empty"), ("book12.qxd 3/4", "drop-production-slug"), ("Chapter heading goes here", "drop-chapter-placeholder"), ("C H A P T E R", "drop-letter-spaced-artifact"), ("THE WIDE SEA  123", "drop-spaced-running-header"),
    ("IV INTRODUCTION", "drop-roman-section-running-head"), ("\ue000\ue000\ue000", "keep-scene-break-ornament-keep"), ("STOP", "keep-short-all-caps-keep"), ("Chapter 7", "keep-chapter-or-structural-keep"), ("Letter to a friend", "keep-chapter-or-structural-keep"),
    ("TREASUREISLAND", "keep-collapsed-running-header-below-page-threshold"), ("12", "drop-standalone-page-number"), ("- 12 -", "drop-standalone-page-number"), ("xiv", "keep-roman-part-opener-keep"), ("iiii", "drop-standalone-roman-page-marker"), ("ii iv", "drop-roman-page-marker-cluster"),
    ("12 chapter IV", "drop-standalone-running-head"), ("see chapter 1 and chapter 2", "drop-toc-listing"), ("partii:The", "drop-toc-listing"), ("The Wide Sea • 12", "drop-story-section-running-head"), ("www.example.org", "drop-running-header-merged"),
    ("The Fox and the Crow", "keep-chapter-subtitle-keep"), ("- 3 - the sea", "drop-toc-header"), ("seven.", "keep-centered-or-boundary-keep"), ("to Mr. Smith in the town", "keep-epistolary-keep"), ("https://x.y/z", "drop-url"), ("www.x.y/z", "drop-www"),
    ("and so they went home, all of them.", "keep-keep-default"), ("twice only, as it is.", "keep-keep-default"), ("some repeated line here.", "drop-recurring-line-running-header"), ("TREASUREMOUNTAIN", "drop-collapsed-running-header"), ("ABCDEFGHIJK", "drop-collapsed-running-header"),
]


def test_line_reasons(spark):
    from quire.operators.drops import explained

    often = {"some repeated line here.": (1, 2, 3), "TREASUREMOUNTAIN": (1, 2, 3), "ABCDEFGHIJK": (1, 2, 3), "twice only, as it is.": (1, 2)}
    rows = [("s", page, i, line) for i, (line, _) in enumerate(REASONS) for page in often.get(line, (1,))]
    got = {r["line"]: r["reason"] for r in explained(spark.createDataFrame(rows, "source string, doc_id long, line_no int, line string")).collect()}
    assert got == dict(REASONS)


def test_line_reasons_by_place_and_look(spark):
    from quire.operators.drops import explained

    rows = [("s", 1, 0, "Preface", False), *[("s", p, 0, "Epilogue", False) for p in (1, 2, 3)], ("t", 1, 0, "conclusion of it all", True), *[("t", p, 1, "a line in the middle", True) for p in (1, 2, 3)], ("t", 9, 0, None, None)]
    got = explained(spark.createDataFrame(rows, "source string, doc_id long, line_no int, line string, mid boolean"), F.col("mid")).orderBy("source", "line", "doc_id").collect()
    assert [(r["line"], r["reason"]) for r in got if r["source"] == "t"] == [(None, "drop-empty"), *[("a line in the middle", "keep-centered-or-boundary-keep")] * 3, ("conclusion of it all", "keep-chapter-or-structural-keep")]
    assert {r["reason"] for r in got if r["source"] == "s"} == {"keep-chapter-or-structural-keep"}


def test_line_rules_are_the_same_in_both_languages(spark):
    duckdb = pytest.importorskip("duckdb")
    from quire.operators.drops import REASONS_SQL, explained

    rows = [("s", 1 + i % 5, i, line) for i, (line, _) in enumerate(REASONS * 3)]
    con = duckdb.connect()
    con.execute("CREATE TABLE l (source VARCHAR, doc_id BIGINT, line_no INTEGER, line VARCHAR)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"WITH {REASONS_SQL} SELECT line_no, reason FROM r ORDER BY line_no").fetchall()
    got = explained(spark.createDataFrame(rows, "source string, doc_id long, line_no int, line string")).orderBy("line_no").collect()
    assert [(r["line_no"], r["reason"]) for r in got] == want


def test_echo_on_the_next_page(spark):
    rows = [("s", 1, 0, "the end of a sentence", False), ("s", 4097, 0, "this is the end of a sentence that went on", False), ("s", 9000, 0, "the end of a sentence", False), ("s", 9999, 0, "nothing like it stands here", False)]
    rows += [("t", 1, 0, "the end of a sentence.", False), ("t", 2, 0, "is the end of a sentence. so", False), ("u", 1, 0, "the end of a sentence", True), ("u", 2, 0, "this is the end of a sentence that went on", False), ("v", 1, 0, "the end of a sentence", False), ("v", 2, 0, "the end of a sentence now", False)]
    got = L.echoes(spark.createDataFrame(rows, "source string, doc_id long, piece_no int, piece string, centred boolean"))
    assert sorted((r["source"], r["doc_id"]) for r in got.collect()) == [("s", 1), ("s", 9000)]


def test_headings_that_are_none(spark):
    texts = ["Chapter 5 - Of", "The End of", "went on and on", "He sat down", "He Sat Down", "by Robert Louis", "Of", "A Title", "x" * 121, "To Build And", "Part One", ""]
    got = quality.false_headings(spark.createDataFrame([(1, i, t, True) for i, t in enumerate(texts)] + [(1, 99, "the end of", False)], "doc_id long, pos int, text string, is_heading boolean"))
    assert sorted(r["pos"] for r in got.collect()) == [1, 2, 3, 8]


def test_faults_of_chapters(spark):
    titles = ["Chapter 1", "", "q", "V", "It was late.", "It was Mr.", "The Sea", "The Sea", "y" * 401, "Chapter 2 - It was late."]
    chapters_ = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "doc_id long, pos int, title string")
    got = quality.chapter_faults(chapters_, spark.createDataFrame([(1, 60), (2, 60), (3, 50)], "doc_id long, pages int"))
    assert sorted((r["doc_id"], -1 if r["pos"] is None else r["pos"], r["fault"]) for r in got.collect()) == [(1, 1, "empty"), (1, 2, "short"), (1, 4, "sentence"), (1, 7, "repeated"), (1, 8, "long"), (2, -1, "none")]


def test_speech_apart_from_its_prose(spark):
    texts = ["He turned and said", "“Go away”", "He left.", "“No”", "He said,", "“Yes”", "“One”", "“Two”"]
    got = quality.split_dialogue(spark.createDataFrame([(1, i, t, False) for i, t in enumerate(texts)], "doc_id long, pos int, text string, is_heading boolean"))
    assert [r["pos"] for r in got.collect()] == [1]


def test_alike_titles_against_all_pairs(spark):
    import random

    from quire.functions import text as T

    r = random.Random(4)
    base = ["".join(r.choice("abcde ") for _ in range(n)) for n in (9, 12, 18, 25, 34, 40)]
    titles = set()
    for t in base:
        for _ in range(25):
            x = list(t)
            for _ in range(r.randint(0, 5)):
                k = r.randrange(len(x))
                x[k : k + r.randint(0, 1)] = r.choice(["", "a", "bc", "z"])
            titles.add("".join(x))
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    all_pairs = rows.select(F.col("title").alias("a")).crossJoin(rows.select(F.col("title").alias("b"))).filter("a < b")
    key = lambda c: F.length(T.title_key(F.col(c)))
    want = all_pairs.filter((key("a") >= 9) & (key("b") >= 9)).filter(T.fuzzy_title(F.col("a"), F.col("b")))
    assert sorted(map(tuple, quality.alike_titles(rows).collect())) == sorted(map(tuple, want.collect())) != []


def test_items_to_lines(spark):
    items = [(1, 0, i, t, x, y, 10.0, 12.0, "f", [1.0] * 6) for i, (t, x, y) in enumerate([("world", 60.0, 700.0), ("Hello", 10.0, 701.0), ("below", 10.0, 680.0), (" ", 0.0, 650.0)])]
    from quire.sources.tables import TEXT_ITEMS

    got = L.items_to_lines(spark.createDataFrame(items, TEXT_ITEMS)).orderBy("line_no").collect()
    assert [r["text"] for r in got] == ["Hello world", "below"]


@pytest.mark.parametrize("w, h, role", [(300, 90, "chapter_heading"), (300, 360, "full_page_illustration"), (100, 100, None), (200, 270, "illustration"), (200, 200, "chapter_heading"), (240, 260, "illustration"), (390, 240, "illustration"), (140, 60, "chapter_heading"), (130, 60, None), (150, 50, None), (0, 10, None)])
def test_image_role(spark, w, h, role):
    got = images.with_roles(spark.createDataFrame([(float(w), float(h), 400.0, 600.0, 7)], "width double, height double, page_width double, page_height double, w int")).first()
    assert got["role"] == role


def test_right_half_of_a_spread(spark):
    rows = [(1, p, 0, role, h, 600.0) for p, role, h in ((1, "full_page_illustration", 500.0), (2, "full_page_illustration", 500.0), (4, "full_page_illustration", 500.0), (5, "full_page_illustration", 400.0), (6, None, 500.0))]
    got = images.spread_halves(spark.createDataFrame(rows, "doc_id long, page int, seq int, role string, height double, page_height double"))
    assert [r["page"] for r in got.collect()] == [2]


def test_late_counters_move_beside_a_later_phase(spark):
    rows = [("a", 1, "ocr", None, None), ("a", 2, "classifying", 7, 9), ("a", 3, "extracting", 99, 99), ("a", 4, "classifying", 5, 9)]
    phases = ("queued", "uploading", "extracting", "structuring", "classifying", "ocr", "ready")
    got = progress.counted(spark.createDataFrame(rows, "key string, at int, phase string, current int, total int"), phases=phases).orderBy("at").collect()
    assert [(phases[r["phase_rank"] - 1], r["seen"], r["of"]) for r in got] == [("ocr", None, None), ("ocr", 7, 9), ("ocr", 7, 9), ("ocr", 7, 9)]


def detected(spark, texts):
    rows = spark.createDataFrame([(1, i, t, t[0].isupper() and len(t) < 20) for i, t in enumerate(texts)], "doc_id long, pos int, text string, is_heading boolean")
    return chapters.detect(rows).orderBy("pos").collect()


def test_chapters_and_a_repeated_one(spark):
    got = detected(spark, ["Chapter 1", "prose of one", "Chapter 2", "prose of two", "Chapter 1"])
    assert [r["chapter_id"] for r in got] == ["chapter-1", "chapter-1", "chapter-2", "chapter-2", "chapter-2"]
    assert [r["is_chapter_start"] for r in got] == [True, False, True, False, False]


def test_chapters_within_a_part(spark):
    assert [r["chapter_id"] for r in detected(spark, ["PART TWO", "Chapter 1"])] == ["part-two", "part-two-chapter-1"]


@pytest.mark.parametrize("n, rows", [(4, 0), (5, 5)])
def test_printed_contents_need_five_rows(spark, n, rows):
    lines = spark.createDataFrame([(1, i, f"Chapter {i + 1} The Title ..... {10 + i}") for i in range(n)], "doc_id long, line_no int, line string")
    assert chapters.printed_contents(chapters.contents_rows(lines)).count() == rows


def test_contents_with_titles_on_the_next_line(spark):
    texts = ["Contents", *[x for i in range(5) for x in (f"Chapter {i + 1}", f"Title {i + 1} ... {i + 9}")]]
    got = chapters.ingest_contents(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")).orderBy("pos").collect()
    assert [(r["key"], r["title"]) for r in got] == [(str(i + 1), f"Title {i + 1}") for i in range(5)]


def test_cursor_moves_to_a_read_number(spark):
    banners = spark.createDataFrame([(1, 0, None), (1, 1, "4"), (1, 2, None)], "doc_id long, pos long, number string")
    contents = spark.createDataFrame([(1, i, str(i)) for i in range(1, 7)], "doc_id long, pos int, key string")
    assert [r["entry"] for r in images.anchored(banners, contents).orderBy("pos").collect()] == [1, 4, 5]


@pytest.mark.parametrize("headings, found", [(4, True), (3, False)])
def test_heading_density(spark, headings, found):
    rows = spark.createDataFrame([(1, i, i < headings) for i in range(20)], "doc_id long, pos int, h boolean")
    assert (quality.density(rows, "doc_id", "pos", "h").count() > 0) == found


def test_provenance(spark):
    rows = spark.createDataFrame([(3, [2, 3]), (4, [2, 3]), (1, [])], "page int, provenance array<int>")
    assert [r["verdict"] for r in quality.page_in_provenance(rows).collect()] == ["ok", "merge", "exempt"]


@pytest.mark.parametrize("numbers, ok", [([1, 2, 3], True), ([1, 3], False), ([2, 3], False)])
def test_contiguity(spark, numbers, ok):
    assert quality.contiguous(spark.createDataFrame([(1, n) for n in numbers], "k int, n int"), "k", "n").first()["ok"] == ok


def test_search(spark):
    docs = spark.createDataFrame([(1, "aXa xa")], "doc_id long, text string")
    assert reader.search(docs, "xa").first()["hits"] == 2
    assert [r["ordinal"] for r in reader.occurrences(docs, "xa").orderBy("ordinal").collect()] == [1, 2]


@pytest.mark.parametrize("heading, font, centred, after, html", [(True, 18.0, False, False, "<h1>a&lt;b</h1>"), (True, 15.0, False, False, "<h2>a&lt;b</h2>"), (False, 1.0, True, False, '<p class="center">a&lt;b</p>'), (False, 1.0, False, True, '<p class="first">a&lt;b</p>'), (False, 1.0, False, False, '<p class="body">a&lt;b</p>')])
def test_block_html(spark, heading, font, centred, after, html):
    assert spark.range(1).select(export.block_html(F.lit("a<b"), F.lit(heading), F.lit(font), F.lit(centred), F.lit(after)).alias("h")).first()["h"] == html


def test_phrases_of_four_to_six_words(spark):
    docs = spark.createDataFrame([("alpha beta gamma delta epsilon zeta",), ("Alpha beta gamma delta epsilon zeta",), ("1 2 3 alpha 4567890",), ("1 2 3 alpha 4567890",), ("one",), (None,)], "text string")
    got = {r["phrase"]: r["n"] for r in counts.ngrams(docs, longest=6, words=counts.words_and_numbers).collect()}
    words = "alpha beta gamma delta epsilon zeta".split()
    assert got == {" ".join(words[i : i + k]): 2 for k in (4, 5, 6) for i in range(7 - k)}


def test_dialogue_split(spark):
    got = blocks.split_dialogue(spark.createDataFrame([("“Go.” “No.” He left.",)], "text string")).first()["parts"]
    assert got == ["“Go.”", "“No.” He left."]


def test_content_pages(spark):
    got = blocks.content_pages(spark.createDataFrame([(1, i, "x") for i in range(85)], "doc_id long, line_no int, line string")).groupBy("content_page").count().orderBy("content_page").collect()
    assert [r["count"] for r in got] == [40, 40, 5]


def test_headings_merge(spark):
    rows = spark.createDataFrame([(1, 0, "Part I", True), (1, 1, "The Start", True), (1, 2, "prose", False)], "doc_id long, pos int, text string, is_heading boolean")
    assert [r["text"] for r in blocks.merge_headings(rows).orderBy("pos").collect()] == ["Part I — The Start", "prose"]


def test_catalog_page(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["One Title", "Another Title", "A Third", "prose that ends."])], "doc_id long, line_no int, line string")
    assert blocks.catalog_pages(rows).first()["titles"] == 3


def test_alike_titles_lose_no_pair(spark):
    import itertools

    from quire.functions import text as T

    names = ["the adventures of tom sawyer", "the adventures of tom sawyr", "adventures of tom sawyer", "a tale of two cities in winter time", "a tale of two citees in winter time", "an tale of two cities in winter tim", "short", "shorter one"]
    got = {(r["a"], r["b"]) for r in quality.alike_titles(spark.createDataFrame([(n,) for n in names], "title string")).collect()}
    pairs = spark.createDataFrame([p for p in itertools.combinations(sorted(names), 2)], "a string, b string")
    assert got == {(r["a"], r["b"]) for r in pairs.filter(T.fuzzy_title(F.col("a"), F.col("b"))).collect()} and got


def test_progress_never_goes_back(spark):
    rows = spark.createDataFrame([("k", 1, 1, "extracting", 30.0), ("k", 2, 2, "structuring", 60.0), ("k", 3, 3, "extracting", 58.0)], "key string, at int, tie int, phase string, percent double")
    last = progress.merged(rows, "key", "at", "tie", "phase", "percent").orderBy("tie").collect()[-1]
    assert (progress.PHASES[last["phase_rank"] - 1], last["percent"]) == ("structuring", 60.0)


def test_progress_stream(spark, tmp_path):
    spark.createDataFrame([("k", "extracting", 30.0), ("k", "structuring", 60.0)], "key string, phase string, percent double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, phase string, percent double").parquet(f"{tmp_path}/in")
    q = progress.merged_stream(stream).writeStream.format("memory").queryName("progress").outputMode("update").option("checkpointLocation", f"{tmp_path}/at").start()
    q.processAllAvailable()
    q.stop()
    row = spark.sql("SELECT * FROM progress").collect()[-1]
    assert (row["phase"], row["percent"]) == ("structuring", 60.0)
