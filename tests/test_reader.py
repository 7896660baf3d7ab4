"""Page maps, places on a page, dropped ends of paragraphs and block transforms on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks, catalog, counts, headings, layout, pagemap, quality, wraps
from quire.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Chapter 5 - The Fox", "CHAPTER 5", True), ("Chapter 5", "Chapter 6", False), ("Chapter V", "Chapter V.", False), ("Part Two", "PART TWO", True), ("Part Two", "Part One", False), ("Part Two — Chapter 1", "Chapter 1", True),
        ("Volume I - Letter I", "Volume I - Letter II", False), ("Volume I - Letter I", "VOLUME I — Letter I", True), ("Part Two", "The Sea", False), ("The Sea", "THE SEA", True), ("The Sea", "Sea", False), ("", "", False),
        ("The chapter of accidents", "On the chapter of accidents and more", True), ("Chapter 5", "The Sea", False), ("Chapter of sorts", "Sorts", False),
    ],
)
def test_titles_of_one_chapter(spark, a, b, same):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(pagemap.same_chapter(F.col("a"), F.col("b")).alias("s"))
    assert row.first()["s"] is same


def test_pages_of_chapters_never_go_back(spark):
    pages = [(1, 1, ["Contents", "Chapter 2"], []), (1, 3, ["Chapter 1"], []), (1, 5, [], ["c2"]), (1, 6, None, None), (1, 7, ["Chapter 1"], []), (1, 9, ["Epilogue"], []), (2, 1, ["Chapter 1"], [])]
    chapters = [(1, 0, "c1", "Chapter 1"), (1, 1, "c2", "Chapter 2"), (1, 2, "c3", "Chapter 3"), (1, 3, "e", "Epilogue"), (3, 0, "x", "Chapter 1")]
    got = pagemap.chapter_pages(spark.createDataFrame(pages, "doc_id long, page int, titles array<string>, ids array<string>"), spark.createDataFrame(chapters, "doc_id long, seq int, id string, title string"))
    assert sorted((r["doc_id"], r["id"], r["page"]) for r in got.collect()) == [(1, "c1", 3), (1, "c2", 5), (1, "e", 9)]


def test_first_pages_and_texts(spark):
    items = spark.createDataFrame([(1, "a", 3, 1, " Two "), (1, "a", 2, 0, "One"), (1, None, 3, 0, "Zero"), (1, "b", 3, 2, None)], "doc_id long, id string, page int, seq int, text string")
    assert sorted((r["id"], r["page"]) for r in pagemap.first_pages(items).collect()) == [("a", 2), ("b", 3)]
    assert sorted((r["page"], r["text"]) for r in pagemap.page_texts(items).collect()) == [(2, "one"), (3, "zero two")]


@pytest.mark.parametrize("spread, want", [(False, ["", "One", "One", "Two", "", ""]), (True, ["One", "One", "One · Two", "Two", "", "Seven"])])
def test_titles_in_the_margin(spark, spread, want):
    pages = [(1, 1, None, True), (1, 2, ["One"], False), (1, 3, [], False), (1, 4, ["Two"], False), (2, 1, ["and"], False), (3, 6, None, False), (3, 7, None, False)]
    entries = spark.createDataFrame([(3, 7, "Seven")], "doc_id long, page int, title string")
    got = pagemap.margin_titles(spark.createDataFrame(pages, "doc_id long, page int, titles array<string>, is_title_page boolean"), entries, spread).orderBy("doc_id", "page").collect()
    assert [r["title"] for r in got][:6] == want
    assert got[6]["title"] == "Seven"


@pytest.mark.parametrize("offset, prefix, old, page", [(1, None, (1, 2), 1), (8, None, (1, 2), 1), (9, None, (1, 2), 2), (999, None, (1, 2), 3), (0, "Third it", (1, 2), 3), (0, "nowhere", (2, 3), 2), (None, None, (0, 0), 1), (None, None, (9, 3), 3)])
def test_place_in_new_pages(spark, offset, prefix, old, page):
    pages = spark.createDataFrame([(1, 1, ["First one"], ), (1, 2, ["Second", " more "]), (1, 3, ["x", " third item"])], "doc_id long, page int, items array<string>")
    anchors = spark.createDataFrame([(1, offset, prefix, *old)], "doc_id long, offset long, prefix string, old_page int, old_total int")
    assert pagemap.page_after(anchors, pages).first()["page"] == (2 if offset == 8 else page)


def test_pages_made_tidy(spark):
    p = lambda t: ("prose", t)
    pages = [(1, 1, [p("a" * 60)]), (1, 2, []), (1, 3, [("list", "one")]), (1, 4, [p("b" * 60)]), (1, 5, [p("end")]), (2, 1, [p("x" * 99)]), (2, 2, [p("end")]), (3, 1, [p("end")])]
    got = pagemap.tidied(spark.createDataFrame(pages, "doc_id long, page int, items array<struct<type:string,text:string>>"), 100).orderBy("doc_id", "page").collect()
    assert [(r["doc_id"], r["page"], [len(i["text"]) for i in r["items"]]) for r in got] == [(1, 1, [60]), (1, 2, [60, 3]), (2, 1, [99]), (2, 2, [3]), (3, 1, [3])]


LINES = "doc_id long, page_index int, line_no int, text string, x double, right_edge double, font_size double"


def test_centred_lines(spark):
    rows = [("A line of the column that runs from edge to edge", 100, 500), ("WIDE SEA", 250, 350), ("Mr. Smith", 250, 350), ("and went on home", 250, 350), ("At the left", 100, 200), ("The Fox", 180, 260), ("The Fox", 180, 260), (None, 0, 0)]
    got = layout.with_centred(spark.createDataFrame([(1, 0, i, t, float(a), float(b), 10.0) for i, (t, a, b) in enumerate(rows[:-1])] + [(1, 1, 0, None, None, None, None)], LINES)).orderBy("page_index", "line_no").collect()
    assert [r["centred"] for r in got] == [False, True, False, False, False, False, False, False]


def test_notes_beside_the_column(spark):
    long = "This is a line of prose, long enough to be the parent of a shorter one here."
    texts = [
        (long, 100, 10), (long + " more", 100, 10), ("another one of the column", 101, 10), ("long enough to be the parent", 100, 10), ("side note", 20, 10), ("side note of the right", 200, 10), ("“Go on", 200, 10), ("Chapter 7", 20, 10),
        ("Big Words Here", 300, 18), ("", 0, 10), ("in the column", 104, 10), ("Big words of old", 20, 18),
    ]
    got = layout.noted(spark.createDataFrame([(1, 0, i, t, float(x), float(x + 6 * len(t)), float(f)) for i, (t, x, f) in enumerate(texts)], LINES)).orderBy("line_no").collect()
    assert [r["verdict"] for r in got] == [
        "keep-not-short", "keep-not-short", "keep-body-column-aligned", "drop-substring-of-longer-line", "drop-margin-callout-displaced-left", "drop-margin-callout-displaced-right", "keep-dialogue-continuation", "keep-structural-heading",
        "keep-chapter-subtitle-after-heading", "keep-body-column-aligned", "keep-large-font-short-line",
    ]


def test_drop_caps(spark):
    rows = [(0, "nce upon a time", 700.0, 10.0), (1, "O", 695.0, 40.0), (2, "there was a fox", 680.0, 10.0), (3, "T he end of it", 650.0, 40.0), (4, "nothing more", 600.0, 10.0)]
    frame = spark.createDataFrame([(1, 0, n, t, y, f) for n, t, y, f in rows] + [(1, 1, 0, "no letter here", 1.0, 10.0)], "doc_id long, page_index int, line_no int, text string, y double, font_size double")
    got = layout.without_drop_caps(frame).orderBy("page_index", "line_no").collect()
    assert [(r["text"], r["font_size"], r["continued"]) for r in got] == [("Once upon a time", 10.0, True), ("Tthere was a fox", 10.0, True), ("he end of it", 10.0, False), ("nothing more", 10.0, False), ("no letter here", 10.0, False)]


def test_ends_of_paragraphs(spark):
    before = "He walked along the long road to the"
    drops = [
        ("recurring-line-running-header", "house.", before, True, "wrap-tail-deleted"), ("recurring-line-running-header", "sea.", before, True, "wrap-tail-token-elsewhere"), ("url", "house.", before, False, "absent-not-wrap"),
        ("recurring-line-running-header", "house.", "It ended here.", False, "absent-not-wrap"), ("x", "the wide sea.", "over", False, "relocated-or-merged"), ("x", "and so it was.", None, True, "wrap-tail-deleted"), ("x", "", None, False, "absent-not-wrap"),
        ("x", "The sea.", "It ended here.", False, "absent-not-wrap"), ("x", "wide", "It ended here.", False, "echo-or-duplicate-token"),
    ]
    rows = spark.createDataFrame([(1, "lines", r, t, p, i) for i, (r, t, p, _, _) in enumerate(drops)], "doc_id long, stage string, reason string, text string, prev string, i int")
    found = wraps.fates(rows, spark.createDataFrame([(1, "They looked over\nthe wide  sea.")], "doc_id long, text string"))
    assert [(r["wrap"], r["fate"]) for r in found.orderBy("i").collect()] == [(w, f) for *_, w, f in drops]
    counted = wraps.mechanisms(found, "doc_id")
    assert sorted((r["reason"], r["n"]) for r in counted.collect()) == [("recurring-line-running-header", 2), ("x", 1)]
    for known, verdict in ((2, "worse"), (3, "same"), (4, "better")):
        assert wraps.against_baseline(counted, spark.createDataFrame([(1, known)], "doc_id long, n long"), "doc_id").first()["verdict"] == verdict
    assert wraps.against_baseline(counted, spark.createDataFrame([], "doc_id long, n long"), "doc_id").first()["verdict"] == "unmeasured"


@pytest.mark.parametrize("text, parts", [("see 1. one 2) two a. three", ["see", "1. one", "2) two", "a. three"]), ("1. one", ["1. one"]), ("x 1. 2. y", ["x", "1.", "2. y"]), ("ends in 3.", ["ends in 3."]), ("", [""])])
def test_items_within_a_text(spark, text, parts):
    got = blocks.split_at_markers(spark.createDataFrame([(1, 0, text)], "doc_id long, line_no int, line string")).orderBy("nth").collect()
    assert [r["part"] for r in got] == parts


def test_listed_items_are_those_of_the_sql(spark, tmp_path):
    """Also of markers in a row, of which two passes leave some together, and between runs of blanks."""
    duckdb = pytest.importorskip("duckdb")
    dice = random.Random(4)
    said = ["a.", "B)", "12.", "3)", "1.", "x", "see", "K.", "\u212a.", "\u017f)", "\u00e9.", "ab.", "\x01"]
    blank = lambda: dice.choice((" ", " ", " ", "  ", "\t", "\r ", "\x0b", "\u00a0", " " * 9))
    texts = ["x 1. 2. y", "a. b. c. d. e. f. g. h", "", " ", "\n", " " * 100_000 + "x" + " " * 100_000 + "1. y"] + ["".join(blank() * dice.randint(0, 1) + w + blank() for w in dice.choices(said, k=dice.randint(1, 12))) for _ in range(2000)]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLE_SQL["document_list_items"]).fetchall()
    assert sorted(map(tuple, QUERIES["document_list_items"](spark, str(tmp_path)).collect())) == sorted(want) and sum(r[0] == 1 for r in want) < 8


def test_parts_glued_into_prose(spark):
    rows = [(1, 0, "so it ended. PARTII: The Sea", False), (1, 1, "partiv: ", False), (1, 2, "PARTII: The Sea", True), (1, 3, None, False), (1, 4, "PartX: All", False)]
    got = blocks.split_parts(spark.createDataFrame(rows, "doc_id long, pos int, text string, is_heading boolean")).orderBy("pos", "nth").collect()
    assert [(r["pos"], r["text"], r["chapter_title"]) for r in got] == [(0, "so it ended.", None), (0, "Part II", "Part II — The Sea"), (1, "partiv: ", None), (2, "PARTII: The Sea", None), (3, None, None), (4, "Part X", "Part X — All")]


def test_the_end_of_a_part(spark):
    texts = [("THE END OF", False), ("", False), ("Part two", False), ("prose", False), ("The end of.", False), ("plate", True), ("Part Three", False), ("THE END OF", False), ("prose", False), ("Part One", False)]
    got = blocks.end_of_parts(spark.createDataFrame([(1, i, t, False, image) for i, (t, image) in enumerate(texts)], "doc_id long, pos int, text string, is_heading boolean, is_image boolean")).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["The End of Part Two", "prose", "The end of.", "plate", "Part Three", "THE END OF", "prose", "Part One"]
    assert [r["is_heading"] for r in got] == [True] + [False] * 7


@pytest.mark.parametrize(
    "meta, file, early, catalog, title",
    [
        ("THE WIDE SEA", "x.pdf", "", False, "The Wide Sea"), ("untitled", "theWideSea.pdf", "", False, "The Wide Sea"), ("wide_sea_2", "the-wide_sea.pdf", "The Wide Sea: a Tale", False, "The Wide Sea"), (None, "other-book.pdf", "The Wide Sea", False, "The Wide Sea"),
        (None, "other-book.pdf", "The Wide Sea", True, "Other Book"), (None, "abc1984.pdf", "", False, "1984"), (None, None, "Classics®", False, "Classics®"), (None, None, None, None, ""), ("lord-of-flies", None, "", False, "Lord-Of-Flies"),
    ],
)
def test_title_of_a_book(spark, meta, file, early, catalog, title):
    row = spark.createDataFrame([(meta, file, early, catalog)], "m string, f string, e string, c boolean").select(blocks.resolve_title(*map(F.col, "mfec")).alias("t"))
    assert row.first()["t"] == title


@pytest.mark.parametrize("text, cased", [("the end of part iv", "The End of Part IV"), ("what it is for", "What It Is For"), ("a well-to-do man", "A Well-to-Do Man"), ("", "")])
def test_words_of_a_title(spark, text, cased):
    assert spark.createDataFrame([(text,)], "t string").select(T.book_cased(F.col("t")).alias("c")).first()["c"] == cased


@pytest.mark.parametrize("text, want, fault", [("front It  WAS so. The End. back", "It  WAS so. The End. ", None), ("front It was so. The end.", "It was so. The end.", None), ("The end. It was", "", "end"), ("no such", "", "start"), (None, "", "start")])
def test_body_between_anchors(spark, text, want, fault):
    got = spark.createDataFrame([(text,)], "t string").select(quality.body(F.col("t"), "it was", "the end", "back").alias("b")).first()["b"]
    assert (got["text"], got["fault"]) == (want, fault)


def test_changes_of_books(spark):
    schema = "doc_id long, words long, headings long, chapters long, titles array<string>, first string, last string"
    old = [(1, 1000, 10, 3, ["a"], "x", "y"), (2, 1000, 10, 3, ["a"], "x", "y"), (3, 0, 0, 0, None, None, None), (4, 1, 1, 1, [], "", "")]
    new = [(1, 1020, 11, 3, ["a"], "x", "y"), (2, 1021, 12, 4, ["b"], "x", "z"), (3, 9, 1, 0, None, None, None), (5, 1, 1, 1, [], "", "")]
    got = quality.book_changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).orderBy("doc_id").collect()
    assert [r["changes"] for r in got] == [[], ["words", "headings", "chapters", "titles", "last"], ["headings"], ["removed"], ["added"]]


def test_phrases_that_parsing_lost(spark):
    raw = spark.createDataFrame([("alpha beta gamma delta epsilon",), ("alpha beta gamma delta epsilon",), ("other words stand right here",), ("other words stand right here",)], "text string")
    parsed = spark.createDataFrame([("other words stand right here",)], "text string")
    assert [(r["phrase"], r["n"], r["score"]) for r in counts.lost_phrases(raw, parsed).collect()] == [("alpha beta gamma delta epsilon", 2, 10)]


@pytest.mark.parametrize(
    "pattern, texts, want",
    [
        (headings.POINTED, [("Chapter 5. THE FOX", True), ("AND THE CROW", False), ("He went home at last, and slept.", False), ("THE SEA", False)], ["Chapter 5 - The Fox and the Crow", "He went home at last, and slept.", "THE SEA"]),
        (headings.POINTED, [("letter II. To Her", True), ("Letter III. To Him.", True), ("prose of many more words than a title has in it", False)], ["Letter II - To Her", "Letter III - To Him", "prose of many more words than a title has in it"]),
        (headings.DASHED, [("Chapter 1 - The", True), ("Wide Sea", False), (None, False), ("Chapter 2 - Land", True)], ["Chapter 1 - The Wide Sea", None, "Chapter 2 - Land"]),
    ],
)
def test_titles_gathered(spark, pattern, texts, want):
    rows = spark.createDataFrame([(1, i, t, h) for i, (t, h) in enumerate(texts)], "doc_id long, pos int, text string, is_heading boolean")
    assert [r["text"] for r in headings.gathered(rows, pattern).orderBy("pos").collect()] == want


def test_parts_promoted(spark):
    rows = [(1, 0, "part two.", False, False, 10.0), (1, 1, "PART TWO", False, None, 20.0), (1, 2, "Part iv", None, None, None), (1, 3, "a part of it", False, False, 10.0), (1, 4, "Chapter 1", True, True, 30.0), (1, 5, None, None, None, None)]
    got = headings.promoted(spark.createDataFrame(rows, "doc_id long, pos int, text string, is_heading boolean, is_chapter_start boolean, font_size double")).orderBy("pos").collect()
    assert [(r["text"], r["is_chapter_start"], r["font_size"]) for r in got] == [("Part Two", True, 15.0), ("PART TWO", True, 15.0), ("Part IV", True, 15.0), ("a part of it", False, 10.0), ("Chapter 1", True, 15.0), (None, False, None)]


def test_chapter_headings_of_documents(spark):
    rows = spark.createDataFrame([(1, "Chapter 5"), (1, "prose"), (2, "Prologue: The Sea"), (3, "prose"), (3, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["chapters"], r["any"]) for r in headings.with_headings(rows).collect()) == [(1, 1, True), (2, 1, True), (3, 0, False)]


def test_blocks_of_an_export(spark):
    rows = [(1, 0, "went on", False, True), (1, 1, " and on ", False, True), (1, 2, " ", False, False), (1, 3, "then", None, True), (1, 4, None, True, None), (1, 5, "after", False, True), (1, 6, "new", False, None)]
    got = headings.exported(spark.createDataFrame(rows, "doc_id long, pos int, text string, is_image boolean, is_continuation boolean")).orderBy("pos").collect()
    assert [(r["pos"], r["is_image"], r["text"]) for r in got] == [(0, False, "went on and on then"), (4, True, ""), (5, False, "after"), (6, False, "new")]


@pytest.mark.parametrize("text, find, want", [("The other", "THE", [("The", True), (" o", False), ("the", True), ("r", False)]), ("a.b", ".", [("a", False), (".", True), ("b", False)]), ("none", "x", [("none", False)]), ("all", " ", [("all", False)])])
def test_text_marked(spark, text, find, want):
    got = spark.createDataFrame([(text,)], "t string").select(headings.marked(F.col("t"), find).alias("m")).first()["m"]
    assert [tuple(p) for p in got] == want


@pytest.mark.parametrize(
    "kind, number, title, raw, want",
    [
        ("prologue", None, "To Kill", None, "To Kill"), ("prologue", "", "", None, "Prologue"), ("interlude_divider", None, None, None, "Interludes"), ("part", "Part One", "Above", None, "Part One: Above"), ("interlude", "", "", "", "Interlude"),
        ("flashback", "1", "Years Ago", None, "Years Ago"), (None, "Chapter 5", "The Sea", None, "Chapter 5: The Sea"), (None, "Chapter 5", "chapter 5", None, "Chapter 5"), (None, None, None, "Chapter 7", "Chapter 7"), (None, None, None, "a fox", None),
    ],
)
def test_plates_in_the_contents(spark, kind, number, title, raw, want):
    rows = spark.createDataFrame([(1, 2, 3, kind, number, title, raw, None), (1, 2, 4, kind, number, title, raw, False)], "doc_id long, page int, block int, kind string, number string, title string, raw string, include boolean")
    assert [(r["block"], r["title"]) for r in headings.plate_entries(rows).collect()] == ([(3, want)] if want else [])


def test_document_to_open(spark):
    rows = spark.createDataFrame([(1, "a", 9, None), (2, "b", 4, 7)], "id long, name string, total_pages int, parser_version int")
    content = spark.createDataFrame([(1, 1, ["y"]), (1, 0, ["x"])], "id long, page int, blocks array<string>")
    got = catalog.opened(rows, content, spark.createDataFrame([(1, 0, "One")], "id long, seq int, title string"), 139).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 2, 139, [["x"], ["y"]], ["One"]), (2, "b", 4, 7, None, None)]
    assert rows.select(catalog.asset_path(F.col("id"), F.col("name")).alias("p")).first()["p"] == "books/1/images/a.jpg"
    assert [r["id"] for r in catalog.named(rows, "name", " B ").collect()] == [2]
    assert catalog.without_binaries(rows.withColumn("buffer", F.lit(b"x"))).columns == rows.columns


def test_paragraphs_up_to_a_size(spark):
    texts = ["One line", "goes on", None, "Ends here.", "New one"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")
    assert [r["text"] for r in blocks.capped_prose(rows, words=3).orderBy("block").collect()] == ["One line goes on", " Ends here.", "New one"]


def test_blocks_on_pages(spark):
    from quire.operators import reader

    texts = [("x" * 25, False, False), ("h", True, False), ("b", False, False), ("c", False, True), ("y" * 45, False, False), (None, False, False)]
    rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(texts)], "doc_id long, pos long, text string, is_heading boolean, is_chapter_start boolean")
    assert [r["page"] for r in reader.packed_pages(rows, rows=3, columns=10).orderBy("pos").collect()] == [1, 2, 2, 3, 4, 5]
