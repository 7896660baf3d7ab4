"""Every query of the engine by name, over the driver's tables, each with the DuckDB SQL that must give the same rows.

A source is read as a book, a document as a page, a text line as a line; orders stand for the library, events for progress
messages, lineitem for image geometry and parts for titles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import blocks, catalog, chapters, counts, export, headings, images, layout, pagemap, quality, reader, wraps
from quire.operators import lines as L
from quire.operators.drops import DUCKDB, REASONS_SQL, explained
from quire.sources.tables import LINES_SQL, lines, table
from quire.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_LINES = f"WITH {LINES_SQL} "
_PIECES = "WITH p AS (SELECT source, doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS piece_no, unnest(x) AS piece FROM (SELECT source, doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\n+') AS x FROM documents) t) "
_HEAD = "(length(line) <= 40 AND NOT regexp_matches(line, '[.!?]$') AND regexp_matches(line, '^[A-Z]'))"


def _heading():
    return (F.length("line") <= 40) & ~F.col("line").rlike("[.!?]$") & F.col("line").rlike("^[A-Z]")


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(_docs(spark, d))


@query("SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def word_counts(spark, d):
    return counts.words_by_document(_docs(spark, d))


@query("WITH w AS (SELECT source, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents) SELECT source, CAST(sum(words) AS BIGINT) AS words, count(*) AS docs, max(words) AS longest FROM w GROUP BY source")
def word_counts_by_source(spark, d):
    return counts.words_by_source(_docs(spark, d))


@query(_LINES + "SELECT source, line, count(DISTINCT doc_id) AS pages, min(doc_id) AS first_page FROM l GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3")
def recurring_lines(spark, d):
    return L.recurring(_lines(spark, d))


_REASONS = f"WITH {LINES_SQL}, {REASONS_SQL}"


@query(_REASONS + "SELECT reason, count(*) AS n, count(DISTINCT doc_id) AS docs FROM r GROUP BY reason")
def line_drop_reasons(spark, d):
    return explained(_lines(spark, d)).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(_REASONS + "SELECT doc_id, line_no, reason, line, prev, next FROM (SELECT *, lag(line) OVER w AS prev, lead(line) OVER w AS next FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) x WHERE starts_with(reason, 'drop-')")
def line_drop_trace(spark, d):
    return L.drops(_lines(spark, d))


@query(
    _PIECES + ", g AS (SELECT source, doc_id, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) AS page, piece_no, piece FROM p) "
    "SELECT DISTINCT a.source, a.doc_id, a.piece_no, a.piece FROM g a JOIN g b ON a.source = b.source AND abs(a.page - b.page) = 1 AND length(a.piece) BETWEEN 12 AND 96 AND NOT regexp_matches(a.piece, '[.!?][”\"’'']?\\s*$') AND length(b.piece) > length(a.piece) + 8 AND contains(b.piece, a.piece)"
)
def adjacent_page_echo(spark, d):
    return L.echoes(L.pieces(_docs(spark, d)))


@query(_LINES + "SELECT doc_id, count(*) AS n, CAST(list_sort(list(length(line)))[count(*) // 2 + 1] AS INTEGER) AS median FROM l GROUP BY doc_id")
def upper_median_line_len(spark, d):
    return L.median_lengths(_lines(spark, d))


@query(_LINES + "SELECT doc_id, line_no, CAST(length(line) - lag(length(line)) OVER w AS INTEGER) AS gap_above, CAST(lead(length(line)) OVER w - length(line) AS INTEGER) AS gap_below FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def line_gaps(spark, d):
    return L.gaps(_lines(spark, d))


@query(
    "WITH v AS (SELECT doc_id, length(line) AS x FROM l), a AS (SELECT doc_id, x, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) <= 2 THEN 0 ELSE 1 END AS new FROM v), "
    "b AS (SELECT doc_id, x, sum(new) OVER (PARTITION BY doc_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM a) "
    "SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS members, CAST(min(x) AS INTEGER) AS lo, CAST(max(x) AS INTEGER) AS hi FROM b GROUP BY doc_id, cluster".replace("WITH ", f"WITH {LINES_SQL}, ", 1)
)
def flush_left_clusters(spark, d):
    return L.clusters(_lines(spark, d).withColumn("x", F.length("line")), "doc_id", "x", 2)


@query(
    f"WITH {LINES_SQL}, f AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM l WHERE length(line) <= 40) "
    "SELECT doc_id, min(line_no) AS first, max(line_no) AS last, count(*) AS length FROM f GROUP BY doc_id, run"
)
def run_length_islands(spark, d):
    return L.islands(_lines(spark, d), "doc_id", "line_no", "length(line) <= 40")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 40 AS INTEGER) AS content_page, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) % 40 AS INTEGER) AS block_index FROM l")
def content_pages_40(spark, d):
    return blocks.content_pages(_lines(spark, d))


@query(_LINES + f"SELECT doc_id, line_no, last_value(CASE WHEN {_HEAD} THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM l")
def chapter_forward_fill(spark, d):
    marked = _lines(spark, d).withColumn("mark", F.when(_heading(), F.col("line")))
    return chapters.forward_fill(marked, "doc_id", "line_no", "mark", "chapter").select("doc_id", "line_no", "chapter")


@query(_LINES + "SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS nth FROM l) x WHERE nth = 1")
def chapter_dedupe_order(spark, d):
    return blocks.first_copies(_lines(spark, d))


@query("SELECT c_custkey, n_name AS title, r_name AS part FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def toc_lookup_left(spark, d):
    met = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return met.select("c_custkey", F.col("n_name").alias("title"), F.col("r_name").alias("part"))


@query("SELECT n_regionkey AS doc_id, n_nationkey AS key, n_name AS title FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nth FROM nation) x WHERE nth = 3")
def toc_nth_entry(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), F.lit("part").alias("kind"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("pos"))
    asked = rows.select("doc_id").distinct().select("doc_id", F.lit("part").alias("kind"), F.lit(-1).alias("key"), F.lit(3).alias("nth"))
    found = chapters.lookup(asked, rows)
    return found.join(rows.select("doc_id", "title", F.col("key").alias("at")), ["doc_id", "title"]).select("doc_id", F.col("at").alias("key"), "title")


@query(f"SELECT role, count(*) AS n FROM (SELECT {images.ROLE_SQL} AS role FROM (SELECT height, width / 400.0 AS w, height / 600.0 AS h, width / height AS shape FROM (SELECT l_quantity * 8.0 AS width, l_linenumber * 80.0 AS height FROM lineitem) a) b) c GROUP BY role")
def image_role_case(spark, d):
    shown = table(spark, d, "lineitem").select((F.col("l_quantity") * 8.0).alias("width"), (F.col("l_linenumber") * 80.0).alias("height"), F.lit(400.0).alias("page_width"), F.lit(600.0).alias("page_height"))
    return images.with_roles(shown).groupBy("role").agg(F.count("*").alias("n"))


@query(
    "WITH b AS (SELECT l_orderkey AS key, l_linenumber AS page, 'image' AS kind, l_suppkey AS seq, 0 AS f FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber, 'text', l_suppkey, 1 FROM lineitem WHERE l_returnflag <> 'R') "
    "SELECT key, page, kind, seq, CAST(row_number() OVER (PARTITION BY key ORDER BY page, f, seq) AS INTEGER) AS pos FROM b"
)
def interleave_union(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("seq"), "l_returnflag")
    return images.interleaved(rows.filter("l_returnflag <> 'R'"), rows.filter("l_returnflag = 'R'"))


@query("WITH l AS (SELECT s_nationkey AS doc_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS line_no, s_name AS line FROM supplier) SELECT doc_id, count(*) AS titles FROM l WHERE line_no < 12 AND regexp_matches(line, '^[A-Z][^.!?]*$') AND length(line) <= 60 GROUP BY doc_id HAVING count(*) >= 3")
def catalog_pages_having(spark, d):
    nth = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    return blocks.catalog_pages(table(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id"), nth.alias("line_no"), F.col("s_name").alias("line")))


@query(f"WITH {LINES_SQL}, n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id HAVING count(*) >= 5) SELECT l.doc_id, min(line_no) AS cut, max(n) AS n FROM l JOIN n ON l.doc_id = n.doc_id WHERE regexp_matches(lower(line), 'licen[cs]e|copyright') AND line_no >= floor(n * 0.8) GROUP BY l.doc_id")
def trailing_matter_cut(spark, d):
    return blocks.trailing_cut(_lines(spark, d), gate=5)


@query(f"WITH {LINES_SQL}, s AS (SELECT doc_id, line_no, string_split(regexp_replace(line, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS x FROM l) SELECT doc_id, line_no, CAST(unnest(range(len(x))) AS INTEGER) AS nth, unnest(x) AS part FROM s")
def dialogue_split(spark, d):
    return blocks.split_sentences(_lines(spark, d))


_LISTED = "SELECT n_regionkey AS doc_id, 0 AS line_no, string_agg(n_nationkey || '. ' || n_name, ' ' ORDER BY n_nationkey) AS line FROM nation GROUP BY n_regionkey"


#: Items of the lines l; the second pass finds markers whose blank the first took as the one behind the marker before.
_ITEMS = r"s AS (SELECT doc_id, line_no, string_split(regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '(?i)\s+((?:\d+|[a-z])[.)]\s)', chr(1) || '\1', 'g'), '(?i)\s+((?:\d+|[a-z])[.)]\s)', chr(1) || '\1', 'g'), chr(1)) AS x FROM l)"


@query(f"WITH l AS ({_LISTED}), {_ITEMS} SELECT doc_id, line_no, CAST(len(x) - 1 AS INTEGER) AS markers FROM s WHERE len(x) > 1")
def embedded_list_markers(spark, d):
    return blocks.list_markers(_listed(spark, d))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """The nations of a region as a list in one line."""
    each = F.sort_array(F.collect_list(F.struct("n_nationkey", F.concat("n_nationkey", F.lit(". "), "n_name").alias("said"))))
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_join(F.transform(each, lambda x: x["said"]), " ").alias("line")).select("doc_id", F.lit(0).alias("line_no"), "line")


@query(f"WITH l AS ({_LISTED}), {_ITEMS} SELECT doc_id, line_no, CAST(unnest(range(len(x))) AS INTEGER) AS nth, unnest(x) AS part FROM s")
def list_items_split(spark, d):
    return blocks.split_at_markers(_listed(spark, d))


@query(f"WITH {LINES_SQL}, {_ITEMS} SELECT doc_id, line_no, CAST(unnest(range(len(x))) AS INTEGER) AS nth, sha256(unnest(x)) AS print FROM s")
def document_list_items(spark, d):
    return blocks.split_in_passes(_lines(spark, d)).select("doc_id", "line_no", "nth", F.sha2("part", 256).alias("print"))



@query(
    f"WITH {LINES_SQL}, a AS (SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM l), "
    "c AS (SELECT doc_id, line_no, line, sum(CASE WHEN b IS NULL OR (regexp_matches(b, '[.!?]$') AND NOT regexp_matches(line, '^[a-z]')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM a) "
    "SELECT doc_id, CAST(block AS BIGINT) AS block, string_agg(line, ' ' ORDER BY line_no) AS text, min(line_no) AS first_line, count(*) AS n_lines FROM c GROUP BY doc_id, block"
)
def prose_blocks(spark, d):
    return blocks.prose(_lines(spark, d))


@query()
def capped_prose_blocks(spark, d):
    return blocks.capped_prose(_lines(spark, d))


@query(_LINES + "SELECT doc_id, count(*) AS n_lines, round(avg(CASE WHEN length(line) <= 55 AND NOT regexp_matches(line, '[.!?]$') THEN 1.0 ELSE 0.0 END), 6) AS short_share, count(*) >= 20 AND avg(CASE WHEN length(line) <= 55 AND NOT regexp_matches(line, '[.!?]$') THEN 1.0 ELSE 0.0 END) >= 0.6 AS is_poetry FROM l GROUP BY doc_id")
def poetry_classifier(spark, d):
    return blocks.poetry(_lines(spark, d))


_WORDS = "SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM {0}"
_STOPS = ", ".join(f"'{w}'" for w in counts.STOP)
_NUMERALS = ", ".join(f"'{w}'" for w in counts.NUMERALS)


@query(
    f"WITH t AS ({_WORDS.format('documents')}), i AS (SELECT t, unnest(range(1, len(t) - 2)) AS i FROM t WHERE len(t) >= 4), g AS (SELECT list_slice(t, i, i + 3) AS g FROM i) "
    f"SELECT array_to_string(g, ' ') AS phrase, count(*) AS n FROM g WHERE len(list_filter(g, lambda w: w IN ({_STOPS}))) / 4.0 <= 0.55 GROUP BY 1 HAVING count(*) >= 2 AND length(array_to_string(g, ' ')) >= 12"
)
def ngram_counts(spark, d):
    return counts.ngrams(_docs(spark, d))


@query(
    "WITH t AS (SELECT regexp_extract_all(lower(text), '[a-z]+|[0-9]+') AS t FROM documents), s AS (SELECT t, unnest([4, 5, 6]) AS size FROM t), i AS (SELECT t, size, unnest(range(1, len(t) - size + 2)) AS i FROM s WHERE len(t) >= size), g AS (SELECT size, list_slice(t, i, i + size - 1) AS g FROM i) "
    f"SELECT array_to_string(g, ' ') AS phrase, count(*) AS n FROM g WHERE len(list_filter(g, lambda w: w IN ({_STOPS}) OR regexp_full_match(w, '[0-9]+'))) / CAST(size AS DOUBLE) <= 0.55 GROUP BY 1 HAVING count(*) >= 2 AND length(array_to_string(g, ' ')) >= 12"
)
def ngram_counts_4_to_6(spark, d):
    return counts.ngrams(_docs(spark, d), longest=6, words=counts.words_and_numbers)


_FREQ = "(SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {0}) x GROUP BY word)"


@query(f"SELECT word, n, n * least(length(word), 12) AS impact FROM {_FREQ.format('documents')} a WHERE length(word) > 1 AND word NOT IN ({_STOPS}, {_NUMERALS}) AND word NOT IN (SELECT word FROM {_FREQ.format('benchmark')} b) ORDER BY impact DESC, word LIMIT 20")
def missing_words_topk(spark, d):
    return counts.missing(_docs(spark, d), table(spark, d, "benchmark"))


@query(
    f"SELECT count(*) AS words, CAST(sum(CASE WHEN a.word IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS found, round(sum(CASE WHEN a.word IS NULL THEN 0 ELSE 1 END) / count(*), 6) AS share, round(sum(CASE WHEN a.word IS NULL THEN 0 ELSE b.n END) / sum(b.n), 6) AS token_share "
    f"FROM {_FREQ.format('benchmark')} b LEFT JOIN {_FREQ.format('documents')} a ON a.word = b.word"
)
def word_coverage(spark, d):
    return counts.coverage(_docs(spark, d), table(spark, d, "benchmark"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) x GROUP BY word")
def word_frequencies(spark, d):
    return counts.frequencies(_docs(spark, d))


@query(_LINES + f"SELECT doc_id, line_no, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, line_no, sum(CASE WHEN {_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM l) x WHERE n > 3")
def sliding_heading_density(spark, d):
    return quality.density(_lines(spark, d).withColumn("h", _heading()), "doc_id", "line_no", "h").select("doc_id", "line_no", "n")


@query(
    f"WITH {LINES_SQL}, f AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM l WHERE {_HEAD}), r AS (SELECT doc_id, run, count(*) AS length FROM f GROUP BY doc_id, run) SELECT doc_id, max(length) AS longest FROM r GROUP BY doc_id"
)
def heading_runs_max(spark, d):
    return L.islands(_lines(spark, d).withColumn("h", _heading()), "doc_id", "line_no", "h").groupBy("doc_id").agg(F.max("length").alias("longest"))


@query("WITH l AS (SELECT p_size AS doc_id, p_partkey AS line_no, lower(p_name) AS line FROM part) SELECT doc_id, line_no FROM (SELECT doc_id, line_no, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM l) x WHERE b IS NOT NULL AND NOT regexp_matches(b, '[.!?]$') AND regexp_matches(line, '^[a-z]')")
def paragraph_continuity(spark, d):
    return quality.continuity(table(spark, d, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("line_no"), F.lower("p_name").alias("line")))


_BLOCKS = f"{LINES_SQL}, k AS (SELECT doc_id, line_no AS pos, line AS text, {_HEAD} AS is_heading FROM l), t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM k)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", F.col("line_no").alias("pos"), F.col("line").alias("text"), _heading().alias("is_heading"))


@query(
    f"WITH {_BLOCKS}, u AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\\s+'), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: w <> '') AS bare, len(regexp_split_to_array(t, '\\s+')) AS n FROM t WHERE is_heading AND t <> ''), "
    "v AS (SELECT *, len(list_filter(bare, lambda w: NOT regexp_matches(w, '^[A-Z]'))) = 0 AS titled FROM u) "
    f"SELECT doc_id, pos, text FROM v WHERE NOT (regexp_matches(t, '{quality.STRUCTURAL}') OR regexp_matches(t, '(?i)^To\\s+.+\\s+And$') OR regexp_matches(t, '^by\\s+[A-Z]')) AND (((regexp_matches(t, '{quality.OPEN}') OR regexp_matches(t, '(?i)\\b(?:{quality.DANGLING})\\s*$')) AND NOT (titled AND n = 1)) "
    f"OR (regexp_matches(t, '^[a-z]') AND NOT regexp_matches(t, '[.!?][”\"’'']?\\s*$') AND NOT regexp_matches(t, '[”\"’'']\\s*$')) OR length(t) > 120 OR (regexp_matches(t, '(?i)^(?:{quality.PRONOUNS})\\b') AND NOT titled))"
)
def false_headings(spark, d):
    return quality.false_headings(_blocks(spark, d))


@query(
    f"WITH {_BLOCKS}, p AS (SELECT *, lag(t) OVER w AS b, lag(is_heading) OVER w AS head FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) "
    "SELECT doc_id, pos, text FROM p WHERE regexp_matches(t, '^[“‘\"'']') AND length(t) < 80 AND b <> '' AND NOT coalesce(head, false) AND NOT regexp_matches(b, '^[“‘\"'']') AND NOT regexp_matches(b, '[.!?][”\"’'']?\\s*$') AND NOT regexp_matches(b, '[,;:—–-]\\s*$')"
)
def split_dialogue(spark, d):
    return quality.split_dialogue(_blocks(spark, d))


@query("SELECT event_type, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, count(*) AS n FROM events GROUP BY ALL")
def event_properties(spark, d):
    first = F.element_at(F.json_object_keys("props"), 1)
    value = F.element_at(F.from_json("props", "map<string,string>"), first)
    return table(spark, d, "events").groupBy("event_type", value.alias("first_value")).agg(F.count("*").alias("n"))


@query(_LINES + "SELECT doc_id, line_no, line FROM l WHERE length(line) BETWEEN 1 AND 55 AND NOT regexp_matches(line, '[.!?]$')")
def orphaned_fragments(spark, d):
    return quality.orphans(_lines(spark, d))


@query(_LINES + "SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(lower(line), 'https?://|www\\.|@[a-z0-9-]+\\.') GROUP BY doc_id")
def watermark_lines(spark, d):
    return quality.watermarks(_lines(spark, d))


@query("SELECT l_orderkey, l_linenumber AS chapter, l_suppkey AS lo, lead(l_suppkey) OVER w - 1 AS hi, coalesce(l_suppkey >= lag(l_suppkey) OVER w, true) AS ok FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) x WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def chapter_page_ranges_monotonic(spark, d):
    starts = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    return chapters.page_ranges(starts, "l_orderkey", "l_linenumber", "l_suppkey")


@query("SELECT e.user_id, e.event_id, m.mark FROM (SELECT user_id, event_id, ts FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS mark FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) m ON e.user_id = m.user_id AND e.ts >= m.ts")
def active_chapter_asof(spark, d):
    events = table(spark, d, "events")
    marks = events.filter("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    return reader.asof(events.filter("event_type <> 'signup'").select("user_id", "event_id", "ts"), marks, "user_id", "ts", "mark", "event_id").select("user_id", "event_id", "mark")


@query(f"WITH {LINES_SQL}, n AS (SELECT doc_id, line_no, length(regexp_replace(line, '\\s', '', 'g')) AS n FROM l), o AS (SELECT doc_id, line_no, sum(n) OVER (PARTITION BY doc_id ORDER BY line_no) - n AS lo FROM n) SELECT doc_id, line_no, CAST(lo // 1200 AS INTEGER) AS page FROM o")
def offset_to_page_range(spark, d):
    return reader.pages(_lines(spark, d))


@query()
def reader_pages_packed(spark, d):
    marked = _lines(spark, d).select("doc_id", F.col("line_no").cast("long").alias("pos"), F.col("line").alias("text"), _heading().alias("is_heading"), F.lit(False).alias("is_chapter_start"))
    return reader.packed_pages(marked)


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'the')) AS INTEGER) AS hits FROM documents WHERE len(regexp_extract_all(lower(text), 'the')) > 0")
def search_occurrences(spark, d):
    return reader.search(_docs(spark, d), "the")


@query(
    "WITH r AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS k, value FROM events) "
    "SELECT user_id, event_id, CAST(max(k) OVER w AS INTEGER) AS phase_rank, max(value) OVER w AS percent FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
def progress_monotone_merge(spark, d):
    return progress.merged(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", "value", ("signup", "view", "click", "purchase"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 100000 ORDER BY o_orderdate, o_orderkey LIMIT 5")
def outdated_topk(spark, d):
    rows = table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return catalog.outdated(rows, "o_totalprice", "at", 100000, 5).select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_custkey = 77 ORDER BY o_orderdate DESC")
def library_listing(spark, d):
    return catalog.listing(table(spark, d, "orders"), F.col("o_custkey") == 77, F.col("o_orderdate")).select("o_orderkey", "o_orderdate", "o_orderstatus")


@query("SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey")
def latest_status(spark, d):
    log = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return catalog.latest(log, "o_custkey", "at").select("o_custkey", "status")


@query(f"WITH {LINES_SQL} SELECT doc_id, count(*) AS blocks, left(arg_min(line, line_no), 40) AS first, left(arg_max(line, line_no), 40) AS last, left(sha256(string_agg(line, chr(10) ORDER BY line_no)), 12) AS print FROM l GROUP BY doc_id")
def snapshot_profile(spark, d):
    return quality.profile(_lines(spark, d))


@query(
    "WITH a AS (SELECT doc_id, sha256(CASE WHEN length(text) >= 500 THEN '1' ELSE '0' END) AS p FROM documents), b AS (SELECT doc_id, sha256(CAST(quality AS VARCHAR)) AS p FROM labels) "
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' WHEN a.p <> b.p THEN 'changed' ELSE 'same' END AS verdict FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id"
)
def snapshot_diff_full_outer(spark, d):
    old = _docs(spark, d).select("doc_id", F.sha2(F.when(F.length("text") >= 500, "1").otherwise("0"), 256).alias("print"))
    return quality.profile_diff(old, table(spark, d, "labels").select("doc_id", F.sha2(F.col("quality").cast("string"), 256).alias("print")))


@query(
    "WITH t AS (SELECT DISTINCT p_name || ' ' || p_brand AS title, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS k FROM part), c AS (SELECT * FROM t WHERE length(k) >= 9) "
    "SELECT a.title AS a, b.title AS b FROM c a JOIN c b ON a.title < b.title AND abs(length(a.k) - length(b.k)) <= 4 AND levenshtein(a.k, b.k) <= 4 AND 1 - levenshtein(a.k, b.k) / greatest(length(a.k), length(b.k)) >= 0.88"
)
def fuzzy_titles_levenshtein(spark, d):
    return quality.alike_titles(table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("title")))


@query("SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AS ok FROM lineitem GROUP BY l_orderkey")
def contiguity(spark, d):
    return quality.contiguous(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT role AS word FROM conversations EXCEPT ALL SELECT role FROM conversations WHERE turn > 0")
def bag_except_all(spark, d):
    turns = table(spark, d, "conversations")
    return turns.select(F.col("role").alias("word")).exceptAll(turns.filter("turn > 0").select("role"))


@query(
    "SELECT conv_id, string_agg('<p class=\"' || replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '\">' || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', chr(10) ORDER BY turn) AS html FROM conversations GROUP BY conv_id"
)
def html_export(spark, d):
    return export.conversations_html(table(spark, d, "conversations"))


@query(_LINES + "SELECT doc_id, arg_max(line, (s, -line_no)) AS title, max(s) AS score FROM (SELECT *, CASE WHEN NOT regexp_matches(line, '[a-z]') AND regexp_matches(line, '[A-Z]') AND length(line) <= 60 THEN 92 WHEN regexp_matches(line, '^[A-Z]') AND NOT regexp_matches(line, '[.!?]$') AND length(line) <= 60 THEN 88 WHEN length(line) <= 40 THEN 75 ELSE 68 END AS s FROM l WHERE line_no < 40) x GROUP BY doc_id")
def book_titles(spark, d):
    return blocks.title_score(_lines(spark, d))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '^\\s+|\\s+$', '', 'g'), '[^a-z0-9]', '', 'g') AS title_key FROM documents")
def title_keys(spark, d):
    return _docs(spark, d).select("doc_id", T.title_key(T.trimmed(F.substring_index("text", "\n", 1))).alias("title_key"))


@query("SELECT page_id, CAST(length(html) AS INTEGER) AS n, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS paragraphs, contains(html, '&amp;') AS escaped FROM pages")
def page_markup(spark, d):
    return table(spark, d, "pages").select("page_id", F.length("html").alias("n"), F.regexp_count("html", F.lit("<p[ >]")).alias("paragraphs"), F.col("html").contains("&amp;").alias("escaped"))


@query("WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*\\s*|[.!?]+\\s*') AS x FROM documents), e AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS nth, unnest(x) AS part FROM p) SELECT doc_id, nth, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY nth) - length(part) AS BIGINT) AS start, CAST(length(part) AS INTEGER) AS size FROM e")
def sentence_spans(spark, d):
    return reader.sentences(_docs(spark, d))


@query("WITH p AS (SELECT doc_id, string_split(lower(text), 'tion') AS x FROM documents), e AS (SELECT doc_id, unnest(range(1, len(x))) AS i, x FROM p WHERE len(x) > 1) SELECT doc_id, CAST(i AS INTEGER) AS ordinal, right(x[i], 20) AS before FROM e")
def phrase_occurrences(spark, d):
    return reader.occurrences(_docs(spark, d), "tion")


@query(f"WITH {LINES_SQL}, b AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 40 AS p, line_no, line FROM l) SELECT doc_id, CAST(p AS INTEGER) AS content_page, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS print FROM b GROUP BY doc_id, p")
def content_pages_nested(spark, d):
    held = _lines(spark, d)
    pages = blocks.content_pages(held).join(held, ["doc_id", "line_no"])
    return blocks.nested(pages).select("doc_id", "content_page", F.size("blocks").cast("long").alias("n"), F.sha2(F.array_join("blocks", "\n"), 256).alias("print"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 100.0 ELSE greatest(coalesce(o_totalprice / 10000, 0), 12.5) END AS percent FROM orders")
def status_percent(spark, d):
    ready = F.when(F.col("o_orderstatus") == "F", "ready")
    return table(spark, d, "orders").select("o_orderkey", catalog.percent(ready, F.col("o_totalprice") / 10000, F.lit(12.5)).alias("percent"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus = 'F' AND (o_custkey % 5 <> 3 OR o_totalprice > 200000)")
def stale_documents(spark, d):
    rows = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "ready").otherwise("pending"))
    due = rows.filter(catalog.needs_work(F.col("status"), F.col("o_custkey") % 5, 3, F.col("o_totalprice") > 200000))
    return due.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'renamed ' || c_mktsegment ELSE c_name END AS c_name FROM customer WHERE c_custkey % 9 <> 0")
def library_rename_and_delete(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    changes = rows.filter("c_custkey % 4 = 0").select("c_custkey", F.concat(F.lit("renamed "), "c_mktsegment").alias("name"))
    return catalog.deleted(catalog.renamed(rows, changes, "c_custkey", "c_name"), rows.filter("c_custkey % 9 = 0"), "c_custkey").select("c_custkey", "c_name")


@query("WITH a AS (SELECT l_orderkey AS doc_id, l_partkey AS id FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT l_orderkey AS doc_id, l_partkey AS id FROM lineitem WHERE l_linenumber >= 2) SELECT doc_id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.id = b.id)) x GROUP BY doc_id")
def chapters_with_unseen(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("id"), "l_linenumber")
    return chapters.with_unseen(rows.filter("l_linenumber <= 2").drop("l_linenumber"), rows.filter("l_linenumber >= 2").drop("l_linenumber")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS doc_id, l_suppkey AS seq, l_partkey AS part, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END, 2147483647), CAST(l_quantity AS INTEGER), l_suppkey, l_partkey) AS INTEGER) AS place FROM lineitem")
def reading_order(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("page_index"), F.col("l_quantity").cast("int").alias("block_index"), F.struct("l_suppkey", "l_partkey").alias("seq")
    )
    return chapters.reading_order(rows).select("doc_id", F.col("seq.l_suppkey").alias("seq"), F.col("seq.l_partkey").alias("part"), "place")


@query("SELECT user_id, event_id, max(CASE WHEN event_type = 'click' THEN k END) OVER (PARTITION BY user_id ORDER BY k RANGE BETWEEN 200 PRECEDING AND 1 PRECEDING) AS image_before, min(CASE WHEN event_type = 'click' THEN k END) OVER (PARTITION BY user_id ORDER BY k RANGE BETWEEN 1 FOLLOWING AND 200 FOLLOWING) AS image_after FROM (SELECT *, CAST(event_id AS INTEGER) AS k FROM events) x")
def nearest_images(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), "event_id", F.col("event_id").cast("int").alias("page"), (F.col("event_type") == "click").alias("is_image"))
    return images.nearest(rows, 200).select(F.col("doc_id").alias("user_id"), "event_id", "image_before", "image_after")


@query(_LINES + "SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(trim(line), '^[\"“‘]')) AS dialogue, count(*) FILTER (WHERE length(regexp_replace(line, '[^A-Z]', '', 'g')) >= 2 AND NOT regexp_matches(line, '[a-z]') AND length(regexp_replace(line, '[^\\p{L}]', '', 'g')) = length(regexp_replace(line, '[^\\p{Lu}]', '', 'g'))) AS capitals FROM l GROUP BY doc_id")
def line_shapes(spark, d):
    from quire.functions import predicates as P

    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    capitals = P.all_caps(F.col("line")) & (F.length(F.regexp_replace("line", "[^A-Z]", "")) >= 2)
    return _lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), hit(P.dialogue(F.col("line"))).alias("dialogue"), hit(capitals).alias("capitals"))


@query("SELECT doc_id, round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.0 / greatest(len(list_filter(regexp_split_to_array(text || ' one two', '\\s+'), lambda x: x <> '')), 1), 6) AS ratio, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.0 / greatest(len(list_filter(regexp_split_to_array(text || ' one two', '\\s+'), lambda x: x <> '')), 1) >= 0.9 AS ok FROM documents")
def word_count_against_raw(spark, d):
    docs = _docs(spark, d).select("doc_id", "text")
    return quality.word_ratio(docs, docs.withColumn("text", F.concat("text", F.lit(" one two"))))


_FATES = (
    _REASONS.rstrip() + f", x AS (SELECT *, lag(line) OVER w AS prev FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), y AS (SELECT doc_id, {wraps.folded_sql('string_agg(line, chr(10) ORDER BY line_no)')} AS hay FROM r WHERE NOT starts_with(reason, 'drop-') GROUP BY doc_id), "
    f"z AS (SELECT x.doc_id, line_no, substr(reason, 6) AS reason, {wraps.folded_sql('line')} AS t, {wraps.folded_sql('prev')} AS p, coalesce(hay, '') AS hay FROM x LEFT JOIN y ON x.doc_id = y.doc_id WHERE starts_with(reason, 'drop-')), "
    f"u AS (SELECT *, {wraps.wrap(DUCKDB)} AS wrap FROM z), fates AS (SELECT doc_id, line_no, reason, wrap, {wraps.FATE} AS fate FROM u) "
)


def _fates(spark: SparkSession, d: str) -> DataFrame:
    """Dropped lines of each document against what stays of it."""
    return wraps.line_fates(explained(_lines(spark, d), by_page=True))


@query(_FATES + "SELECT doc_id, line_no, reason, wrap, fate FROM fates")
def wrap_tail_fates(spark, d):
    return _fates(spark, d).select("doc_id", "line_no", "reason", "wrap", "fate")


@query(_FATES + "SELECT 'lines' AS stage, reason, count(*) AS n FROM fates WHERE wrap AND fate IN ('wrap-tail-deleted', 'wrap-tail-token-elsewhere') GROUP BY reason")
def wrap_tail_mechanisms(spark, d):
    return wraps.mechanisms(_fates(spark, d))


#: Lines of documents with places on a page that follow from their number and length.
_PLACED = f"WITH {LINES_SQL}, g AS (SELECT doc_id, CAST(line_no // 30 AS INTEGER) AS page_index, line_no, line AS text, CAST((line_no * 37 + length(line)) % 120 AS DOUBLE) AS x, CAST((line_no * 37 + length(line)) % 120 + 4 * length(line) AS DOUBLE) AS right_edge, CAST(9 + (line_no % 4) * 3 AS DOUBLE) AS font_size FROM l), "


def _placed(spark: SparkSession, d: str) -> DataFrame:
    n, at = F.length("line"), F.col("line_no")
    x = ((at * 37 + n) % 120).cast("double")
    return _lines(spark, d).select("doc_id", F.floor(at / 30).cast("int").alias("page_index"), "line_no", F.col("line").alias("text"), x.alias("x"), (x + 4 * n).alias("right_edge"), (9 + (at % 4) * 3).cast("double").alias("font_size"))


@query(_PLACED + layout.CENTRED_SQL + " SELECT doc_id, line_no, centred FROM v")
def centred_lines(spark, d):
    return layout.with_centred(_placed(spark, d)).select("doc_id", "line_no", "centred")


@query(_PLACED + layout.CENTRED_SQL + layout.NOTED_SQL + " SELECT doc_id, line_no, verdict FROM n")
def margin_notes(spark, d):
    return layout.noted(_placed(spark, d)).select("doc_id", "line_no", "verdict")


@query(
    "WITH RECURSIVE pg AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, month(o_orderdate) AS m FROM orders), r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS seq, CAST(1 AS BIGINT) AS low, CAST(NULL AS BIGINT) AS page FROM pg "
    "UNION ALL SELECT r.doc_id, r.seq + 1, coalesce(min(pg.page), min(r.low)), min(pg.page) FROM r LEFT JOIN pg ON pg.doc_id = r.doc_id AND pg.m = r.seq + 1 AND pg.page >= r.low WHERE r.seq < 12 GROUP BY r.doc_id, r.seq) SELECT doc_id, seq, page FROM r WHERE page IS NOT NULL"
)
def chapter_page_map(spark, d):
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    pages = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), nth.alias("page"), F.array(F.concat(F.lit("CHAPTER "), F.month("o_orderdate"))).alias("titles"), F.array().cast("array<string>").alias("ids"))
    chapters_ = pages.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("seq")).select("doc_id", "seq", F.concat(F.lit("c"), "seq").alias("id"), F.concat(F.lit("Chapter "), "seq", F.lit(" - A Month")).alias("title"))
    return pagemap.chapter_pages(pages, chapters_).select("doc_id", "seq", "page")


@query(
    "WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'click ' || event_id END AS own, CASE WHEN event_type = 'purchase' THEN 'bought ' || event_id END AS entry FROM events), "
    "f AS (SELECT user_id, event_id, last_value(own IGNORE NULLS) OVER w AS own, last_value(entry IGNORE NULLS) OVER w AS entry FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, coalesce(own, entry, '') AS title FROM f"
)
def margin_chapter_titles(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page"), "event_type")
    pages = rows.select("doc_id", "page", F.when(F.col("event_type") == "click", F.array(F.concat(F.lit("click "), "page"))).alias("titles"), F.lit(False).alias("is_title_page"))
    entries = rows.filter("event_type = 'purchase'").select("doc_id", "page", F.concat(F.lit("bought "), "page").alias("title"))
    return pagemap.margin_titles(pages, entries).select(F.col("doc_id").alias("user_id"), F.col("page").alias("event_id"), "title")


@query(
    f"WITH {LINES_SQL}, n AS (SELECT doc_id, line_no + 1 AS page, sum(length(regexp_replace(line, '\\s', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY line_no) AS hi FROM l), a AS (SELECT doc_id, doc_id * 37 % 900 AS spot FROM documents) "
    "SELECT a.doc_id, CAST(CASE WHEN a.spot > 0 THEN coalesce(min(CASE WHEN a.spot < n.hi THEN n.page END), max(n.page)) ELSE greatest(1, floor(0.5 * count(n.page) + 0.5)) END AS INTEGER) AS page FROM a JOIN n ON a.doc_id = n.doc_id GROUP BY a.doc_id, a.spot"
)
def page_after_repagination(spark, d):
    pages = _lines(spark, d).select("doc_id", (F.col("line_no") + 1).alias("page"), F.array("line").alias("items"))
    anchors = _docs(spark, d).select("doc_id", (F.col("doc_id") * 37 % 900).alias("offset"), F.lit(None).cast("string").alias("prefix"), F.lit(1).alias("old_page"), F.lit(2).alias("old_total"))
    return pagemap.page_after(anchors, pages).select("doc_id", "page")


@query(
    "WITH a AS (SELECT doc_id, text, strpos(lower(text), 'the') AS spot FROM documents), b AS (SELECT doc_id, CASE WHEN spot > 0 THEN substr(text, spot) END AS rest FROM a), c AS (SELECT doc_id, rest, strpos(lower(rest), 'and') AS past FROM b), "
    "e AS (SELECT doc_id, rest, past, CASE WHEN past > 0 THEN strpos(lower(substr(rest, past + 3)), 'of') END AS cut FROM c) "
    "SELECT doc_id, CASE WHEN rest IS NULL THEN 'start' WHEN past = 0 THEN 'end' END AS fault, CAST(length(CASE WHEN rest IS NULL OR past = 0 THEN '' WHEN cut > 0 THEN left(rest, past + 2 + cut - 1) ELSE rest END) AS INTEGER) AS n FROM e"
)
def body_windows(spark, d):
    return _docs(spark, d).select("doc_id", quality.body(F.col("text"), "the", "and", "of").alias("b")).select("doc_id", "b.fault", F.length("b.text").alias("n"))


@query(
    "WITH a AS (SELECT o_orderkey AS doc_id, CAST(floor(o_totalprice) AS BIGINT) AS words, o_custkey % 5 AS headings, o_custkey % 7 AS chapters FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT l_orderkey AS doc_id, CAST(floor(sum(l_quantity * 1000)) AS BIGINT) AS words, count(*) AS headings, max(l_linenumber) AS chapters FROM lineitem GROUP BY l_orderkey) "
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'removed' WHEN a.doc_id IS NULL THEN 'added' ELSE concat_ws(' ', CASE WHEN a.words > 0 AND abs(b.words - a.words) / CAST(a.words AS DOUBLE) > 0.02 THEN 'words' END, "
    "CASE WHEN (a.headings > 0 AND abs(b.headings - a.headings) / CAST(a.headings AS DOUBLE) > 0.1) OR (a.headings = 0 AND b.headings <> 0) THEN 'headings' END, CASE WHEN a.chapters <> b.chapters THEN 'chapters' END) END AS changes FROM a FULL JOIN b ON a.doc_id = b.doc_id"
)
def book_changes_tolerant(spark, d):
    none, blank = F.array().cast("array<string>").alias("titles"), [F.lit("").alias("first"), F.lit("").alias("last")]
    old = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc_id"), F.floor("o_totalprice").alias("words"), (F.col("o_custkey") % 5).alias("headings"), (F.col("o_custkey") % 7).alias("chapters"), none, *blank)
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.floor(F.sum(F.col("l_quantity") * 1000)).alias("words"), F.count("*").alias("headings"), F.max("l_linenumber").cast("long").alias("chapters"))
    return quality.book_changes(old, new.select("*", none, *blank)).select("doc_id", F.array_join("changes", " ").alias("changes"))


@query(
    f"WITH {LINES_SQL}, a AS (SELECT doc_id, line_no, line_no % 7 = 3 AS is_image, trim(line) AS text, regexp_matches(line, '^[a-z]') AS goes FROM l), b AS (SELECT * FROM a WHERE is_image OR text <> ''), "
    "c AS (SELECT *, CASE WHEN NOT is_image AND goes AND lag(is_image) OVER (PARTITION BY doc_id ORDER BY line_no) = false THEN 0 ELSE 1 END AS new FROM b), e AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM c) "
    "SELECT doc_id, min(line_no) AS pos, arg_min(is_image, line_no) AS is_image, sha256(string_agg(text, ' ' ORDER BY line_no)) AS print FROM e GROUP BY doc_id, run"
)
def export_blocks_merged(spark, d):
    rows = _lines(spark, d).select("doc_id", F.col("line_no").alias("pos"), F.col("line").alias("text"), (F.col("line_no") % 7 == 3).alias("is_image"), F.col("line").rlike("^[a-z]").alias("is_continuation"))
    return headings.exported(rows).select("doc_id", "pos", "is_image", F.sha2("text", 256).alias("print"))


#: Parts as the blocks of books, one for each size: labels with titles, tails of titles, and other blocks.
_TITLED = "SELECT p_size AS doc_id, p_partkey AS pos, CASE p_partkey % 5 WHEN 0 THEN 'Chapter ' || (p_partkey % 40 + 1) || '. ' || p_name WHEN 1 THEN upper(p_type) WHEN 2 THEN p_brand || ' is what they said to them there.' ELSE p_name END AS text, p_partkey % 5 < 2 AS is_heading FROM part"


@query(
    f"WITH b AS ({_TITLED}), c AS (SELECT *, trim(text) AS t, is_heading AND regexp_matches(trim(text), '{headings.POINTED}') AS opens FROM b), e AS (SELECT *, opens OR NOT {headings.tail(DUCKDB)} AS first FROM c), "
    "f AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM e), g AS (SELECT *, bool_or(opens) OVER (PARTITION BY doc_id, run) AS joins FROM f), "
    f"h AS (SELECT doc_id, run, string_agg(CASE WHEN opens THEN regexp_replace(t, '{headings.POINTED}', 'Chapter \\2 - \\3') ELSE t END, ' ' ORDER BY pos) AS said FROM g WHERE joins GROUP BY doc_id, run) "
    "SELECT g.doc_id, g.pos, CASE WHEN opens THEN said ELSE text END AS text, opens AS is_chapter_start FROM g LEFT JOIN h ON g.doc_id = h.doc_id AND g.run = h.run WHERE opens OR NOT joins"
)
def chapter_titles_gathered(spark, d):
    return headings.gathered(table(spark, d, "part").selectExpr(*_TITLED.removeprefix("SELECT ").removesuffix(" FROM part").split(", "))).select("doc_id", "pos", "text", "is_chapter_start")


@query("WITH b AS (SELECT p_size AS doc_id, p_partkey AS pos, CASE WHEN p_partkey % 11 = 0 THEN 'Part Two' ELSE p_name END AS text, p_partkey % 29 = 0 AS plate FROM part) SELECT doc_id, pos FROM (SELECT *, bool_or(plate) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 23 FOLLOWING) AS again FROM b) x WHERE text = 'Part Two' AND again")
def parts_before_plates(spark, d):
    at = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.col("p_size").alias("doc_id"), at.alias("pos"), F.when(at % 11 == 0, "Part Two").otherwise(F.col("p_name")).alias("text"), F.when(at % 29 == 0, "part").alias("plate"))
    return headings.before_plates(rows)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'er#00000001')")
def library_filter(spark, d):
    return catalog.named(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", " ER#00000001")


@query("WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)(the)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents), e AS (SELECT doc_id, unnest(range(len(x))) AS i, x FROM p) SELECT doc_id, count(*) FILTER (WHERE i % 2 = 1) AS hits, count(*) AS pieces, sha256(string_agg(x[i + 1], '|' ORDER BY i)) AS print FROM e WHERE x[i + 1] <> '' GROUP BY doc_id")
def highlighted_text(spark, d):
    rows = _docs(spark, d).filter("text <> ''").select("doc_id", headings.marked(F.col("text"), "the").alias("m"))
    return rows.select("doc_id", F.size(F.filter("m", lambda p: p["hit"])).cast("long").alias("hits"), F.size("m").cast("long").alias("pieces"), F.sha2(F.array_join(F.transform("m", lambda p: p["text"]), "|"), 256).alias("print"))


@query("SELECT o_custkey AS id, count(*) AS pages, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS content FROM orders GROUP BY o_custkey")
def opened_documents(spark, d):
    orders = table(spark, d, "orders")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("total_pages"), F.lit(None).cast("int").alias("parser_version"))
    content = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("blocks"))
    held = catalog.opened(rows, content, content.select("id", F.col("page").alias("seq"), F.col("blocks").alias("title")), 1)
    return held.filter("content IS NOT NULL").select("id", F.col("total_pages").alias("pages"), F.array_join("content", "").alias("content"))
