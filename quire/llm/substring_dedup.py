"""Substring dedup: content-defined chunks by a gear rolling hash, windows of them that repeat as a whole, joined to passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.kernels import IS_SPACE, SEEDS, SEGMENT, digests, groups, joined, mix, strings, word_places
from quire.llm.shared import keep_only, stored, table
from quire.session import ship

#: Bytes the gear hash looks back, mean distance of its cuts, and bytes without a cut that a cut needs before it.
LOOK_BACK, MEAN, QUIET = 16, 24, 6
#: Words of a window of chunks that must repeat as a whole, and of a repeated passage. A passage loses a part of a chunk at either end.
MIN_WORDS = 14
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def _hits(part: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places, with LOOK_BACK more before each text, where the gear hash has its lead bits at zero."""
    place = np.arange(len(part)) + LOOK_BACK * np.repeat(np.arange(1, len(own)), np.diff(own))
    gear = np.zeros(len(part) + LOOK_BACK * len(own), np.uint64)  # with a gap of zeros before each text
    gear[place] = _GEAR[part]
    step = 1
    while step < LOOK_BACK:
        gear[step:] = gear[step:] + (gear[:-step] << np.uint64(step))
        step *= 2
    return place[(mix(gear[place]) >> np.uint64(32)) % np.uint64(MEAN) == 0]


def _far(hits: np.ndarray) -> np.ndarray:
    """Of increasing places, those without another one up to QUIET before them."""
    return hits[np.diff(hits, prepend=-QUIET - 1) > QUIET]


def cut_ends(part: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where chunks end, in bytes from the start of part, with the end of each text that isn't empty."""
    if len(own) == 2:  # a long text is read in pieces, each with what the first decision in it looks back on
        found = []
        for a in range(0, len(part), SEGMENT):
            lo = max(0, a - LOOK_BACK - QUIET)
            hits = _hits(part[lo : a + SEGMENT], np.array([0, min(len(part), a + SEGMENT) - lo])) - LOOK_BACK
            hits = _far(hits[hits >= (LOOK_BACK - 1 if lo else 0)]) + lo
            found.append(hits[hits >= a] + 1)
        cut = np.concatenate(found) if found else np.zeros(0, np.int64)
    else:
        far = _far(_hits(part, own))
        gaps = own[:-1] + LOOK_BACK * np.arange(1, len(own))  # where each text begins among these places
        cut = far - LOOK_BACK * np.searchsorted(gaps, far, side="right") + 1
    return np.unique(np.concatenate([cut, own[1:][np.diff(own) > 0]])).astype(np.int64)


def sequences(x: np.ndarray, y: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes for the sequence of the spans[k] hashes from k on, by doubling: hashes of 1, 2, 4, ... neighbours are made
    of those of half as many, and a span is put together of those whose sizes add up to it."""
    found, at, left, n = (np.full(len(x), SEEDS[0]), np.full(len(x), SEEDS[1])), np.arange(len(x)), spans.copy(), 1
    while left.any():
        own = np.flatnonzero(left & 1)
        lanes = joined((found[0][own], found[1][own]), (x[at[own]], y[at[own]]))
        found[0][own], found[1][own] = lanes
        at[own] += n
        left >>= 1
        if left.any():
            x, y = joined((x[:-n], y[:-n]), (x[n:], y[n:]))
            x, y = (np.concatenate([lane, np.zeros(n, np.uint64)]) for lane in (x, y))
        n *= 2
    return found


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, end, digest, words) of windowed(), the digest being that of the chunk alone."""
    part, own = data[at[0] : at[-1]], (at - at[0]).astype(np.int64)
    text, ends, words = windowed(data, at, 0)[:3]
    stops = ends + own[text]
    return text, ends, digests(part, np.concatenate([[0], stops[:-1]])[: len(stops)], stops)[0], words


def windowed(data: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, end, words, window, check, span) of every chunk of the texts data[at[i]:at[i+1]]; ends are bytes from the text's start.

    The gear hash of a place is the sum of a random value of each of the last LOOK_BACK bytes, doubled for each byte since:
    it depends on these bytes alone, so the same passage is cut alike wherever it stands. A place whose hash has its lead
    bits at zero is a cut, unless another such place lies up to QUIET bytes before it. No chunk is cut by length.
    words counts the words that begin in the chunk. The window of a chunk is the fewest chunks from it on that hold least
    words, by their own bytes alone: a part of a word that they start with counts as one. window and check are 64 and 32
    bits of a digest of all its chunks' bytes, and span counts its chunks, 0 where the text ends before.
    """
    part, own = data[at[0] : at[-1]], (at - at[0]).astype(np.int64)
    if not len(part):
        return (np.zeros(0, np.int64),) * 6
    ends = cut_ends(part, own)
    starts = np.concatenate([[0], ends[:-1]])
    begins = word_places(part, own)[0]
    before, upto = np.searchsorted(begins, starts, side="right"), np.searchsorted(begins, ends)
    whose, k = np.searchsorted(own[1:], starts, side="right"), np.arange(len(ends))
    last = np.maximum(k, np.searchsorted(upto, before + least - ~IS_SPACE[part[starts]]))
    whole = (last < len(ends)) & (whose[np.minimum(last, len(ends) - 1)] == whose) & (least > 0)
    spans = np.where(whole, last - k + 1, 0)
    x, y = sequences(*digests(part, starts, ends), spans) if least else (k.astype(np.uint64),) * 2
    return whose, ends - own[whose], np.diff(upto, prepend=0), x.view(np.int64), (y >> np.uint64(32)).astype(np.uint32).view(np.int32), spans


FIELDS = "row long, doc_id long, windows array<long>, checks array<int>, spans array<int>, ends array<int>, words array<int>"
FOUND = "row long, doc_id long, start long, end long, words long, first_doc_id long, kept boolean"


def _chunk(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    keep_only("chunks")
    for batch in batches:
        data, at = strings(batch.column(2))
        for i, own in groups(data, at):
            whose, ends, words, windows, checks, spans = windowed(data, own, least)
            n = len(own) - 1
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (windows, checks.astype(np.int32), *(x.astype(np.int32) for x in (spans, ends, words)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), *lists], names=["row", "doc_id", "windows", "checks", "spans", "ends", "words"])


def _runs(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Passages of texts (row, doc_id, spans, ends, words, met), where met has the place and first document of repeated windows."""
    for batch in batches:
        if not len(batch):
            continue
        row, doc, spans, ends, words = *(np.asarray(batch.column(i)) for i in (0, 1)), *(np.asarray(batch.column(i).flatten()) for i in (2, 3, 4))
        sizes, found = (np.asarray(pc.list_value_length(batch.column(i))) for i in (3, 5))
        base, met = np.concatenate([[0], np.cumsum(sizes)]), batch.column(5).flatten()
        text = np.repeat(np.arange(len(doc)), sizes)
        first = np.asarray(met.field("first"))
        at = np.repeat(base[:-1], found) + np.asarray(met.field("nth"))
        here = first == np.repeat(doc, found)
        covered = []
        for which in (here, ~here):
            a = at[which]
            covered.append(np.cumsum(np.bincount(a, minlength=len(text) + 1) - np.bincount(a + spans[a], minlength=len(text) + 1))[:-1] > 0)
        state = np.where(covered[1], 2, np.where(covered[0], 1, 0))
        heads = np.flatnonzero(np.concatenate([[True], (state[1:] != state[:-1]) | (text[1:] != text[:-1])]))
        tails = np.append(heads[1:], len(text))
        upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
        run = np.searchsorted(heads, np.arange(len(text)), side="right") - 1
        low = np.full(len(heads), np.iinfo(np.int64).max)
        far = ~here
        np.minimum.at(low, run[at[far]], first[far])
        own = state[heads] == 1
        low = np.where(own, doc[text[heads]], low)
        good = np.flatnonzero((state[heads] > 0) & (upto[tails] - upto[heads] >= min_words))
        h, t = heads[good], tails[good]
        start = np.where(h > base[text[h]], ends[np.maximum(h - 1, 0)], 0)
        columns = [row[text[h]], doc[text[h]], start.astype(np.int64), ends[t - 1].astype(np.int64), upto[t] - upto[h], low[good], own[good]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["row", "doc_id", "start", "end", "words", "first_doc_id", "kept"])


def _passages(rows: DataFrame, min_words: int) -> DataFrame:
    """FOUND for rows (row, doc_id, text), where row is a number of its own for each."""
    cut = stored(rows.filter("doc_id IS NOT NULL").mapInArrow(lambda batches: _chunk(batches, min_words), FIELDS), "chunks")
    windows = cut.select("row", "doc_id", F.posexplode(F.arrays_zip("windows", "checks", "spans")).alias("nth", "c")).filter("c.spans > 0").select("row", "doc_id", "nth", F.col("c.windows").alias("window"), F.col("c.checks").alias("check"))
    repeated = windows.groupBy("window", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    repeated = stored(repeated.select("window", "check", "first"), "repeated")
    met = windows.select("row", "nth", "window", "check").join(repeated, ["window", "check"]).groupBy("row").agg(F.collect_list(F.struct("nth", "first")).alias("met"))
    return cut.drop("windows", "checks").join(met, "row").select("row", "doc_id", "spans", "ends", "words", "met").mapInArrow(lambda batches: _runs(batches, min_words), FOUND)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, end, words, first_doc_id, kept): a row for each repeated passage in each document that has it.

    A window is the fewest chunks one after the other that hold min_words words. It is repeated if the digest (96 bits) of
    its chunks occurs in documents of different ids, so common phrases that only stand side by side here make no passage. Chunks
    of repeated windows one after the other, with at least min_words words in all, are a passage; it ends where chunks of
    windows that first occur elsewhere meet chunks whose windows all first occur here. start and end are bytes of the UTF-8
    text, end exclusive. first_doc_id is the smallest id that has a window of it, and kept says that this document has the
    first occurrence of all its windows, so the passage stays here and goes elsewhere; without kept, each of its chunks is in
    a window that first occurs elsewhere. Repeats within one document alone, null, empty and short texts give no row.
    Rows repeated with one id count as one document, with a row each. Null ids take no part. Empty table: no rows.
    """
    return _passages(numbered(docs, id_col, text_col), min_words).drop("row")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text), one row per input row: every text without the passages whose first occurrence is in another document.

    Each row loses its own passages only, also where several rows have one id. A word that a passage begins or ends within
    stays whole. Null texts and rows with a null id stay as they are; empty texts stay empty. Extra columns are ignored,
    whatever their names. Empty table: no rows.
    """
    rows = stored(numbered(docs, id_col, text_col), "texts")
    gone = _passages(rows, min_words).filter("NOT kept").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    both = rows.join(gone, "row", "left").select("doc_id", "text", "spans")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                text, spans = text.as_py(), spans.as_py()
                if not spans:
                    texts.append(text)
                    continue
                raw, out, upto = text.encode(), [], 0
                for s in spans:
                    a, b = max(upto, s["start"]), s["end"]
                    if a and not IS_SPACE[raw[a - 1]]:
                        a = (m.start() if (m := _SPACE.search(raw, a, b)) else b) if a < len(raw) and not IS_SPACE[raw[a]] else a
                    while a < b < len(raw) and not IS_SPACE[raw[b]] and not IS_SPACE[raw[b - 1]]:
                        b -= 1
                    if a < b:
                        out.append(raw[upto:a])
                        upto = b
                texts.append(b"".join([*out, raw[upto:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return both.mapInArrow(drop, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
