"""Packing: length combinations by non-negative least squares on the histogram, then greedy windows for what is left."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.kernels import LOWER, cuts_of, digests, groups, strings, word_places
from quire.llm.shared import keep_only, stored, table
from quire.session import ship

WINDOW, END = 2048, 1
#: Bytes of text whose words are held at once, stems that a worker keeps, marks at the end of a word that are looked for,
#: lengths from which triples are formed, rows and bytes of a batch that a worker gives back.
SEGMENT, STEMS, MARKS, TRIPLES, ROWS, BYTES = 1 << 21, 600_000, 8, 48, 4096, 1 << 23
_BYTE = np.arange(256)
_IS_MARK = np.isin(_BYTE, list(b".,!?;:"))
_ASCII, _LATIN = (_BYTE >= 97) & (_BYTE <= 122), (_BYTE >= 0x80) & (_BYTE <= 0xBF) & (_BYTE != 0x97) & (_BYTE != 0xB7)
#: Stems that are one pretoken: letters of ASCII and Latin-1 alone.
_SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")


class Stems:
    """Token ids by stem, for a tokenizer that drops white space.

    A word is one or two stems: the word with A-Z lower-cased (as the tokenizer does), or that without its closing marks,
    which are a pretoken of their own after a letter, and these marks. Only letters of ASCII and Latin-1 settle this: a
    letter of another kind may become several characters when it is lower-cased, and the last of them may be no letter.
    A word with the beginning of a special string stays as it is written. Stems are known by a 128-bit digest and have
    their ids in one flat array, so a worker holds some 30 bytes for each. Only new stems go to the library, all those of
    a segment at once: stems that are letters alone as one text, where ids with the mark of a word's end say whose they
    are, others one by one. If there are too many, those met once since the last time are forgotten.
    """

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(text)
        size = self.library.get_vocab_size()
        self.kind = np.uint32 if size > 1 << 16 else np.uint16
        self.last = np.zeros(size, bool)
        self.last[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.x, self.y, self.number = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)  # by x
        self.start, self.size, self.met, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def forget(self) -> None:
        """Keep the stems that were met more than once, unless these are too many too."""
        keep = self.met > 1
        if keep.sum() > STEMS // 2:
            keep[:] = False
        own = keep[self.number]
        size = self.size[keep]
        at = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.start[keep] - at, size) + np.arange(size.sum())]
        self.x, self.y, self.number = self.x[own], self.y[own], (np.cumsum(keep) - 1).astype(np.int32)[self.number[own]]
        self.start, self.size, self.met = at.astype(np.int32), size, np.zeros(len(size), np.int32)

    def encode(self, stems: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, sizes) of stems by the library: in which order they come, all their ids, and how many each has."""
        simple, other = [], []
        for k, stem in enumerate(stems):
            (simple if _SIMPLE.match(stem) else other).append(k)
        joined = [b" ".join(stems[k] for k in simple[i : i + 1000]).decode() for i in range(0, len(simple), 1000)]
        found = [e.ids for e in self.library.encode_batch_fast(joined, add_special_tokens=False)] if joined else []
        ids = np.fromiter(chain.from_iterable(found), self.kind, sum(map(len, found)))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(simple) or len(ids) != (ends[-1] if len(ends) else 0):  # the vocabulary marks ends in another way
            ids, ends, simple, other = ids[:0], ends[:0], [], [*simple, *other]
        size = np.diff(ends, prepend=0)
        if other:
            found = [e.ids for e in self.library.encode_batch_fast([stems[k].decode() for k in other], add_special_tokens=False)]
            size = np.concatenate([size, np.fromiter(map(len, found), np.int64, len(found))])
            ids = np.concatenate([ids, np.fromiter(chain.from_iterable(found), self.kind, sum(map(len, found)))])
        return np.array([*simple, *other], np.int64), ids, size

    def stems_of(self, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends) of the stems of the texts part[own[i]:own[i+1]]."""
        starts, ends = word_places(part, own)
        lowered, whole = LOWER[part], np.zeros(len(starts), bool)
        for k in np.unique(np.searchsorted(starts, np.flatnonzero((part[:-1] == 60) & (part[1:] == 124)), side="right") - 1):  # <|
            lowered[starts[k] : ends[k]] = part[starts[k] : ends[k]]
            whole[k] = True
        stop = ends.copy()
        for _ in range(MARKS):
            stop -= (stop > starts) & _IS_MARK[lowered[stop - 1]]
        last, before = lowered[stop - 1], lowered[np.maximum(stop - 2, 0)]
        letter = _ASCII[last] | _LATIN[last] & (before == 0xC3) & (stop - starts > 1)
        two = (stop > starts) & (stop < ends) & letter & ~whole
        stop = np.where(two, stop, ends)
        at = np.arange(len(starts)) + np.cumsum(two) - two
        s, e = np.empty(len(starts) + int(two.sum()), np.int64), np.empty(len(starts) + int(two.sum()), np.int64)
        s[at], e[at] = starts, stop
        s[at[two] + 1], e[at[two] + 1] = stop[two], ends[two]
        return lowered, s, e

    def ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all token ids, how many each text has) of the texts data[at[i]:at[i+1]]."""
        if len(self.size) > STEMS:
            self.forget()
        part, own = data[at[0] : at[-1]], at - at[0]
        if not len(part):
            return np.zeros(0, self.kind), np.zeros(len(own) - 1, np.int64)
        lowered, starts, ends = self.stems_of(part, own)
        x, y = digests(lowered, starts, ends)
        order = np.argsort(x)
        sx, sy = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (sx[1:] != sx[:-1]) | (sy[1:] != sy[:-1])
        ux, uy, first = sx[new], sy[new], order[new]
        place = np.searchsorted(self.x, ux)
        near = np.minimum(place, len(self.x) - 1)
        known = (self.x[near] == ux) & (self.y[near] == uy) if len(self.x) else np.zeros(len(ux), bool)
        number = np.empty(len(ux), np.int32)
        number[known] = self.number[near[known]]
        missing = np.flatnonzero(~known)
        if len(missing):
            raw = lowered.tobytes()
            come, ids, size = self.encode([raw[a:b] for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist())])
            number[missing[come]] = np.arange(len(self.size), len(self.size) + len(come), dtype=np.int32)
            self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
            self.size, self.met = np.concatenate([self.size, size.astype(np.int32)]), np.concatenate([self.met, np.zeros(len(size), np.int32)])
            self.flat = np.concatenate([self.flat, ids])
            self.x, self.y, self.number = (np.insert(old, place[missing], more[missing]) for old, more in ((self.x, ux), (self.y, uy), (self.number, number)))
        self.met += np.bincount(number, minlength=len(self.met)).astype(np.int32)
        stems = np.empty(len(x), np.int32)
        stems[order] = number[np.cumsum(new) - 1]
        sizes = self.size[stems].astype(np.int64)
        upto = np.cumsum(sizes) - sizes
        flat = self.flat[np.repeat(self.start[stems] - upto, sizes) + np.arange(sizes.sum())]
        text = np.searchsorted(own[1:], starts, side="right")
        return flat, np.bincount(text, weights=sizes, minlength=len(own) - 1).astype(np.int64)


def texts_ids(known: Stems, column: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each text of a column in turn; null counts as empty. A long text is cut at white space."""
    data, at = strings(column)
    for _, own in groups(data, at, SEGMENT):
        if len(own) == 2 and own[1] - own[0] > SEGMENT:
            cuts = cuts_of(data, int(own[0]), int(own[1]), SEGMENT)
            yield np.concatenate([known.ids(data, np.array([a, b]))[0] for a, b in zip(cuts, cuts[1:])])
        else:
            flat, count = known.ids(data, own)
            yield from np.split(flat, np.cumsum(count)[:-1])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


CUT = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
CUT_DDL = "part int, nth long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"


def windows_and_rests(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """Full windows of every document, and the rest of fewer ids with these ids; nth counts the equal lengths of a part."""
    with open(tokenizer, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, count = keep_only(f"words of {tokenizer}", lambda: Stems(held.value)), TaskContext.get().partitionId(), Counter()
        kind = np.dtype(known.kind).newbyteorder("<")
        columns: list[list] = [[] for _ in CUT]
        size = 0

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CUT)], schema=CUT)
            for c in columns:
                c.clear()
            return made

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts_ids(known, batch.column(1))):
                ids = np.append(ids, known.kind(END))
                for a in range(0, len(ids), window):
                    own = ids[a : a + window]
                    rest = own.astype(kind).tobytes() if len(own) < window else None
                    for c, v in zip(columns, (part, count[len(own)], doc_id, a, len(own), crc(own), len(ids), rest)):
                        c.append(v)
                    count[len(own)] += 1
                    size += len(rest or b"")
                if len(columns[0]) >= ROWS or size >= BYTES:
                    yield full()
                    size = 0
        if columns[0]:
            yield full()

    return docs.mapInArrow(cut, CUT_DDL)


def combinations(have: dict[int, int], window: int, triples: int = TRIPLES) -> list[tuple[int, ...]]:
    """Pairs of the lengths at hand that fill a window, and triples with two of the most frequent lengths."""
    out = {(a, window - a) for a in have if a * 2 <= window and window - a in have}
    often = sorted(have, key=lambda a: (-have[a], a))[:triples]
    out |= {tuple(sorted((a, b, window - a - b))) for a in often for b in often if window - a - b in have}
    return sorted(out)


def least_squares(columns: list[tuple[int, ...]], have: dict[int, int], sweeps: int = 40) -> list[float]:
    """x >= 0 that minimises the squares of (lengths used - lengths at hand), by coordinate descent."""
    left, x = {a: float(n) for a, n in have.items()}, [0.0] * len(columns)
    uses = [Counter(c) for c in columns]
    norms = [sum(k * k for k in u.values()) for u in uses]
    for _ in range(sweeps):
        moved = 0.0
        for j, u in enumerate(uses):
            step = max(-x[j], sum(k * left[a] for a, k in u.items()) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for a, k in u.items():
                    left[a] -= k * step
        if moved < 0.01:
            break
    return x


class Pool:
    """Pieces by length. A segment [length, lo, hi, start] stands for the ids from start of all rests of that length whose
    rank is in lo to hi."""

    def __init__(self, have: dict[int, int]):
        self.segments = defaultdict(list, {a: [[a, 0, n, 0]] for a, n in have.items()})
        self.count, self.lengths = dict(have), sorted(have)

    def take(self, length: int, n: int, part: int | None = None) -> list[tuple[int, int, int, int]]:
        """n pieces of a length; with part, only their first ids, and what remains comes back as pieces of its own."""
        out, rest = [], length - (part or length)
        self.count[length] -= n
        while n:
            own = self.segments[length][-1]
            k = min(n, own[2] - own[1])
            out.append((own[0], own[1], own[1] + k, own[3]))
            if rest:
                self.segments[rest].append([own[0], own[1], own[1] + k, own[3] + part])
            own[1] += k
            n -= k
            if own[1] == own[2]:
                self.segments[length].pop()
        if rest:
            if not self.count.get(rest):
                bisect.insort(self.lengths, rest)
            self.count[rest] = self.count.get(rest, 0) + sum(x[2] - x[1] for x in out)
        if not self.count[length]:
            self.lengths.remove(length)
        return out


def plan(have: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, lo, hi, start, size, sequence, offset): where pieces go; rank lo is in the sequence named, the next in the next.

    have: how many pieces there are of each length up to window, so this is small whatever the corpus. Full windows stand
    alone. The repeat counts of combinations come from least squares, rounded down. What remains is packed greedily: the
    longest piece, then the longest that still fits; if none fits, the longest piece is cut to fill the gap. A window made
    so is repeated as often as its pieces allow. Only the very last sequence can be short.
    """
    pool, out, sequence = Pool({a: n for a, n in have.items() if n}), [], 0

    def put(taken: list[tuple[int, int, int, int]], size: int, first: int, offset: int) -> None:
        for length, lo, hi, start in taken:
            out.append((length, lo, hi, start, size, first, offset))
            first += hi - lo

    if pool.count.get(window):
        n = pool.count[window]
        put(pool.take(window, n), window, sequence, 0)
        sequence += n
    columns = combinations({a: n for a, n in pool.count.items() if n}, window)
    for c, x in zip(columns, least_squares(columns, {a: n for a, n in pool.count.items() if n})):
        n = min(int(x + 1e-6), *(pool.count[a] // k for a, k in Counter(c).items()))
        if n > 0:
            offset = 0
            for a in c:
                put(pool.take(a, n), a, sequence, offset)
                offset += a
            sequence += n
    while pool.lengths:
        chosen, gap, left = [], window, dict()
        while gap and (at := bisect.bisect_right(pool.lengths, gap)):
            while at and left.get(pool.lengths[at - 1], pool.count[pool.lengths[at - 1]]) == 0:
                at -= 1
            if not at:
                break
            a = pool.lengths[at - 1]
            left[a] = left.get(a, pool.count[a]) - 1
            chosen.append((a, None))
            gap -= a
        if gap:
            more = next((a for a in reversed(pool.lengths) if a > gap and left.get(a, pool.count[a])), None)
            if more:
                left[more] = left.get(more, pool.count[more]) - 1
                chosen.append((more, gap))
                gap = 0
        uses = Counter(a for a, _ in chosen)
        n = min(pool.count[a] // k for a, k in uses.items())
        if gap:
            n = 1  # the pool is used up by it
        offset = 0
        for a, part in chosen:
            put(pool.take(a, n, part), part or a, sequence, offset)
            offset += part or a
        sequence += n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece; each id is in exactly one.

    tokenizer is the path, on the driver, of a file of the tokenizers library that drops white space (word_bpe_49k.json); a
    document is its ids and the end id, so a null or empty text is one id. Repeated rows are packed each. Empty table: no
    rows. Sequences are numbered from 0 and gapless; only the last can be shorter than the window.
    """
    spark = docs.sparkSession
    ship(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    own = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")
    cut = stored(windows_and_rests(own, tokenizer, window), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    have = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most a row for each length up to window
    places = spark.createDataFrame(plan(have, window), "length int, lo long, hi long, from int, size int, sequence long, offset long")
    base = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    ranked = cut.drop("ids").join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    # The plan is about lengths up to window, not about documents: each of its steps uses up a length or makes one, so it has
    # some ten rows for a length on average (23,390 in all were seen), whatever the input.
    met = ranked.join(F.broadcast(places), "length").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = stored(met.select("part", "nth", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "from", "size", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"), "placed")

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for ids, length, a, n in zip(*(batch.column(c) for c in ("ids", "length", "from", "size"))):
                raw = np.frombuffer(ids.as_buffer(), np.uint8)
                step = len(raw) // length.as_py()
                sums.append(crc(raw.view(f"<u{step}")[a.as_py() : a.as_py() + n.as_py()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sums, pa.int64())], names=[*keep, "ids_crc32"])

    keep = ["doc_id", "start", "from", "size", "doc_tokens", "sequence_id", "offset"]
    parts = placed.filter(F.col("size") < F.col("length")).join(cut.select("part", "nth", "length", "ids"), ["part", "nth", "length"])
    summed = parts.select(*keep, "length", "ids").mapInArrow(checksums, "doc_id long, start long, from int, size int, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
    whole = placed.filter(F.col("size") == F.col("length")).select(*keep, "ids_crc32")
    return whole.unionByName(summed).select(
        "doc_id", (F.col("start") + F.col("from")).cast("long").alias("start"), F.col("size").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
