"""Array code over Arrow string columns: words, 5-word shingles and their distinct 128-bit fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; longer texts are cut after white space.
SEGMENT = 1 << 21
WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the input moves every bit of the output."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
IS_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
#: Where the two lanes of a hash start, and bytes up to which a piece is hashed in lanes of eight bytes; longer ones take blake2b.
SEEDS, SHORT = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)), 96
_KEEP = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], dtype=np.uint64)


def joined(lanes: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit lanes that take in two more words each; the lanes differ in how, so they collide independently."""
    x, y = lanes
    return mix(x ^ more[0]), mix((y << np.uint64(1) | y >> np.uint64(63)) + more[1] * np.uint64(0xD1342543DE82EF95))


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes, as two lanes, of the pieces data[starts[i]:ends[i]]: eight bytes at a time through a mixing
    function, or blake2b of a long piece. Neither is a polynomial, so no family of texts collides by construction."""
    sizes = (ends - starts).astype(np.int64)
    x, y = mix(SEEDS[0] ^ sizes.astype(np.uint64)), mix(SEEDS[1] + sizes.astype(np.uint64))
    if not len(sizes):
        return x, y
    short = np.flatnonzero(sizes <= SHORT)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at, left, a, b = starts[short], sizes[short], x[short], y[short]
    alive = np.arange(len(short))
    while len(alive := alive[left[alive] > 0]):
        word = eight[at[alive]] & _KEEP[np.minimum(left[alive], 8)]
        a[alive], b[alive] = joined((a[alive], b[alive]), (word, word))
        at[alive] += 8
        left[alive] -= 8
    x[short], y[short] = a, b
    for i in np.flatnonzero(sizes > SHORT):
        found = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
        x[i], y[i] = np.frombuffer(found, "<u8")
    return x, y


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def word_places(part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in part of every word of the texts part[own[i]:own[i+1]]: maximal runs without white space."""
    inside = ~IS_SPACE[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = own[:-1][own[:-1] < own[1:]]
    first[heads] = inside[heads]
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, lane, text) of every word of the texts data[at[i]:at[i+1]], A-Z lower-cased."""
    part, own = data[int(at[0]) : int(at[-1])], at - at[0]
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, ends = word_places(part, own)
    return *digests(LOWER[part], starts, ends), np.searchsorted(own[1:], starts, side="right")


def groups(data: np.ndarray, at: np.ndarray, segment: int = SEGMENT) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, offsets) of runs of whole texts of about a segment's bytes in all; a longer text is a run of its own."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + segment, side="right")) - 1)
        yield i, at[i : j + 1]
        i = j


def cuts_of(data: np.ndarray, lo: int, hi: int, segment: int = SEGMENT) -> list[int]:
    """Places that cut data[lo:hi] into pieces of about a segment, each before white space; a run without any stays whole."""
    cuts = [lo]
    while hi - cuts[-1] > segment:
        to = cuts[-1] + segment
        while to < hi:
            found = np.flatnonzero(IS_SPACE[data[to : min(hi, to + segment)]])
            if len(found):
                to += int(found[0])
                break
            to = min(hi, to + segment)
        cuts.append(to)
    return [*cuts, hi] if hi > cuts[-1] else cuts


def words_of(data: np.ndarray, at: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes() in bounded memory: a single long text is cut at white space."""
    if at[-1] - at[0] <= 2 * segment or len(at) > 2:
        return word_hashes(data, at)
    cuts = cuts_of(data, int(at[0]), int(at[-1]), segment)
    parts = [word_hashes(data, np.array([a, b]))[:2] for a, b in zip(cuts, cuts[1:])]
    x, y = (np.concatenate(lane) for lane in zip(*parts))
    return x, y, np.zeros(len(x), np.int64)


def distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs (x[i], y[i]) in order."""
    order = np.argsort(x)
    x, y = x[order], y[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():  # a lane collides, once in a very long while
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    keep = np.concatenate([np.ones(min(1, len(x)), bool), ~same])
    return x[keep], y[keep]


def shingle_sets(column: pa.Array, size: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first text, sets): for each run of texts the distinct 128-bit fingerprints of the shingles of each text, in order,
    as an array of two rows, one for each lane.

    With fewer words than size, the whole sequence is the one shingle; without words the set is empty.
    """
    data, at = strings(column)
    for i, own in groups(data, at):
        x, y, text = words_of(data, own)
        count = np.bincount(text, minlength=len(own) - 1)
        upto = np.concatenate([[0], np.cumsum(count)])
        n = max(0, len(x) - size + 1)
        whole = np.full(n, SEEDS[1]), np.full(n, SEEDS[0])
        for k in range(size if n else 0):
            whole = joined(whole, (x[k : k + n], y[k : k + n]))
        sets = []
        for j, n in enumerate(count):
            a = upto[j]
            if n >= size:
                pair = distinct(whole[0][a : a + n - size + 1], whole[1][a : a + n - size + 1])
            elif n:
                pair = np.full(1, n, dtype=np.uint64), np.full(1, n, dtype=np.uint64)
                for w in range(a, a + n):
                    pair = joined(pair, (x[w : w + 1], y[w : w + 1]))
            else:
                pair = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            sets.append(np.stack(pair))
        yield i, sets
