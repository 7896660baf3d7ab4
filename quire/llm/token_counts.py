"""Token counts by a compiled finite-state tokenizer: transitions annotated with emitted-token counts, chunk maps composed."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.shared import keep_only, table
from quire.session import ship

LIMIT = 512
#: Code points of a chunk; states and words that a worker keeps before it starts its tables anew.
CHUNK, STATES, WORDS = 1 << 16, 300_000, 400_000

#: The white space of the byte-level pattern (Unicode White_Space), as a character class.
BLANK = r"\t-\r\x20\x85\xa0 \u2000-\u200a\u2028\u2029\u202f 　"
#: Up to here the classes letter and number are the same in every Unicode version, so they can be read from Python's tables.
SETTLED = 0x530


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Transducer:
    """A byte-level BPE vocabulary as a deterministic transducer over the bytes of one pretoken.

    After each prefix the encoding's last token is settled by the prefix alone, and the encoding is that of the prefix
    before this token, and the token. A state therefore holds every place in the prefix from which a token may still reach
    beyond its end: (trie node of the bytes since, last token before, tokens before less tokens now). Reading a byte moves
    each place along the trie; the one place that completes a token which may follow its last token gives the new last
    token and so the number that the transition emits, which is negative where tokens merge. States are compiled when
    first reached and are finite in number; the table starts anew when it is full.
    """

    def __init__(self, text: str):
        model = json.loads(text)["model"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks, self.made, self.halves = {}, {}, {}
        for r, (x, y) in enumerate(pairs):
            x, y = raw(x), raw(y)
            i = self.ids[x + y]
            self.ranks[self.ids[x], self.ids[y]] = r
            self.made.setdefault(i, r)
            self.halves.setdefault(i, (self.ids[x], self.ids[y]))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.next: dict[int, int] = {}
        self.token: list[int] = [-1]
        whole = set(self.single)
        for i, r in sorted(self.made.items(), key=lambda x: x[1]):
            if whole.issuperset(self.halves[i]) and self.apart(*self.halves[i], r):
                whole.add(i)
        for t, i in self.ids.items():
            if i not in whole:
                continue  # no encoding has it
            node = 0
            for b in t:
                node = self.next.setdefault(node << 8 | b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.follows: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = ((0, -1, 0),)
        self.number, self.places, self.moves = {start: 0}, [start], {}
        self.follows.clear()

    def apart(self, left: int, right: int, before: int = 1 << 30) -> bool:
        """Whether no merge of a rank below before joins anything across the border of two tokens.

        The merges that made both are undone, last one first, and at each stage the pieces at the border are looked up: a
        merge across would have come first if its rank is lower than that of the merge just undone; on a tie, merges run
        from left to right, so the one across comes before that of the right token and after that of the left one.
        """
        while True:
            if self.ranks.get((left, right), 1 << 30) < before:
                return False
            x, y = self.made.get(left, -1), self.made.get(right, -1)
            if x > y:
                before, left = x, self.halves[left][1]
            elif y >= 0:
                before, right = y + 1, self.halves[right][0]
            else:
                return True

    def may_follow(self, last: int, token: int) -> bool:
        found = self.follows.get((last, token))
        if found is None:
            found = self.follows[last, token] = last < 0 or self.apart(last, token)
        return found

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        moved, emitted, new = [], 0, -1
        for node, last, before in self.places[state]:
            to = self.next.get(node << 8 | byte)
            if to is None:
                continue
            moved.append((to, last, before))
            token = self.token[to]
            if new < 0 <= token and self.may_follow(last, token):
                new, emitted = token, before + 1
        key = (*((node, last, before - emitted) for node, last, before in moved if node in self.inner), (0, new, 0))
        to = self.number.setdefault(key, len(self.places))
        if to == len(self.places):
            self.places.append(key)
        return to, emitted

    @functools.cached_property
    def inner(self) -> frozenset[int]:
        """The trie's nodes that have children."""
        return frozenset(k >> 8 for k in self.next)

    def count(self, word: bytes) -> int:
        """Tokens of a pretoken."""
        if len(self.places) > STATES:
            self.clear()
        state, total, moves = 0, 0, self.moves
        for b in word:
            step = moves.get(state << 8 | b)
            if step is None:
                step = moves[state << 8 | b] = self.compile(state, b)
            state = step[0]
            total += step[1]
        return total


class Counter:
    """Counts the tokens of whole texts as the library does.

    The outer machine reads white space: a unit is one optional blank and a run without white space, or white space that
    leaves its last sign to what follows. Units do not depend on each other, and no unit spans a place where white space
    follows other text. So a chunk of a text maps what was left open before it to tokens emitted and what it leaves open:
    (head, count, tail), or only a fragment while no such place has come. Maps compose associatively.
    """

    unit = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
    edge = re.compile(f"(?<=[^{BLANK}])(?=[{BLANK}])")
    pretoken = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[\d²³¹¼½¾]+| ?(?:[^\w\s²³¹¼½¾]|_)+")

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.machine, self.library = Transducer(text), Tokenizer.from_str(text)
        self.special = [t["content"] for t in json.loads(text).get("added_tokens", [])]
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.words: dict[str, int] = {}

    def of_unit(self, unit: str) -> int:
        if ord(max(unit)) < SETTLED and unit[-1] not in "\t\n\r\x0b\x0c\x20\x85\xa0":
            parts = self.pretoken.findall(unit)
        else:
            parts = None
        if parts is None or sum(map(len, parts)) != len(unit):
            letters = byte_letters()
            back = {c: b for b, c in enumerate(letters)}
            return sum(self.machine.count(bytes(back[c] for c in p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(unit))
        total = 0
        for p in parts:
            n = self.words.get(p)
            if n is None:
                n = self.words[p] = self.machine.count(p.encode())
            total += n
        return total

    def closed(self, text: str) -> int:
        """Tokens of a stretch between two places where units surely end."""
        if len(self.words) > WORDS:
            self.words.clear()
        total, known = 0, self.words
        for unit in self.unit.findall(text):
            n = known.get(unit)
            if n is None:
                n = known[unit] = self.of_unit(unit)
            total += n
        return total

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """The map of a chunk: (head, tokens between, tail); tokens None: all of it is one fragment."""
        first = self.edge.search(text)
        if first is None:
            return text, None, ""
        last = first.end()
        for step in range(1, 1 + len(text).bit_length()):  # the last edge, looked for from the end
            lo = max(first.end(), len(text) - (64 << step))
            found = [m.end() for m in self.edge.finditer(text, lo)]
            if found or lo == first.end():
                last = found[-1] if found else last
                break
        return text[: first.end()], self.closed(text[first.end() : last]), text[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two chunks one after the other."""
        if a[1] is None and b[1] is None:
            return self.chunk(a[0] + b[0])
        if a[1] is None:
            x = self.chunk(a[0] + b[0])
            return (x[0] + x[2], b[1], b[2]) if x[1] is None else (x[0], x[1] + self.closed(x[2]) + b[1], b[2])
        x = self.chunk(a[2] + b[0])
        if b[1] is None:
            return (a[0], a[1], x[0]) if x[1] is None else (a[0], a[1] + self.closed(x[0]) + x[1], x[2])
        return a[0], a[1] + self.closed(a[2] + b[0]) + b[1], b[2]

    def plain(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.closed(text)
        maps = [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # the up-sweep of a parallel prefix scan
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.closed(head + tail) if n is None else self.closed(head) + n + self.closed(tail)

    def __call__(self, text: str) -> int:
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        return sum(map(self.plain, parts)) + len(parts) - 1


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    tokenizer is the path, on the driver, of a byte-level BPE file of the tokenizers library; its content (a megabyte or
    two) goes to the workers with the task. No begin or end tokens; special strings inside a text count one token each, as
    by the library's default. Null text is empty: 0 bytes and tokens. Ids may be null or repeated. Empty table: no rows.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ship(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = keep_only(f"counter of {tokenizer}", lambda: Counter(held.value))
        for batch in batches:
            sizes, counts = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(of(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
