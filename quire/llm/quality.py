"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.kernels import IS_SPACE, LOWER, SEGMENT, cuts_of, digests, groups, mix, strings, word_places
from quire.llm.shared import fold, keep_only, stored, table
from quire.session import ship

#: A document is accepted from this score on.
ACCEPT = 0.3
#: Share of the pooled, diagonal covariance mixed into each class's own, and what is added to each variance.
SHRINK, RIDGE = 0.2, 1e-2

STATISTICS = (
    "words", "word_bytes", "upper", "digit", "mark", "shout", "symbol", "bar", "beyond_ascii", "short_words", "repeat_next", "repeat_second", "distinct_words", "repeat_lines", "repeat_fives", "line_words", "long_words"
)

_B = np.arange(256)
_CLASSES = {
    "upper": (_B >= 65) & (_B <= 90), "lower": (_B >= 97) & (_B <= 122), "digit": (_B >= 48) & (_B <= 57), "mark": np.isin(_B, list(b".,;:'\"()?-")), "shout": _B == ord("!"),
    "symbol": np.isin(_B, list(b"#$%&*+/<=>@[\\]^_`{}~")), "bar": _B == ord("|"), "beyond": _B >= 128, "solid": ~IS_SPACE,
}
_MEMBERS = np.stack(list(_CLASSES.values())).astype(float)


def _repeated(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text, how many of its keys came before in it."""
    if n == 1:
        keys = np.sort(keys)
        return np.array([(keys[1:] == keys[:-1]).sum()])
    both = mix(keys ^ mix(text.astype(np.uint64)))
    order = np.argsort(both)
    again = np.concatenate([[False], both[order][1:] == both[order][:-1]]) if len(both) else np.zeros(0, bool)
    return np.bincount(text[order][again], minlength=n)


def _pieces(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Offsets of pieces that are looked at one after the other: all texts at once, or a single long text cut at white space."""
    cuts = cuts_of(data, int(at[0]), int(at[-1]), SEGMENT) if len(at) == 2 else []
    yield from (np.array(x) for x in zip(cuts, cuts[1:])) if len(cuts) > 2 else [at]


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of transformed STATISTICS for each text data[at[i]:at[i+1]]; an empty text has zeros before the transform.

    A single long text is read in pieces, so beside the text only a few numbers for each of its words are held.
    """
    n = len(at) - 1
    sums, found, line = np.zeros((n, len(_MEMBERS))), [], 0
    for own in _pieces(data, at):
        part, own = data[own[0] : own[-1]], own - own[0]
        for lo in range(0, len(part), SEGMENT) if n == 1 else [0]:
            seen = part[lo : lo + SEGMENT] if n == 1 else part
            key = seen if n == 1 else np.repeat(np.arange(n) * 256, np.diff(own)) + seen
            sums += np.bincount(key, minlength=n * 256).reshape(n, 256) @ _MEMBERS.T
        starts, ends = word_places(part, own) if len(part) else (np.zeros(0, np.int64),) * 2
        ended = np.flatnonzero(part == 10)
        found.append((digests(LOWER[part], starts, ends)[0], np.searchsorted(own[1:], starts, side="right").astype(np.int32), np.minimum(ends - starts, 64).astype(np.int8), (line + np.searchsorted(ended, starts)).astype(np.int32)))
        line += len(ended)
    hashes, text, size, line_of = (np.concatenate(x) for x in zip(*found))
    sums = dict(zip(_CLASSES, sums.T))
    words = np.bincount(text, minlength=n).astype(float)
    most, solid = np.maximum(1.0, words), np.maximum(1.0, sums["solid"])
    share = lambda hit, text: np.bincount(text[hit], minlength=n) / most

    def share_equal(k: int) -> np.ndarray:
        return share((hashes[k:] == hashes[:-k]) & (text[k:] == text[:-k]), text[k:]) if len(hashes) > k else np.zeros(n)

    fives = hashes[:-4].copy() if len(hashes) > 4 else hashes[:0]
    for k in range(1, 5):
        fives = mix(fives ^ hashes[k : k + len(fives)] * np.uint64(0x9E3779B1)) if len(fives) else fives
    same = text[: len(fives)] == text[4 : 4 + len(fives)] if len(fives) else np.zeros(0, bool)
    fives, five_text = fives[same], text[: len(same)][same]
    five_n = np.maximum(1.0, np.bincount(five_text, minlength=n))
    line_key, line_text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes):
        new = np.concatenate([[True], (line_of[1:] != line_of[:-1]) | (text[1:] != text[:-1])])
        heads = np.flatnonzero(new)
        place = np.arange(len(hashes)) - np.repeat(heads, np.diff(np.append(heads, len(hashes))))
        line_key = np.add.reduceat(mix(hashes ^ mix(place.astype(np.uint64))), heads)
        line_text = text[new]
    lines = np.maximum(1.0, np.bincount(line_text, minlength=n))
    letters = np.maximum(1.0, sums["upper"] + sums["lower"] + sums["beyond"] / 2)
    log = lambda x, eps=1e-3: np.log(x + eps)
    return np.stack(
        [
            np.log1p(words), np.log1p(solid / most), log(sums["upper"] / letters), log(sums["digit"] / solid), log(sums["mark"] / solid), log(sums["shout"] / solid), log(sums["symbol"] / solid),
            log(sums["bar"] / solid), log(sums["beyond"] / solid), log(share(size < 4, text)), log(share_equal(1)), log(share_equal(2)), log(1 - _repeated(hashes, text, n) / most),
            log(_repeated(line_key, line_text, n) / lines), log(_repeated(fives, five_text, n) / five_n), np.log1p(words / lines), log(share(size > 15, text)),
        ],
        axis=1,
    )


def measured(text: Column) -> Column:
    """The statistics of a whole text; null counts as empty. Only the texts go to Python, the rest of a row stays in the JVM."""

    @F.arrow_udf("array<double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep_only("statistics")
        for column in batches:
            data, at = strings(column)
            rows = [statistics(data, own) for _, own in groups(data, at, SEGMENT)]
            x = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.reshape(-1)))

    return measure(text)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and constants of the classes 0 and 1, all computed once by fit()."""

    means: np.ndarray
    whitens: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(class 1): the logistic of the difference of Mahalanobis log-densities."""
        logs = [c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, c in zip(self.means, self.whitens, self.constants)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(rows: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant | None:
    """From (x, label): counts, sums and products are added up where the rows are, so all labelled rows take part.

    None if a class has fewer than two rows.
    """
    d = len(STATISTICS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(-1, d)
            y = np.array(batch.column(1))
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(map(list, total)), pa.list_(pa.float64()))], names=["label", "sums"])

    parts = rows.select("x", "label").mapInArrow(add, "label int, sums array<double>")
    flat = parts.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) numbers
    total = np.zeros((2, 1 + d + d * d))
    for r in flat:
        total[r["label"], r["i"]] = r["v"]
    n = total[:, 0]
    if (n < 2).any():
        return None
    means = total[:, 1 : 1 + d] / n[:, None]
    own = [total[k, 1 + d :].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = np.diag(np.diag((own[0] * n[0] + own[1] * n[1]) / n.sum()))
    covariances = [(1 - shrink) * c + shrink * pooled + ridge * np.eye(d) for c in own]
    whitens = np.stack([np.linalg.inv(np.linalg.cholesky(c)) for c in covariances])
    constants = np.array([np.log(n[k] / n.sum()) + np.log(np.diag(whitens[k])).sum() for k in (0, 1)])
    return Discriminant(means, whitens, constants)


def learned(x: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Discriminant | None:
    """The model of all labelled documents outside the held-out fold."""
    ids, label = F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")
    known = labels.select(ids, label).filter((fold(F.col("doc_id")) != 0) & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    return fit(x.select("doc_id", "x").join(known, "doc_id"))


def scored(x: Column, model: Discriminant | None) -> Column:
    """The score of each row of statistics; 1 without a model."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            own = np.array(column.flatten()).reshape(-1, len(STATISTICS))
            yield pa.array(model.scores(own))

    return score(x) if model else F.lit(1.0)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Statistics are of the whole text alone. Labels of documents whose crc32(id as text) mod 5 is 0 are never read. Where
    one id has several labels the smallest counts; null labels, and ids that are null or without a document, take no part.
    An empty text is scored like any other. With fewer than two labelled documents of a class, every score is 1. Empty
    table: no rows.
    """
    ship(docs.sparkSession)
    x = stored(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), measured(F.col(f"`{text_col}`")).alias("x")), "statistics")
    found = x.select("doc_id", scored(F.col("x"), learned(x, labels, id_col, label_col)).alias("score"))
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", accept: float = ACCEPT) -> DataFrame:
    """The documents that the classifier accepts, with their own columns, whatever their names.

    Each row is judged by its own text, so repeated rows stay or go alike; null text is empty. Labels are read as by
    classify(); without a model all documents stay. Empty table: no rows.
    """
    ship(docs.sparkSession)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), measured(F.col(f"`{text_col}`")).alias("x"))
    held = stored(held, "statistics")
    return held.filter(scored(F.col("x"), learned(held, labels, id_col, label_col)) >= accept).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
