"""Approximate nearest neighbours by several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.shared import stored, table
from quire.session import ship

NEAREST = 20
#: Orderings, dimensions that each projects to, and bits of a coordinate: a key has DIMS * DEPTH < 64 bits.
CURVES, DIMS, DEPTH = 6, 6, 10
#: Vectors the projection is fitted on, queries whose exact neighbours set the window, and the recall that it shall give.
SAMPLE, PROBES, RECALL = 20_000, 128, 0.95
#: Rows of a block that one task holds, blocks of queries that meet a block of rows in one task.
BLOCK, COARSE = 4096, 16
SEED = 7


def hilbert(cells: np.ndarray, depth: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of whole numbers below 2**depth, by transposing to Gray code and back."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


@dataclass(frozen=True)
class Curves:
    """For each ordering a projection, a shift, and the range of the fitted sample."""

    projections: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def keys(self, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """(rows, orderings) Hilbert keys; vectors beyond the fitted range are put at its edge."""
        out = np.empty((len(x), len(self.projections)), np.int64)
        for k, p in enumerate(self.projections):
            cells = (x @ p - self.low[k]) / np.maximum(self.high[k] - self.low[k], 1e-300) * (1 << depth)
            out[:, k] = hilbert(np.clip(cells, 0, (1 << depth) - 1), depth)
        return out


def fitted(sample: np.ndarray, curves: int, dims: int, seed: int) -> Curves:
    """Random orthonormal directions, weighted by the sample's spread along its principal axes, each with its own shift.

    The shift is a random part of the range added on both sides, so that cells of one ordering are cut elsewhere in another.
    """
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    spread, axes = np.linalg.eigh(np.cov(sample.T) + 1e-12 * np.eye(d)) if len(sample) > 1 else (np.ones(d), np.eye(d))
    weight = axes * np.sqrt(np.maximum(spread, 0) / max(spread.max(), 1e-300))
    projections, low, high = [], [], []
    for _ in range(curves):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0][:, : min(dims, d)]
        p = weight @ q
        y = sample @ p
        a, b = y.min(axis=0), y.max(axis=0)
        shift = rng.uniform(0, 0.5, len(a)) * (b - a)
        projections.append(p)
        low.append(a - shift)
        high.append(b + 0.5 * (b - a) - shift)
    return Curves(np.array(projections), np.array(low), np.array(high))


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of scores the k best columns as (ids, scores): score descending, then smaller id. ids ascend.

    -inf marks columns that don't count. Ties at the edge are all looked at, so the smaller ids win.
    """
    out = []
    for row in scores:
        at = np.flatnonzero(row > -np.inf)
        if len(at) > k:
            edge = -np.partition(-row[at], k - 1)[k - 1]
            at = at[row[at] >= edge]
        at = at[np.argsort(-row[at], kind="stable")[:k]]
        out.append((ids[at], row[at]))
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, one for each id."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.coalesce(fine, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (length["d"] if length else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def points_of(rows: DataFrame, keep: int) -> DataFrame:
    """(pid, ids, v): a row for each different vector with its keep smallest ids in order; pid is the smallest.

    Salting first keeps a vector that many rows have out of any one task.
    """
    nth = F.row_number().over(W.partitionBy("v", "salt").orderBy("vec_id"))
    few = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("nth", nth).filter(F.col("nth") <= keep)
    ids = F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep)  # of at most 64 * keep
    return few.groupBy("v").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("pid"), "ids", "v")


def ordered(points: DataFrame, curves: Curves) -> DataFrame:
    """(o, pid, rank): the place of every point in every ordering, by key and then id."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys = curves.keys(_vectors(batch.column(1)))
                n = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), len(keys))), pa.array(keys.reshape(-1)), pa.array(np.repeat(np.asarray(batch.column(0)), n))], names=["o", "key", "pid"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            o = np.asarray(batch.column(0))
            nth = np.empty(len(o), np.int64)
            for k in np.unique(o):
                own = o == k
                nth[own] = seen.get(k, 0) + np.arange(own.sum())
                seen[k] = seen.get(k, 0) + int(own.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(o), part, np.int32)), pa.array(nth)], names=["o", "pid", "part", "nth"])

    spark = points.sparkSession
    keys = points.select("pid", "v").mapInArrow(key, "o int, key long, pid long")
    by_key = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "o", "key", "pid").sortWithinPartitions("o", "key", "pid")
    sorted_ = stored(by_key.select("o", "pid").mapInArrow(number, "o int, pid long, part int, nth long"), "ordered")
    counts = sorted_.groupBy("o", "part").agg(F.count("*").alias("n"))
    base = counts.select("o", "part", (F.sum("n").over(W.partitionBy("o").orderBy("part")) - F.col("n")).alias("base"))
    return stored(sorted_.join(base, ["o", "part"]).select("o", "pid", (F.col("base") + F.col("nth")).alias("rank")), "ranks")


def exact(points: DataFrame, pids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    """(probe, pid): the k nearest points of a few probes, by comparing them with all points in blocks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(x)
        for batch in batches:
            if not len(batch):
                continue
            ids = np.asarray(batch.column(0))
            order = np.argsort(ids)
            scores = x @ _vectors(batch.column(1))[order].T
            scores[pids[:, None] == ids[order][None, :]] = -np.inf
            for j, (i, s) in enumerate(_top(scores, ids[order], k)):
                i, s = np.concatenate([best[j][0], i]), np.concatenate([best[j][1], s])
                at = np.lexsort((i, -s))[:k]
                best[j] = i[at], s[at]
        rows = [(int(p), int(i), float(s)) for p, (ids, sc) in zip(pids, best) for i, s in zip(ids, sc)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["probe", "pid", "score"])

    near = points.select("pid", "v").mapInArrow(compare, "probe long, pid long, score double")
    return near.withColumn("nth", F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "pid"))).filter(F.col("nth") <= k).select("probe", "pid")


def drawn(points: DataFrame, n: int, seed: int) -> DataFrame:
    """About n rows of points at most, chosen by a hash of pid; all rows if there are no more."""
    every = points.count()
    return points if every <= n else points.filter(F.pmod(F.xxhash64(F.lit(seed), "pid"), F.lit(1 << 30)) < int((1 << 30) * n / every))


def window_of(points: DataFrame, ranks: DataFrame, asked: DataFrame, nearest: int, recall: float, probes: int) -> tuple[int, int]:
    """(orderings, places): the cheapest number of orderings, two at least, and the window with which probes find recall."""
    few = sorted(drawn(asked, probes, 1).join(points.select("pid", "v"), "pid").collect(), key=lambda r: r["pid"])  # about probes rows
    if not few:
        return 2, 1
    pids = np.array([r["pid"] for r in few])
    near = exact(points, pids, np.array([r["v"] for r in few]), nearest).collect()  # probes * nearest at most
    spark = points.sparkSession
    wanted = spark.createDataFrame([(int(r["pid"]),) for r in near] + [(int(p),) for p in pids], "pid long").distinct()
    at = {(r["pid"], r["o"]): r["rank"] for r in ranks.join(F.broadcast(wanted), "pid").collect()}
    orderings = 1 + max((o for _, o in at), default=0)
    if not near:
        return 2, 1
    gaps = np.array([[abs(at[r["probe"], o] - at[r["pid"], o]) for o in range(orderings)] for r in near])
    choices = [(c, int(np.quantile(gaps[:, :c].min(axis=1), recall, method="higher"))) for c in range(min(2, orderings), orderings + 1)]
    return min(choices, key=lambda x: (x[0] * x[1], x[0]))


def search(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, nearest: int = NEAREST, curves: int = CURVES, dims: int = DIMS, recall: float = RECALL, probes: int = PROBES, seed: int = SEED
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query, by inner product in double precision.

    Queries are the rows whose id is divisible by every. Equal vectors are one point of the index with their smallest
    nearest + 1 ids, which is all that can be needed as ties go to the smaller id. Each ordering sorts all points by their
    Hilbert key; a query is compared with the points whose place in an ordering is within its window, and the best of all
    orderings are merged and ranked by exact scores. The window and the number of orderings used are the cheapest with which
    a few probes find the wanted recall of their exact neighbours, for which the probes alone are compared with every row.
    The curves are fitted on about SAMPLE vectors at most, chosen by a hash where they are; every row is indexed.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    null ids. Of rows repeated with one id, the smallest vector counts. Fewer rows than nearest give all candidates found.
    Empty table: no rows.
    """
    spark, k = vectors.sparkSession, nearest + 1
    ship(spark)
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    points = stored(points_of(rows, k), "points")
    asks = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    asks = stored(asks.join(points.select("v", "pid"), "v").select("query_id", "pid"), "queries")
    asked = asks.select("pid").distinct()
    sample = [r["v"] for r in sorted(drawn(points, SAMPLE, 0).select("pid", "v").collect(), key=lambda r: r["pid"])]  # about SAMPLE rows
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranks = ordered(points, fitted(np.array(sample), curves, dims, seed))
    used, window = window_of(points, ranks, asked, nearest, recall, probes)
    window = max(window, nearest + 1)  # at either end of an ordering there are points on one side alone
    ranks = ranks.filter(F.col("o") < used)
    reach = -(-window // BLOCK)

    block = F.floor(F.col("rank") / BLOCK)
    queries = ranks.join(asked, "pid").select("o", "pid", "rank", F.floor(block / COARSE).alias("part"), F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("rank") - window) / BLOCK)), F.floor((F.col("rank") + window) / BLOCK))).alias("block"))
    rest = ranks.select(F.col("o").alias("o2"), F.col("pid").alias("pid2"), F.col("rank").alias("rank2"), F.explode(F.sequence(F.greatest(F.lit(0), F.floor((block - reach) / COARSE)), F.floor((block + reach) / COARSE))).alias("part2"), block.alias("block2"))
    held = points.select("pid", "v")
    keys = ["o", "part", "block"]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            right = right.sort_by("pid2")
            ids, places, x = np.asarray(right["pid2"]), np.asarray(right["rank2"]), _vectors(right["v2"])
            asked_ids, asked_places, y = np.asarray(left["pid"]), np.asarray(left["rank"]), _vectors(left["v"])
            for a in range(0, len(y), 128):
                scores = y[a : a + 128] @ x.T
                scores[np.abs(asked_places[a : a + 128, None] - places[None, :]) > window] = -np.inf
                found += [(q, i, s) for q, (i, s) in zip(asked_ids[a : a + 128], _top(scores, ids, k)) if len(i)]
        return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=["query", "pids", "scores"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        best = dict(zip(np.concatenate([np.asarray(x) for x in group["pids"].to_pylist()]), np.concatenate([np.asarray(x) for x in group["scores"].to_pylist()])))
        ids, scores = np.array(list(best), np.int64), np.array(list(best.values()))
        at = np.lexsort((ids, -scores))[:k]
        return pa.table([pa.array(np.full(len(at), key[0].as_py()), pa.int64()), pa.array(ids[at]), pa.array(scores[at])], names=["query", "pid", "score"])

    met = queries.join(held, "pid").groupBy(*keys).cogroup(rest.join(points.select(F.col("pid").alias("pid2"), F.col("v").alias("v2")), "pid2").groupBy("o2", "part2", "block2")).applyInArrow(compare, "query long, pids array<long>, scores array<double>")
    best = stored(met.groupBy("query").applyInArrow(merge, "query long, pid long, score double"), "best")
    each = best.join(points.select("pid", "ids"), "pid").select("query", "score", F.explode("ids").alias("vec_id"))
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    each = each.withColumn("nth", nth).filter(F.col("nth") <= k).select("query", "score", "vec_id")
    own = asks.join(each, asks["pid"] == each["query"]).filter("query_id <> vec_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return own.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= nearest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
