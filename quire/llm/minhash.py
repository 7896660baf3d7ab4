"""Near-dedup: fast similarity sketches, banding, exact verification on full shingle sets, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.kernels import mix, shingle_sets
from quire.llm.shared import forget, keep_only, stored, table
from quire.session import ship

#: Coordinates of a sketch, in BANDS bands. Two sets of similarity s share no band with a probability of about
#: (1 - s ** (COORDS / BANDS)) ** BANDS: 5e-6 at s = 0.75.
COORDS, BANDS = 128, 32
#: Least similarity, as two whole numbers: OVER * intersection >= LEAST * union.
OVER, LEAST = 100, 75
#: Sets of a bucket that are compared with each other in one task, and elements in all (16 bytes each); larger buckets are
#: dealt out as pairs of blocks.
BLOCK, ELEMENTS = 1024, 1 << 20


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """The fast similarity sketch of each set that isn't empty, a row of coords values each.

    Round r places every element by a hash of its own into one bin; a bin keeps its smallest (round, value). Rounds stop
    once all bins are filled. After coords rounds, round coords + j puts every element into bin j, so each bin fills for
    sure. Only sets with open bins take part in a further round.
    """
    out = np.full((len(sets), coords), np.uint64(0xFFFFFFFFFFFFFFFF))
    n = np.array([x.shape[1] for x in sets], dtype=np.int64)
    flat, owner = (np.concatenate([x[0] for x in sets]) if len(sets) else np.zeros(0, np.uint64)), np.repeat(np.arange(len(sets)), n)
    bits, top = np.uint64(coords - 1), np.uint64(56)
    for r in range(2 * coords):
        if not len(flat):
            break
        x = mix(flat ^ mix(np.array([r + 1], dtype=np.uint64)))
        value = (np.uint64(min(r, 255)) << top) | (x >> np.uint64(8))
        if r < coords:
            np.minimum.at(out.reshape(-1), owner * coords + (x & bits).astype(np.int64), value)
        else:
            low = np.full(len(sets), np.uint64(0xFFFFFFFFFFFFFFFF))
            np.minimum.at(low, owner, value)
            out[:, r - coords] = np.minimum(out[:, r - coords], low)
        open_ = (out == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
        if r + 1 < 2 * coords:
            keep = open_[owner]
            if not keep.all():
                flat, owner = flat[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each sketch; the band's number is part of it."""
    parts = sketch.reshape(len(sketch), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = mix(key * np.uint64(0x100000001B3) ^ parts[:, :, k])
    return key.view(np.int64)


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only("sets")
    for batch in batches:
        ids = batch.column(0)
        for i, sets in shingle_sets(batch.column(1)):
            full = [j for j, x in enumerate(sets) if x.shape[1]]
            keys = band_keys(sketches([sets[j] for j in full]))
            counts = np.zeros(len(sets), np.int32)
            counts[full] = keys.shape[1] if len(full) else 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(keys.reshape(-1)))
            made = [pa.array([x.shape[1] for x in sets], pa.int64()), pa.array([_digest(x) for x in sets], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([ids.slice(i, len(sets)), *made], schema=SIGNED)


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only("sets")
    for batch in batches:
        for _, sets in shingle_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["set_id", "elements"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as shingle_sets() gives them, are linked."""
    x, y = (x, y) if x.shape[1] <= y.shape[1] else (y, x)
    n, m = x.shape[1], y.shape[1]
    if OVER * n < LEAST * m:
        return False
    if (y[0][1:] == y[0][:-1]).any():  # a lane collides within the set
        both = len(set(zip(*x.tolist())) & set(zip(*y.tolist())))
    else:
        at = np.searchsorted(y[0], x[0])
        at[at == m] = 0
        both = int(((y[0][at] == x[0]) & (y[1][at] == x[1])).sum())
    return OVER * both >= LEAST * (n + m - both)


def _elements(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=np.uint64).reshape(2, -1) for v in column]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only("sets")
    for batch in batches:
        mask = pa.array([_similar(x, y) for x, y in zip(_elements(batch.column(2)), _elements(batch.column(3)))], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _block_links(group: pa.Table) -> pa.Table:
    """Links that join components among the sets of one block, or between those of two.

    A pair is compared in the first band that both share, so once in the whole job, and only while its sets aren't known
    to be connected; the links found form a forest over the components.
    """
    group = group.combine_chunks()
    band, low, high = (group.column(c)[0].as_py() for c in ("band", "low", "high"))
    ids, roots, block = (group.column(c).to_pylist() for c in ("set_id", "root", "block"))
    sets = _elements(group.column("elements"))
    keys = np.array(group.column("bands").to_pylist(), dtype=np.int64).reshape(len(ids), -1)
    up = {r: r for r in roots}

    def top(x: bytes) -> bytes:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    a, b = [], []
    sizes = np.array([x.shape[1] for x in sets])
    for i in range(len(ids)):
        if block[i] != low:
            continue
        same = keys == keys[i]
        fits = (np.argmax(same, axis=1) == band) & (np.minimum(sizes, sizes[i]) * OVER >= np.maximum(sizes, sizes[i]) * LEAST)
        for j in np.flatnonzero(fits):
            if block[j] == high and (low != high or i < j) and top(roots[i]) != top(roots[j]) and _similar(sets[i], sets[j]):
                up[top(roots[i])] = top(roots[j])
                a.append(ids[i])
                b.append(ids[j])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def near_size(n: Column, m: Column) -> Column:
    """What linked sets' sizes fulfil: the smaller is at least LEAST / OVER of the larger."""
    return F.least(n, m) * OVER >= F.greatest(n, m) * LEAST


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that are linked, by their full sets."""
    left = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_linked, "a binary, b binary")


def links_of(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root): set ids with links, and the smallest set id they reach.

    One row for each different set goes into the buckets. First each bucket's leader, its smallest set id, is verified
    against the other members, which settles groups of near copies by a star of pairs. What is left are buckets with members
    of several components: these are compared with each other in blocks of a bounded size, where only links that join
    components come out. So every pair that shares a bucket is verified or known to be connected, and no join makes all
    pairs of a bucket.
    """
    sets = signed.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = stored(sets, "sets")
    spread = sets.select("set_id", "n", F.posexplode("bands").alias("band", "bucket"))
    lead = spread.groupBy("bucket").agg(F.min("set_id").alias("lead"), F.count("*").alias("m")).filter("m > 1").select("bucket", "lead")
    members = stored(spread.join(lead, "bucket"), "members")
    wanted = stored(members.select("set_id").distinct().join(sets.select("set_id", "doc_id"), "set_id"), "wanted")
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    unknown = docs.filter("doc_id IS NULL")
    full = texts.unionByName(unknown).mapInArrow(_full, "set_id binary, elements binary").join(wanted.select("set_id"), "set_id", "left_semi")
    full = stored(full.groupBy("set_id").agg(F.first("elements").alias("elements")), "elements")
    sizes = sets.select(F.col("set_id").alias("lead"), F.col("n").alias("lead_n"))
    star = members.filter(F.col("set_id") != F.col("lead")).select("lead", "set_id", "n").distinct().join(sizes, "lead").filter(near_size(F.col("n"), F.col("lead_n")))
    # a table, so that the joins deal these rows anew and Spark can split a leader with very many members
    pairs = stored(star.select(F.col("lead").alias("a"), F.col("set_id").alias("b")), "pairs")
    links = stored(verified(pairs, full), "links")
    roots = components(links)
    rest = members.filter(F.col("set_id") != F.col("lead")).join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    rest = stored(rest.select("bucket", "band", "set_id", "n", F.coalesce("root", "set_id").alias("root")), "rest")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / ELEMENTS)).cast("int").alias("blocks")
    open_ = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks).filter("lo <> hi").select("bucket", "blocks")
    # a bucket can hold a large part of the rows: with a merge join, Spark splits it when it sees its size
    dealt = rest.join(open_.hint("merge"), "bucket").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = stored(dealt.select("bucket", "band", "set_id", "root", "block", "low", "high"), "open")
    held = dealt.join(full, "set_id").join(sets.select("set_id", "bands"), "set_id")
    more = stored(held.groupBy("bucket", "low", "high").applyInArrow(_block_links, "a binary, b binary").distinct(), "links")
    out = components(links.unionByName(more))
    forget(sets, members, wanted, full, pairs, links, roots, rest, dealt, more)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Sets are the distinct shingles of five words, A-Z lower-cased; texts with fewer words have their whole sequence as the
    only shingle; null, empty and blank texts have none and are linked with nothing. component_id is the smallest id that
    can be reached by links of similarity 0.75 or more. Equal sets are one node, whatever the number of their rows. Rows
    repeated with one id get equal results; a null id is never the smallest unless all are null. Empty table: no rows.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = stored(base.mapInArrow(_sign, "doc_id long, n long, set_id binary, bands array<long>"), "signed")
    roots = links_of(signed, base)
    sets = signed.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    known = stored(sets.join(roots, sets["set_id"] == roots["node"], "left").select("set_id", "least", "rows", F.coalesce("root", "set_id").alias("root"), F.col("root").isNotNull().alias("near")), "known")
    whole = known.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stored(known.filter("near OR rows > 1").join(whole, "root").select("set_id", "component_id"), "found")
    forget(roots, known)
    out = signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(found, "set_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which none with a smaller id is in their group, with their own columns, whatever their names.

    Rows repeated with one id stay all or go all; rows with a null id stay if no row of their group has an id. Documents
    with null, empty or blank text stay. Empty table: no rows.
    """
    keep = near_dedup(docs, id_col, text_col).filter("kept").select("doc_id").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return rows.join(keep, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
u AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, f.b FROM r JOIN f ON r.b = f.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
