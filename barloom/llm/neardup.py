"""Near-duplicate vectors by cross-polytope hashing.

Vectors are scaled to length 1 and grouped into classes of equal direction and
label. A table hashes a vector by pseudo-random rotations (sign flips and a
fast Hadamard transform, three times): two rotations, more for very large
labels, give a nearest signed axis each, which name a bucket together. Multiprobe: a vector is also filed under
the next nearest axes. Pairs that share a bucket of a label and whose sketches
(signs of 64 rotated components) are not far apart are candidates; they are
verified by exact cosine in double precision.

Only names and sketches travel to the buckets; vectors follow for the
candidates that join groups (see ``components.linked``), and once for each
chunk of a component, where all pairs are verified to count the links. Nothing
is capped and no bucket is gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, text_batches, written
from .components import link_counts, linked

TABLES, PROBES = 8, 4
#: Classes, and components of vectors, in a chunk of a component.
CELL_ROWS, CELL_VALUES = 1024, 1 << 21
#: Signs of a sketch, and how many may differ. At a cosine of 0.98 a sign differs
#: with a chance of 0.064, so 16 of 64 are passed once in about 10^7 links.
BITS, MOST = 64, 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, length preserving."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axes_for(n: int, dim: int) -> int:
    """Rotations of a table, such that a bucket holds about 64 of ``n`` unlike
    vectors at any size of the input; 2 at least."""
    return max(2, math.ceil(math.log(max(1.0, n / 64)) / math.log(2 * max(2, dim))))


def rotations(dim: int, seed: int, tables: int = TABLES, axes: int = 2) -> np.ndarray:
    """Signs of three flips, for each rotation of a table."""
    width = 1 << max(0, (max(1, dim) - 1).bit_length())
    return np.random.default_rng([seed, width]).choice([-1.0, 1.0], (tables, axes, 3, width))


def rotated(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    for flip in flips:
        x = hadamard(x * flip)
    return x


def bucket_keys(x: np.ndarray, signs: np.ndarray, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (rows x tables * probes) of vectors of length 1, the
    likeliest first: the axis pairs with the smallest sums of distances; and the
    sketch of each (0 for vectors of fewer components than it has signs, whose
    rotations are too alike)."""
    width = signs.shape[-1]
    wide = np.zeros((len(x), width))
    wide[:, : x.shape[1]] = x
    out, sketch = [], np.zeros(len(x), np.int64)
    for t in range(len(signs)):
        name, total = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for r in range(signs.shape[1]):
            y = rotated(wide, signs[t, r])
            if t == r == 0 and width >= BITS:
                sketch = np.packbits(y[:, :BITS] > 0, axis=1).view(np.int64).ravel()
            both = np.concatenate([y, -y], axis=1)
            few = min(probes, both.shape[1])
            top = np.argpartition(-both, few - 1, axis=1)[:, :few]
            value = np.take_along_axis(both, top, 1)
            order = np.lexsort((top, -value), axis=1)
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            # the likeliest names so far, each with the likeliest next axes
            total = (total[:, :, None] + (value[:, :1] - value)[:, None, :]).reshape(len(x), -1)
            name = (name[:, :, None] * (2 * width) + top[:, None, :]).reshape(len(x), -1)
            pick = np.argsort(total, axis=1, kind="stable")[:, :probes]
            total, name = np.take_along_axis(total, pick, 1), np.take_along_axis(name, pick, 1)
        keys = name * len(signs) + t
        if keys.shape[1] < probes:
            keys = np.concatenate([keys, np.repeat(keys[:, :1], probes - keys.shape[1], 1)], 1)
        out.append(keys)
    return np.concatenate(out, axis=1), sketch


def classes(vectors: DataFrame) -> DataFrame:
    """Rows that can link (``vec_id, label, cls, unit``): label and vector not
    null, all components finite, not all zero. ``cls`` names label and exact
    components."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col("label").isNotNull() & x.isNotNull()).where(F.coalesce(good, F.lit(False)))
    return rows.select("vec_id", "label", F.transform(x, lambda v: v.cast("double")).alias("unit")).withColumn("cls", F.xxhash64("label", "unit"))


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of one length, scaled to length 1 without overflow."""
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def packed(row: np.ndarray) -> bytes:
    """A vector in single precision if nothing is lost; the first byte tells."""
    small = row.astype(np.float32)
    return b"s" + small.tobytes() if (small.astype(np.float64) == row).all() else b"d" + row.tobytes()


def unpacked(raw: list[bytes]) -> np.ndarray:
    return _unit([np.frombuffer(r, np.float32 if r[:1] == b"s" else np.float64, offset=1) for r in raw])


def filed(reps: DataFrame, n: int, tables: int = TABLES, probes: int = PROBES, seed: int = 7) -> DataFrame:
    """``node, weight, dim, sketch, keys, raw`` of each class; keys are hashes of
    bucket, length and label; ``n`` is the size of the largest label."""

    def run(batches):
        for batch in batches:
            rows = [np.asarray(r, np.float64) for r in batch.column(3).to_pylist()]
            keys, sketch = np.zeros((len(rows), tables * probes), np.int64), np.zeros(len(rows), np.int64)
            dims = np.array([len(r) for r in rows], np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                keys[at], sketch[at] = bucket_keys(_unit([rows[k] for k in at]), rotations(int(d), seed, tables, axes_for(n, int(d))), probes)
            cols = [batch.column(0), batch.column(2), batch.column(1), pa.array(dims, pa.int32()), pa.array(sketch), pa.array(list(keys), pa.list_(pa.int64())), pa.array([packed(r) for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "weight", "label", "dim", "sketch", "keys", "raw"])

    kind = reps.schema["label"].dataType.simpleString()
    out = reps.select("cls", "label", "n", "unit").mapInArrow(run, f"node long, weight long, label {kind}, dim int, sketch long, keys array<long>, raw binary")
    return out.withColumn("keys", F.array_distinct(F.transform("keys", lambda k: F.xxhash64("label", "dim", k)))).drop("label")


def far(x, y):
    """Signs of two sketches that differ."""
    return F.bit_count(x.bitwiseXOR(y))


def verified(pairs: DataFrame, file: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose exact cosine reaches ``least``."""

    def check(batches):
        for batch in batches:
            x, y = (batch.column(k).to_pylist() for k in (2, 3))
            keep = np.zeros(len(x), bool)
            size = np.array([len(r) for r in x])
            for s in np.unique(size):
                at = np.flatnonzero((size == s) & (np.array([len(r) for r in y]) > 0))
                a, b = unpacked([x[k] for k in at]), [y[k] for k in at]
                same = np.array([len(np.frombuffer(r, np.float32 if r[:1] == b"s" else np.float64, offset=1)) == a.shape[1] for r in b])
                keep[at[same]] = np.einsum("ij,ij->i", a[same], unpacked([r for r, ok in zip(b, same, strict=True) if ok])) >= least if same.any() else False
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    one = lambda k, x: file.select(F.col("node").alias(k), F.col("raw").alias(x))
    full = pairs.join(one("a", "x"), "a").join(one("b", "y"), "b").select("a", "b", "x", "y")
    return written(full.mapInArrow(check, "a long, b long"), "links")


def cell_links(names, weight, side, same, raw, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a cell that link with others in it, and how many vectors each
    links with there: exact cosines in blocks."""
    x = unpacked(raw)
    left = np.arange(len(x)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    near = np.zeros(len(x), np.int64)
    for lo in range(0, len(left), 512):
        part = left[lo : lo + 512]
        cos = x[part] @ x[right].T
        hit = cos >= least
        # where the order of a sum could matter, the sum of the verification counts
        a, b = np.nonzero(np.abs(cos - least) < 1e-9)
        hit[a, b] = np.einsum("ij,ij->i", x[part[a]], x[right[b]]) >= least
        if same:
            hit[np.arange(len(part)), lo + np.arange(len(part))] = False
        near[part] += hit @ weight[right]
        if not same:
            near[right] += weight[part] @ hit
    return names[near > 0], near[near > 0]


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """One row per vector: ``vec_id, n_links`` (other vectors linked directly),
    ``component_id`` (smallest vec_id reachable, itself included), ``kept``
    (whether it is that one).

    Vectors that are null, zero or hold null or non-finite components, and
    those without label, link with nothing; neither do vectors of different
    lengths. Equal rows link with each other, rows that share an id too. Links
    found are exact; groups form by pairs that share a bucket (recall is measured
    in the tests), and within a group every link is counted. A null id links
    like any other; its component may then have another smallest id. An empty
    table gives no rows; columns besides ``vec_id``, ``embedding`` and ``label``
    are not read, whatever their names.
    """
    text_batches(vectors.sparkSession)
    own = classes(vectors)
    most = own.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    file = written(filed(own.groupBy("cls", "label", "unit").agg(F.count("*").alias("n")), most, tables, probes), "vectors")
    many = file.select("node", "sketch", F.explode("keys").alias("token"))
    shared = many.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    held = written(many.join(shared, "token"), "held")
    roots = linked(held, [], lambda x, y: far(x("sketch"), y("sketch")) <= MOST, lambda pairs: verified(pairs, file, least))
    groups = roots.join(file.select("node", "weight", "dim"), "node")
    parts = F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum("dim") / CELL_VALUES))
    near = link_counts(groups, parts, file.select("node", "raw"), lambda *cell: cell_links(*cell, least))
    named = file.select("node", "weight").join(roots, "node", "left").join(near, "node", "left")
    named = named.select(F.col("node").alias("cls"), F.coalesce("root", "node").alias("root"), (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    members = written(own.select("vec_id", "cls").join(named, "cls"), "members")
    discard(file, held, roots)
    least_id = members.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked_rows = members.join(least_id, "root").select("vec_id", "n_links", "component_id")
    x = F.col("embedding")
    good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    alone = vectors.where(~good | x.isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND x IS NOT NULL
      AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.label = q.label AND p.vec_id <> q.vec_id WHERE list_inner_product(p.x, q.x) / (p.norm * q.norm) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
