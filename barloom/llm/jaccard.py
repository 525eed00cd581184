"""Exact Jaccard join of word shingles by prefixes under several global orders.

If two sets reach the threshold, then under *any* total order of the tokens
their prefixes share a token. The first order is rare-first (document counts of
all documents in a sketch of fixed size, ties by hash); its prefixes meet in a
shuffle by token, with a bound from positions: behind the first shared token no
more can follow than the shorter rest. Under the second order, by hash, and the
third, by hash downwards, the first tokens of both sets must share as many as
the threshold leaves no choice about. Only pairs that pass every order are
verified, and only their texts are read again.

Work stays linear in groups of copies: equal sets are one node, of each prefix
token first only the pairs with its hub (the entry nearest to the front) are
verified, and the exact rest looks at pairs of different components alone (see
``components.linked``). Every link thus lies within a component, and there all
pairs of different sets are verified to count the links of each document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, LOWER_ASCII, discard, flat, mixed, side, spread, text_batches, tidy, word_hashes, written
from .components import link_counts, linked

#: Sets, and tokens, of a chunk of a component.
CELL_SETS, CELL_TOKENS = 1024, 400_000
#: Steps a doubling of the count sketch's levels.
STEPS = 16
_C = [np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64)) for k in range(64)]


def shingle_sets(column: pa.Array, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of every text; a text with fewer words
    has one shingle of all of them, one without words none."""
    word, row, _ = word_hashes(*flat(column), fold=LOWER_ASCII)
    rows = len(column)
    at = np.searchsorted(row, np.arange(rows + 1))
    whole = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        whole += word[k : k + len(whole)] * _C[k]
    whole = mixed(whole, words)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            out.append(mixed((word[a:b] * np.array(_C[: b - a])).sum(keepdims=True), 100 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def names_of(tokens: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two names of a set: its node, and the twin that tells sets apart whose
    nodes are the same by chance."""
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True) >> (64 - bits), int.from_bytes(raw[8:], "little", signed=True)


def node_of(tokens: np.ndarray, clash: frozenset[int] = frozenset(), bits: int = 64) -> int:
    """Name of a set; where several sets share one, the twin takes its place."""
    node, twin = names_of(tokens, bits)
    return twin if node in clash else node


def head_of(tokens: np.ndarray) -> bytes:
    """The first tokens by hash upwards, and by hash downwards, cut to 32 bits:
    about an eighth of the set each, eight at least."""
    few = min(len(tokens), max(8, -(-13 * len(tokens) // 100)))
    ends = np.concatenate([tokens[:few], ~tokens[len(tokens) - few :][::-1]])
    return (ends >> np.uint64(32)).astype(np.uint32).tobytes()


def heads_agree(x: bytes, n: int, y: bytes, m: int, num: int, den: int) -> bool:
    """Whether two sets of n and m tokens may reach the threshold under the
    second and the third order. Up to the smaller last token both heads are
    complete; of the tokens there at most n - least (m - least) can lie outside
    the intersection."""
    least = -(-num * (n + m) // (num + den))
    for a, b in zip(np.frombuffer(x, np.uint32).reshape(2, -1), np.frombuffer(y, np.uint32).reshape(2, -1), strict=True):
        last = min(a[-1], b[-1]) if len(a) < n and len(b) < m else a[-1] if len(a) < n else b[-1] if len(b) < m else np.uint32(0xFFFFFFFF)
        # equal cut tokens at the very end may continue behind the head
        a, b = a[: np.searchsorted(a, last)], b[: np.searchsorted(b, last)]
        must = max(len(a) - (n - least), len(b) - (m - least))
        if must > 0:
            at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
            if not len(b) or int((b[at] == a).sum()) < must:
                return False
    return True


def _pack(counts: np.ndarray) -> bytes:
    """Counts of a slice, sparse or dense, whichever is shorter."""
    at = np.flatnonzero(counts)
    small = np.minimum(counts, 255).astype(np.uint8)
    if len(at) * 6 < len(counts):
        return b"s" + zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + small[at].tobytes(), 1)
    return b"d" + zlib.compress(small.tobytes(), 1)


def _unpack(blob: bytes, into: np.ndarray) -> None:
    raw = zlib.decompress(blob[1:])
    if blob[:1] == b"d":
        into += np.frombuffer(raw, np.uint8)
    else:
        n = len(raw) // 5
        into[np.cumsum(np.frombuffer(raw[: 4 * n], np.uint32).astype(np.int64))] += np.frombuffer(raw[4 * n :], np.uint8)


def signatures(docs: DataFrame, words: int, bits: int, name_bits: int) -> DataFrame:
    """One pass over whole texts: a row per document (``doc_id, node, twin, n,
    head, handle``, handle = hash of the text) and, at the end of a partition, its
    token counts in ``2^bits`` slots as slices."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slices, names = 64, ["doc_id", "node", "twin", "n", "handle", "head", "slice", "counts"]

    def run(batches):
        counts, seen = np.zeros(1 << bits, np.uint16), set()  # may wrap: it only steers an order
        types = None
        for batch in batches:
            types = batch.column(0).type
            sets = shingle_sets(batch.column(1), words)
            nodes = [names_of(s, name_bits) for s in sets]
            for s, v in zip(sets, nodes, strict=True):
                if v not in seen:  # copies within the task count once
                    seen.add(v)
                    np.add.at(counts, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
            if len(seen) > 1_000_000:
                seen.clear()
            n = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([v[k] for v in nodes], pa.int64()) for k in (0, 1)), pa.array([len(s) for s in sets], pa.int32()), batch.column(2), pa.array([head_of(x) for x in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if types is not None:
            size = len(counts) // slices
            blobs = [_pack(counts[k * size : (k + 1) * size]) for k in range(slices)]
            yield pa.RecordBatch.from_arrays([pa.nulls(slices, types), pa.nulls(slices, pa.int64()), pa.nulls(slices, pa.int64()), pa.nulls(slices, pa.int32()), pa.nulls(slices, pa.int64()), pa.nulls(slices, pa.binary()), pa.array(range(slices), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("handle"))
    return written(spread(rows).mapInArrow(tidy(run), f"doc_id {kind}, node long, twin long, n int, handle long, head binary, slice int, counts binary"), "signatures")


def token_levels(signed: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """Document counts per slot on a log scale (one byte a slot: 16 MB at 24
    bits, whatever the input), and the mean count."""
    size = (1 << bits) // 64

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _unpack(blob, total.setdefault(k, np.zeros(size, np.uint64)))
        for k, v in total.items():
            level = np.minimum(255, np.round(STEPS * np.log2(1.0 + v))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([float(v.sum())])], names=["slice", "level", "total"])

    text_batches(signed.sparkSession)
    rows = signed.where(F.col("slice").isNotNull()).select("slice", "counts").repartition(64, "slice")
    got = rows.mapInArrow(tidy(run), "slice int, level binary, total double").collect()
    out = np.zeros(1 << bits, np.uint8)
    for r in got:
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r.level, np.uint8)
    return out, sum(r.total for r in got) / (1 << bits)


def entries(docs: DataFrame, levels: Broadcast, load: float, words: int, bits: int, num: int, den: int, name: Callable) -> DataFrame:
    """Prefixes under the rare-first order as ``key, node, code``. ``code``
    packs set size, position and whether the token is ``hot``: its count is far
    above the mean, so it certainly has partners. The key is the token; that of
    a hot one also holds six bits of the node, so that no task gets it whole."""
    text_batches(docs.sparkSession)
    hot = int(min(255, round(STEPS * np.log2(1.0 + 64 + 16 * load))))

    def run(batches):
        level, seen = np.frombuffer(levels.value, np.uint8), set()
        for batch in batches:
            out = []
            for s in shingle_sets(batch.column(0), words):
                n = len(s)
                if not n:
                    continue
                v = name(s)
                if v in seen:
                    continue
                seen.add(v)
                mine = level[(s >> np.uint64(64 - bits)).astype(np.int64)]
                p = n - -(-num * n // den) + 1
                # rarest first, then by hash: s is sorted, so a stable sort keeps ties in order
                first = np.argsort(mine, kind="stable")[:p]
                often = mine[first] >= hot
                key = s[first].view(np.int64) ^ (often * np.int64((v % 64) << 57))
                out.append((key, np.full(p, v, np.int64), (n << 32) + 2 * np.arange(p, dtype=np.int64) + often))
            if len(seen) > 1_000_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["key", "node", "code"])

    return spread(docs.select("text")).mapInArrow(tidy(run), "key long, node long, code long")


def shared_entries(found: DataFrame) -> DataFrame:
    """``token, node, n, pos`` of tokens that more than one entry holds."""
    hot = F.col("code").bitwiseAND(F.lit(1)) == 1
    held = found.withColumn("m", F.count("*").over(Window.partitionBy("key"))).where((F.col("m") > 1) | hot)
    token = F.when(hot, F.col("key").bitwiseXOR(F.shiftleft(F.pmod("node", F.lit(64)), 57))).otherwise(F.col("key"))
    n, pos = F.shiftright("code", 32).cast("int"), F.shiftright(F.col("code").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")
    return held.select(token.alias("token"), "node", n.alias("n"), pos.alias("pos"))


def may_reach(x: Callable, y: Callable, num: int, den: int) -> Column:
    """Size and position filters for a pair whose first shared token is here:
    at most 1 + the shorter rest is shared, and |A & B| must reach
    num (|A| + |B|) / (num + den)."""
    n, m = x("n"), y("n")
    rest = F.least(n - x("pos"), m - y("pos"))
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((num + den) * rest >= num * (n + m))


def by_heads(pairs: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose heads under the second and the third order agree.
    ``heads`` has ``node, n, head`` of every document. One shuffle drops what
    repeats and serves both ends; of few pairs, only their nodes take part."""
    if pairs.count() <= BROADCAST_ROWS // 2:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        heads = heads.join(F.broadcast(ends), "node", "left_semi")
    each = heads.dropDuplicates(["node"])
    one = lambda k, h, n: each.select(F.col("node").alias(k), F.col("head").alias(h), F.col("n").alias(n))
    full = pairs.join(one("a", "x", "n"), "a").join(one("b", "y", "m"), "b").select("a", "b", "x", "n", "y", "m")

    def run(batches):
        for batch in batches:
            x, n, y, m = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = pa.array([heads_agree(*r, num, den) for r in zip(x, n, y, m, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return written(full.mapInArrow(tidy(run), "a long, b long"), "candidates")


def sets_of(docs: DataFrame, need: DataFrame, words: int, name: Callable) -> DataFrame:
    """``node, tokens`` of the texts whose handle is in ``need``; written without
    a shuffle, so a node may repeat: the join that reads it drops repeats in the
    shuffle that it needs anyway."""
    text = docs.select("text", F.xxhash64("text").alias("handle")).where(F.col("text").isNotNull())
    found = text.join(side(need), "handle", "left_semi")

    def sets(batches):
        seen = set()
        for batch in batches:
            own = [(name(s), s) for s in shingle_sets(batch.column(0), words)]
            own = [(v, s) for v, s in own if not (v in seen or seen.add(v))]
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in own], pa.int64()), pa.array([s.tobytes() for _, s in own], pa.binary())], names=["node", "tokens"])

    return written(found.select("text").mapInArrow(tidy(sets), "node long, tokens binary"), "sets")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, heads: DataFrame, words: int, num: int, den: int, name: Callable) -> DataFrame:
    """The pairs ``a, b`` (nodes) that link. Only texts of nodes in pairs that
    pass every order are read again, by the handle that ``nodes`` has."""
    pairs = by_heads(pairs, heads, num, den)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    need = written(nodes.join(ends, "node").select("handle"), "needed", packed=True)
    sets = sets_of(docs, need, words, name)
    own = sets.dropDuplicates(["node"])

    def check(batches):
        for batch in batches:
            a, b, left, right = (batch.column(k) for k in range(4))
            good = []
            for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, True))
                good.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    full = pairs.join(own.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    out = written(full.select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long"), "links")
    discard(need, sets, pairs)
    return out


def cell_links(names: np.ndarray, weight: np.ndarray, side: np.ndarray, same: bool, sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of a cell that link with others in it, and how many documents each
    links with there. All pairs of a chunk (``same``), or of two chunks, whose
    sizes allow it are verified on whole sets."""
    size = np.array([len(x) for x in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(size, kind="stable")
    right = order if same else order[side[order] == 1]
    ids = np.concatenate([token[start[k] : start[k + 1]] for k in right] or [token[:0]])
    begin, many = np.concatenate([[0], np.cumsum(size[right])]), size[right]
    near, present = np.zeros(len(sets), np.int64), np.zeros(len(token) and int(token.max()) + 1, bool)
    for at, k in enumerate(right if same else order[side[order] == 0]):
        n = size[k]
        # sizes ascend: from the least partner (behind this one in its own chunk) to the largest
        lo = max(at + 1 if same else 0, int(np.searchsorted(den * many, num * n)))
        hi = int(np.searchsorted(num * many, den * n, "right"))
        if lo >= hi:
            continue
        own = token[start[k] : start[k + 1]]
        present[own] = True
        both = np.add.reduceat(present[ids[begin[lo] : begin[hi]]], begin[lo:hi] - begin[lo], dtype=np.int64)
        present[own] = False
        hit = right[lo:hi][den * both >= num * (n + many[lo:hi] - both)]
        near[k] += weight[hit].sum()
        near[hit] += weight[k]
    linked = near > 0
    return names[linked], near[linked]


def counted(docs: DataFrame, nodes: DataFrame, roots: DataFrame, words: int, num: int, den: int, name: Callable) -> DataFrame:
    """``node, near``: the documents of other sets that a set links with."""
    own = written(roots.join(nodes.select("node", "n", "weight", "handle"), "node"), "grouped", packed=True)
    need = written(own.select("handle"), "needed", packed=True)
    sets = sets_of(docs, need, words, name)
    parts = F.greatest(F.ceil(F.count("*") / CELL_SETS), F.ceil(F.sum("n") / CELL_TOKENS))

    def count(names, weight, side, same, raw):
        return cell_links(names, weight, side, same, [np.frombuffer(r, np.uint64) for r in raw], num, den)

    out = written(link_counts(own, parts, sets.dropDuplicates(["node"]), count), "near")
    discard(own, need, sets)
    return out


def nodes_of(members: DataFrame) -> DataFrame:
    """Nodes with size, weight (documents), the smallest row, and whether all
    sets of that name are the same (``lo`` and ``hi`` of the twins)."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "handle"))
    nodes = members.where("n > 0").groupBy("node").agg(least.alias("first"), F.min("n").alias("n"), F.count("*").alias("weight"), F.min("twin").alias("lo"), F.max("twin").alias("hi"))
    return written(nodes.select("node", "n", "weight", "first", F.col("first.handle").alias("handle"), "lo", "hi"), "nodes")


def join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bits: int = 24, name_bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links, handle,
    kept``.

    Two documents link when den * |A & B| >= num * |A | B| for their sets of
    distinct shingles of ``words`` words (A-Z in lower case). ``component_id``
    is the smallest doc_id reachable by links, itself included; ``n_links`` the
    number of other documents (rows) that it links with directly; ``handle`` is
    the hash of the text, and ``kept`` marks the row of the component with the
    smallest id (null last) and handle. A null, empty or wordless text has no
    shingle, links with nothing and is kept; repeated rows and equal sets link;
    rows with a null id link, and count for no smallest id (null if all ids of
    the component are null); an empty table gives no rows; columns besides
    ``doc_id`` and ``text`` are not read.

    ``bits`` sets the size of the count sketch (2^bits bytes, broadcast). It
    steers the first order only: results are the same for any value. Sets are
    told apart by 128 bits: the few whose first ``name_bits`` agree (one pair in
    about 10^10 sets) are found and go by the other half.
    """
    spark = docs.sparkSession
    text_batches(spark)
    signed = signatures(docs, words, bits, name_bits)
    levels, load = token_levels(signed, bits)
    members = signed.where(F.col("slice").isNull()).select("doc_id", "node", "twin", "n", "handle", "head")
    nodes = nodes_of(members)
    clash = frozenset(r.node for r in nodes.where("lo <> hi").select("node").collect())
    if clash:
        members = members.withColumn("node", F.when(F.col("node").isin(list(clash)), F.col("twin")).otherwise(F.col("node")))
        discard(nodes)
        nodes = nodes_of(members)

    def name(tokens):
        return node_of(tokens, clash, name_bits)

    # what the first order brings together; tokens of one set alone go
    shared = spark.sparkContext.broadcast(levels.tobytes())
    held = written(shared_entries(entries(docs, shared, load, words, bits, num, den, name)), "held")
    shared.destroy()
    heads = members.where("n > 0").select("node", "n", "head")
    roots = linked(held, ["pos", "n"], lambda x, y: may_reach(x, y, num, den), lambda pairs: verified(pairs, docs, nodes, heads, words, num, den, name))
    discard(held)
    near = counted(docs, nodes, roots, words, num, den, name)

    named = nodes.select("node", "first", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    # equal sets link with each other
    named = named.join(best, "root").join(near, "node", "left").select("node", "best", (F.col("weight") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    out = members.drop("head", "twin").join(named, "node", "left")
    alone = F.col("n") == 0
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("best.id")) & F.col("handle").eqNullSafe(F.col("best.handle")))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "handle", kept.alias("kept"))
    out = written(out, "groups")
    discard(signed, nodes, roots, near)
    return out


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN c USING (doc_id)
"""
