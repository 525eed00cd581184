import math

import numpy as np
import pytest

from barloom.llm import components, neardup, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def weights(rows):
    out = []
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    return out


def brute_topk(rows, k=5):
    w, out = weights(rows), []
    for q, a in w:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in w if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def rows_topk(n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 8) / 4], 0) for k in range(n)]
    rows += [(9000, None, 0), (9001, [1.0, None], 0), (9002, [float("nan")] * 8, 0), (9003, [float("inf")] + [0.0] * 7, 1), (None, [1.0] * 8, 0), (9004, [], 0), (9050, [0.5] * 3, None), (9005, [0.5] * 12, None)]
    return rows


@pytest.mark.parametrize("blocks", [(2048, 4096), (3, 37)])
def test_topk(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rows = rows_topk()
    v = topk.integer_rows(spark.createDataFrame(rows, VECTORS))
    got = sorted(map(tuple, topk.search(v, v.where("vec_id % 50 = 0")).collect()))
    assert got == brute_topk(rows)


def test_topk_few_large_and_repeated(spark):
    rows = [(0, [1e6, -1e6], 0), (1, [1e6, 0.0], 0), (2, [0.0, 3e6], 0)]
    v = topk.integer_rows(spark.createDataFrame(rows + [rows[0], rows[1]], VECTORS))
    got = sorted(map(tuple, topk.search(v, v.where("vec_id % 50 = 0")).collect()))
    s = 256_000_000 * 256_000_000
    assert got == [(0, 1, 1, s), (0, 2, 1, s), (0, 3, 2, -3 * s)]
    empty = topk.integer_rows(spark.createDataFrame([], VECTORS))
    assert topk.search(empty, empty).count() == 0 and topk.search(v, v.where("false")).count() == 0


def test_topk_of_weights_beyond_64_bits(spark):
    """No finite vector is dropped; ranks go by the whole numbers."""
    rows = [(50 * k, [1.5 * (-1) ** k, 0.25, k / 8], 0) for k in range(6)] + [(1, [1.7e38, 0.0, 1.0], 0), (2, [1.7e38, 0.0, 2.0], 0), (3, [-3e38, 1e30, 0.0], 0), (4, [2e16, -1.0, 3.0], 0), (100, [3e38, 3e38, -3e38], 0)]
    v = topk.integer_rows(spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS + ", rank int, score string"))
    got = sorted(map(tuple, topk.search(v, v.where("vec_id % 50 = 0")).collect()))
    assert got == sorted((q, r, i, max(-topk.LONG, min(topk.LONG, s))) for q, r, i, s in brute_topk(rows))


def test_topk_of_long_vectors_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(25 * k, [float(x) for x in rng.integers(-4, 5, 3000) / 4], 0) for k in range(8)] + [(7, [1.0] * 3000, 0)] * 300
    v = topk.integer_rows(spark.createDataFrame(rows, VECTORS))
    got = sorted(map(tuple, topk.search(v, v.where("vec_id % 50 = 0")).collect()))
    assert got == brute_topk(rows)


def clusters(seed, groups=40, size=6, dim=16):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for g in range(groups):
        c = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((k, [float(x) for x in c + 0.12 * rng.standard_normal(dim)], g % 3))
            k += 1
    rows += [(k, rows[0][1], rows[0][2]), (k + 1, [2 * x for x in rows[0][1]], rows[0][2]), (k + 2, rows[0][1], 7), (k + 3, rows[0][1], None), (k + 4, None, 0), (k + 5, [0.0] * dim, 0), (k + 6, [None] * dim, 0), (k + 7, [float("inf")] * dim, 0), (k + 8, [], 0), (k + 9, [1.0], 0), (k + 10, [1e-30] * dim, 0), (k + 11, [1e-30] * dim, 0)]
    return rows


def brute_links(rows):
    good = [(i, np.asarray(v, np.float32).astype(float), y) for i, v, y in rows if y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: v / np.abs(v).max() for i, v, _ in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    return {(a, b) for a, x, y in good for b, _, z in good if a < b and y == z and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98}


@pytest.mark.parametrize("chunk", [1024, 5])
def test_neardup_recall_and_exactness(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "CELL_ROWS", chunk)
    rows = clusters(2)
    want = brute_links(rows)
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == len(rows)
    n = {i: 0 for i, _, _ in rows}
    for a, b in want:
        n[a] += 1
        n[b] += 1
    assert all(got[i].n_links <= n[i] for i in n)  # none below the threshold
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(want)
    for r in got.values():
        assert r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id


def test_neardup_copies_and_empty(spark):
    rows = [(k, [1.0, 2.0, 3.0], 1) for k in range(50)] + [(50, [1.0, 2.0, 3.01], 1), (51, [3.0, -2.0, 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got[7] == (50, 0, False) and got[0] == (50, 0, True) and got[50] == (50, 0, False) and got[51] == (0, 51, True)
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_neardup_of_long_vectors_and_clashing_names(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((3, 4000))
    rows = [(k, [float(v) for v in centre[k % 3] + 0.05 * rng.standard_normal(4000)], 1, 7, "x", 1) for k in range(12)]
    rows += [(20, [1.0, 1.0], 1, 7, "x", 1), (21, [1.0, 1.01], 1, 7, "x", 1), (21, [1.0, 1.01], 1, 7, "x", 1), (None, [1.0, 1.0], 1, 7, "x", 1)]
    df = spark.createDataFrame(rows, VECTORS + ", node long, raw string, n_links int")
    got = sorted(((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in neardup.near_duplicates(df).collect()))
    assert got == sorted([(k, 3, k % 3) for k in range(12)] + [(20, 3, 20), (21, 3, 20), (21, 3, 20), (-1, 3, 20)])


def test_sketches_of_links_are_close():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20_000, 64))
    y = x + 0.2 * rng.standard_normal(x.shape)
    x, y = neardup._unit(list(x)), neardup._unit(list(y))
    link = np.einsum("ij,ij->i", x, y) >= 0.98
    signs = neardup.rotations(64, 7)
    a, b = (neardup.bucket_keys(z, signs)[1] for z in (x, y))
    differ = np.array([bin(int(p) & (2**64 - 1)).count("1") for p in a ^ b])
    assert link.sum() > 5000 and (differ[link] <= neardup.MOST).all()
    assert (np.array([bin(int(p) & (2**64 - 1)).count("1") for p in a ^ np.roll(b, 1)]) > neardup.MOST).mean() > 0.99


@pytest.mark.parametrize("axes", [2, 3, 4])
def test_links_share_buckets_at_any_number_of_axes(axes):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 64))
    y = x + 0.17 * rng.standard_normal(x.shape)
    x, y = neardup._unit(list(x)), neardup._unit(list(y))
    link = np.einsum("ij,ij->i", x, y) >= 0.98
    signs = neardup.rotations(64, 7, axes=axes)
    a, b = (neardup.bucket_keys(z, signs)[0] for z in (x, y))
    met = np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)])
    assert link.sum() > 2000 and met[link].mean() > 0.98
    assert [neardup.axes_for(n, 64) for n in (0, 10**5, 10**6, 10**8, 10**10)] == [2, 2, 2, 3, 4]
