import random
import re

import numpy as np
import pytest

from barloom.llm import common, jaccard
from barloom.llm import components as components_of
from barloom.llm.components import components

DOCS = "doc_id long, text string"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(k) for k in range(n)]


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    r = roots(len(docs), links)
    least = {}
    for (i, _), k in zip(docs, r, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return sorted(((i, len(s), least.get(k)) for (i, _), s, k in zip(docs, sets, r, strict=True)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("xyz")
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(n):
        kind = rng.random()
        if docs and kind < 0.35:  # a copy with a few changes
            w = words_of(rng.choice(docs)) or ["a"]
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
        elif kind < 0.5:
            docs.append(" ".join(passage + [word() for _ in range(rng.randint(0, 30))]))
        else:
            docs.append("\t ".join(word() for _ in range(rng.choice([0, 1, 3, 5, 6, 40, 90]))))
    return docs


@pytest.mark.parametrize("seed,bits,name_bits", [(1, 24, 64), (2, 6, 64), (3, 12, 5)])
def test_against_all_pairs(spark, monkeypatch, seed, bits, name_bits):
    if seed == 2:
        monkeypatch.setattr(components_of, "CHUNK", 3)
    texts = corpus(seed)
    docs = [(k * 3 % 1009, t) for k, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, " \n"), (None, texts[0]), (2003, texts[5].upper()), (2003, texts[5].upper())]
    df = spark.createDataFrame(docs, DOCS)
    rows = jaccard.join(df, bits=bits, name_bits=name_bits).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)
    want = brute(docs)
    # a text without words is a component of its own
    assert got == want
    groups = {r.component_id for r in rows if r.n_shingles}
    assert len({(r.doc_id, r.handle) for r in rows if r.kept and r.n_shingles}) == len(groups)


def test_shuffled_joins_and_hot_tokens_change_nothing(spark, monkeypatch):
    docs = list(enumerate(corpus(4, 60) + ["the same words in a row here " * 3] * 40))
    df = spark.createDataFrame(docs, DOCS)
    monkeypatch.setattr(jaccard, "side", lambda d: common.side(d, 0))
    monkeypatch.setattr(jaccard.np, "log2", lambda x, f=np.log2: f(x) if np.ndim(x) else 0.0)  # every level is hot
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, bits=6).collect()), key=str)
    assert got == brute(docs)


def test_group_of_near_copies_without_a_base(spark):
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(60):
        w = list(base)
        for j in range(2):
            w[(k * 7 + j * 31) % 120] = f"c{k}_{j}"
        docs.append((k, " ".join(w)))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(docs, DOCS)).collect()), key=str) == brute(docs)


def brute_counts(docs):
    sets = [shingles(t) for _, t in docs]
    return [sum(a != b and bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y) for b, y in enumerate(sets)) for a, x in enumerate(sets)]


@pytest.mark.parametrize("seed,chunk", [(1, 1024), (2, 3)])
def test_every_link_is_counted(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(jaccard, "CELL_SETS", chunk)
    base = [f"w{k}" for k in range(120)]
    near = [" ".join([*base[:k], f"c{k}", *base[k + 1 :]]) for k in range(0, 120, 4)]
    texts = corpus(seed, 100) + near + near[:3] * 4 + ["", " ", "one two"] * 2
    texts += [" ".join(f"{x}{k // 25}" if k < 50 else f"v{k}" for k in range(300)) for x in "abc"] + [" ".join([f"b{k}" for k in range(20)] + [f"v{k}" for k in range(20, 300)])]
    docs = list(enumerate(texts))
    rows = {r.doc_id: r for r in jaccard.join(spark.createDataFrame(docs, DOCS)).collect()}
    want = brute_counts(docs)
    assert [rows[k].n_links for k, _ in docs] == want and max(want) >= len(near)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows.values()), key=str) == brute(docs)


def test_heads_never_reject_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = a.copy()
        for k in rng.choice(len(a), int(rng.integers(0, max(1, len(a) // 8))), replace=False):
            b[k] = rng.integers(0, 2**63, dtype=np.uint64)
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert jaccard.heads_agree(jaccard.head_of(a), len(a), jaccard.head_of(b), len(b), 80, 100)


def test_empty_long_and_extra_columns(spark):
    assert jaccard.join(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"x{k % 5000}" for k in range(200_000))
    df = spark.createDataFrame([(1, long, 5, "t"), (2, long + " end", 6, "t")], DOCS + ", node long, handle string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join(df).collect()) == [(1, 1), (2, 1)]


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    r = roots(2100, links)
    least = {}
    for k in range(2100):
        least.setdefault(r[k], k)
    assert got == {k: least[r[k]] for k in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_heads_are_shuffled_once(spark, monkeypatch, tmp_path):
    """Both ends of a pair read one shuffle of the heads, which drops repeats."""
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(6)]
    rows = [(k, len(s), bytearray(jaccard.head_of(s))) for k, s in enumerate(sets) for _ in range(2)]
    spark.createDataFrame(rows, "node long, n int, head binary").write.parquet(f"{tmp_path}/heads")
    spark.createDataFrame([(0, 1), (2, 2), (3, 4), (5, 5)], "a long, b long").write.parquet(f"{tmp_path}/pairs")
    pairs, heads = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("pairs", "heads"))
    made = []
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0, raising=False)
    monkeypatch.setattr(jaccard, "written", lambda df, *_: made.append(df) or df)
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        got = jaccard.by_heads(pairs, heads, 80, 100).collect()
        plan = made[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in got) == [(2, 2), (5, 5)]
    assert plan.count("ReusedExchange") == 1
