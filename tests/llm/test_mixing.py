"""Targets against plain resharing; selection against a plain prefix walk."""

import hashlib
import math
import re

import pytest

from barloom.llm import mixing


def reshared(sizes, weights, epochs=3):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        share, left = left, 0.0
        for s in open_:
            target[s] += share * weight[s] / total
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = float(epochs * sizes[s])
                full.add(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, "d": 70, None: 300}, {"a": 0, "b": 7}, {"x": 5}, {"a": 900, "b": 1, "c": 1, "d": 1, "e": 800, "é": 30, "Z": 44}, {None: 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = reshared(sizes, mixing.WEIGHTS)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6)


def test_mix_against_prefix_walk(spark):
    docs = [(i, " ".join(["word"] * (1 + i * 7 % 23)) if i % 9 else None, [f"s{i % 4}", None][i % 13 == 0], i) for i in range(300)]
    docs += [docs[5], docs[5]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size long")
    rows = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = reshared(sizes, mixing.WEIGHTS)
    taken = {}
    for s in sizes:
        own = []
        for i, t, src, _ in docs:
            if src == s:
                n = size(t)
                u = (int(hashlib.md5(f"11:{i}:{hashlib.md5((t or chr(0)[:0]).encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                w = max(0.25, 1 - abs(len(t or "") / max(n, 1) - 6) / 12) * (0.5 + 0.5 * min(1, n / 100))
                own.append((-math.log(u) / w, i, n))
        whole = int(want[s] // sizes[s]) if sizes[s] else 0
        rest, before = want[s] - whole * sizes[s], 0
        for _, i, n in sorted(own):
            taken.setdefault(i, []).append(n * (whole + (rest > 0 and before + n / 2 <= rest)))
            before += n
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.taken)
        assert r.taken <= 3 * r.size
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in taken.items()}
    keep = ["doc_id", "text", "source", "size"]
    again = {}
    for r in mixing.mixed_documents(df, keep).collect():
        again[r.doc_id] = again.get(r.doc_id, 0) + size(r.text)
    assert again == {k: sum(v) for k, v in taken.items() if sum(v)}
    # reruns agree; an empty table gives no rows
    assert sorted(mixing.mix(df).collect()) == sorted(rows)
    assert mixing.mix(df.limit(0)).count() == 0


def test_order_of_rows_changes_nothing(spark):
    text = lambda n: " ".join(["word"] * n)
    rows = [(7, text(9), "a", k % 3) for k in range(60)] + [(None, text(9 + k % 5), "a", 0) for k in range(40)] + [(k, text(5), "b", 1) for k in range(5)]
    keep = ["doc_id", "text", "source", "extra"]
    schema = "doc_id long, text string, source string, extra long"
    a, b = (spark.createDataFrame(r, schema).repartition(n) for r, n in ((rows, 1), (rows[::-1], 3)))
    got = [sorted(map(str, mixing.mixed_documents(d, keep).collect())) for d in (a, b)]
    assert got[0] == got[1] and 0 < len(got[0]) < 3 * len(rows)
    taken = [sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(d).collect()) for d in (a, b)]
    assert taken[0] == taken[1] and len(taken[0]) == len(rows)
    assert sum(x[2] for x in taken[0]) == sum(len(r.text.split()) for r in mixing.mixed_documents(a, keep).collect())


def test_copies_of_one_row_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    rows = [(1, "one two three", "a")] * 500 + [(2, "x y", "b")] * 40 + [(3, "z", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and len({r.taken for r in got if r.doc_id == 1}) == 2
    for s in (1, 2, 3):
        own = [r for r in got if r.doc_id == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= own[0].size
    docs = mixing.mixed_documents(df, ["doc_id", "text", "source"]).collect()
    assert sum(len(r.text.split()) for r in docs) == sum(r.taken for r in got)
