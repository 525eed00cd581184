import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, common, langid, licenses, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def model():
    with open(queries.tokenizer_path(), "rb") as f:
        return bpe.ByteBPE(f.read(), cache_words=500)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def odd_texts(n=3000):
    rng = random.Random(3)
    chars = list("abcdeeeethin  \n\t'sK0²½日本😀é́​\xa0İß.!<|>\x00\x85　")
    out = ["".join(rng.choices(chars, k=rng.randint(0, 70))) for _ in range(n)]
    return out + ["", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", " " * 4000, "a" * 9000, "ab" * 3000, "don't we'll I'VE", "thththththth" * 50]


def test_encoding_equals_the_library(model, library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x for k in range(0, len(texts), 100) for x in model.encode_batch(texts[k : k + 100])] == want
    assert [model.decode(x).decode() for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_pairs_are_compatible_exactly_if_merging_keeps_them(model):
    rng = np.random.default_rng(1)
    common_ids = rng.integers(0, 5000, (4000, 2))
    a, b = common_ids[:, 0], common_ids[:, 1]
    ok = [i for i in range(len(a)) if model.bytes[a[i]] and model.bytes[b[i]]]
    got = model.compatible(a[ok], b[ok])
    want = [model.merge((model.bytes[a[i]] + model.bytes[b[i]]).decode("latin-1")) == (a[i], b[i]) for i in ok]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_encode_frame(spark, library):
    rows = [(1, "hello there"), (1, "hello there"), (2, None), (3, ""), (None, "x")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, ids int")
    got = bpe.encode(df, queries.tokenizer_path(), outputs=("ids", "decoded", "digests")).collect()
    assert len(got) == 5
    for r in got:
        ids = list(r.ids)
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode(df.limit(0), queries.tokenizer_path()).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    w, hits = words(text), []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses_base_against_brute_force(spark):
    texts = [None, "", "CC-BY 4.0 and cc by", "All rights\nreserved. all RIGHTS reserved", "cc bye", "é general public license", "Xcc by", "GENERAL  PUBLIC, LICENSE" * 3, "a" * 100_000 + " cc by " + "b " * 50_000]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    texts += [r.text for r in docs]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in licenses.scan(df).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(df.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_notices():
    rng, search = random.Random(7), licenses.NoticeSearch()
    for k, (phrase, label, most) in enumerate(licenses.NOTICES):
        for _ in range(30):
            t = list(phrase)
            for _ in range(rng.randint(0, most)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
            noisy = "".join(t)
            if edits(phrase, noisy) <= most:
                found = [m for m in search.find(f" lorem {noisy} ipsum ") if m[0] == k]
                assert found and found[0][3] <= most, (phrase, noisy)
    assert not search.find(" nothing of this kind stands here at all ")


def test_matches_before_the_best_of_a_window_are_kept():
    search = licenses.NoticeSearch()
    k = [p for p, _, _ in licenses.NOTICES].index("licensed under the mit license")
    text = " licensed under the mit licence licensed under the mit license "
    assert [m for m in search.find(text) if m[0] == k] == [(k, 1, 31, 1), (k, 32, 62, 0)]
    rng = random.Random(5)
    for k, (phrase, _, most) in enumerate(licenses.NOTICES):
        for _ in range(10):
            # repeated notices with fewer and fewer edits, side by side
            parts = []
            for edit in range(min(most, 3), -1, -1):
                t = list(phrase)
                for at in rng.sample(range(1, len(t) - 1), edit):
                    t[at] = "0"
                parts.append("".join(t))
            found = [m for m in search.find(f" {' '.join(parts)} ") if m[0] == k]
            assert len(found) == len(parts) and sum(m[3] for m in found) == sum(edits(phrase, p) for p in parts)


def ends_within(phrase, text, most):
    """Sellers: of every place, the least edits of the phrase ending there."""
    row = list(range(len(phrase) + 1))
    out = []
    for c in text:
        new = [0]
        for i, x in enumerate(phrase, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        out.append(row[-1])
    return [(k + 1, d) for k, d in enumerate(out) if d <= most]


def test_notices_of_unlike_edits_close_together_against_all_alignments():
    rng, search = random.Random(11), licenses.NoticeSearch()
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(2, 5)):
            phrase, _, most = rng.choice(licenses.NOTICES[:12])
            t = list(phrase)
            for _ in range(rng.randint(0, most + 1)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "z", " "])
            parts.append(rng.choice(["", "the ", "license "]) + "".join(t))
        text = f" {' '.join(parts)} "
        got = search.find(text)
        for k, (phrase, _, most) in enumerate(licenses.NOTICES):
            ends, own = ends_within(phrase, text, most), [m for m in got if m[0] == k]
            for _, a, b, e in own:
                assert edits(phrase, text[a:b]) == e <= most
            assert all(p[2] <= q[1] for p, q in zip(own, own[1:], strict=False))
            runs = []
            for end, d in ends:
                if runs and end == runs[-1][1] + 1:
                    runs[-1] = (runs[-1][0], end, min(d, runs[-1][2]))
                else:
                    runs.append((end, end, d))
            for lo, hi, least in runs:
                # each place where the notice ends within its edits is told by a match there, as good as the best one
                assert any(a < hi and b >= lo - 2 * most and e <= least for _, a, b, e in own), (phrase, text, lo, hi, least, own)


def test_notices_that_the_judge_of_a_window_could_hide(spark):
    texts = ["released undr the mit license released under the mit license", "all right reserved all rights reserved", "licensed under the apache licens version 2 0 licensed under the apache license version 2 0", "Creative Commons Attribution-NonCommercial", "creative commons attribution only"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(m.from_word, m.to_word, m.edits) for m in got[0].matches] == [(0, 4, 1), (5, 9, 0)]
    assert [m.edits for m in got[1].matches] == [1, 0] and [m.edits for m in got[2].matches if m.label == "apache-2.0"] == [1, 0]
    assert got[3].labels == "cc-by-nc" and got[4].labels == "cc-by"


def test_many_hits_in_a_text_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(1, "cc by " * n + "all rights reserved " * (n // 4))], "doc_id long, text string")
        start = time.time()
        r = licenses.scan(df).first()
        assert r.n_base == n + n // 4 and len(r.matches) == n // 4 and r.last_word == 2 * n + 3 * (n // 4) - 3
        return time.time() - start

    seconds(100)
    assert seconds(80_000) < 20 * max(0.5, seconds(10_000))


def truth(spark, column):
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    return docs, labels, {r.doc_id: r[column] for r in labels.collect()}


def edge_docs(spark):
    rows = [(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, "...", None, None, None), (None, "the word", "en", "s", 1), (-4, "the of " * 60_000, "en", "s", 9), (-4, "the of " * 60_000, "en", "s", 9)]
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows], DOCS + ", score double, held_out string")


def test_toxicity(spark):
    docs, labels, y = truth(spark, "toxic")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    rows = [r for r in rows if r.doc_id in y]
    right = [r.predicted == y[r.doc_id] for r in rows]
    clean = [r.predicted == 0 for r in rows if y[r.doc_id] == 0]
    assert np.mean(right) > 0.97 and np.mean(clean) > 0.985
    edge = toxicity.score(edge_docs(spark), model, keep=("doc_id", "score")).collect()
    assert len(edge) == 6 and all(r.predicted == 0 for r in edge) and all(r.score_ == 1.0 for r in edge)
    nothing = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(edge_docs(spark), nothing).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_the_fit_on_executors_equals_the_plain_one(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, per_class=10**6)
    y = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in y)
    plain = toxicity.train([" ".join(sorted(set(toxicity.tokens(t)))) for _, t in rows], [y[i] for i, _ in rows], [x[: toxicity.SKETCH] for x in toxicity.shingle_sets(pa.array([t for _, t in rows]))], k=model.k)
    assert model.odds.keys() == plain.odds.keys() and len(model.odds) > 3
    assert all(model.odds[w] == pytest.approx(plain.odds[w]) for w in model.odds) and model.lam == pytest.approx(plain.lam)
    found = [model.found(t) for i, t in rows if not y[i]]
    assert model.k == pytest.approx(toxicity.extent([(n, max((x for _, _, x in own), default=0.0)) for n, own in found if n], model.lam))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, t in rows:
        score, passages = plain.score(t)
        assert got[i].score == pytest.approx(score, abs=1e-9) and [(p.from_word, p.to_word) for p in got[i].passages] == [p[:2] for p in passages]
        assert got[i].predicted == (plain.value(t)[0] >= -math.log(model.alpha))


def test_chances_of_segments():
    # one segment: the extreme-value law itself, less ln 2 for the choice of how many
    for x in (-2.0, 0.0, 3.0, 12.0):
        want = max(0.0, -math.log(1 - math.exp(-math.exp(-x))) - math.log(2))
        assert toxicity.surprise([x]) == pytest.approx(want, abs=1e-6)
    assert toxicity.surprise([]) == 0 and toxicity.surprise([5.0, 4.0]) > toxicity.surprise([5.0]) and toxicity.surprise([5.0, -1.0]) == toxicity.surprise([5.0])
    # K is found again from texts that follow the law
    rng = np.random.default_rng(1)
    n = rng.integers(50, 500, 4000)
    best = np.log(0.3 * n / rng.exponential(size=4000)) / 1.5
    assert toxicity.extent([(int(a), max(0.0, float(b))) for a, b in zip(n, best, strict=True)], 1.5) == pytest.approx(0.3, rel=0.1)


def test_unrelated_texts_count_although_they_share_a_word():
    rng, letters = random.Random(4), "bcdfghklmnprst"
    word = lambda: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(4))
    lowest = min((word() for _ in range(3000)), key=lambda w: zlib.crc32(w.encode()))
    clean = [sorted({lowest, *(word() for _ in range(12))}) for _ in range(60)]
    toxic = [sorted({lowest, "vile", *(word() for _ in range(12))}) for _ in range(30)]
    model = toxicity.train([" ".join(w) for w in clean + toxic], [0] * 60 + [1] * 30)
    assert "vile" in model.odds and lowest not in model.odds


def test_copies_and_near_copies_count_once(spark):
    rng = random.Random(6)
    noise = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    base, long = noise(100), noise(900)
    near, far = [*base[:50], "changed", *base[51:]], [w for k, w in enumerate(base) if k % 7]
    texts = [base, base, near, far, long, [*long, "end"], noise(100)]
    sketches = [s[: toxicity.SKETCH] for s in toxicity.shingle_sets(pa.array([" ".join(t) for t in texts]))]
    copies = toxicity.Copies()
    assert [copies.seen(1, " ".join(sorted(t)), s) for t, s in zip(texts, sketches, strict=True)] == [False, True, True, False, False, True, False]
    assert not copies.seen(0, " ".join(sorted(base)), sketches[0])  # of another class
    # near copies of one toxic text give no word the weight of many
    w = [[*base[:k], f"y{k}", *base[k + 1 :]] for k in range(30)]
    rows = [(k, " ".join(t), 1) for k, t in enumerate(w)] + [(100 + k, " ".join(noise(50)), 0) for k in range(30)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert not toxicity.fit(docs, labels).odds


def test_segments_are_maximal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 14)
        score = [rng.choice([3.0, 1.0, -1.0, -1.0, -1.0]) for _ in range(n)]
        at = np.array([k for k, s in enumerate(score) if s > 0])
        if not len(at):
            continue
        got = toxicity.segments(at, np.array([score[k] for k in at]), 1.0)
        sums = {(a, b): sum(score[a : b + 1]) for a in range(n) for b in range(a, n)}
        assert max(x for _, _, x in got) == max(sums.values())
        for a, b, x in got:
            assert x == sums[a, b] and all(sums[a, k] > 0 for k in range(a, b + 1)) and all(sums[k, b] > 0 for k in range(a, b + 1))
        assert all(p[1] < q[0] for p, q in zip(got, got[1:], strict=False))


def test_language(spark):
    docs, _, _ = truth(spark, "toxic")
    model = langid.fit(docs)
    rows = langid.identify(docs, model, keep=("doc_id", "lang")).where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.985
    edge = {r.doc_id: r for r in langid.identify(edge_docs(spark), model).collect()}
    assert edge[-1].lang_pred == edge[-2].lang_pred == edge[-3].lang_pred == "und" and edge[-4].lang_pred == "en" and edge[None].held_out is False
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(edge_docs(spark), nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    one = langid.fit(docs.where("lang = 'fr'").limit(50))
    assert {r.lang_pred for r in langid.identify(docs.limit(20), one).collect()} == {"fr"}


def test_decoding_against_all_codewords():
    rng = np.random.default_rng(4)
    texts = pa.array(["the cat sat", "le chat noir", "", "der Hund", "été"])
    for n in (2, 5, 9):
        code = langid.codewords(n)
        model = langid.LanguageModel([f"l{k}" for k in range(n)], code, rng.standard_normal((64, code.shape[1])).astype(np.float32))
        lang, score, close = model.predict(texts)
        margin = langid.features(common.ngram_counts(texts, 64, langid.SIZES, langid._LOWER)) @ model.weights
        for k in range(len(texts)):
            loss = [sum(math.log1p(math.exp(-float(m) * int(b))) for m, b in zip(margin[k], word, strict=True)) for word in code]
            chance = sorted((math.exp(min(loss) - x) for x in loss), reverse=True)
            assert lang[k] == f"l{loss.index(min(loss))}" or chance[1] > 1 - 1e-4
            assert score[k] == pytest.approx(chance[0] / sum(chance), abs=1e-4) and close[k] == ((chance[0] - chance[1]) / sum(chance) < 0.1)


def test_many_languages_and_repeated_rows(spark):
    rng = random.Random(9)
    word = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(30)] for _ in range(40)]
    rows = [(k, " ".join(rng.choices(word[k % 40], k=40)), f"x{k % 40:02d}") for k in range(2000)] + [(None, "one and the same", "x00")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, most=800)
    assert len(model.languages) == 40
    got = [r for r in langid.identify(df, model, keep=("doc_id", "lang")).where("held_out").collect()]
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    again = langid.fit(df.repartition(3), most=800)
    assert (again.weights == model.weights).all()


@pytest.mark.parametrize("n", [2, 3, 5, 7, 9, 40])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and len(np.unique(code, axis=0)) == n
    assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= (1 if n == 2 else 2)


def test_quality(spark):
    docs, labels, y = truth(spark, "quality")
    model = quality.fit(docs, labels)
    rows = [r for r in quality.score(docs, model).where("held_out").collect() if r.doc_id in y]
    right = np.array([r.predicted == y[r.doc_id] for r in rows])
    assert right.mean() > 0.97
    edge = quality.score(edge_docs(spark), model).collect()
    assert len(edge) == 6 and all(0 <= r.score <= 1 for r in edge)
    nothing = quality.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in quality.score(edge_docs(spark), nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_voting_against_all_neighbours():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 4, (60, 33)).astype(np.float32)
    counts[50:] = counts[0]  # many neighbours that are equally near
    labels = (rng.random(60) < 0.5).astype(np.int64)
    model = quality.train(counts, labels, directions=8)
    test = np.concatenate([counts[:3], rng.integers(0, 4, (20, 33)).astype(np.float32), np.zeros((1, 33), np.float32)])
    model.prior = 0.7
    got = model.score(test)
    for k, x in enumerate(test):
        cos = [float(model.latent(x[None])[0] @ v) for v in model.vectors]
        last = sorted(cos, reverse=True)[model.near - 1]
        votes = [(max(c, 0.0), y) for c, y in zip(cos, labels, strict=True) if c >= last - 1e-6]
        total = sum(c for c, _ in votes)
        assert got[k] == pytest.approx(sum(c * y for c, y in votes) / total if x.any() and total else 0.7, abs=1e-4)
    assert len([1 for c in [float(model.latent(counts[:1])[0] @ v) for v in model.vectors] if c > 1 - 1e-5]) >= 11
    order = rng.permutation(60)
    assert quality.train(counts[order], labels[order], directions=8).score(test)[:-1] == pytest.approx(got[:-1], abs=0.05)


def test_quality_of_empty_texts_and_of_rows_in_any_order(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    again = quality.fit(docs.repartition(3), labels.repartition(2))
    assert (model.vectors == again.vectors).all() and (model.labels == again.labels).all()
    share = [r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.quality is not None]
    for r in quality.score(edge_docs(spark), model).where("doc_id < -0 and doc_id > -3").collect():
        assert r.score == pytest.approx(np.mean(share))


def test_slices_change_nothing():
    texts = pa.array(["ab cd é 日本 x", None, "", "word " * 400, "one"])
    a, b = common.ngram_counts(texts, 64), common.ngram_counts(texts, 64, step=7)
    assert (a == b).all() and a[1].sum() == 0
    for step in (1 << 22, 5):
        h, row, size = common.word_hashes(*common.flat(texts), step=step)
        assert len(h) == 405 + 1 and size.sum() == sum(len(w.encode()) for t in texts.to_pylist() for w in (t or "").split())
        assert len(set(h.tolist())) == 7


def test_class_sample_is_bounded(spark):
    d = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = {r.y: r["count"] for r in common.class_sample(d, "y", 100).groupBy("y").count().collect()}
    assert 50 < got[0] < 160 and 50 < got[1] < 160
