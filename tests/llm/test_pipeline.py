import json

import corpus_pipeline
from barloom.llm import bpe, common, jaccard, queries
from barloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long"
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_copies", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name in ("toxicity", "language"):
            assert docs.exceptAll(before).count() == 0 and docs.count() > 0.8 * before.count()
        if name == "near_copies":
            groups = jaccard.join(before).select("component_id").where("component_id IS NOT NULL").distinct().count()
            assert docs.count() == groups and jaccard.join(docs).where("NOT kept").count() == 0
        if name == "bpe":
            assert docs.count() == before.count()
    whole = corpus_pipeline.run(spark, SF)
    assert json.dumps(sorted(map(tuple, whole.collect()))) == json.dumps(sorted(map(tuple, docs.collect())))


def test_stages_on_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + ".", None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0), (4, "", "en", "b", 0), (None, text, "en", "b", 2), (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, 0.5, 7) for r in rows], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
        stage(spark, df, SF).collect()
    kept = corpus_pipeline.drop_near_copies(spark, df, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == sorted([(False, 1, text), (False, 2, text + "."), (False, 3, ""), (False, 4, ""), (False, 4, ""), (True, 0, "")])


def test_every_stage_on_odd_rows_has_the_stated_result(spark):
    text = "the one of two and three in four the five of six and seven in eight"
    rows = [(1, text, "en", "a", 1), (1, text, "fr", "b", 2), (1, text, "en", "b", 2), (3, None, "en", "a", 0), (4, "", None, "b", 0), (4, "", None, "b", 0), (5, "the of " * 40_000, "en", "a", 3), (None, "... 1 2", None, None, None), (None, "other words of the text here", "en", None, None)]
    frames = [spark.createDataFrame([(*r, 0.5, 7) for r in (rows if k else rows[::-1])], DOCS) for k in (0, 1)]
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(rows, key=lambda r: key(r[:1] + r[2:]))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        a, b = (sorted(map(tuple, stage(spark, f, SF).collect()), key=lambda r: key(r[:1] + r[2:])) for f in frames)
        assert a == b, name
        out[name] = a
    assert out["toxicity"] == want
    # no row has a language of its own text that is learnt elsewhere: English alone, and nothing without a letter
    assert all(t and any(c.isalpha() for c in t) for _, t, *_ in out["language"])
    assert out["near_copies"] == [r for r in want if r[0] != 1 or r[2:] == ("en", "a", 1)]
    sizes = {}
    for r in out["mixing"]:
        assert r in rows and r[1].split()
        sizes[r] = sizes.get(r, 0) + 1
    assert all(n <= 3 for n in sizes.values()) and {r[3] for r in sizes} <= {"a", "b", None}
    assert sorted(r[0] or 0 for r in out["bpe"]) == sorted(r[0] or 0 for r in rows) and sum(r[1] == 0 for r in out["bpe"]) == 3


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))


def test_sample_starts_no_workers_of_rows(spark, monkeypatch):
    """The table of bounds comes by Arrow: one of rows would start Python
    workers of another kind, which stay beside those of the operators."""
    rows = spark.range(200).selectExpr("id AS doc_id", "if(id % 4 = 0, 'a', if(id % 50 = 1, null, 'b')) AS lang").localCheckpoint()

    def no(*args, **kwargs):
        raise AssertionError("a table of rows")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", no)
    drawn = common.class_sample(rows, "lang", 40).groupBy("lang").count().collect()
    assert 20 <= {r.lang: r["count"] for r in drawn}["a"] <= 50 and {r.lang for r in drawn} == {"a", "b"}


def test_workers_drop_the_state_of_other_operators():
    """A model that a worker keeps goes when a task of another operator runs."""
    model = bpe._model(open(tokenizer_path(), "rb").read())
    assert bpe._model(open(tokenizer_path(), "rb").read()) is model
    assert list(common.tidy(iter, keep=True)([1, 2])) == [1, 2] and list(common._resident.values()) == [model]
    assert list(common.tidy(iter)([1, 2])) == [1, 2] and not common._resident
