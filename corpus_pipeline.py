"""A corpus pipeline: each stage applies one operator of ``barloom.llm`` to the
documents that the stage before it kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import bpe, jaccard, langid, mixing, toxicity
from barloom.llm.common import discard, read, side, written
from barloom.llm.queries import tokenizer_path

#: The columns of ``documents``, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go. The model learns
    from the labels outside its held-out fold. Null and empty texts are not
    toxic and stay, repeated rows stay, an empty table gives an empty one, whole
    texts of any length are scored; other columns than those of ``documents``
    do not come back, whatever their names (so too in the stages below)."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    keep = _columns(docs)
    scored = toxicity.score(docs, model, passages=False, keep=tuple(keep))
    return scored.where("predicted = 0").select(*keep)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold no letter (``und``: null and empty texts too), or
    whose language is ambiguous: the runner-up is about as likely, or ties.
    Repeated rows stay; if no row teaches a language all documents go; an empty
    table gives an empty one."""
    keep = _columns(docs)
    named = langid.identify(docs, langid.fit(docs), keep=tuple(keep))
    return named.where("lang_pred <> 'und' AND NOT ambiguous").select(*keep)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the row with the
    smallest id, null last (and text hash, should ids repeat). Rows are known by
    id and text hash, and only those that go are joined; of rows equal in both,
    the one that is least in all columns stays, whatever their order. Texts
    without a word are groups of their own."""
    keep = _columns(docs)
    groups = jaccard.join(docs)
    names = [F.col("doc_id").alias("_id"), F.col("handle").alias("_handle")]
    gone = written(groups.where("NOT kept").select(*names).distinct(), "gone", packed=True)
    again = written(groups.where("kept AND n_shingles > 0").groupBy(*names).count().where("count > 1").select("_id", "_handle"), "again", packed=True)
    discard(groups)
    rows = docs.select(*keep).withColumn("_h", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_handle"))
    left = rows.join(side(gone), same, "left_anti")
    if again.limit(1).count():
        repeated = side(again)
        one = left.join(repeated, same, "left_semi").groupBy("doc_id", "_h").agg(F.min(F.struct(*keep)).alias("row")).select("row.*")
        return left.join(repeated, same, "left_anti").select(*keep).unionByName(one)
    return left.select(*keep)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document is repeated as often as it is taken, and goes if it
    is not taken. Null and wordless texts have size 0 and go; the null source is
    a source of its own; repeated rows count each; the order of rows does not
    matter; an empty table gives an empty one."""
    return mixing.mixed_documents(docs, _columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of every document, with digests of ids and decoded text.
    Null texts count as empty; repeated rows give repeated rows; whole texts of
    any length are encoded; an empty table gives no rows."""
    return bpe.encode(docs, tokenizer_path(), outputs=("digests",))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained classifiers cannot be written in SQL; the tests check every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next; a table
    goes once the next one is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
