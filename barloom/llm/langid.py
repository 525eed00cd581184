"""Language identification with error-correcting output codes.

Every language has a codeword; one linear classifier over hashed byte n-grams
predicts each bit. Decoding adds up, per language, the logistic loss of all
bits against its codeword and picks the least: the runner-up's distance tells
how sure that is, and close calls are flagged as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import class_sample, held_out, ngram_counts, sliced, sparse, spread, text_batches, tidy, unsparse

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48
SIZES = (1, 2, 3)
#: Names of result columns.
RESULTS = ("held_out", "lang_pred", "score", "ambiguous")


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """Codewords (languages x bits) of -1 and 1. Up to 7 languages: the
    exhaustive code, every split of the languages once; beyond, the best of
    many random codes by the least distance between rows. Columns that do not
    split, or that repeat another one, are dropped."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= 7:
        bits = np.arange(1, 1 << (languages - 1))
        return np.array([np.ones(len(bits)), *(((bits >> k) & 1) * -2 + 1 for k in range(languages - 1))]).astype(np.int8)
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(languages)))
    best, least = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, width))
        code = np.unique(code * code[:1], axis=1)
        code = code[:, (code != code[0]).any(0)]
        far = int((code[:, None, :] != code[None]).sum(2)[~np.eye(languages, dtype=bool)].min())
        if far > least:
            best, least = code, far
    return best


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, each row scaled to length 1."""
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def train_bits(x: np.ndarray, signs: np.ndarray, rounds: int = 150, rate: float = 40.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regressions for all bits at once, both sides of a bit weighing
    the same, by gradient steps with momentum. Returns weights (dim x bits)."""
    x, signs = x.astype(np.float32, copy=False), signs.astype(np.float32, copy=False)
    w = np.zeros((x.shape[1], signs.shape[1]), np.float32)
    move = np.zeros_like(w)
    weight = np.where(signs > 0, 0.5 / np.maximum(1, (signs > 0).sum(0)), 0.5 / np.maximum(1, (signs < 0).sum(0))).astype(np.float32)
    for _ in range(rounds):
        margin = np.clip(signs * (x @ w), -30, 30)
        move = np.float32(0.9) * move + x.T @ (signs * weight / (1 + np.exp(margin))) - np.float32(decay) * w
        w += np.float32(rate * 0.1) * move
    return w


class LanguageModel:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray):
        self.languages, self.code, self.weights = languages, code, weights

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (share of the chosen one when losses become
        chances) and whether the runner-up is close."""
        n = len(column)
        if not self.languages:
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        if len(self.languages) == 1:
            return self.languages * n, np.ones(n), np.zeros(n, bool)
        x = features(ngram_counts(column, self.weights.shape[0], SIZES, _LOWER))
        margin = x @ self.weights
        # loss-weighted decoding: sum over bits of ln(1 + exp(-margin * bit))
        yes, no = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        loss = yes @ (self.code > 0).T + no @ (self.code < 0).T
        chance = np.exp(-(loss - loss.min(1, keepdims=True)))
        chance /= chance.sum(1, keepdims=True)
        order = np.sort(chance, axis=1)
        return [self.languages[k] for k in chance.argmax(1)], order[:, -1], order[:, -1] - order[:, -2] < 0.1


def fit(docs: DataFrame, per_language: int = 800, dim: int = 4096, fold: tuple[int, int] = (4, 2), most: int = 12_000) -> LanguageModel:
    """Fit on about ``per_language`` rows of each language that the column
    ``lang`` holds outside the held-out fold, and ``most`` rows in all, however
    many languages there are (at 4096 features that is 200 MB of the driver).
    Rows without a language or a letter teach nothing, repeated rows count once;
    the sample is in order, so reruns agree; without any row the model answers
    ``und``."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"), *fold))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    kept = class_sample(rows, "lang", per_language, ("doc_id", "_hash"), most)
    kept = kept.groupBy("lang", "doc_id", "_hash").agg(F.min("text").alias("text")).repartition(spark.sparkContext.defaultParallelism, "doc_id", "_hash")

    def run(batches):
        for batch in sliced(batches):
            counts = ngram_counts(batch.column(1), dim, SIZES, _LOWER).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sparse(c) for c in counts], pa.binary())], names=["lang", "x"])

    got = sorted(kept.select("lang", "text").mapInArrow(tidy(run), "lang string, x binary").collect())
    languages = sorted({r.lang for r in got})
    if len(languages) < 2:
        return LanguageModel(languages, codewords(len(languages)), np.zeros((dim, 1)))
    x = np.zeros((len(got), dim), np.float32)
    for k, r in enumerate(got):
        unsparse(r.x, x[k])
    np.sqrt(x, out=x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    y = np.array([languages.index(r.lang) for r in got])
    code = codewords(len(languages))
    return LanguageModel(languages, code, train_bits(x, code[y].astype(np.float32)))


def identify(docs: DataFrame, model: LanguageModel, fold: tuple[int, int] = (4, 2), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Language of every whole text: the kept columns, ``held_out``,
    ``lang_pred`` (``und`` for null text or text without a letter, with score
    0), ``score`` (0 to 1) and ``ambiguous``. Of languages whose losses tie the
    first by name is named, and the row is ambiguous. Repeated rows give repeated
    rows; an empty table gives no rows; a null id is in no fold. Kept columns may be named like the results: they
    come back with an underscore behind."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.code, model.weights.astype(np.float32)))
    kept = [F.col(c).alias(c + "_" if c in RESULTS else c) for c in keep]
    own = docs.select(*kept, *([] if "text" in keep else ["text"]), held_out(F.col("doc_id"), *fold).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_lettered"))
    names = [c for c in own.columns if c != "_lettered" and (c != "text" or "text" in keep)]
    schema = ", ".join([*(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in names), "lang_pred string, score double, ambiguous boolean"])

    def run(batches):
        m = LanguageModel(*shared.value)
        for batch in sliced(batches):
            lang, score, close = m.predict(batch.column("text"))
            lettered = batch.column("_lettered").to_numpy(zero_copy_only=False).astype(bool)
            lang = [x if ok else "und" for x, ok in zip(lang, lettered, strict=True)]
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(np.where(lettered, score, 0.0), pa.float64()), pa.array(close | ~lettered, pa.bool_())], names=[*names, "lang_pred", "score", "ambiguous"])

    return spread(own).mapInArrow(tidy(run), schema)
