"""Text quality by nearest-neighbour voting in a latent space.

Hashed byte n-grams, weighted by rarity, are projected on the leading singular
directions of a bounded labelled sample. The labelled vectors are broadcast;
every document is compared with all of them by exact cosine in blocks, and the
nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import class_sample, flat, held_out, ngram_counts, sliced, sparse, spread, text_batches, unsparse, word_hashes

SIZES = (1, 2, 3)


#: The last slot of a feature vector counts what repeats the word before it.
DIM = 4097


def features(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """Hashed byte n-grams; the last slot holds, on the same scale, the n-grams
    inside words that repeat the word before them."""
    out = np.zeros((len(column), dim), np.float32)
    out[:, :-1] = ngram_counts(column, dim - 1, SIZES)
    word, row, size = word_hashes(*flat(column))
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    np.add.at(out[:, -1], row[again], len(SIZES) * size[again].astype(np.float32))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class QualityModel:
    """Rarity of features, latent directions, labelled vectors and the share of
    label 1, which a text that resembles nothing gets."""

    def __init__(self, rarity: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, near: int = 15, prior: float = 0.5):
        self.rarity, self.basis, self.vectors, self.labels, self.near, self.prior = rarity, basis, vectors, labels, near, prior

    def parts(self) -> tuple:
        return self.rarity, self.basis, self.vectors, self.labels, self.near, self.prior

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(np.sqrt(counts) * self.rarity) @ self.basis)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by their
        cosine. Vectors as near as the last of them, to 1e-6, vote too, so no
        order breaks a tie; without a similar one the prior counts."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cos = self.latent(counts) @ self.vectors.T
        near = min(self.near, len(self.labels))
        last = -np.partition(-cos, near - 1, axis=1)[:, near - 1 : near]
        weight = np.where(cos >= last - 1e-6, np.maximum(cos, 0), 0)
        total = weight.sum(1)
        return np.where(total > 0, weight @ self.labels / np.where(total > 0, total, 1), self.prior)


def train(counts: np.ndarray, labels: np.ndarray, directions: int = 64, seed: int = 3) -> QualityModel:
    """Latent directions by randomised subspace iteration."""
    dim = counts.shape[1] if counts.ndim == 2 else 1
    if not len(labels):
        return QualityModel(np.ones(dim, np.float32), np.zeros((dim, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    rarity = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.3
    rarity[-1] = rarity.max()  # repetition: rare occurrences are noise, many are not
    x = unit(np.sqrt(counts) * rarity).astype(np.float32)
    width = min(directions + 16, *x.shape)
    basis = np.random.default_rng(seed).standard_normal((dim, width)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    small = x @ basis
    _, _, turn = np.linalg.svd(small, full_matrices=False)
    model = QualityModel(rarity, (basis @ turn.T[:, :directions]).astype(np.float32), np.zeros((0, 1)), labels)
    model.vectors, model.labels = model.latent(counts).astype(np.float32), labels.astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, dim: int = DIM, label: str = "quality", fold: tuple[int, int] = (3, 1)) -> QualityModel:
    """Fit on about ``per_class`` rows of each label outside the held-out fold.
    Rows without label or id are not used; of two labels of an id the smaller
    counts, and of texts that share an id the smallest. The sample is in order,
    so reruns agree. Without labels every text scores 0.5."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))
    learn = rows.where(~held_out(F.col("doc_id"), *fold))
    sample = class_sample(learn, "y", per_class)
    text_batches(docs.sparkSession)

    def run(batches):
        for batch in sliced(batches):
            counts = features(batch.column(2), dim).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sparse(c) for c in counts], pa.binary())], names=["doc_id", "y", "x"])

    # the sample is bounded by per_class, so it can be broadcast and collected
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    texts = texts.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
    got = sorted(texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x binary").collect())
    counts = np.zeros((len(got), dim), np.float32)
    for k, r in enumerate(got):
        unsparse(r.x, counts[k])
    model = train(counts, np.array([r.y for r in got], np.int64))
    model.prior = learn.agg(F.coalesce(F.avg("y"), F.lit(0.5))).first()[0]
    return model


def score(docs: DataFrame, model: QualityModel, fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``. Null
    and empty texts have no direction and get the share of label 1 among the
    labelled rows, as any text does that resembles nothing; repeated rows give
    repeated rows; an empty table gives no rows; of neighbours that are equally
    near all vote; columns besides ``doc_id`` and ``text`` are not read, whatever
    their names; a null id is in no fold."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model.parts())
    own = docs.select("doc_id", held_out(F.col("doc_id"), *fold).alias("held_out"), "text")
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches):
        m = QualityModel(*shared.value)
        for batch in sliced(batches):
            value = m.score(features(batch.column(2), len(m.rarity))).astype(np.float64).clip(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return spread(own).mapInArrow(run, schema)
