"""Toxic passages as maximum-scoring segments of word log-odds.

Fit: document counts of words and word stems (first five and four letters) in
toxic and other labelled texts give log-odds with an informative Dirichlet
prior (the pooled counts); only significant ones score positive, all other
words cost a fixed drift, so the expected score of a word is negative. Score: a
linear-time scan finds every maximal segment. Extreme-value statistics tell what
segments are worth in a text of n words: the chance of one is 1 - exp(-K n
exp(-lambda S)), lambda solved from the scores of clean words and K fitted to the
best segments of clean texts; the chances of several are summed (Karlin and
Altschul), and a text is toxic if its chance is below ``alpha``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import class_sample, discard, held_out, spread, text_batches, tidy, written
from .jaccard import shingle_sets

#: Names of result columns.
RESULTS = ("held_out", "score", "predicted", "passages")

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _TOKEN.findall(text.lower())


def stems(word: str) -> tuple[str, ...]:
    """What a word is scored by: itself and its first five and four letters."""
    return (word, word[:5] + "*", word[:4] + "*") if len(word) > 5 else (word, word[:4] + "*") if len(word) > 4 else (word,)


def segments(at: np.ndarray, gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text
    whose words cost ``drift`` except those at ``at`` that gain ``gain``: a
    linear scan over the gains with a stack of open segments."""
    stack: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    total, last = 0.0, -1
    for p, g in zip(at.tolist(), gain.tolist(), strict=True):
        total -= drift * (p - last - 1)
        last = p
        first, before, after = p, total, total + g
        total = after
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= after:
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, p, before, after))
    return [(a, b, hi - lo) for a, b, lo, hi in stack]


def surprise(strength: list[float]) -> float:
    """-ln of the chance of the best segments of a text, given lambda S - ln(K n)
    of each: of one by the extreme-value law, of r by the law of the sum of the r
    best, with a factor 2^r for the choice of r."""
    if not strength:
        return 0.0
    best = sorted(strength, reverse=True)
    # the chance is 1 - exp(-e); for small e that is e
    e = math.exp(-max(-50.0, best[0]))
    out, total = (best[0] if best[0] > 30 else -math.log(-math.expm1(-e)) if e < 700 else 0.0) - math.log(2), best[0]
    for r, x in enumerate(best[1:], 2):
        if x <= 0:
            break
        total += x
        out = max(out, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return max(0.0, out)


class ToxicityModel:
    """Log-odds of features, drift, and lambda and K of the extreme-value law."""

    def __init__(self, odds: dict[str, float], drift: float, lam: float, k: float, alpha: float = 1e-5):
        self.odds, self.drift, self.lam, self.k, self.alpha = odds, drift, lam, k, alpha
        self.cut = -math.log(alpha)
        self.seen: dict[str, float] = {}

    def parts(self) -> tuple:
        return self.odds, self.drift, self.lam, self.k, self.alpha

    def gain(self, word: str) -> float:
        g = self.seen.get(word)
        if g is None:
            g = max([self.odds.get(s, 0.0) for s in stems(word)])
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = g
        return g

    def found(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal segments."""
        words = tokens(text)
        gains = np.fromiter(map(self.gain, words), np.float64, len(words))
        at = np.flatnonzero(gains > 0)
        return len(words), segments(at, gains[at], self.drift) if len(at) else []

    def value(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """-ln of the chance that a clean text has such segments (minus infinity
        if no word is toxic) and the passages that stand out by themselves: first
        word, last word, nats above chance."""
        n, own = self.found(text)
        if not own:
            return -math.inf, []
        base = math.log(self.k * n)
        strength = [(a, b, self.lam * s - base) for a, b, s in own]
        return surprise([x for _, _, x in strength]), [(a, b, x) for a, b, x in strength if x > 0]

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score in 0..1 (0.5 where the chance is ``alpha``), and the passages."""
        v, passages = self.value(text)
        return (1 / (1 + math.exp(-min(50.0, max(-50.0, v - self.cut)))) if v > -math.inf else 0.0), passages


#: Shingles of a text that are compared with those of others.
SKETCH = 256


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sets of shingles by their sketches, the least ``SKETCH``
    hashes: exact if the sets are no larger, else an estimate."""
    whole = np.union1d(a, b)[:SKETCH]
    return float(np.isin(np.intersect1d(a, b, True), whole, True).sum()) / max(1, len(whole))


class Copies:
    """Tells whether a text of a class came before: one of the same words, or
    a near copy, whose sets of 5-word shingles agree by ``least`` at least.
    Near copies are looked up by the first hashes and verified on the sketch."""

    def __init__(self, least: float = 0.8, first: int = 8):
        self.least, self.first = least, first
        self.words: set[tuple[int, str | bytes]] = set()
        self.kept: list[np.ndarray] = []
        self.by_hash: dict[tuple[int, int], list[int]] = {}

    def seen(self, y: int, words: str | bytes, sketch: np.ndarray | None) -> bool:
        if (y, words) in self.words:
            return True
        self.words.add((y, words))
        if sketch is None or not len(sketch):
            return False
        keys = [(y, h) for h in sketch[: self.first].tolist()]
        if any(similarity(sketch, self.kept[k]) >= self.least for k in sorted({k for key in keys for k in self.by_hash.get(key, ())})):
            return True
        for key in keys:
            self.by_hash.setdefault(key, []).append(len(self.kept))
        self.kept.append(sketch)
        return False


def strong(c0: int, c1: int, share: float, least: float) -> bool:
    """Whether more toxic texts hold a feature than chance gives any of so many
    features (Chernoff bound)."""
    n = c0 + c1
    return c1 > n * share and c1 * math.log(c1 / (n * share)) + (c0 * math.log(c0 / (n * (1 - share))) if c0 else 0) >= least


def log_odds(table: list[tuple[str, int, int]], leading: dict[str, int], size: list[int], n0: int, n1: int, spread: float) -> dict[str, float]:
    """Log-odds of significant features (feature, texts of either class that hold
    it), given how often each stem's commonest word is held."""
    odds = {}
    for s, c0, c1 in table:
        if s[-1] == "*" and (c1 / size[1] < 20 * c0 / size[0] or 2 * leading.get(s, 0) > c1):
            continue  # a stem must be rarer still in other texts, and stand for several words
        prior = 0.5 + spread * (c0 + c1) / (n0 + n1)
        a, b = c1 + prior, c0 + prior
        delta = math.log(a / (n1 + spread - c1)) - math.log(b / (n0 + spread - c0))
        if delta > 1:
            odds[s] = min(6.0, delta)
    return odds


def decay(gains: dict[float, int]) -> float:
    """Lambda: solves E[exp(lambda * score)] = 1 over the words of clean texts."""
    total = sum(gains.values())
    if not any(g > 0 for g in gains):
        return 2.0
    excess = lambda lam: sum(n * math.exp(lam * g) for g, n in gains.items()) / total - 1
    lo, hi = 1e-3, 4.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return max(lo, 0.2)


def extent(best: list[tuple[int, float]], lam: float) -> float:
    """K by maximum likelihood from clean texts (words, best segment or 0): with
    x = n exp(-lambda S), K x is exponential. The law is one of high scores, so
    texts without a segment are only known to stay below the least one seen."""
    least = min((s for _, s in best if s > 0), default=0.0)
    x = sum(n * math.exp(-lam * max(s, least)) for n, s in best)
    return max(1e-6, (1 + sum(s > 0 for _, s in best)) / max(x, 1e-9)) if best else 1.0


def train(words: list[str], labels: list[int], sketches: list[np.ndarray] | None = None, drift: float = 0.35, margin: float = 0.0, spread: float = 500.0, k: float = 0.05, alpha: float = 1e-5) -> ToxicityModel:
    """Fit on the distinct words (joined by spaces) of labelled texts: the plain
    form of ``fit``, with K given. ``spread`` is the weight of the Dirichlet
    prior; a feature must be significant by ``margin`` nats beyond what the
    number of features explains. Of copies, and near copies by ``sketches`` if
    given, one text counts. Without a text of each class nothing is toxic."""
    counts, size, copies = (Counter(), Counter()), [0, 0], Copies()
    single: Counter = Counter()
    for own, y, sketch in zip(words, labels, sketches or [None] * len(words), strict=True):
        if copies.seen(y, own, sketch):
            continue  # copies would make every word of theirs look toxic
        size[y] += 1
        counts[y].update({s for w in own.split() for s in stems(w)})
        if y:
            single.update(own.split())
    if not size[0] or not size[1]:
        return ToxicityModel({}, drift, 1.0, 1.0, alpha)
    n0, n1 = (sum(c.values()) for c in counts)
    share, least = size[1] / sum(size), math.log(len(counts[1])) + margin
    leading: Counter = Counter()  # of each stem, the texts of its commonest word
    for w, c in single.items():
        for s in stems(w)[1:]:
            leading[s] = max(leading[s], c)
    table = [(s, counts[0][s], c1) for s, c1 in counts[1].items() if strong(counts[0][s], c1, share, least)]
    model = ToxicityModel(log_odds(table, leading, size, n0, n1, spread), drift, 2.0, k, alpha)
    gains: Counter = Counter()
    for own, y in zip(words, labels, strict=True):
        if y == 0:
            gains.update(round(g, 2) if g > 0 else -drift for g in map(model.gain, own.split()))
    model.lam = decay(gains)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, label: str = "toxic", fold: tuple[int, int] = (5, 0), drift: float = 0.35, margin: float = 0.0, spread: float = 500.0, alpha: float = 1e-5) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows: about ``per_class`` of each
    label, never of the held-out fold. Rows without label or id are not used; an
    id that is labelled twice counts as toxic; of texts that share an id the
    smallest one counts. Words are counted on the executors: a sketch a text and
    the significant features alone come to the driver. ``alpha`` is the chance
    below which a text is toxic."""
    spark = docs.sparkSession
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    sample = class_sample(rows.where(~held_out(F.col("doc_id"), *fold)), "y", per_class)
    text_batches(spark)
    # the sample is bounded by per_class, so it can be broadcast
    text = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))

    def distinct(batches):
        for batch in batches:
            words = [sorted(set(tokens(t))) for t in batch.column(2).to_pylist()]
            name = [hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest() for w in words]
            sketch = [s[:SKETCH].tobytes() for s in shingle_sets(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(name, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "y", "text", "words", "name", "sketch"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    cores = spark.sparkContext.defaultParallelism
    own = written(text.repartition(cores, "doc_id").mapInArrow(tidy(distinct), f"doc_id {ids}, y int, text string, words array<string>, name binary, sketch binary"), "toxic-sample")
    copies, size, counted = Copies(), [0, 0], set()
    for r in sorted(own.select("doc_id", "y", "name", "sketch").collect()):
        if not copies.seen(r.y, r.name, np.frombuffer(r.sketch, np.uint64)):
            size[r.y] += 1
            counted.add(r.doc_id)
    if not size[0] or not size[1]:
        discard(own)
        return ToxicityModel({}, drift, 1.0, 1.0, alpha)

    def count(batches):
        found = Counter(), Counter()
        for batch in batches:
            for i, y, words in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if i in counted:
                    found[y].update({s for w in words for s in stems(w)})
        every = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[s] for s in every], pa.int64()) for c in found)], names=["feature", "c0", "c1"])

    counts = own.select("doc_id", "y", "words").mapInArrow(tidy(count), "feature string, c0 long, c1 long")
    features = written(counts.groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "toxic-features")
    n0, n1, many = features.agg(F.sum("c0"), F.sum("c1"), F.count_if(F.col("c1") > 0)).first()
    share, least = size[1] / sum(size), math.log(max(1, many)) + margin
    c0, c1 = F.col("c0"), F.col("c1")
    n = c0 + c1
    evidence = c1 * F.log(c1 / (n * share)) + F.when(c0 > 0, c0 * F.log(c0 / (n * (1 - share)))).otherwise(0.0)
    table = [tuple(r) for r in features.where((c1 > 0) & (c1 > n * share) & (evidence >= least)).collect()]
    # words that significant stems stand for
    stem = lambda n: F.concat(F.substring("feature", 1, n), F.lit("*"))
    word = features.where((c1 > 0) & ~F.col("feature").endswith("*") & (F.length("feature") > 4))
    five = F.when(F.length("feature") > 5, stem(5))
    of_stem = word.select(F.explode(F.array(five, stem(4))).alias("stem"), "c1").where(F.col("stem").isin([f for f, _, _ in table if f[-1] == "*"]))
    leading = {r.stem: r.c for r in of_stem.groupBy("stem").agg(F.max("c1").alias("c")).collect()}
    shared = ToxicityModel(log_odds(table, leading, size, n0, n1, spread), drift, 2.0, 1.0, alpha).parts()

    def clean(batches):
        """Words and best segment of each text; at the end how often each gain."""
        m, found = ToxicityModel(*shared), Counter()
        for batch in batches:
            got = [m.found(t) for t in batch.column(0).to_pylist()]
            for words in batch.column(1).to_pylist():
                found.update(round(g, 2) if g > 0 else -drift for g in map(m.gain, words))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([max((s for _, _, s in x), default=0.0) for _, x in got], pa.float64()), pa.array([False] * len(got))], names=["n", "s", "gain"])
        yield pa.RecordBatch.from_arrays([pa.array(list(found.values()), pa.int64()), pa.array(list(found), pa.float64()), pa.array([True] * len(found))], names=["n", "s", "gain"])

    # two numbers a text of the sample
    got = own.where("y = 0").select("text", "words").mapInArrow(tidy(clean), "n long, s double, gain boolean").collect()
    discard(own, features)
    gains: Counter = Counter()
    for r in got:
        if r.gain:
            gains[r.s] += r.n
    lam = decay(gains)
    return ToxicityModel(*shared[:2], lam, extent(sorted((r.n, r.s) for r in got if not r.gain and r.n), lam), alpha)


def score(docs: DataFrame, model: ToxicityModel, fold: tuple[int, int] = (5, 0), passages: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text: the kept columns, ``held_out``, ``score``,
    ``predicted`` (score at least 0.5) and, with ``passages``, the toxic
    passages as word spans. Null and empty texts score 0, as does any text if
    there were no labels of both kinds; repeated rows give repeated rows; an
    empty table gives no rows; work is linear in a long text; a null id is in no
    fold. Kept columns that are named like
    results come back with an underscore behind."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model.parts())
    kept = [F.col(c).alias(c + "_" if c in RESULTS else c) for c in keep]
    own = docs.select(*kept, *([] if "text" in keep else ["text"]), held_out(F.col("doc_id"), *fold).alias("held_out"))
    names = [c for c in own.columns if c != "text" or "text" in keep]
    schema = ", ".join([*(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in names), "score double", "predicted int"])
    if passages:
        schema += ", passages array<struct<from_word:int,to_word:int,strength:double>>"

    def run(batches):
        m = ToxicityModel(*shared.value)
        for batch in batches:
            got = [m.score(t or "") for t in batch.column("text").to_pylist()]
            value = np.array([s for s, _ in got], np.float64)
            cols = [*(batch.column(c) for c in names), pa.array(value), pa.array((value >= 0.5).astype(np.int32))]
            if passages:
                cols.append(pa.array([[{"from_word": a, "to_word": b, "strength": x} for a, b, x in p] for _, p in got], pa.list_(pa.struct([("from_word", pa.int32()), ("to_word", pa.int32()), ("strength", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "score", "predicted", *["passages"] * passages])

    return spread(own).mapInArrow(tidy(run), schema)
