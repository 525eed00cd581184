"""Mixing sources to target weights, with DataFrame functions alone.

Targets: every source has a weight; all words are shared by weight, no source
above ``epochs`` times its size, what is over is shared again by weight. That
is water-filling, solved in one pass over the sources in the order in which
they fill up. Selection: whole epochs first; the fraction that remains goes to
the documents with the smallest exponential keys -ln(u) / quality
(Efraimidis-Spirakis), by prefix sums within the source.

No source is ever sorted as a whole: keys fall into ``BUCKETS`` ranges, sums
per range find the one range in which the budget ends, and only that range is
sorted. A key hangs on id and text, so rows that share an id (or have none)
spread over all ranges; rows that are equal in both are one group with a count,
and how many of them are taken follows from the sums: nothing hangs on the
order in which rows lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, discard, side, written

BUCKETS = 4096
#: Copies of a group that one task writes out.
COPIES = 4096
#: Weights by place of the source, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
#: Per-source tables up to this many rows are broadcast, larger ones are joined
#: by a shuffle.
BROADCAST_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight, 0.125 to 1: texts with words of usual length and of
    some extent are preferred."""
    mean = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    usual = F.greatest(F.lit(0.25), 1 - F.abs(mean - 6.0) / 12)
    return usual * (0.5 + 0.5 * F.least(F.lit(1.0), size / 100.0))


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from id, text and seed: reruns agree."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = 3, share: float = 1.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row a
    source (code point order, null last). A source fills at the level cap /
    weight; with all fuller ones set aside, the level of the others is (total -
    their caps) / (weights left); the highest level that no source fills below is
    the one that holds."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    t = t.withColumn("fills", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fills", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (share * F.sum("source_size").over(every) - gone("cap")) / (F.sum("weight").over(every) - gone("weight"))
    t = t.withColumn("level", level)
    open_level = F.max(F.when(F.col("fills") > F.col("level"), F.col("level"))).over(every)
    return t.withColumn("open", open_level).select("source", "source_size", F.when(F.col("fills") <= F.col("level"), F.col("cap")).otherwise(F.col("open") * F.col("weight")).alias("target"))


def _keyed(docs: DataFrame, quality: Column | None, seed: int, carry: list[str]) -> DataFrame:
    """Carried columns with ``_id, _source, size, _key, _tie, _bucket``. ``_tie``
    tells rows of equal id and text apart by what they carry."""
    rows = docs.select(*carry, F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text").alias("_text"))
    rows = rows.withColumn("size", word_count(F.col("_text")))
    weight = quality if quality is not None else quality_weight(F.col("_text"), F.col("size"))
    tie = F.xxhash64(*names) if (names := [c for c in rows.columns if c.startswith("k_")]) else F.lit(0).cast("long")
    rows = rows.withColumn("_key", exponential_key(F.col("_id"), F.col("_text"), weight, seed)).withColumn("_tie", tie).drop("_text")
    # monotone in the key, and even for like weights
    return rows.withColumn("_bucket", F.least(F.lit(BUCKETS - 1), F.floor(BUCKETS * (1 - F.exp(-F.col("_key"))))).cast("int"))


def _goal(rows: DataFrame, weights: tuple[float, ...], epochs: int, share: float) -> DataFrame:
    """Per source: ``source, source_size, target, epochs, rest`` and ``cut``
    (bucket in which the rest ends, words before it); written, one row a source."""
    sums = written(rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("words")), "mix-sums")
    goal = targets(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, epochs, share)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    run = Window.partitionBy("_source").orderBy("_bucket")
    cut = sums.withColumn("upto", F.sum("words").over(run)).join(goal.select("source", "rest"), F.col("_source").eqNullSafe(F.col("source")))
    cut = cut.where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest"))).groupBy("_source").agg(F.min(F.struct("_bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    goal = written(goal.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "mix-goal")
    discard(sums)
    return goal


GROUP = ["_source", "_key", "_id", "size", "_tie"]


def _edge(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Groups of equal rows in the bucket in which a source's budget ends, with
    ``_rows`` and ``_picked``: of how many taking one more row brings the sum of
    the source nearer to the target."""
    inside = rows.join(goal, F.col("_source").eqNullSafe(F.col("source"))).where(F.col("_bucket") == F.col("cut._bucket"))
    groups = inside.groupBy(*GROUP, "source_size", "target", "epochs", "rest", F.col("cut.before").alias("before")).agg(F.count("*").alias("_rows"))
    order = Window.partitionBy("_source").orderBy(*GROUP[1:]).rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("_rows") * F.col("size")).over(order), F.lit(0))
    picked = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(0)
    return groups.withColumn("_picked", F.least(F.col("_rows"), F.greatest(F.lit(0), picked)).cast("long"))


def _copies(groups: DataFrame, times: Column) -> DataFrame:
    """Every row ``times`` times, with ``_nth`` from 0; large counts are dealt
    out in parts, so that no task writes a group alone."""
    parts = groups.withColumn("_times", times).where("_times > 0").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / COPIES))))
    start = F.col("_part") * COPIES
    return parts.withColumn("_nth", F.explode(F.sequence(start, F.least(start + COPIES, F.col("_times")) - 1))).drop("_times", "_part")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = 3, share: float = 1.0, seed: int = 11, quality: Column | None = None) -> DataFrame:
    """What the mix takes of every document: ``doc_id, size`` (words),
    ``source_size, target`` (of its source), ``taken`` (words, repeats counted:
    a multiple of ``size``).

    Null text has size 0 and is never taken; the null source is a source of its
    own; rows that share an id, null ids too, are told apart by their text, and
    of rows equal in both any may be the one that is taken; an empty table gives
    no rows; columns beyond ``doc_id``, ``text`` and ``source`` are not read.
    The document at the end of a budget is taken if that brings the sum nearer
    to the target. ``quality`` is a weight above 0 over the columns ``_text``
    and ``size``.
    """
    rows = written(_keyed(docs, quality, seed, []), "mix")
    goal = _goal(rows, weights, epochs, share)
    small = side(goal, BROADCAST_ROWS)
    inside = F.coalesce(F.col("_bucket") == F.col("cut._bucket"), F.lit(False))
    columns = [F.col("_id").alias("doc_id"), "size", "source_size", "target"]
    times = lambda more: (F.col("size") * (F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long"))).cast("long").alias("taken")
    edge = _copies(_edge(rows, small), F.col("_rows")).select(*columns, times(F.col("_nth") < F.col("_picked")))
    all_ = rows.join(small, F.col("_source").eqNullSafe(F.col("source"))).where(~inside)
    return edge.unionByName(all_.select(*columns, times(F.col("_bucket") < F.col("cut._bucket"))))


def mixed_documents(docs: DataFrame, keep: list[str], weights: tuple[float, ...] = WEIGHTS, epochs: int = 3, share: float = 1.0, seed: int = 11) -> DataFrame:
    """The mix itself: the kept columns of each document, as often as ``mix``
    takes it. Texts are neither written nor shuffled: buckets are made again in
    a scan, and only the few rows of last buckets have their decision joined. Of
    equal rows of which some are taken (one group a source at most), one comes
    back as often as it is due."""
    own = [F.col(c).alias(f"k_{c}") for c in keep]
    names = [f"k_{c}" for c in keep]
    keyed = _keyed(docs.select("doc_id", "source", "text", *own), None, seed, names)
    rows = written(keyed.select(*GROUP, "_bucket"), "mix")
    goal = _goal(rows, weights, epochs, share)
    goal_side = side(goal, BROADCAST_ROWS)
    last = _edge(rows, goal_side).select(*[F.col(c).alias(f"_g{c}") for c in GROUP], "_rows", "_picked")
    last = written(last, "mix-last", packed=True)
    discard(rows)
    inside = F.coalesce(F.col("_bucket") == F.col("cut._bucket"), F.lit(False))
    same = F.lit(True)
    for c in GROUP:
        same = same & F.col(c).eqNullSafe(F.col(f"_g{c}"))
    d = keyed.where("size > 0").join(goal_side, F.col("_source").eqNullSafe(F.col("source"))).withColumn("_edge", inside)
    d = d.join(side(last), F.col("_edge") & same, "left")
    split = F.coalesce((F.col("_picked") > 0) & (F.col("_picked") < F.col("_rows")), F.lit(False))
    more = F.when(F.col("_edge"), F.col("_picked") > 0).otherwise(F.coalesce(F.col("_bucket") < F.col("cut._bucket"), F.lit(False)))
    times = F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long")
    out = [F.col(n).alias(c) for n, c in zip(names, keep, strict=True)]
    whole = d.where(~split).select(*out, F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("_t")).drop("_t")
    if not last.where("_picked > 0 AND _picked < _rows").limit(1).count():
        return whole
    some = d.where(split).groupBy(*GROUP, "epochs", "_rows", "_picked").agg(*[F.first(n).alias(n) for n in names])
    return whole.unionByName(_copies(some, F.col("epochs") * F.col("_rows") + F.col("_picked")).select(*out))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS n, text FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
        / (greatest(0.25, 1 - abs(n / greatest(size, 1)::DOUBLE - 6.0) / 12) * (0.5 + 0.5 * least(1.0, size / 100.0::DOUBLE))) AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
f AS (SELECT *, 3 * source_size / weight AS fills FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM f WINDOW b AS (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN fills <= level THEN 3 * source_size ELSE max(CASE WHEN fills > level THEN level END) OVER () * weight END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * (epochs + CASE WHEN rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
