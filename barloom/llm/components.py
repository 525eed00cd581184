"""Connected components of link tables that are too large for one machine, and
of things that share keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import dealt_pairs, discard, tidy, written

#: Rows of a key, or of a component, in a chunk.
CHUNK = 1024


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of its component) for all nodes of
    ``links(a, b)``, which need be given in one direction only.

    Rounds of two steps: every node takes the smallest root among itself and
    its neighbours; then roots are replaced by their own root (pointer
    jumping), so paths shorten by halves. Sums per node are combined before the
    shuffle, so a hub costs a row a task; tables are written after each round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.where("a <> b").distinct(), "edges")
    if not edges.limit(1).count():
        none = written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
        discard(edges)
        return none
    label = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "roots")
    while True:
        # smallest root around, offered to the node and to its present root
        near = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        offer = label.join(near, "node").select("node", "root", F.least("root", "low").alias("low"))
        to_root = offer.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("from_below"))
        step = offer.join(to_root, "node", "left").select("node", "root", F.least("low", F.coalesce("from_below", "low")).alias("new"))
        step = written(step, "roots")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        moved = written(step.join(jump, "new", "left").select("node", "root", F.least("new", F.coalesce("far", "new")).alias("new")), "roots")
        discard(label, step)
        changed = moved.where("new <> root").limit(1).count()
        label = moved.select("node", F.col("new").alias("root"))
        label._barloom_path = moved._barloom_path
        if not changed:
            discard(edges)
            return label


def linked(held: DataFrame, order: list[str], may: Callable[[Callable, Callable], Column], verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node, root`` of all nodes that link with others, where links are found
    among the nodes that share a key. ``held`` has ``token`` (the key), ``node``
    and what ``order`` and ``may`` use; ``may`` tells of two rows, given as
    functions from a column's name, whether their nodes may link; ``verify``
    keeps the pairs ``a, b`` that do.

    Work stays linear in groups of alike nodes. Of each key, first only the
    pairs with its hub (the least by ``order``) are verified; what they link is
    one component. The exact rest then looks at every pair of *different*
    components that a key still holds, dealt out in chunks, so no link between
    components is lost.
    """
    rest_of = [c for c in held.columns if c not in ("token", "node", *order)]
    hubs = held.groupBy("token").agg(F.min(F.struct(*order, "node", *rest_of)).alias("h"))
    near = (F.col("node") != F.col("h.node")) & may(F.col, lambda c: F.col(f"h.{c}"))
    star = held.join(hubs, "token").where(near).select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b"))
    star = written(star.distinct(), "star")
    links = verify(star)
    roots = components(links)

    marked = written(held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "marked")
    open_ = marked.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    still = written(dealt_pairs(marked.join(open_, "token", "left_semi"), ["token"], F.ceil(F.count("*") / CHUNK)), "open")
    discard(marked)
    l, r = still.alias("l"), still.alias("r")
    of = lambda side: lambda c: F.col(f"{side}.{c}")
    cell = (F.col("l.token") == F.col("r.token")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
    once = F.when(F.col("l.i") == F.col("l.j"), F.col("l.node") < F.col("r.node")).otherwise((F.col("l.side") == 0) & (F.col("r.side") == 1))
    rest = l.join(r, cell & once & (F.col("l.root") != F.col("r.root")) & may(of("l"), of("r")))
    rest = rest.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()
    rest = written(rest.join(star, ["a", "b"], "left_anti"), "rest")
    discard(star, still)
    if not rest.limit(1).count():
        discard(links, rest)
        return roots
    discard(roots)
    more = verify(rest)
    discard(rest)
    both = written(links.unionByName(more), "links")
    roots = components(both)
    discard(links, more, both)
    return roots


def link_counts(own: DataFrame, parts: Column, payload: DataFrame, count: Callable) -> DataFrame:
    """``node, near``: the weights of the other nodes of its component that a
    node links with. ``own`` has ``root, node, weight`` and what the aggregate
    ``parts`` uses; ``payload`` has ``node`` and one binary column. All pairs of
    a component are looked at: a large one is cut into chunks, and every pair of
    chunks is a task of its own that returns sums per node, so the work grows
    with the square of the group and the rows do not. ``count(names, weight, side,
    same, payload)`` gives the nodes of a cell that link there, and their sums.
    """
    body = [c for c in payload.columns if c != "node"][0]
    cells = dealt_pairs(own, ["root"], parts).select("root", "i", "j", "side", "node", "weight")
    full = cells.join(payload, "node").select("root", "i", "j", "side", "node", "weight", body).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")

    def run(batches):
        mark, rows = None, []

        def flush():
            if len(rows) > 1:
                side, names, weight = (np.array([r[k] for r in rows], np.int64) for k in range(3))
                found = count(names, weight, side, mark[1] == mark[2], [r[3] for r in rows])
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "near"])

        for batch in batches:
            root, i, j, *body = (batch.column(k).to_pylist() for k in range(7))
            for k, row in enumerate(zip(*body, strict=True)):
                if (root[k], i[k], j[k]) != mark:
                    yield from flush()
                    mark, rows = (root[k], i[k], j[k]), []
                rows.append(row)
        yield from flush()

    return full.mapInArrow(tidy(run), "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))
