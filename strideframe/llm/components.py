"""Connected components within tasks, then by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import discard, settle

STRETCH = 1 << 18  # edges that a task draws together at a time


def _drawn_together(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, that keep the components: within a stretch of a task's edges each node is linked with the least that it reaches there."""

    def least_of(u, v):
        import pyarrow as pa

        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = ends[: len(u)], ends[len(u) :]
        label = np.arange(len(nodes))
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not ((least := label[label]) == label).all():
                label = least
        at = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[at]), pa.array(nodes[label[at]])], names=["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("u", "v")])
            n += batch.num_rows
            if n >= STRETCH:
                yield least_of(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield least_of(*map(np.concatenate, zip(*held, strict=True)))

    return edges.mapInArrow(run, "u bigint, v bigint")


def connected_components(edges: DataFrame, scratch: list[DataFrame] | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint) but the least of each component.

    The component is its least node.  Tasks first draw together what is linked
    within stretches of their edges, which ends it where all edges are one
    stretch.  Otherwise rounds follow, each written to the shared
    folder and the one before deleted; rows never outnumber the edges,
    whatever a node's degree; rounds go on until no node has two labels.  Null ends
    and loops are ignored, repeated edges count once, no edges give no rows.
    The table that the result still reads is added to ``scratch``.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = settle(e, "edges")
    tasks = -(-e.count() // STRETCH)
    if tasks:
        before, e = e, settle(_drawn_together(e.coalesce(tasks)), "edges")
        discard(before)
    while tasks > 1:
        labels = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", F.col("v").alias("y")))
        if labels.groupBy("x").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo <> hi").isEmpty():
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        before, e = e, settle(small.distinct(), "edges")
        discard(before)
    if scratch is not None:
        scratch.append(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def merged_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) of all links so far: ``labels`` of the links before, and ``links`` (a, b) that are new.

    The new links are drawn between the components known so far, so only what
    has still to meet is worked on.
    """
    scratch: list[DataFrame] = []
    if labels is None:
        out = settle(connected_components(links, scratch), "labels")
        discard(*scratch)
        return out
    name = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
    drawn = links.join(name("a"), "a", "left").join(name("b"), "b", "left")
    fresh = connected_components(drawn.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")), scratch)
    step = fresh.select(F.col("node").alias("component"), F.col("component").alias("into"))
    moved = labels.join(step, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    out = settle(moved.union(fresh), "labels")
    discard(*scratch)
    return out
