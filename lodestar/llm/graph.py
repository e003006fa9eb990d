"""Connected components: forests within tasks, then alternating steps to the neighbour's and the node's least neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.llm.tables import Saved

#: Links that a task joins at once before it passes on what they come to.
HELD = 1 << 19
#: A node is hot if it is the lower end of at least HOT links and of one in SHARE: there are SHARE hot nodes at most.
HOT, SHARE = 1024, 512
#: So few links are joined by one task at once, as a round would cost some hundred tasks for them.
LAST = 1 << 14


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star on its least node for each component of the links (a, b): fewer rows than there are nodes, the least node second."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        np.minimum.at(low, label, low)
        low = low[low]
        if (low == label).all():
            break
        label = low
    keep = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[keep], nodes[label[keep]]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star forests of the links of a task, HELD at a time. Where rows come sorted by a, those of one a stay together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def out(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = star_forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        if rows >= HELD and len(a) and a[0] != held[-1][0][-1]:
            yield out(held)
            held, rows = [], 0
        if len(a):
            held.append((a, b))
            rows += len(a)
    if held:
        yield out(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that links (a, b) join to another: component is the smallest node that they reach.

    Links may repeat, point both ways or join a node to itself; rows with a null end are ignored. First every task
    joins its own links into stars. Then each round moves a link from its lower end to that end's least neighbour and
    joins what every upper end reaches, which halves the longest chain at least. The least neighbours of hot lower
    ends, SHARE rows at most, are broadcast, so a node with a third of all links is no single task's; an upper end
    has one link for each task of the round before at most. A round is one written table. When LAST links or fewer
    are left, one task joins them and no more rounds are needed.
    """
    tables = Saved(edges.sparkSession)
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    links = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b")

    def save(df: DataFrame) -> tuple[DataFrame, int, int]:
        seen = Observation()
        out = tables.save(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")))
        return out, seen.get["n"], seen.get["h"] or 0

    now, *mark = save(links.mapInArrow(_stars, "a long, b long"))
    while mark[0]:
        if mark[0] <= LAST:
            before, (now, *mark) = now, save(now.coalesce(1).mapInArrow(_stars, "a long, b long"))
            tables.drop(before)
            break
        low = now.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
        hot = [r["b"] for r in now.groupBy("b").count().where(F.col("count") >= max(HOT, mark[0] // SHARE)).select("b").collect()] if mark[0] >= HOT else []  # SHARE at most
        if hot:
            cold = ~F.col("b").isin(hot)
            moved = now.where(cold).join(low.where(cold), "b", "left").unionByName(now.where(~cold).join(F.broadcast(low.where(~cold)), "b", "left"))
        else:
            moved = now.join(low, "b", "left")
        moved = moved.select("a", F.coalesce("m", "b").alias("b"))
        before, was, (now, *mark) = now, mark, save(moved.repartition("a").sortWithinPartitions("a").mapInArrow(_stars, "a long, b long"))
        tables.drop(before)
        if mark == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
