"""Hard negatives: for each anchor and positive the best rows of other labels in a window under the positive's score.

The upper limits of an anchor's positives cut scores into slots that don't overlap. Whatever the windows, an answer is
made of the first few rows of some slots: those of the positive's own slot, then of the slots below it. So tiles keep the
first rows of each slot, and one merge from the lowest slot upwards answers all of an anchor's windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.int_vectors import BLOCK_SCHEMA, packed, products, unpacked
from lodestar.llm.tables import Saved

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 50, 95
#: Rows and anchors that a tile multiplies.
ROWS, ANCHORS = 4096, 1024
#: Rows kept by a task before it combines them.
BUFFER = 1 << 18


def limits(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest whole scores with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def _first(keys: np.ndarray, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each (key, slot): higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, slots, keys))
    a, b = keys[order], slots[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    within = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[within < k]


class _Best:
    """The first k rows of each (key, slot) met so far, combined whenever the buffer is full."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.full = k, [], 0, BUFFER

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.size += len(columns[0])
            if self.size > self.full:
                self.combine()
                self.full = max(BUFFER, 2 * self.size)

    def combine(self) -> None:
        if self.parts:
            all_ = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            kept = _first(*all_, self.k)
            self.parts = [tuple(c[kept] for c in all_)]
            self.size = len(kept)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.combine()
        for columns in self.parts:
            for at in range(0, len(columns[0]), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 65536]) for c in columns], ["key", "slot", "score", "id"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):  # one tile at a time is held
            yield batch.slice(k, 1).to_pylist()[0]


def _positives(k: int):
    """The first k rows of an anchor's label, of another id, among the tiles of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for tile in _tiles(batches):
            keys, own, labels, a = unpacked(tile, "a_")
            _, ids, kinds, x = unpacked(tile)
            for label in np.intersect1d(labels, kinds):
                i, j = np.flatnonzero(labels == label), np.flatnonzero(kinds == label)
                scores = products(a[i], x[j])
                free = own[i][:, None] != ids[j][None, :]
                n = min(k, len(j))
                shown = np.where(free, scores, np.iinfo(np.int64).min)
                edge = np.partition(shown, len(j) - n, axis=1)[:, len(j) - n]
                above, tied = shown > edge[:, None], free & (scores == edge[:, None])
                # ties at the edge are settled by id, the order of a block's rows
                tied &= np.cumsum(tied, axis=1) <= n - above.sum(axis=1, keepdims=True)
                r, c = np.nonzero(above | tied)
                best.add(keys[i][r], np.zeros(len(r), np.int64), scores[r, c], ids[j][c])
        yield from best.batches()

    return run


def _slotted(k: int, low: int, high: int):
    """The first k rows of other labels in each slot of each anchor, among the tiles of a task.

    Slot j holds scores up to the limit of positive j and above that of the next; below the least limit of all windows
    there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for tile in _tiles(batches):
            keys, _, labels, a = unpacked(tile, "a_")
            _, ids, kinds, x = unpacked(tile)
            wanted = dict(zip(tile["anchor_keys"], tile["anchor_scores"], strict=True))
            scores = products(a, x)
            for r, key in enumerate(keys.tolist()):
                positive = np.array([s for s in wanted.get(key, ()) if s >= 0], np.int64)  # a negative score has an empty window
                if not len(positive):
                    continue
                bottom, top = limits(positive, low, high)
                c = np.flatnonzero((scores[r] >= bottom.min()) & (scores[r] <= top.max()) & (kinds != labels[r]))
                if not len(c):
                    continue
                s = scores[r, c]
                slot = np.searchsorted(-top, -s, side="right") - 1  # the last positive whose limit reaches s
                if len(c) > 4 * k * len(top):
                    kept = _first(np.zeros(len(c), np.int64), slot, s, ids[c], k)
                    c, s, slot = c[kept], s[kept], slot[kept]
                best.add(np.full(len(c), key), slot.astype(np.int64), s, ids[c])
        yield from best.batches()

    return run


_KEPT = "key long, slot long, score long, id long"


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "id", label_col: str = "label", vector_col: str = "x") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors (id, label, x), x an array of longs, for which `anchors` is true.

    A score is the inner product with the anchor, higher ones first, ties by smaller id. An anchor's positives are its first
    `positives` rows of the same label; for each of them come the first `negatives` rows of other labels whose score lies
    from `low` to `high` hundredths of the positive's. Rows whose id, label or vector is null, or whose vector is empty, take no part; a
    row is never a positive of its own id; rows that repeat an id are rows each, so an anchor twice is answered twice; a
    positive with a negative score has no window; an empty table gives none. Vectors of unlike length raise ValueError.

    Blocks of anchors, a stated share of the rows, meet blocks of all rows; a task holds one tile and the first rows of each slot it
    met. No label, vector or anchor is a key that rows are gathered by before they are cut to `positives` and `negatives`.
    """
    saved = Saved(vectors.sparkSession)
    rows = vectors.where(F.size(vector_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"), anchors.alias("is_anchor")).where("id is not null and label is not null")
    blocks = saved.save(rows.select(F.lit(0).cast("long").alias("key"), "id", "label", "x").mapInArrow(packed(ROWS), BLOCK_SCHEMA))
    asked = saved.save(rows.where("is_anchor").select(F.monotonically_increasing_id().alias("key"), "id", "label", "x"))
    first_blocks = saved.save(asked.mapInArrow(packed(ANCHORS), BLOCK_SCHEMA))
    # a stated query set against all rows, block by block: nothing is shuffled, both sides are read as written
    met = blocks.crossJoin(first_blocks.select(*[F.col(c).alias(f"a_{c}") for c in first_blocks.columns]))
    nearest = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    found = met.mapInArrow(_positives(positives), _KEPT).withColumn("place", F.row_number().over(nearest) - 1).where(F.col("place") < positives)
    found = saved.save(found.select("key", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    ordered = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    # anchors in blocks with their positives' scores
    with_scores = saved.save(asked.join(ordered, "key"))
    second = saved.save(with_scores.select("key", "id", "label", "x", F.col("positives.positive_score").alias("scores")).mapInArrow(_with_scores(ANCHORS), f"{BLOCK_SCHEMA}, anchor_keys array<long>, anchor_scores array<array<long>>"))
    met = blocks.crossJoin(second.select(*[F.col(c).alias(c if c.startswith("anchor_") else f"a_{c}") for c in second.columns]))
    best = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    slots = met.mapInArrow(_slotted(negatives, low, high), _KEPT).withColumn("place", F.row_number().over(best)).where(F.col("place") <= negatives)
    listed = slots.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("below"), "id"))).alias("slots"))
    answers = with_scores.select("key", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("j", "p")).join(listed, "key")
    # slots from the positive's own downwards, which is the order of scores
    window = F.filter(F.slice(F.filter("slots", lambda s: s["slot"] >= F.col("j")), 1, negatives), lambda s: -100 * s["below"] >= low * F.col("p.positive_score"))
    answers = answers.select("anchor_id", F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score"), F.posexplode(window).alias("at", "n"))
    return answers.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.below")).alias("negative_score"))


def _with_scores(size: int):
    """As packed(), with each anchor's key and scores beside the block."""
    pack = packed(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                for block in pack(iter([part.select(["key", "id", "label", "x"])])):
                    more = [pa.array([part.column("key").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("scores").to_pylist()], pa.list_(pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays([*block.columns, *more], [*block.schema.names, "anchor_keys", "anchor_scores"])

    return run
