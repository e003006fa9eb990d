"""Document quality: random-indexing word vectors pooled by document, and a two-layer network on top."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.tables import split_column
from lodestar.llm.textbytes import chunks, word_hashes

#: Labelled documents that the network learns from at most, drawn by a hash of the id; word vectors come from all documents.
SAMPLE = 12_000
#: Rows of the table of word vectors (words share rows by hash), and dimensions.
ROWS, DIMS = 1 << 15, 96
#: Non-zero entries of a word's index vector, and words to each side that count as its context.
NONZERO, REACH = 6, 2
#: Ranges of rows in which tasks' tables are added.
RANGES = 64
HIDDEN, EPOCHS, BATCH = 48, 30, 128
#: Python and numpy hold so many words of a text at once.
PIECE = 1 << 16


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of the entries of every row's index vector, from a fixed seed; of entries at one place the last counts."""
    rng = np.random.default_rng(11)
    at = rng.integers(0, DIMS, (ROWS, NONZERO))
    sign = rng.choice(np.array([-1, 1], np.float32), (ROWS, NONZERO)).astype(np.int32)
    for k in range(NONZERO - 1):
        sign[(at[:, k : k + 1] == at[:, k + 1 :]).any(axis=1), k] = 0
    return at, sign


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, one for each row of the table."""
    at, sign = index_entries()
    out = np.zeros((ROWS, DIMS), np.float32)
    np.add.at(out, (np.arange(ROWS)[:, None], at), sign.astype(np.float32))
    return out


def tokens(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for the words of every text as written, and words by text."""
    words, counts = word_hashes(flat, offsets, lower=False)
    return (words >> np.uint64(64 - 15)).astype(np.int64), counts


#: Numbers by text: the mean vector, its direction, its length, and of the cosines of neighbouring words the mean, the spread and the share of ones.
FEATURES = 2 * DIMS + 4


def features(table: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The word vectors of every text pooled: FEATURES numbers; those of a text without words are zeros."""
    words, counts = tokens(flat, offsets)
    out = np.zeros((len(counts), FEATURES), np.float32)
    ends = np.cumsum(counts)
    for k in np.flatnonzero(counts):
        own, n = words[ends[k] - counts[k] : ends[k]], int(counts[k])
        pooled, near = np.zeros(DIMS), np.zeros(3)
        for a in range(0, n, PIECE):
            v = table[own[a : a + PIECE + 1]]  # and the first word of the next piece
            pooled += v[:PIECE].sum(axis=0, dtype=np.float64)
            cosines = np.einsum("ij,ij->i", v[1:], v[:-1], dtype=np.float64)
            near += cosines.sum(), (cosines**2).sum(), (cosines > 0.999).sum()
        pooled, near = pooled / n, near / max(1, n - 1)
        length = np.sqrt((pooled**2).sum())
        out[k] = np.concatenate([pooled, pooled / max(length, 1e-6), [length, near[0], np.sqrt(max(0.0, near[1] - near[0] ** 2)), near[2]]])
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every task one table, by ranges of rows: for each word the sum of the index vectors around it."""
    (at, sign), total = index_entries(), np.zeros(ROWS * DIMS, np.int32)

    def add(x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(total, (x[:, None] * DIMS + at[y]).ravel(), sign[y].ravel())

    for batch in batches:
        for _, flat, offsets in chunks(batch.column("text"), PIECE):
            words, counts = tokens(flat, offsets)
            doc = np.repeat(np.arange(len(counts)), counts)
            for d in range(1, REACH + 1):
                for a in range(0, len(words) - d, PIECE):
                    x, y = words[a : a + PIECE], words[a + d : a + d + PIECE]
                    x = x[: len(y)]
                    ok = doc[a : a + len(y)] == doc[a + d : a + d + len(y)]
                    add(x[ok], y[ok])
                    add(y[ok], x[ok])
    parts = [(k, part.tobytes()) for k, part in enumerate(total.reshape(RANGES, -1)) if part.any()]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary()), strict=True)], ["range", "total"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word vectors of ranges: tasks' tables added in 64 bits and scaled, with the words' own index vectors."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, total in zip(batch.column("range").to_pylist(), batch.column("total"), strict=True):
            part = np.frombuffer(total.as_buffer(), np.int32)
            sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
    own = index_vectors() if sums else None
    rows = ROWS // RANGES
    for k, part in sums.items():
        v = _scaled(_scaled(part.reshape(rows, DIMS).astype(np.float64)) + own[k * rows : (k + 1) * rows] / np.sqrt(NONZERO))
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["range", "vectors"])


def _scaled(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v**2).sum(axis=1, keepdims=True)), 1e-6)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The table of word vectors over texts (text): summed contexts and the word's own index vector, scaled to length 1.

    Tasks' tables are added and scaled by range of rows in Spark, and the driver gets one table of ROWS x DIMS
    numbers, whatever the number of tasks. Contexts are whole numbers, so their order has no effect.
    """
    out = _scaled(index_vectors()).astype(np.float32).reshape(RANGES, -1)
    by_range = texts.mapInArrow(_contexts, "range int, total binary").repartition(RANGES, "range")
    got = by_range.mapInArrow(_added, "range int, vectors binary").toArrow()
    for k, v in zip(got.column("range").to_pylist(), got.column("vectors"), strict=True):
        out[k] = np.frombuffer(v.as_buffer(), np.float32)
    return out.reshape(ROWS, DIMS)


class Network:
    """Features scaled, one hidden layer of rectified units, a sigmoid whose temperature is fitted on rows kept from training."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.std
        order = rng.permutation(len(x))
        kept, rows = order[: len(x) // 5], order[len(x) // 5 :]
        w = [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        share = np.clip(y[rows].mean() if len(rows) else 0.5, 0.05, 0.95)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        for _ in range(EPOCHS):
            rng.shuffle(rows)
            for a in range(0, len(rows), BATCH):
                b = rows[a : a + BATCH]
                h = np.maximum(x[b] @ w[0] + w[1], 0)
                e = weight[b] * (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - y[b]) / len(b)
                back = (e[:, None] * w[2]) * (h > 0)
                grads, t = [x[b].T @ back, back.sum(axis=0), h.T @ e, np.array([e.sum()])], t + 1
                for k, g in enumerate(grads):
                    g = g + 1e-4 * w[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 2e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if len(kept):
            z, losses = self.logits(x[kept], scaled=True), []
            for temp in (grid := np.geomspace(0.25, 8, 41)):
                p = np.clip(1 / (1 + np.exp(-np.clip(z / temp, -40, 40))), 1e-6, 1 - 1e-6)
                losses.append(-(y[kept] * np.log(p) + (1 - y[kept]) * np.log(1 - p)).mean())
            self.temperature = float(grid[int(np.argmin(losses))])
        return self

    def logits(self, x: np.ndarray, scaled: bool = False) -> np.ndarray:
        x = x if scaled else (x - self.mean) / self.std
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast, Network]:
    """Word vectors from all documents, broadcast, and a network from labels (doc_id, quality) and their documents, SAMPLE of them at most.

    Rows without an id or a label of 0 or 1 are passed over; an id with both labels counts as 0, one with
    several texts by the least of them. The sample's ids are broadcast, SAMPLE rows at most, so only its texts are shuffled.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    table = docs.sparkSession.sparkContext.broadcast(word_vectors(docs.select(F.col("text").cast("string").alias("text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, offsets in chunks(batch.column("text"), PIECE):
                x = features(table.value, flat, offsets)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("quality").slice(first, len(x)).cast(pa.int32()), batch.column("doc_id").slice(first, len(x)).cast(pa.int64())], ["x", "y", "doc_id"])

    got = rows.mapInArrow(run, "x binary, y int, doc_id long").toArrow().sort_by("doc_id")  # SAMPLE rows at most
    if not got.num_rows:
        return table, Network().fit(np.zeros((2, FEATURES), np.float32), np.array([0.0, 1.0]))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    return table, Network().fit(x, got.column("y").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: tuple[Broadcast, Network], text_col: str = "text") -> DataFrame:
    """docs with a column `score` in [0, 1] (named _score where docs has one): higher where label 1 is likelier.

    Whole texts are scored, null and empty ones too; ids, labels, languages and sources are no inputs.
    """
    table, net = model
    name = split_column(docs, "score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [net.score(features(table.value, flat, offsets)) for _, flat, offsets in chunks(batch.column(at), PIECE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else np.empty(0), pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(docs_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(docs_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
