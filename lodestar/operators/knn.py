"""Exact k-nearest-neighbour joins, merging of shards, and what follows a search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import as_doubles, check_metric, score_of

#: Vectors in a block of queries and in a block of the index: what a task multiplies at once.
QUERY_BLOCK, INDEX_BLOCK = 1024, 4096
#: Raw values are compared after rounding to so many places, so equal vectors tie whatever block they are in.
PLACES = 9


def _ids_and_matrix(ids: pa.Array, vectors: pa.Array) -> tuple[pa.Array, np.ndarray]:
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return ids, values.reshape(len(ids), -1)


def _packed(size: int):
    """Rows (id, vector) in blocks: (ids, dim, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def block(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ids, x = _ids_and_matrix(t.column(0).combine_chunks(), t.column(1).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.string())), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["ids", "dim", "values"])

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
            while sum(t.num_rows for t in held) >= size:
                rows = pa.concat_tables(held)
                yield block(rows.slice(0, size))
                held = [rows.slice(size)]
        if sum(t.num_rows for t in held):
            yield block(pa.concat_tables(held))

    return run


def raw_values(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """cos, inner product or squared distance of every pair; a zero vector has cos 0."""
    if metric == "cosine":
        length = lambda v: np.sqrt((v * v).sum(axis=1))
        scale = length(q)[:, None] * length(x)[None, :]
        return np.divide(q @ x.T, scale, out=np.zeros_like(scale), where=scale > 0)
    if metric == "inner_product":
        return q @ x.T
    return np.maximum(0.0, (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T))


def _best_of_tiles(k: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["q_dim"] != row["dim"]:
                    raise ValueError(f"query vectors have {row['q_dim']} components, index vectors {row['dim']}")
                q = np.frombuffer(row["q_values"]).reshape(-1, row["q_dim"])
                x = np.frombuffer(row["values"]).reshape(-1, row["dim"])
                raw = raw_values(q, x, metric)
                key = np.round(raw, PLACES) * (1 if metric == "euclidean" else -1)
                ids = row["ids"]
                n = min(k, len(ids))
                rows: list[tuple[str, str, float]] = []
                edge = np.partition(key, n - 1, axis=1)[:, n - 1]
                for i, query in enumerate(row["q_ids"]):
                    best = np.flatnonzero(key[i] <= edge[i])  # ties at the edge go on to the window
                    rows += [(query, ids[j], float(raw[i, j])) for j in best]
                if rows:
                    a, b, c = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.float64())], ["query_id", "match_id", "raw"])

    return run


def ranked(pairs: DataFrame, k: int | None, metric: str, ids: str = "string") -> DataFrame:
    """Adds rank, best first, ties by match_id, and keeps ranks up to k; pairs has query_id, match_id and raw."""
    by = F.round("raw", PLACES)
    pairs = pairs.withColumn("match_id", F.col("match_id").cast(ids))
    order = Window.partitionBy("query_id").orderBy(by.asc() if metric == "euclidean" else by.desc(), "match_id")
    out = pairs.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k is not None else out


def knn_join(queries: DataFrame, index: DataFrame, k: int, metric: str = "cosine", is_distance: bool = True, flavour: str = "squared", id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, match_id, rank, score, raw): for each query its k nearest rows of index, exactly.

    Both sides are packed into blocks of vectors, every block of queries meets every block of the index, and a task
    multiplies two blocks and keeps k of each query's matches (and ties with the last); a window then ranks the few
    that are left. Nothing is broadcast, and no task holds more than two blocks. Rows whose id or vector is null are
    left out; unequal dimensions raise ValueError. Ids come back in the index's type.
    """
    check_metric(metric, flavour)
    if k < 1:
        raise ValueError("k must be positive")
    kind = index.schema[id_col].dataType.simpleString()
    side = lambda df: df.select(F.col(id_col).cast("string").alias("id"), as_doubles(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
    q = side(queries).coalesce(1 + queries.sparkSession.sparkContext.defaultParallelism // 4).mapInArrow(_packed(QUERY_BLOCK), "q_ids array<string>, q_dim int, q_values binary".replace("q_", "")).toDF("q_ids", "q_dim", "q_values")
    x = side(index).mapInArrow(_packed(INDEX_BLOCK), "ids array<string>, dim int, values binary")
    pairs = x.crossJoin(q).mapInArrow(_best_of_tiles(k, metric), "query_id string, match_id string, raw double")
    out = ranked(pairs, k, metric, kind)
    return out.select(F.col("query_id").cast(queries.schema[id_col].dataType).alias("query_id"), "match_id", "rank", score_of(F.col("raw"), metric, is_distance, flavour).alias("score"), "raw")


def merge_shards(shards: list[DataFrame], k: int | None, metric: str = "cosine") -> DataFrame:
    """The best k of all shards' matches for each query, best first; all of them if k is None."""
    union = shards[0]
    for s in shards[1:]:
        union = union.unionByName(s)
    kind = union.schema["match_id"].dataType.simpleString()
    return ranked(union.drop("rank"), k, metric, kind).select("query_id", "match_id", "rank", "score", "raw")


def hydrate(matches: DataFrame, store: DataFrame, key: str = "match_id", store_key: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """matches with the store's columns for each; a match that the store lacks stays, with nulls."""
    cols = columns or [c for c in store.columns if c != store_key]
    right = store.select(F.col(store_key).alias("_store_key"), *cols)
    return matches.join(right, F.col(key) == F.col("_store_key"), "left").drop("_store_key")


def fill_embedding(docs: DataFrame, index: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """docs with the index's vector by id, null where it has none."""
    right = index.select(F.col(id_col).alias("_index_id"), F.col(vector_col).alias("_vector"))
    return docs.drop(vector_col).join(right, F.col(id_col) == F.col("_index_id"), "left").withColumnRenamed("_vector", vector_col).drop("_index_id")
