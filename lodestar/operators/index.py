"""Vector index tables: upserts, deletes, deltas, status, and inverted files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.vectors import as_doubles, check_metric, normalized, score_of
from lodestar.operators.knn import knn_join, ranked, raw_values
from lodestar.operators.store import one_each

#: Vectors of one list that a search task holds, and queries it meets them with.
LIST_BLOCK, PROBE_BLOCK = 8192, 4096


def check_dimension(vectors: DataFrame, vector_col: str = "embedding") -> int | None:
    """The dimension that all vectors share, None if there are none; otherwise ValueError."""
    row = vectors.where(F.col(vector_col).isNotNull()).agg(F.min(F.size(vector_col)).alias("low"), F.max(F.size(vector_col)).alias("high")).first()
    if row["low"] != row["high"]:
        raise ValueError(f"vectors have {row['low']} to {row['high']} components")
    return row["low"]


def last_wins(rows: DataFrame, id_col: str = "id", order: str = "ord") -> DataFrame:
    """Of rows with one id the one with the greatest order; of equal ones a deletion, then the greatest by the other columns, so that reruns agree."""
    cols = [c for c in rows.columns if c != id_col]
    first = [F.col("is_deleted")] if "is_deleted" in cols else []
    sorts = lambda c: F.to_json(F.struct(c)) if "map<" in rows.schema[c].dataType.simpleString() else F.col(c)  # maps have no order
    settled = F.struct(F.col(order), *first, *[sorts(c).alias(f"_{k}") for k, c in enumerate(cols) if c not in (order, "is_deleted")])
    return rows.groupBy(id_col).agg(F.max_by(F.struct(*cols), settled).alias("_r")).select(id_col, *[F.col(f"_r.{c}").alias(c) for c in cols])


def check_same_dimension(index: DataFrame, new: DataFrame, vector_col: str = "embedding") -> None:
    """ValueError unless the vectors of both have one dimension."""
    a, b = check_dimension(index, vector_col), check_dimension(new, vector_col)
    if None not in (a, b) and a != b:
        raise ValueError(f"the index has vectors of {a} components, not {b}")


def upsert(index: DataFrame, new: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """index with new's rows in place of those with the same ids; of rows of new that repeat an id the last by `order`, or any."""
    new = one_each(new, order, id_col=id_col).select(*index.columns)
    return index.join(new.select(id_col), id_col, "left_anti").unionByName(new)


def update_known(index: DataFrame, new: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """As upsert, but ids that the index lacks are ignored."""
    return upsert(index, new.join(index.select(id_col), id_col, "left_semi"), id_col, order)


def mark_deleted(index: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """is_deleted set for ids, unknown ones ignored."""
    gone = ids.select(F.col(id_col).alias("_gone")).distinct()
    return index.join(gone, F.col(id_col) == F.col("_gone"), "left").withColumn("is_deleted", F.col("is_deleted") | F.col("_gone").isNotNull()).drop("_gone")


def status(index: DataFrame) -> DataFrame:
    """count_active, count_indexed, count_deleted."""
    return index.agg(F.sum((~F.col("is_deleted")).cast("long")).alias("count_active"), F.count("*").alias("count_indexed"), F.sum(F.col("is_deleted").cast("long")).alias("count_deleted"))


def classify_delta(index: DataFrame, delta: DataFrame, id_col: str = "id") -> DataFrame:
    """delta with `action`: add, replace, remove or skip.

    New, live and with a vector: add. Known and live: replace. Known and deleted or without a vector: remove. Else skip.
    """
    known = index.select(F.col(id_col).alias("_known")).distinct()
    gone = F.col("is_deleted") | F.col("embedding").isNull()
    action = F.when(F.col("_known").isNotNull(), F.when(gone, "remove").otherwise("replace")).when(gone, "skip").otherwise("add")
    return delta.join(known, F.col(id_col) == F.col("_known"), "left").withColumn("action", action).drop("_known")


def apply_delta(index: DataFrame, delta: DataFrame, id_col: str = "id") -> DataFrame:
    """index (id, embedding, updated_at) after delta (id, embedding, updated_at, is_deleted), the latest row of each id."""
    latest = classify_delta(index, last_wins(delta, id_col, "updated_at"), id_col)
    touched = latest.where("action in ('add', 'replace', 'remove')").select(id_col)
    new = latest.where("action in ('add', 'replace')").select(*index.columns)
    return index.join(touched, id_col, "left_anti").unionByName(new)


class InvertedFile:
    """K-means cells over an index; a search looks into each query's nearest cells.

    All rows are in the index; the cells are fitted on at most `sample` rows, drawn by a hash of the id. A search is
    exact within the cells it probes, and over all cells it equals knn_join.
    """

    def __init__(self, metric: str = "cosine", cells: int = 16, nprobe: int = 4, sample: int = 100_000, seed: int = 1):
        check_metric(metric)
        self.metric, self.cells, self.nprobe, self.sample, self.seed = metric, cells, nprobe, sample, seed
        self.fitted: np.ndarray | None = None

    def _placed(self, v):
        return normalized(v) if self.metric == "cosine" else v

    def train(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> InvertedFile:
        rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(self.sample)
        rows = rows.select(array_to_vector(self._placed(as_doubles(F.col(vector_col)))).alias("features"))
        self.fitted = np.array(KMeans(k=self.cells, seed=self.seed, maxIter=20).fit(rows).clusterCenters())
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        """Keeps the centers and settings at `path`, with a checksum of the centers."""
        cells = [(int(k), c.tolist()) for k, c in enumerate(self.centers())]
        rows = spark.createDataFrame(cells, "cell int, center array<double>").coalesce(1)
        rows.withColumns({"metric": F.lit(self.metric), "nprobe": F.lit(self.nprobe), "sha256": F.lit(self._checksum())}).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedFile:
        """What save() kept; ValueError if the centers aren't those it kept."""
        rows = spark.read.parquet(path).orderBy("cell").collect()  # one row a cell
        out = cls(rows[0]["metric"], len(rows), rows[0]["nprobe"])
        out.fitted = np.array([r["center"] for r in rows])
        if out._checksum() != rows[0]["sha256"]:
            raise ValueError(f"the model at {path} is damaged")
        return out

    def _checksum(self) -> str:
        return hashlib.sha256(np.ascontiguousarray(self.centers()).tobytes()).hexdigest()

    def centers(self) -> np.ndarray:
        if self.fitted is None:
            raise ValueError("train() or load() comes first")
        return self.fitted

    def _near(self, rows: DataFrame, n: int, id_col: str, vector_col: str) -> DataFrame:
        centers, cosine = self.centers(), self.metric == "cosine"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                if cosine:
                    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
                cells = np.argsort(raw_values(x, centers, "euclidean"), axis=1, kind="stable")[:, :n]
                take = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cells.ravel().astype(np.int32))], ["id", "v", "cell"])

        side = rows.select(F.col(id_col).cast("string").alias("id"), as_doubles(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
        return side.mapInArrow(run, "id string, v array<double>, cell int")

    def lists(self, index: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
        """(id, v, cell): every row of the index in its cell."""
        return self._near(index, 1, id_col, vector_col)

    def search(self, queries: DataFrame, lists: DataFrame, k: int, is_distance: bool = True, nprobe: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, match_id, rank, score, raw) of the best k in each query's nprobe cells.

        Large cells and many queries are cut into blocks, so a task holds LIST_BLOCK rows and PROBE_BLOCK queries.
        """
        probes = self._near(queries, min(nprobe or self.nprobe, self.cells), id_col, vector_col)
        parts = lambda df, size: df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
        lp, pp = parts(lists, LIST_BLOCK).withColumnRenamed("parts", "lparts"), parts(probes, PROBE_BLOCK).withColumnRenamed("parts", "pparts")
        both = lp.join(pp, "cell")
        spread = lambda df, own, other: df.join(both, "cell").withColumn(own[0], F.pmod(F.xxhash64("id"), F.col(own[1])).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)))
        left = spread(lists, ("l", "lparts"), ("p", "pparts")).select("cell", "l", "p", "id", "v")
        right = spread(probes, ("p", "pparts"), ("l", "lparts")).select("cell", "l", "p", "id", "v")
        metric = self.metric

        def best(x: pa.Table, q: pa.Table) -> pa.Table:
            out: list[tuple[str, str, float]] = []
            if x.num_rows and q.num_rows:
                mat = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
                raw = raw_values(mat(q), mat(x), metric)
                key = np.round(raw, 9) * (1 if metric == "euclidean" else -1)
                n = min(k, x.num_rows)
                edge = np.partition(key, n - 1, axis=1)[:, n - 1]
                xi, qi = x.column("id").to_pylist(), q.column("id").to_pylist()
                for i in range(len(qi)):
                    out += [(qi[i], xi[j], float(raw[i, j])) for j in np.flatnonzero(key[i] <= edge[i])]
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            return pa.table({"query_id": pa.array(a, pa.string()), "match_id": pa.array(b, pa.string()), "raw": pa.array(c, pa.float64())})

        keys = ["cell", "l", "p"]
        pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id string, match_id string, raw double")
        out = ranked(pairs, k, self.metric)
        return out.select("query_id", "match_id", "rank", score_of(F.col("raw"), self.metric, is_distance).alias("score"), "raw")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact matches (query_id, match_id) that found has."""
    as_text = lambda df: df.select(F.col("query_id").cast("string").alias("query_id"), F.col("match_id").cast("string").alias("match_id"))
    return as_text(exact).join(as_text(found), ["query_id", "match_id"], "left_semi").count() / max(1, exact.count())


def search_live(queries: DataFrame, index: DataFrame, k: int, **options) -> DataFrame:
    """knn_join over rows that aren't deleted: the filter comes before the search, so k matches come back if there are k."""
    return knn_join(queries, index.where(~F.col("is_deleted")), k, **options)


__all__ = ["InvertedFile", "apply_delta", "check_dimension", "check_same_dimension", "classify_delta", "last_wins", "mark_deleted", "recall", "search_live", "status", "update_known", "upsert"]
