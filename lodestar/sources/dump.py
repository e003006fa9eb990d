"""Sharded dumps of live rows, for rebuilding searchers and stores elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.hashing import shard_of
from lodestar.operators.store import BOOKKEEPING, prune


def by_position(rows: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """rows with `dump_shard`: equal slices in order of the id, the last with the remainder.

    Positions come from the sizes of id ranges and ranks within a range; no window spans all rows.
    """
    n = max(4, rows.sparkSession.sparkContext.defaultParallelism)
    cuts = rows.select(F.percentile_approx(F.xxhash64(id_col), [k / n for k in range(1, n)])).first()[0] or []
    part = sum((F.xxhash64(F.col(id_col)) > c).cast("int") for c in cuts) if cuts else F.lit(0)
    placed = rows.withColumn("_part", part)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(F.xxhash64(id_col), id_col)) - 1)
    at = F.col("_before") + F.col("_rank")
    each = F.greatest(F.lit(1), F.floor(F.col("_all") / shards))
    return ranked.join(F.broadcast(before), "_part").withColumn("dump_shard", F.least(F.floor(at / each), F.lit(shards - 1)).cast("int")).drop("_part", "_n", "_before", "_all", "_rank")


def export(store: DataFrame, path: str, shards: int, include_docs: bool = True, by: Column | None = None) -> None:
    """Writes the live rows under `path`, one folder dump_shard=N for each shard; by their virtual shard unless `by` is given."""
    if shards is None or shards < 1:
        raise ValueError("shards must be a positive number")
    rows = prune(store) if "is_deleted" in store.columns else store
    target = by if by is not None else shard_of(F.col("shard"), shards)
    cols = [c for c in rows.columns if c not in BOOKKEEPING] if include_docs else ["doc_id", "embedding"]
    rows.withColumn("dump_shard", target).select(*cols, "dump_shard").repartition("dump_shard").write.partitionBy("dump_shard").mode("overwrite").parquet(path)


def dump_rows(store: DataFrame) -> DataFrame:
    """(doc_id, embedding, doc) of the live rows: doc is a struct of what else the document has."""
    rows = prune(store) if "is_deleted" in store.columns else store
    rest = [c for c in rows.columns if c not in ("doc_id", "embedding", *BOOKKEEPING)]
    return rows.select("doc_id", "embedding", F.struct(*rest).alias("doc"))


def load_vectors(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    """(doc_id, embedding) of a dump; other columns and other shards are never read."""
    rows = spark.read.parquet(path)
    return (rows.where(F.col("dump_shard") == shard) if shard is not None else rows).select("doc_id", "embedding")


def load_docs(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return (rows.where(F.col("dump_shard") == shard) if shard is not None else rows).drop("dump_shard")
