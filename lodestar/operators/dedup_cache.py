"""Content cache: which documents are the first with their content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.hashing import content_hash


def first_wins(docs: DataFrame, fields: tuple[str, ...], order: str, cache: DataFrame | None = None) -> DataFrame:
    """The documents whose content is neither in cache (hash) nor earlier in docs by `order`.

    The least order of each hash is a partial aggregate; documents meet it in a join on the hash and the order, so
    copies of one content are spread over tasks by their order. Rows with equal order and content all stay.
    """
    rows = docs.withColumn("_hash", content_hash(*fields))
    if cache is not None:
        rows = rows.join(cache.select(F.col("hash").alias("_hash")), "_hash", "left_anti")
    first = rows.groupBy("_hash").agg(F.min(order).alias(order))
    return rows.join(first, ["_hash", order], "left_semi").drop("_hash")


def entries(docs: DataFrame, fields: tuple[str, ...], id_col: str = "id", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """What indexing docs into an empty cache leaves: (id, hash) of every document, and (hash, id) of each content's first."""
    rows = docs.select(F.col(id_col).alias("id"), content_hash(*fields).alias("hash"), F.col(order).alias("ord"))
    ids = rows.groupBy("id").agg(F.max_by("hash", "ord").alias("hash"))
    hashes = rows.groupBy("hash").agg(F.min_by("id", "ord").alias("id"))
    return ids, hashes


def counts(ids: DataFrame, hashes: DataFrame) -> DataFrame:
    """ids_count and hashes_count, distinct contents."""
    return ids.agg(F.count("*").alias("ids_count")).crossJoin(hashes.agg(F.count_distinct("hash").alias("hashes_count")))


def update(ids: DataFrame, hashes: DataFrame, docs: DataFrame, fields: tuple[str, ...], id_col: str = "id", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The cache after documents change content, unknown ids ignored.

    Each known id gets its new hash. The hashes that it and its earlier changes had leave the cache, whoever owned
    them, and its last one is owned by the last id that took it; as one batch: removals of old hashes come first.
    """
    rows = docs.select(F.col(id_col).alias("id"), content_hash(*fields).alias("new"), F.col(order).alias("ord")).join(ids.select("id"), "id", "left_semi")
    last = rows.groupBy("id").agg(F.max_by("new", "ord").alias("new"), F.max("ord").alias("ord"))
    new_ids = ids.join(last, "id", "left").select("id", F.coalesce("new", "hash").alias("hash"))
    old = ids.join(last.select("id"), "id", "left_semi").select("hash").unionByName(rows.select(F.col("new").alias("hash"))).distinct()
    owners = last.groupBy(F.col("new").alias("hash")).agg(F.max_by("id", "ord").alias("id"))
    return new_ids, hashes.join(old, "hash", "left_anti").unionByName(owners.select(*hashes.columns))


def delete(ids: DataFrame, hashes: DataFrame, gone: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The cache without the ids in gone and the hashes that they had; unknown ids are ignored."""
    out = gone.select(F.col(id_col).alias("id")).distinct()
    lost = ids.join(out, "id", "left_semi").select("hash").distinct()
    return ids.join(out, "id", "left_anti"), hashes.join(lost, "hash", "left_anti")
