"""Deduplication of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodestar.functions.hashing import content_hash
from lodestar.operators.dedup_cache import first_wins
from lodestar.sources.versioned import VersionedTable


def drop_seen(stream: DataFrame, fields: tuple[str, ...], time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The rows whose content was not seen before; with a time column, within the delay, after which state is dropped."""
    rows = stream.withColumn("_hash", content_hash(*fields))
    if time_col:
        return rows.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")
    return rows.dropDuplicates(["_hash"]).drop("_hash")


def into_store(stream: DataFrame, table: VersionedTable, cache: VersionedTable, fields: tuple[str, ...], order: str) -> DataStreamWriter:
    """A writer that adds each micro-batch's first-seen contents to a table, and their hashes to a cache.

    Batches carry their number; one that is repeated after a failure is recognised by it and adds nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        known = cache.read() if cache.versions() else None
        if known is not None and not known.where(F.col("batch") == number).isEmpty():
            return
        new = first_wins(batch, fields, order, known.select("hash") if known is not None else None).persist()
        rows = new.withColumn("_batch", F.lit(number).cast("long"))
        if table.versions() and not table.read().where(F.col("_batch") == number).isEmpty():
            # the batch got as far as the table before: its rows are put there anew
            table.write(table.read().where(F.col("_batch") != number).unionByName(rows))
        else:
            table.append(rows)
        cache.append(new.select(content_hash(*fields).alias("hash"), F.lit(number).cast("long").alias("batch")))
        new.unpersist()

    return stream.writeStream.foreachBatch(add)
