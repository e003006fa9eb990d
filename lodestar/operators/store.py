"""Keyed document tables: (doc_id, embedding, doc columns, shard, created_at, updated_at, is_deleted), DataFrame in, DataFrame out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.hashing import VIRTUAL_SHARDS, shard_bounds, virtual_shard

CONFLICTS = ("abort", "ignore", "replace", "error")
BOOKKEEPING = ("shard", "created_at", "updated_at", "is_deleted")


class DuplicateIdError(ValueError):
    """A new row has an id that the store has already."""


def _now(now: datetime | Column | None) -> Column:
    return now if isinstance(now, Column) else F.current_timestamp() if now is None else F.lit(now)


def as_rows(docs: DataFrame, virtual_shards: int = VIRTUAL_SHARDS, now: datetime | Column | None = None) -> DataFrame:
    """docs with the store's bookkeeping columns: a live row each, in the virtual shard of its id."""
    at = _now(now)
    return docs.withColumns({"shard": virtual_shard(F.col("doc_id"), virtual_shards), "created_at": at, "updated_at": at, "is_deleted": F.lit(False)})


def existing(docs: DataFrame, store: DataFrame) -> DataFrame:
    return docs.join(store.select("doc_id"), "doc_id", "left_semi")


def missing(docs: DataFrame, store: DataFrame) -> DataFrame:
    return docs.join(store.select("doc_id"), "doc_id", "left_anti")


def one_each(rows: DataFrame, order: str | None = None, last: bool = True, id_col: str = "doc_id") -> DataFrame:
    """One row for each id: the last or first by `order`, or any of them without one."""
    cols = [c for c in rows.columns if c != id_col]
    row = F.struct(*cols)
    pick = F.first(row) if order is None else F.max_by(row, order) if last else F.min_by(row, order)
    return rows.groupBy(id_col).agg(pick.alias("_r")).select(*[F.col(id_col) if c == id_col else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def add(store: DataFrame, new: DataFrame, on_conflict: str = "abort", order: str | None = None) -> DataFrame:
    """store with new rows. If ids are there already, or twice in the batch: abort adds none of the batch, ignore adds the
    other ids and of a repeated one its first row, replace puts the new rows in their place and of a repeated id the
    last, error raises DuplicateIdError. `order` is a column of new that says which row is first; without it any is."""
    if on_conflict not in CONFLICTS:
        raise ValueError(f"on_conflict must be one of {CONFLICTS}")
    if on_conflict == "replace":
        new = one_each(new, order).select(*store.columns)
        return store.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)
    return store.unionByName(additions(store, new, on_conflict, order))


def additions(store: DataFrame, new: DataFrame, on_conflict: str = "abort", order: str | None = None) -> DataFrame:
    """The rows that add() puts beside the store's own; replace isn't among its conflicts."""
    if on_conflict == "ignore":
        return missing(one_each(new, order, last=False), store).select(*store.columns)
    rows = new.select(*store.columns)
    if existing(new, store).isEmpty() and new.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    if on_conflict == "error":
        raise DuplicateIdError("some ids are in the store already, or twice in the batch")
    return rows.where(F.lit(False))


def update(store: DataFrame, changes: DataFrame, on_missing: str = "ignore", now: datetime | Column | None = None, order: str | None = None) -> DataFrame:
    """store with the columns of changes (doc_id, ...) put into the rows of those ids, which come alive again; shard and
    created_at stay. Ids that the store lacks are ignored or inserted. Of changes that repeat an id the last by `order`
    counts, or any of them without one."""
    changes = one_each(changes, order)
    cols = [c for c in changes.columns if c not in ("doc_id", *BOOKKEEPING) and c in store.columns]
    new = changes.select(F.col("doc_id").alias("_id"), F.struct(*cols).alias("_new"))
    hit = F.col("_id").isNotNull()
    out = store.join(new, F.col("doc_id") == F.col("_id"), "left")
    put = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in cols}
    put |= {"updated_at": F.when(hit, _now(now)).otherwise(F.col("updated_at")), "is_deleted": ~hit & F.col("is_deleted")}
    out = out.withColumns(put).select(*store.columns)
    return out.unionByName(as_rows(missing(changes.select("doc_id", *cols), store), now=now)) if on_missing == "insert" else out


def soft_delete(store: DataFrame, ids: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    gone = ids.select(F.col("doc_id").alias("_id")).distinct()
    hit = F.col("_id").isNotNull()
    out = store.join(gone, F.col("doc_id") == F.col("_id"), "left")
    return out.withColumns({"is_deleted": F.col("is_deleted") | hit, "updated_at": F.when(hit, _now(now)).otherwise(F.col("updated_at"))}).drop("_id")


def hard_delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("doc_id"), "doc_id", "left_anti")


def prune(store: DataFrame) -> DataFrame:
    return store.where(~F.col("is_deleted"))


def clear(store: DataFrame) -> DataFrame:
    return store.where(F.lit(False))


def lookup(queries: DataFrame, store: DataFrame, with_embedding: bool = True) -> DataFrame:
    """queries (doc_id, ...) with the live rows' columns; a query without a live row keeps its own values."""
    cols = [c for c in store.columns if c not in ("doc_id", *BOOKKEEPING) and (with_embedding or c != "embedding")]
    live = prune(store).select(F.col("doc_id").alias("_id"), F.struct(*cols).alias("_found"))
    out = queries.join(live, F.col("doc_id") == F.col("_id"), "left")
    found = F.col("_id").isNotNull()
    return out.withColumns({c: F.when(found, F.col(f"_found.{c}")).otherwise(F.col(c) if c in queries.columns else None) for c in cols}).drop("_id", "_found")


def scan(store: DataFrame, include_docs: bool = True, filter_deleted: bool = True, shards: list[int] | None = None, check_embedding: bool = False, limit: int = 0) -> DataFrame:
    """Rows for iteration, pruned to what is asked for; each predicate reaches the files below."""
    out = prune(store) if filter_deleted else store
    if shards is not None:
        out = out.where(F.col("shard").isin(shards))
    if check_embedding:
        out = out.where(F.col("embedding").isNotNull())
    out = out if include_docs else out.select("doc_id", "embedding", *[c for c in BOOKKEEPING if c in out.columns])
    return out.limit(limit) if limit > 0 else out


def of_shard(store: DataFrame, shard_id: int, total_shards: int, virtual_shards: int = VIRTUAL_SHARDS) -> DataFrame:
    first, end = shard_bounds(shard_id, total_shards, virtual_shards)
    return store.where(F.col("shard").between(first, end - 1))


def delta_since(store: DataFrame, timestamp: datetime | Column, shard_id: int = 0, total_shards: int = 1, filter_deleted: bool = False) -> DataFrame:
    """(doc_id, embedding, updated_at, is_deleted) of rows changed after timestamp, not at it."""
    out = of_shard(store, shard_id, total_shards).where(F.col("updated_at") > (timestamp if isinstance(timestamp, Column) else F.lit(timestamp)))
    return (prune(out) if filter_deleted else out).select("doc_id", "embedding", "updated_at", "is_deleted")


def status(store: DataFrame) -> DataFrame:
    """total_docs, live ones, and last_updated over all rows, deleted too."""
    return store.agg(F.sum((~F.col("is_deleted")).cast("long")).alias("total_docs"), F.count("*").alias("total_rows"), F.max("updated_at").alias("last_updated"))
