"""A document store and a vector index that follows it: search with documents, sync by snapshot or delta."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import store as ops
from lodestar.operators.index import InvertedFile, apply_delta, check_dimension, classify_delta, last_wins
from lodestar.operators.knn import hydrate, knn_join
from lodestar.sources.dump import export, load_docs
from lodestar.sources.versioned import ConcurrentWriteError, VersionedTable

#: Times that a change is made anew because another writer was faster.
TRIES = 5


class SearchStore:
    """Documents at `path`/data, snapshots at `path`/snapshot, the index at `path`/index; writes reach searches at sync().

    With `model`, the path that train() keeps a trained index at, it is loaded at the start if it is there."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine", shard_id: int = 0, total_shards: int = 1, model: str | None = None):
        self.spark, self.metric, self.shard_id, self.total_shards = spark, metric, shard_id, total_shards
        self.data, self.snapshots, self.index_table = (VersionedTable(spark, f"{path}/{x}", "doc_id") for x in ("data", "snapshot", "index"))
        for t in (self.data, self.snapshots, self.index_table):
            t.check_schema()
        self.trained = self.load(model) if model and self._there(model) else None

    def _there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p))

    def _rows(self) -> DataFrame:
        return self.data.read()

    def _write(self, rows: DataFrame) -> None:
        self.data.write(rows, partition_by="shard")
        self.data.vacuum(keep=2)

    def _again(self, step: Callable[[int], int]) -> None:
        """Runs a change made from the version that is current, anew if another writer commits meanwhile."""
        for turn in range(TRIES):
            try:
                step(max(self.data.versions(), default=0))
                break
            except ConcurrentWriteError:
                if turn + 1 == TRIES:
                    raise
        self.data.vacuum(keep=2)

    def _checked(self, docs: DataFrame) -> None:
        """ValueError if vectors of docs aren't as long as each other and as those that the store has."""
        if "embedding" in docs.columns:
            new = check_dimension(docs)
            old = self._rows().where("embedding is not null").select(F.size("embedding").alias("n")).first() if self.data.versions() else None
            if None not in (new, old) and new != old["n"]:
                raise ValueError(f"the store has vectors of {old['n']} components, not {new}")

    def index(self, docs: DataFrame, on_conflict: str = "abort", now: datetime | None = None, order: str | None = None) -> None:
        """Adds docs (doc_id, embedding, ...). What the store has already isn't rewritten, whatever the conflicts."""
        new = ops.as_rows(docs, now=now)
        self._checked(docs)

        def step(base: int) -> int:
            if not base:
                empty = new.drop(*([order] if order else [])).limit(0)
                return self.data.write(ops.add(empty, new, on_conflict, order), "shard", base)
            rows = self.data.read(base)
            if on_conflict == "replace":
                return self.data.change(ops.one_each(new, order).select(*rows.columns), partition_by="shard", base=base)
            return self.data.append(ops.additions(rows, new, on_conflict, order), "shard", base)

        self._again(step)

    def update(self, docs: DataFrame, on_missing: str = "ignore", now: datetime | None = None) -> None:
        """Puts the columns of docs into the rows of their ids, which alone are written."""
        self._checked(docs)

        def step(base: int) -> int:
            rows = self.data.read(base)
            return self.data.change(ops.update(ops.existing(rows, docs), docs, on_missing, now), partition_by="shard", base=base)

        self._again(step)

    def delete(self, ids: DataFrame, soft: bool = True, now: datetime | None = None) -> None:
        """Marks the rows of ids deleted, or removes them: writes those rows, or their ids."""

        def step(base: int) -> int:
            if not soft:
                return self.data.change(gone=ids, base=base)
            return self.data.change(ops.soft_delete(ops.existing(self.data.read(base), ids), ids, now), partition_by="shard", base=base)

        self._again(step)

    def prune(self) -> None:
        self._again(lambda base: self.data.change(gone=self.data.read(base).where("is_deleted"), base=base))

    def clear(self) -> None:
        self._write(ops.clear(self._rows()))

    def compact(self) -> None:
        """Rewrites the live rows into one folder; changes do so themselves when many have gathered."""
        self._again(lambda base: self.data.compact("shard"))

    def lookup(self, queries: DataFrame, with_embedding: bool = True) -> DataFrame:
        return ops.lookup(queries, self._rows(), with_embedding)

    def snapshot(self) -> int:
        """Copies the store's rows, deleted ones too, under a version that later writes leave alone."""
        n = self.snapshots.write(self._rows(), partition_by="shard")
        self.snapshots.vacuum(keep=2)
        return n

    def dump(self, path: str, shards: int, include_docs: bool = True) -> None:
        export(self._rows(), path, shards, include_docs)

    def restore(self, path: str, now: datetime | None = None) -> None:
        """Replaces the store by a dump: what a rolling update does with each replica."""
        self._write(ops.as_rows(load_docs(self.spark, path), now=now))

    def _last(self) -> datetime | None:
        return self.index_table.read().agg(F.max("updated_at")).first()[0] if self.index_table.versions() else None

    def sync(self, only_delta: bool | None = None, use_delta: bool = False, timestamp: datetime | None = None) -> int:
        """Brings this shard's index up to date and returns its version.

        Without a snapshot, or if only_delta: rows changed after `timestamp`, or after the index's latest change, are
        applied; a first sync takes the live rows. Otherwise the index is rebuilt from the latest snapshot's live rows,
        followed with use_delta by the rows changed since.
        """
        only_delta = not self.snapshots.versions() if only_delta is None else only_delta
        cols = ("doc_id", "embedding", "updated_at")
        table, base = self.index_table, max(self.index_table.versions(), default=0)
        if only_delta:
            since = timestamp or self._last()
            if since is None or not base:
                built = ops.of_shard(ops.prune(self._rows()), self.shard_id, self.total_shards).where("embedding is not null").select(*cols)
                if since is not None:
                    built = built.where(F.col("updated_at") > F.lit(since))
                n = table.write(built, base=base)
            else:
                # only what changed is written: one row at most for each id since
                delta = classify_delta(table.read(base), last_wins(ops.delta_since(self._rows(), since, self.shard_id, self.total_shards), "doc_id", "updated_at"), "doc_id")
                new = delta.where("action in ('add', 'replace')").select(*cols)
                self._same(table.read(base), new)
                n = table.change(new, delta.where("action = 'remove'"), base=base)
        else:
            shot = ops.of_shard(self.snapshots.read(), self.shard_id, self.total_shards)
            built = ops.prune(shot).where("embedding is not null").select(*cols)
            if use_delta:
                latest = shot.agg(F.max("updated_at")).first()[0]
                if latest is not None:
                    built = apply_delta(built, ops.delta_since(self._rows(), latest, self.shard_id, self.total_shards), "doc_id")
            if base:
                self._same(table.read(base), built)
            n = table.write(built, base=base)
        table.vacuum(keep=2)
        return n

    @staticmethod
    def _same(index: DataFrame, new: DataFrame) -> None:
        """ValueError unless new vectors are as long as those of the index; of the index one is looked at, as all are alike."""
        old, size = index.where("embedding is not null").select(F.size("embedding").alias("n")).first(), check_dimension(new)
        if None not in (old, size) and old["n"] != size:
            raise ValueError(f"the index has vectors of {old['n']} components, not {size}")

    def train(self, path: str, cells: int = 16, nprobe: int = 4, force: bool = False, **options) -> InvertedFile:
        """Fits an inverted file on the live rows' vectors and keeps it at `path`. Shard 0 trains for all; ValueError on another, and where a model is there already, unless forced."""
        if self.shard_id:
            raise ValueError(f"shard 0 trains, not shard {self.shard_id}")
        if not force and self._there(path):
            raise ValueError(f"there is a model at {path}; force replaces it")
        trained = InvertedFile(self.metric, cells, nprobe, **options).train(ops.prune(self._rows()).where("embedding is not null"), "doc_id")
        trained.save(self.spark, path)
        self.trained = trained
        return trained

    def load(self, path: str) -> InvertedFile:
        """An inverted file kept by train(); ValueError if its metric isn't the store's."""
        trained = InvertedFile.load(self.spark, path)
        if trained.metric != self.metric:
            raise ValueError(f"the model at {path} is for {trained.metric}, not {self.metric}")
        return trained

    def search_trained(self, queries: DataFrame, k: int, trained: InvertedFile | None = None, is_distance: bool = True) -> DataFrame:
        """As search() without documents, in the cells of an inverted file, by default the one trained or loaded at the start."""
        trained = trained or self.trained
        if trained is None:
            raise ValueError("train() or load() comes first")
        return trained.search(queries, trained.lists(self.index_table.read(), "doc_id"), k, is_distance)

    def search(self, queries: DataFrame, k: int, is_distance: bool = True, with_docs: bool = True, with_embedding: bool = False) -> DataFrame:
        """The k nearest indexed rows of each query (id, embedding), with their live documents from the store."""
        index = self.index_table.read().withColumnRenamed("doc_id", "id")
        found = knn_join(queries, index, k, self.metric, is_distance)
        if not with_docs:
            return found
        live = ops.prune(self._rows())
        cols = [c for c in live.columns if c not in ("doc_id", *ops.BOOKKEEPING) and (with_embedding or c != "embedding")]
        return hydrate(found, live, columns=cols)

    def status(self) -> DataFrame:
        """total_docs in the store, active_docs in the index."""
        active = self.index_table.read().count() if self.index_table.versions() else 0
        return ops.status(self._rows()).select("total_docs", F.lit(active).cast("long").alias("active_docs"), "last_updated")
