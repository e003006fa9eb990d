"""An index that follows a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lodestar.operators.index import last_wins
from lodestar.sources.versioned import VersionedTable


COLUMNS = ("id", "embedding", "updated_at", "is_deleted")


def follow(changes: DataFrame, index: VersionedTable) -> DataStreamWriter:
    """A writer that applies each micro-batch of changes (id, embedding, updated_at, is_deleted) to a log of an index's rows.

    A batch is appended to the log; a deleted id stays there with its time, so a late change from before the deletion
    doesn't bring it back, and a repeated batch changes nothing. live() has the index.
    """

    def apply(batch: DataFrame, number: int) -> None:
        index.append(last_wins(batch.select(*COLUMNS), "id", "updated_at"))

    return changes.writeStream.foreachBatch(apply)


def live(index: VersionedTable) -> DataFrame:
    """The rows (id, embedding, updated_at) of the latest change of each id, without those that it deleted."""
    return last_wins(index.read(), "id", "updated_at").where("not is_deleted and embedding is not null").select("id", "embedding", "updated_at")


def compact(index: VersionedTable) -> int:
    """Rewrites the log to the latest change of each id, deletions too: to be run between batches, when the log has grown."""
    return index.write(last_wins(index.read(), "id", "updated_at").select(*COLUMNS))
