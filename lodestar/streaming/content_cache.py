"""The content cache as state of a stream: documents are indexed, updated and deleted, and only first contents come out.

Two stateful steps follow each other in one query. By id the state is the content that the id has; an update or deletion
becomes a release of the old content and, for an update, the taking of the new one. By content the state is who owns it;
the first claim of a content that nobody owns passes. Both go by the order of events, so the result is that of one cache
that sees all events in turn, however they fall into micro-batches and keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.functions.hashing import content_hash

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPS = ("index", "update", "delete")
_STEPS = "hash string, step string, id string, ord long"
OUT = "id string, ord long, hash string, step string, kept boolean"


class _Ids(StatefulProcessor):
    """The content of each id. Events of ids that the cache doesn't have do nothing unless they index."""

    def __init__(self, expires_ms: int | None):
        self.expires_ms = expires_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.content = handle.getValueState("content", "hash string", self.expires_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (doc,) = key
        known = self.content.get()
        before = now = known[0] if known else None
        out = []
        events = pd.concat(list(rows)).sort_values("ord", kind="stable")  # one id's events of one batch
        for op, new, at in zip(events["op"], events["hash"], events["ord"], strict=True):
            if op == "index":
                out.append((new, "claim", doc, at))
                now = new
            elif now is not None:
                out.append((now, "release", doc, at))
                if op == "update":
                    out.append((new, "own", doc, at))
                now = new if op == "update" else None
        if now is None and before is not None:
            self.content.clear()
        elif now is not None and (now != before or self.expires_ms):
            self.content.update((now,))
        yield pd.DataFrame(out, columns=["hash", "step", "id", "ord"])

    def close(self) -> None:
        pass


class _Contents(StatefulProcessor):
    """The owner of each content: its first claimer, or the last id that was updated to it, until it is released."""

    def __init__(self, expires_ms: int | None):
        self.expires_ms = expires_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "id string", self.expires_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.owner.get()
        before = owner = known[0] if known else None
        # one content's events of one batch; an update that keeps its content releases it, then takes it
        events = pd.concat(list(rows))
        events["turn"] = (events["step"] != "release").astype(int)
        events = events.sort_values(["ord", "turn"], kind="stable")
        kept = []
        for step, doc in zip(events["step"], events["id"], strict=True):
            kept.append(step == "claim" and owner is None)
            if step == "release":
                owner = None
            elif step == "own" or owner is None:
                owner = doc
        if owner is None and before is not None:
            self.owner.clear()
        elif owner is not None and (owner != before or self.expires_ms):
            self.owner.update((owner,))
        yield pd.DataFrame({"id": events["id"], "ord": events["ord"], "hash": key[0], "step": events["step"], "kept": kept})

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store that keyed state needs, where none is set."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(name):
        spark.conf.set(name, PROVIDER)


def cached(events: DataFrame, fields: tuple[str, ...], expires_ms: int | None = None) -> DataFrame:
    """A stream (id, ord, hash, step, kept) from a stream of events (op, id, ord, fields...), op one of index, update and delete.

    `kept` marks index events whose content nobody owned: their documents go on, others' are repeats. Steps claim,
    own and release say what happened to a content. `ord` is the order of events and must not repeat; a batch's events come after
    those of batches before it. Unknown ids are not updated or deleted; an update releases the id's old content whoever owned it;
    missing fields count as empty. Events without id, order or a known op are left out. With
    expires_ms, what isn't touched for so long is forgotten. State survives restarts from the query's checkpoint.

    A task holds the events of one id, and of one content, in one micro-batch: a source's rate bounds them.
    """
    use_state_store(events.sparkSession)
    mode = "ProcessingTime" if expires_ms else "None"
    rows = events.where(F.col("op").isin(*OPS) & F.col("id").isNotNull() & F.col("ord").isNotNull())
    rows = rows.select(F.col("id").cast("string").alias("id"), F.col("ord").cast("long").alias("ord"), "op", content_hash(*fields).alias("hash"))
    steps = rows.groupBy("id").transformWithStateInPandas(_Ids(expires_ms), _STEPS, "Append", mode)
    return steps.groupBy("hash").transformWithStateInPandas(_Contents(expires_ms), OUT, "Append", mode)
