"""Content digests and shard numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIRTUAL_SHARDS = 128


def content_hash(*fields: str) -> Column:
    """SHA-256 of 'field:value;' over the fields; a missing value counts as empty, so rows without any are all equal."""
    parts = [F.concat(F.lit(f"{f}:"), F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(";")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def virtual_shard(doc_id: Column, shards: int = VIRTUAL_SHARDS) -> Column:
    """SHA-256 of the id, taken as one number, modulo the number of virtual shards: folded 8 hex digits at a time."""
    digest = F.sha2(doc_id.cast("string"), 256)
    rest = F.lit(0).cast("long")
    for k in range(8):
        word = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        rest = (rest * (2**32 % shards) + word) % shards
    return rest.cast("int")


def shard_bounds(shard_id: int, total_shards: int, virtual_shards: int = VIRTUAL_SHARDS) -> tuple[int, int]:
    """The virtual shards [first, end) of a shard; the last takes the remainder."""
    if not 0 <= shard_id < total_shards:
        raise ValueError("shard_id must be in 0 .. total_shards - 1")
    each = virtual_shards // total_shards
    return shard_id * each, virtual_shards if shard_id == total_shards - 1 else (shard_id + 1) * each


def shard_of(virtual: Column, total_shards: int, virtual_shards: int = VIRTUAL_SHARDS) -> Column:
    each = max(1, virtual_shards // total_shards)
    return F.least(F.floor(virtual / each), F.lit(total_shards - 1)).cast("int")
