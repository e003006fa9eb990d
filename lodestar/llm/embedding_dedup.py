"""Near-duplicate vectors: p-stable hashing into buckets, then exact cosines within buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.graph import components, star_forest
from lodestar.llm.streams import groups
from lodestar.llm.tables import Saved

#: A pair at cosine 0.98 (distance 0.2) shares one of 20 tables of 8 projections cut at width 1.2 with probability 0.9996.
TABLES, PROJECTIONS, WIDTH = 20, 8, 1.2
THRESHOLD = 0.98
#: Rows of one side of a tile: what a task holds of a bucket, however large the bucket is.
BLOCK = 2048


def bucket_ids(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit bucket for each vector and table: the quantised projections on Gaussian directions, mixed."""
    rng = np.random.default_rng(seed)
    lines = rng.standard_normal((unit.shape[1], tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    cells = np.floor((unit @ lines + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, projections)
    h = np.full((len(unit), tables), unit.shape[1], np.uint64)  # vectors of another length are in other buckets, cells of zeros too
    for k in range(projections):
        h = (h ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision at length 1, scaled by the largest component first, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(tables: int, projections: int, width: float, seed: int):
    """The vectors as bytes of the type they came in, and their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {}
            for i, v in enumerate(batch.column("vector").to_pylist()):
                rows.setdefault(len(v), []).append(i)
            for dim, idx in rows.items():  # vectors of unlike length never link
                part = batch.take(pa.array(idx))
                column = part.column("vector")
                x = column.flatten().to_numpy().reshape(len(idx), dim)
                h = bucket_ids(unit(x), tables, projections, width, seed + dim)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("label", "digest", "cid", "copies")), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(h), pa.list_(pa.int64()))],
                    ["label", "digest", "cid", "copies", "raw", "buckets"],
                )

    return run


def _tile_links(threshold: float, kind: type):
    """Of every tile: how many rows each class links with by pairs first met in this table, and links that join what is linked. `earlier` has the buckets of the tables before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in groups(batches, ["tile", "bucket", "label", "i", "j"]):
            own = tile.column("own").to_numpy()
            i, j = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
            key, copies = tile.column("key").to_numpy(), tile.column("copies").to_numpy()
            raw = tile.column("raw").to_pylist()
            x = unit(np.frombuffer(b"".join(raw), kind).reshape(len(key), -1))
            earlier = tile.column("earlier").combine_chunks().flatten().to_numpy().reshape(len(key), -1).T
            left = np.flatnonzero(own == i)
            right = left if i == j else np.flatnonzero(own == j)
            links, a, b = np.zeros(len(key), np.int64), [], []
            for s in range(0, len(left), 256):
                rows = left[s : s + 256]
                found = x[rows] @ x[right].T >= threshold
                if i == j:
                    found &= right[None, :] > rows[:, None]
                for e in earlier:  # a pair counts in the first table in which it meets
                    if not found.any():
                        break
                    found &= e[rows][:, None] != e[right][None, :]
                if not found.any():
                    continue
                links[rows] += found @ copies[right]
                np.add.at(links, right, copies[rows] @ found)
                # a right row joins the first left row it links with, and each left row joins the first ones of all its right rows
                top = found.argmax(axis=0)
                col = np.flatnonzero(found.any(axis=0))
                a += [key[right[col]]]
                b += [key[rows[top[col]]]]
                shared = np.zeros((len(rows), len(rows)), bool)
                r, c = np.nonzero(found)
                shared[r, top[c]] = True
                r, c = np.nonzero(shared)
                a += [key[rows[r]]]
                b += [key[rows[c]]]
                a, b = _fewer(a, b)
            some = np.flatnonzero(links)
            a, b = star_forest(np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2
            if len(some) or len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([key[some], a])), pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])), pa.array(np.concatenate([np.full(len(some), -1), b]), pa.int64(), mask=np.arange(len(some) + len(a)) < len(some))],
                    ["key", "links", "to"],
                )

    return run


def _fewer(a: list, b: list) -> tuple[list, list]:
    if sum(map(len, a)) < 65536:
        return a, b
    x, y = star_forest(np.concatenate(a), np.concatenate(b))
    return [x], [y]


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = 7
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row.

    Rows link when their labels are equal and not null, their vectors equally long and their cosine, in double
    precision, is at least `threshold`. A vector that is null, empty, all zero or holds a null or a non-finite
    component links with nothing and is kept; so is one without a label. Equal vectors of a label are one class with
    a count, so copies cost nothing. Rows that repeat an id are vectors of their own, each with its own links; a null
    id is no component's least, and such a row is kept only if no row with an id is reached from it.

    Each class goes into `tables` buckets, on ids alone. Buckets with one class end there, and so do those that hold
    just what a bucket of an earlier table holds. The vectors of the others, in the type they came in, meet in tiles of at most
    BLOCK x BLOCK classes, so no task holds a whole bucket. A pair counts in the first table where it meets; a tile
    returns counts and a forest of links, never pairs.
    """
    spark = vectors.sparkSession
    saved = Saved(spark)
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind, name = (np.float32, "float") if single else (np.float64, "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{name}>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    finite = f"label is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < {name}('infinity')) and exists(vector, x -> x <> 0)"
    # one digest stands for a vector in all that follows
    rows = rows.withColumn("digest", F.when(F.expr(finite), F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0.0).cast(name)).cast("string"))), 256)))
    classes = rows.where("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    hashed = classes.mapInArrow(_hashed(tables, projections, width, seed), "label string, digest string, cid long, copies long, raw binary, buckets array<long>")
    hashed = saved.save(hashed.withColumn("key", F.monotonically_increasing_id()))  # fixed once written
    slots = hashed.select("label", "key", F.posexplode("buckets").alias("tile", "bucket"))
    full = slots.groupBy("tile", "bucket", "label").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64("key", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]).where("n > 1")
    first = full.groupBy("label", "n", "s1", "s2").agg(F.min(F.struct("tile", "bucket")).alias("at")).select("label", "n", "at.tile", "at.bucket")
    met = slots.join(first, ["tile", "bucket", "label"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    tiles = met.select("tile", "bucket", "label", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("tile", "bucket", "label", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    tiles = tiles.join(hashed.select("key", "copies", "raw", "buckets"), "key").withColumn("earlier", F.slice("buckets", F.lit(1), F.col("tile")))
    keys = ["tile", "bucket", "label", "i", "j"]
    out = tiles.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "own", "key", "copies", "raw", "earlier").mapInArrow(_tile_links(threshold, kind), "key long, links long, to long")
    found = saved.save(out)
    comp = components(found.where("to is not null").select(F.col("key").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    by_class = hashed.select("label", "digest", "key", "cid", "copies").join(links, "key", "left").join(comp, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))
    least = by_class.groupBy("component").agg(F.min("cid").alias("component_id"))
    by_class = saved.save(by_class.join(least, "component").select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("usable")))
    saved.drop(hashed)
    saved.drop(found)
    out = rows.select("vec_id", "label", "digest").join(by_class, ["label", "digest"], "left").withColumn("component_id", F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast(T.LongType()).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
