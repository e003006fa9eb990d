"""Reading inputs, and tables that cut lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where none is set (single-machine tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-lodestar-")
    return f"file://{_LOCAL[app]}"


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}"


class Saved:
    """Tables written to the shared folder, so that a lost executor costs a re-read and no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)  # held, so that no other frame gets its id
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes the table behind a frame that save() gave; nothing may read it afterwards."""
        _, path = self.paths.pop(id(df), (None, None))
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of rows that go to a Python worker at once, about; Spark's own limit is 64 MB.
BATCH_BYTES = 1 << 21
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limit for Arrow batches to BATCH_BYTES, unless it has been set before.

    A batch of texts stands in the JVM's direct memory, as it grows and as it is read back, and in the worker, for
    each core of an executor, and what is freed of buffers that large isn't given back at once. A row is never cut.
    Frames run after they are returned, so the setting stays.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


#: Bits of the filter below: 4 MB, however many keys there are.
FILTER_BITS = 1 << 25


def maybe_among(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column `name`: false only where key, a long, surely isn't in keys (key).

    Keys set bits of one bitmap of FILTER_BITS, built by a Spark aggregate in 1024 rows and broadcast, so that what
    can't meet them needs no shuffle. The more keys, the more rows pass; none that should is held back.
    """
    bit = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))
    bits = keys.select(bit(F.col("key")).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    at = F.bitmap_bit_position(bit(key))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(bit(key)) == F.col("_bucket"), "left")
    return met.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def split_column(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, for helpers that add one."""
    while name in df.columns:
        name = f"_{name}"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
