"""Wave files as rows."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_wave(raw: bytes) -> tuple[np.ndarray, int]:
    """Channels x samples in -1 .. 1, and the sample rate, of 8-, 16-, 24- or 32-bit PCM."""
    with wave.open(io.BytesIO(raw)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        data = f.readframes(f.getnframes())
    kind = {1: np.uint8, 2: "<i2", 3: "<i4", 4: "<i4"}
    if width not in kind:
        raise ValueError(f"{8 * width}-bit samples aren't supported")
    if width == 3:  # as the upper three bytes of four
        four = np.zeros((len(data) // 3, 4), np.uint8)
        four[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, 3)
        data, width = four.tobytes(), 4
    x = np.frombuffer(data, kind[width]).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(2 ** (8 * width - 1))
    return x.reshape(-1, channels).T, rate


def encode_wave(samples: np.ndarray, rate: int) -> bytes:
    """16-bit PCM of one channel."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, wave, sample_rate) of the .wav files under path, through Spark's binary source; doc_id is the file's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, rate = decode_wave(raw)
                rows.append({"doc_id": name, "wave": x.tolist(), "sample_rate": rate})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.string()), ("wave", pa.list_(pa.list_(pa.float32()))), ("sample_rate", pa.int32())]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "doc_id string, wave array<array<float>>, sample_rate int")


def write_waves(chunks: DataFrame, folder: str, rate: int) -> DataFrame:
    """Writes each row (doc_id, offset, wave) as a file of one channel under `folder` and returns (doc_id, offset, path).

    Files are named by a digest of the id and the offset, so a repeated task writes the same ones again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            ids, offsets, names = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for doc_id, offset, samples in zip(ids, offsets, batch.column(2), strict=True):
                names.append(f"{hashlib.sha256(str(doc_id).encode()).hexdigest()[:24]}-{offset}.wav")
                with store.open_output_stream(f"{root}/{names[-1]}") as out:
                    out.write(encode_wave(samples.values.to_numpy(), rate))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(offsets, pa.int32()), pa.array([f"{folder}/{n}" for n in names], pa.string())], ["doc_id", "offset", "path"])

    rows = chunks.select(F.col("doc_id").cast("string"), F.col("offset").cast("int"), F.col("wave").cast("array<float>"))
    return rows.mapInArrow(run, "doc_id string, offset int, path string")
