"""One row in, many chunks out: detections cropped from images, and speech cut from audio."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<shape:array<int>,data:array<float>>"
CHUNK = "doc_id string, offset int, label string, confidence double, location array<int>, weight double, blob " + IMAGE
RATE = 16_000


class BadDocType(ValueError):
    """Audio without a usable sample rate."""


def detect(docs: DataFrame, load_model: Callable[[], Callable[[np.ndarray], list[tuple[tuple[int, int, int, int], str, float]]]], confidence_threshold: float = 0.3, id_col: str = "doc_id", blob_col: str = "blob") -> DataFrame:
    """A chunk for each detection of at least confidence_threshold: its crop, [top, left], label and confidence.

    The model takes an image H x W x C and gives ((top, left, bottom, right), label, confidence). Rows without a blob
    give no chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model()
        for batch in batches:
            rows = []
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = np.asarray(blob["data"], np.float32).reshape(tuple(blob["shape"]))
                for (top, left, bottom, right), label, confidence in model(image):
                    if confidence >= confidence_threshold:
                        crop = image[top:bottom, left:right]
                        rows.append({"doc_id": doc_id, "offset": 0, "label": label, "confidence": float(confidence), "location": [top, left], "weight": 1.0, "blob": {"shape": list(crop.shape), "data": crop.ravel().tolist()}})
            yield pa.RecordBatch.from_pylist(rows, _chunk_schema())

    return docs.where(F.col(blob_col).isNotNull()).select(F.col(id_col).cast("string"), blob_col).mapInArrow(run, CHUNK)


def _chunk_schema() -> pa.Schema:
    image = pa.struct([("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float32()))])
    return pa.schema([("doc_id", pa.string()), ("offset", pa.int32()), ("label", pa.string()), ("confidence", pa.float64()), ("location", pa.list_(pa.int32())), ("weight", pa.float64()), ("blob", image)])


def resample(wave: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Linear interpolation to another sample rate."""
    if rate == to or not len(wave):
        return wave
    n = int(round(len(wave) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(wave)), wave).astype(np.float32)


def loud_spans(wave: np.ndarray, frame: int = 500, threshold: float = 0.02, gap: int = 2) -> list[tuple[int, int]]:
    """[start, end) of runs of frames whose root mean square is over the threshold, joined over gaps of up to `gap` frames."""
    n = len(wave) // frame
    loud = np.sqrt((wave[: n * frame].reshape(n, frame) ** 2).mean(axis=1)) > threshold if n else np.empty(0, bool)
    spans: list[list[int]] = []
    for k in np.flatnonzero(loud).tolist():
        if spans and k - spans[-1][1] <= gap:
            spans[-1][1] = k + 1
        else:
            spans.append([k, k + 1])
    return [(a * frame, b * frame) for a, b in spans]


def speech(docs: DataFrame, find: Callable[[np.ndarray], list[tuple[int, int]]] = loud_spans, id_col: str = "doc_id", wave_col: str = "wave", rate_col: str = "sample_rate") -> DataFrame:
    """(doc_id, offset, location, wave) of each span of speech at 16 kHz; several channels are averaged first.

    wave is array<array<float>>, a list for each channel. A wave without a sample rate, or with one of 0, raises
    BadDocType.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, wave, rate in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not rate:
                    raise BadDocType(f"document {doc_id} has no sample rate")
                mono = resample(np.asarray(wave, np.float32).mean(axis=0), int(rate))
                rows += [{"doc_id": doc_id, "offset": k, "location": [a, b], "wave": mono[a:b].tolist()} for k, (a, b) in enumerate(find(mono))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.string()), ("offset", pa.int32()), ("location", pa.list_(pa.int32())), ("wave", pa.list_(pa.float32()))]))

    return docs.where(F.col(wave_col).isNotNull()).select(F.col(id_col).cast("string"), wave_col, rate_col).mapInArrow(run, "doc_id string, offset int, location array<int>, wave array<float>")
