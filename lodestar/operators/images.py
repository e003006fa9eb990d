"""Images and clips made ready for a model: resampled, cropped, normalised, frames picked, axes moved."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOB = "struct<shape:array<int>,data:array<float>>"
_BLOB = pa.struct([("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float32()))])


def cubic(n: int, m: int, a: float = -0.5) -> np.ndarray:
    """m x n weights that bring a line of n values to m, by cubic convolution; a shorter line averages over as many more values."""
    scale = n / m
    wide = max(scale, 1.0)
    x = np.abs((np.arange(n)[None, :] + 0.5 - (np.arange(m)[:, None] + 0.5) * scale) / wide)
    w = np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * (x**3 - 5 * x**2 + 8 * x - 4), 0.0))
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image H x W x C at another size, one axis after the other."""
    rows = np.tensordot(cubic(image.shape[0], height), image, (1, 0))
    return np.moveaxis(np.tensordot(cubic(image.shape[1], width), rows, (1, 1)), 0, 1)


def shortest_to(image: np.ndarray, side: int) -> np.ndarray:
    """An image with its shorter side at `side` and its proportions."""
    h, w = image.shape[:2]
    return resized(image, side, max(1, int(side * w / h))) if h <= w else resized(image, max(1, int(side * h / w)), side)


def centre_crop(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The middle of an image, with zeros around it where it is too small."""
    h, w = image.shape[:2]
    pad = [(max(0, height - h) // 2, -(-max(0, height - h) // 2)), (max(0, width - w) // 2, -(-max(0, width - w) // 2)), (0, 0)]
    image = np.pad(image, pad)
    top, left = round((image.shape[0] - height) / 2), round((image.shape[1] - width) / 2)
    return image[top : top + height, left : left + width]


def frame_numbers(n: int, wanted: int) -> np.ndarray:
    """`wanted` of n frames, evenly spaced from the first to the last; some twice where there are fewer."""
    return np.round(np.linspace(0, n - 1, wanted)).astype(int) if n else np.empty(0, int)


def _mapped(rows: DataFrame, blob_col: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    columns = rows.columns
    at = columns.index(blob_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch.column(at):
                blob = cell.as_py()
                if blob is None or blob["data"] is None:
                    out.append(None)
                    continue
                made = f(np.asarray(blob["data"], np.float64).reshape(tuple(blob["shape"])))
                out.append({"shape": list(made.shape), "data": made.astype(np.float32).ravel()})
            yield pa.RecordBatch.from_arrays([pa.array(out, _BLOB) if k == at else c for k, c in enumerate(batch.columns)], columns)

    schema = ", ".join(f"`{c}` {BLOB if c == blob_col else rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.withColumn(blob_col, F.col(blob_col).cast(BLOB)).select(*columns).mapInArrow(run, schema)


def prepared(rows: DataFrame, resize: int, crop: int, mean: tuple[float, ...], std: tuple[float, ...], scale: float = 1 / 255, channels_first: bool = True, blob_col: str = "blob") -> DataFrame:
    """rows with their images H x W x C ready for a model: shorter side to `resize`, middle `crop` x `crop`, times `scale`, less the channels' means over their deviations, channels first.

    A null image stays null. An image that hasn't as many channels as there are means raises ValueError.
    """

    def one(image: np.ndarray) -> np.ndarray:
        if image.ndim != 3 or image.shape[2] != len(mean):
            raise ValueError(f"an image of shape {image.shape} hasn't {len(mean)} channels")
        if not image.size:
            raise ValueError(f"an image of shape {image.shape} has no pixels")
        made = (centre_crop(shortest_to(image, resize), crop, crop) * scale - np.array(mean)) / np.array(std)
        return np.moveaxis(made, 2, 0) if channels_first else made

    return _mapped(rows, blob_col, one)


def prepared_clips(rows: DataFrame, frames: int, resize: tuple[int, int], crop: int, mean: tuple[float, ...], std: tuple[float, ...], scale: float = 1 / 255, blob_col: str = "blob") -> DataFrame:
    """rows with their clips T x H x W x C as C x frames x crop x crop: frames evenly picked, each brought to `resize`, cropped and normalised. Null clips stay null; other channels than means raise ValueError."""

    def one(clip: np.ndarray) -> np.ndarray:
        if clip.ndim != 4 or clip.shape[3] != len(mean):
            raise ValueError(f"a clip of shape {clip.shape} hasn't {len(mean)} channels")
        picked = [centre_crop(resized(clip[k], *resize), crop, crop) * scale for k in frame_numbers(len(clip), frames)]
        return np.moveaxis((np.stack(picked) - np.array(mean)) / np.array(std), 3, 0) if picked else np.zeros((len(mean), 0, crop, crop))

    return _mapped(rows, blob_col, one)
