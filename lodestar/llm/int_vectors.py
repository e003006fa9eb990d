"""Vectors of whole numbers: which rows have one, and blocks of them as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a component is multiplied by before it is rounded down.
SCALE = 256
#: Whole numbers under this are held exactly in double precision, and those under the other in single.
EXACT_DOUBLE, EXACT_SINGLE = 1 << 53, 1 << 24


def usable(vector_col: str) -> Column:
    """True for a vector that isn't null or empty and holds no null and no non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def whole(vector_col: str, scale: int = SCALE) -> Column:
    """floor(scale * c) of every component, in double precision, as longs."""
    return F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(c * scale).cast("long"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of longs as the rows of a matrix; ValueError if they aren't equally long."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    dim, rest = divmod(len(flat), max(1, len(vectors)))
    if rest or any(n != dim for n in np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))):
        raise ValueError("vectors aren't equally long")
    return flat.reshape(len(vectors), dim)


def least_type(x: np.ndarray) -> np.dtype:
    """The smallest of the integer types that holds all of x."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return next(np.dtype(t) for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


BLOCK_SCHEMA = "keys binary, ids binary, labels binary, dim int, kind string, x binary"


def packed(size: int):
    """Rows (key, id, label, x), all long but x, in blocks of at most `size`, each in order of id."""

    def block(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        x = matrix(t.column("x").combine_chunks() if isinstance(t.column("x"), pa.ChunkedArray) else t.column("x"))
        key, ids, label = (t.column(c).to_numpy() for c in ("key", "id", "label"))
        order = np.argsort(ids, kind="stable")
        kind = least_type(x)
        cells = [key[order].tobytes(), ids[order].tobytes(), label[order].tobytes(), x.shape[1], kind.str, x[order].astype(kind).tobytes()]
        types = [pa.binary()] * 3 + [pa.int32(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], y) for c, y in zip(cells, types, strict=True)], ["keys", "ids", "labels", "dim", "kind", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
            while sum(t.num_rows for t in held) >= size:
                rows = pa.concat_tables(held)
                yield block(rows.slice(0, size))
                held = [rows.slice(size)]
        if sum(t.num_rows for t in held):
            yield block(pa.concat_tables(held))

    return run


def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """keys, ids, labels and the matrix of a block."""
    keys, ids, labels = (np.frombuffer(row[prefix + c], np.int64) for c in ("keys", "ids", "labels"))
    return keys, ids, labels, np.frombuffer(row[prefix + "x"], row[prefix + "kind"]).reshape(len(ids), row[prefix + "dim"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exactly, as longs.

    No partial sum exceeds the product of the greatest lengths, so floating-point sums of whole numbers below what the
    type holds exactly are exact in any order; OverflowError beyond double precision.
    """
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"vectors of {a.shape[1]} and of {b.shape[1]} components")
    longest = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))
    bound = longest(a) * longest(b) * (1 + 1e-9)
    if bound >= EXACT_DOUBLE:
        raise OverflowError("inner products beyond 2**53 aren't exact")
    kind = np.float32 if bound < EXACT_SINGLE else np.float64
    return np.rint(a.astype(kind) @ b.astype(kind).T).astype(np.int64)
