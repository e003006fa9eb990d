"""Groups out of sorted Arrow batches, so that a task holds one group and never its whole partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """For every row but the first, whether any key differs from the row before; keys hold no null."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in keys:
        col = batch.column(k)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        v = col.to_numpy(zero_copy_only=False)
        out |= v[1:] != v[:-1]
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, each as one table; the batches come sorted by the keys."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held and any(held[-1].column(k)[-1] != table.column(k)[0] for k in keys):
            yield pa.concat_tables(held)
            held = []
        cuts = np.flatnonzero(changes(table, keys)) + 1
        edges = [0, *cuts.tolist(), table.num_rows]
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            yield pa.concat_tables([*held, table.slice(a, b - a)])
            held = []
        held.append(table.slice(edges[-2]))
    if held:
        yield pa.concat_tables(held)
