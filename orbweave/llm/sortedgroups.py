"""Groups of rows that arrive sorted by key, across Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_change(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows at which a new key begins, but for row 0."""
    turn = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        turn |= v[1:] != v[:-1]
    return np.flatnonzero(turn) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups only, with the offsets of the groups (0 and the end included).

    Rows must come sorted by ``keys``. A group that spans batches is held until it is complete, so
    memory is bounded by the largest group that the caller's keys allow.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = key_change(batch, keys)
        if held:
            same = all(held[-1].column(k)[held[-1].num_rows - 1].equals(batch.column(k)[0]) for k in keys)
            end = (int(cuts[0]) if len(cuts) else batch.num_rows) if same else 0
            if same:
                held.append(batch.slice(0, end))
                batch, cuts = batch.slice(end), cuts[1:] - end
                if not batch.num_rows:
                    continue
            whole = pa.concat_batches(held)
            yield whole, np.array([0, whole.num_rows])
            held = []
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield batch.slice(0, last), np.concatenate(([0], cuts))
        held = [batch.slice(last)]
    if held:
        whole = pa.concat_batches(held)
        yield whole, np.array([0, whole.num_rows])
