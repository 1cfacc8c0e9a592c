"""Whole groups of a sorted partition, and a forest over their rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups with the groups' starts; the last group waits for the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = part if held is None else pa.concat_tables([held, part])
        starts = _starts(part, keys)
        if len(starts) > 1:
            yield part.slice(0, starts[-1]), starts[:-1]
            part = part.slice(starts[-1])
        held = part
    if held is not None and held.num_rows:
        yield held, _starts(held, keys)


def _starts(part: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(part.num_rows, bool)
    if part.num_rows:
        new[0] = True
    for k in keys:
        v = part.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def roots(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return root
        root = up


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join rows a and b of a local forest until every pair has one root."""
    while len(a):
        root[:] = roots(root)
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
