"""Groups of rows from partitions that are sorted by the groups' keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which another group begins, without the first."""
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        values = table[key].to_numpy()
        new |= values[1:] != values[:-1]
    return np.flatnonzero(new) + 1


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group; keys are integers without nulls. Only one group and one batch are held."""
    open_rows: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        first = tuple(table[k][0].as_py() for k in keys)
        if open_rows and first != last:
            yield pa.concat_tables(open_rows)
            open_rows = []
        start = 0
        for end in _changes(table, keys):
            open_rows.append(table.slice(start, end - start))
            yield pa.concat_tables(open_rows) if len(open_rows) > 1 else open_rows[0]
            open_rows, start = [], end
        open_rows.append(table.slice(start))
        last = tuple(table[k][table.num_rows - 1].as_py() for k in keys)
    if open_rows:
        yield pa.concat_tables(open_rows)


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes by the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
