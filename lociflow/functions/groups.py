"""Whole groups from sorted Arrow batches, and the lanes that step through many groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def widened(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with 64-bit offsets in its text and binary columns, so any number of batches can be one."""
    wide = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}
    return pa.RecordBatch.from_arrays([c.cast(wide[c.type]) if c.type in wide else c for c in batch.columns], batch.schema.names)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of all rows; an error where they can't be one, rather than fewer rows."""
    if len(batches) == 1:
        return batches[0]
    made = pa.Table.from_batches(batches).combine_chunks().to_batches()
    if sum(b.num_rows for b in made[:1]) != sum(b.num_rows for b in batches):
        raise ValueError("rows don't fit into one batch")
    return made[0]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a group of equal keys ends; the input is sorted by the keys. Text and binary columns come back widened."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = widened(batch)
        last = np.ones(batch.num_rows, dtype=bool)
        for k in keys:
            c = batch.column(k)
            last &= pc.equal(c, c[batch.num_rows - 1]).to_numpy(zero_copy_only=False)
        cut = batch.num_rows - int(last.sum())
        if cut or (held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys)):
            ready = [b for b in (*held, batch.slice(0, cut)) if b.num_rows]
            if ready:
                yield joined(ready)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield joined(held)


def bounds(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where each group begins, and the end."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        values = np.asarray(batch.column(k).to_pandas())
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def lanes(begin: np.ndarray, reverse: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups, rows): step by step the next row of every group that still has one, longest groups first in the numbering."""
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    active, size_sorted = len(order), size[order]
    for t in range(int(size_sorted[0]) if len(size_sorted) else 0):
        while size_sorted[active - 1] <= t:
            active -= 1
        groups = order[:active]
        yield groups, begin[groups + 1] - 1 - t if reverse else begin[groups] + t
