"""Sparse count vectors as bytes, and sums of vectors over whole tables.

Vectors are summed as whole numbers of 2**-SCALE, so a sum does not depend on the order or the partitions of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCALE = 30
#: Vectors that are taken at a time.
AT_ONCE = 1024


def packed(cell: np.ndarray, count: np.ndarray, by: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Each row's cells (below 65536) as 16-bit numbers, and counts as 32-bit ones, in binary columns; they compress well."""
    out = []
    for x in (cell.astype(np.uint16), count.astype(np.uint32)):
        out.append(pa.Array.from_buffers(pa.large_binary(), len(by) - 1, [None, pa.py_buffer((by * x.itemsize).astype(np.int64)), pa.py_buffer(x)]).cast(pa.binary()))
    return out[0], out[1]


def unpacked(cells: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, counts, n + 1 offsets) of packed rows."""
    out = []
    for column, kind in ((cells, np.uint16), (counts, np.uint32)):
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        out.append(np.frombuffer(column.buffers()[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes(), kind))
        by = (at - at[0]) // np.dtype(kind).itemsize
    return out[0].astype(np.int64), out[1], by


def weights(cell: np.ndarray, count: np.ndarray, by: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of rows that all have cells, of length 1 a row."""
    x = np.log1p(count.astype(np.float64)) * idf[cell]
    x /= np.repeat(np.maximum(np.sqrt(np.add.reduceat(x * x, by[:-1])), 1e-12), np.diff(by))
    return x


def summed(own: np.ndarray, cell: np.ndarray, x: np.ndarray, by: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups that have rows, sum of each one's vectors, rows of each); own: each row's group."""
    whole = np.rint(x * 2.0**SCALE)
    have, own, rows = np.unique(own, return_inverse=True, return_counts=True)
    sums = np.bincount(np.repeat(own, np.diff(by)) * dim + cell, weights=whole, minlength=len(have) * dim).astype(np.int64).reshape(-1, dim)
    return have, sums, rows


def _add(into: dict, groups: np.ndarray, sums: list | np.ndarray, rows: np.ndarray) -> None:
    for k, vector, n in zip(groups.tolist(), sums, rows.tolist(), strict=True):
        into[k] = (into[k][0] + vector, into[k][1] + n) if k in into else (vector.astype(np.int64), n)


def total(rows: DataFrame, parts: Callable) -> dict[int, tuple[np.ndarray, int]]:
    """For each group, the sum of its vectors and its number of rows.

    parts(batch) yields (groups, vectors of whole numbers, rows of each). A task hands on one row a group, and these are
    added by group.
    """

    def out(have: dict) -> Iterator[pa.RecordBatch]:
        for k, (vector, n) in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([vector.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["group", "total", "n"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict = {}
        for batch in batches:
            for got in parts(batch):
                _add(have, *got)
        yield from out(have)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict = {}
        for batch in batches:
            _add(have, batch.column(0).to_numpy(), [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()], batch.column(2).to_numpy())
        yield from out(have)

    schema = "group long, total binary, n long"
    sums = rows.mapInArrow(first, schema).repartition("group").mapInArrow(merge, schema)
    return {r["group"]: (np.frombuffer(bytes(r["total"]), np.int64), r["n"]) for r in sums.collect()}


def added(vectors: DataFrame, part: Callable, extra: str | None = None) -> dict[int, tuple[np.ndarray, int]]:
    """``total`` of packed ``cells`` and ``counts``, no row empty; part(cells, counts, offsets, extra) of AT_ONCE rows, extra: one more column."""

    def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i in range(0, batch.num_rows, AT_ONCE):
            rows = batch.slice(i, AT_ONCE)
            yield part(*unpacked(rows.column(0), rows.column(1)), rows.column(2) if extra else None)

    return total(vectors.select("cells", "counts", *([extra] if extra else [])), parts)
