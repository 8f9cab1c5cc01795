"""Vectors in blocks: checks, packing rows into binary blocks in a given order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    ok = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as rows."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision. Rows are first brought near 1 by a power of two, which
    is exact, so that neither large nor small components leave the range when squared."""
    x = x.astype(float)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def runs(dims: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], dims[1:] != dims[:-1], [True]]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, int, pa.Table]]:
    """(block id, dimension, up to ``rows`` rows) of a sorted partition whose first column is dim.

    Block ids rise with the partition and the order in it; a block has one dimension.
    """
    number, held, dim = TaskContext.get().partitionId() << 32, [], None

    def out():
        nonlocal number, held
        table = pa.Table.from_batches(held).combine_chunks()
        held, number = [], number + 1
        return number - 1, dim, table

    for batch in batches:
        for s, e in runs(batch.column(0).to_numpy()) if batch.num_rows else ():
            here = batch.column(0)[s].as_py()
            if held and here != dim:
                yield out()
            dim = here
            while s < e:
                room = rows - sum(b.num_rows for b in held)
                held.append(batch.slice(s, min(room, e - s)))
                s += min(room, e - s)
                if sum(b.num_rows for b in held) == rows:
                    yield out()
    if held:
        yield out()
