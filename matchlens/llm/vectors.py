"""Vectors as whole numbers, and exact distances between them, for the operators that cluster vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import encoded

#: Whole numbers are cut to this size, so that squares and sums of them stay within a long.
LARGEST = float(1 << 26)
#: Whole numbers below this are exact in doubles, sums included.
EXACT = float(1 << 53)


def whole_numbers(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have `dims` components, all finite, and those as rows of floor(scale * x)."""
    keep = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    flat = column.filter(keep).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # a null is nan
    finite = np.isfinite(x).all(axis=1)
    which = keep.to_numpy(zero_copy_only=False).astype(bool)
    which[np.flatnonzero(which)[~finite]] = False
    with np.errstate(over="ignore"):
        return which, np.clip(np.floor(scale * x[finite]), -LARGEST, LARGEST)


def cleaned(vectors: DataFrame, dims: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """vec_id, the columns to keep as keep_0, keep_1, ..., and v (whole numbers, encoded) of the rows that take part.

    Those have exactly `dims` components, none of them null or non-finite. A null id stays. Components that come out
    beyond 2^26 are cut there.
    """
    columns = [F.col(f"`{id_col}`").cast("long").alias("vec_id"), *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)]]
    rows = vectors.select(*columns, F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    names = [*rows.columns[:-1], "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, x = whole_numbers(batch.column(batch.num_columns - 1), dims, scale)
            which = pa.array(which, pa.bool_())
            out = pa.array([encoded(v) for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*[c.filter(which) for c in batch.columns[:-1]], out], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", v binary"
    return rows.mapInArrow(run, schema)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and all of y, which hold whole numbers up to LARGEST in size."""
    most = max(float(np.abs(x).max(initial=0.0)), float(np.abs(y).max(initial=0.0)))
    if 4 * x.shape[1] * most * most < EXACT:
        return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    out, y = np.empty((len(x), len(y)), dtype=np.int64), y.astype(np.int64)
    for at in range(0, len(x), 256):
        apart = x[at : at + 256].astype(np.int64)[:, None, :] - y
        out[at : at + 256] = (apart * apart).sum(axis=2)
    return out


def squared_pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x and the same row of y."""
    apart = x.astype(np.int64) - y.astype(np.int64)
    return (apart * apart).sum(axis=1)


def sums_by(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups that rows of x are in, how many are in each, and their sums as whole numbers."""
    if not len(x):
        return group[:0], group[:0].astype(np.int64), np.zeros((0, x.shape[1]), dtype=np.int64)
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1))
    return group[order[first]], np.diff(first, append=len(x)), np.add.reduceat(x[order].astype(np.int64), first, axis=0)
