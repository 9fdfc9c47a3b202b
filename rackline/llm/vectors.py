"""Vectors as whole steps, and bounded blocks of query vectors for tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of query vectors, as doubles, that go to the tasks at a time.
BLOCK_BYTES = 8 << 20


def is_usable(vector: Column, scale: float) -> Column:
    """Not null, and all components (if any) finite numbers, also when multiplied by ``scale``."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(F.lit(scale) * x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def steps(column: pa.Array | list, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, one row for each vector, short ones filled with zeros."""
    if not isinstance(column, pa.Array):
        column = pa.array(column, pa.list_(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        values = flat.reshape(len(sizes), width)
    else:
        values = np.zeros((len(sizes), width))
        values[np.arange(width) < sizes[:, None]] = flat
    return np.floor(scale * values)


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices cut to their common width, in a type whose inner products are exact.

    Doubles as long as all sums stay below 2^53, else 64-bit integers.  Scores that may not
    fit in those are an error, as in SQL.
    """
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
    if most < 2**53:
        return a, b
    if most < 2**62:
        return a.astype(np.int64), b.astype(np.int64)
    raise OverflowError("an inner product may not fit in 64 bits")


@dataclass
class Block:
    """Some query vectors: ids, steps, and further columns as arrays of objects."""

    ids: np.ndarray
    values: np.ndarray
    more: dict[str, np.ndarray]


def blocks(queries: DataFrame, scale: float, more: tuple[str, ...] = (), size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The vectors of ``queries`` (vec_id, embedding, ...) in blocks of bounded size."""

    def made(rows) -> Block:
        extra = {c: np.array([r[c] for r in rows], object) for c in more}
        return Block(np.array([r.vec_id for r in rows], np.int64), steps([r.embedding for r in rows], scale), extra)

    held, bytes_ = [], 0
    for row in queries.select("vec_id", "embedding", *more).toLocalIterator():
        held.append(row)
        bytes_ += 8 * (1 + len(row.embedding))
        if bytes_ >= size:
            yield made(held)
            held, bytes_ = [], 0
    if held:
        yield made(held)


def one_per_id(rows: DataFrame, *more: str) -> DataFrame:
    """One vector for each vec_id, the largest of those that share it."""
    best = F.max(F.struct("embedding", *more)).alias("best")
    return rows.groupBy("vec_id").agg(best).select("vec_id", "best.embedding", *(f"best.{c}" for c in more))
