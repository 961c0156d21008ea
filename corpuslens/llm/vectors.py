"""What the operators on integer vectors share: which rows they keep, exact distances, sums by slot, tables made under small batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest integer component: squared distances of 64 components then stay below 2^63.
LIMIT = 1 << 27
#: Integers below this have dot products of 64 components that double precision holds exactly.
EXACT = 1 << 22


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few bytes for the jobs run inside; the session's own settings come back after them."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def usable(column: str, scale: int) -> Column:
    """Whether a vector has no null or non-finite component and none whose integer is beyond LIMIT; false for a null vector."""
    fits = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LIMIT), F.lit(False))
    return F.coalesce(F.forall(F.col(column), fits), F.lit(False))


def integers(column: str, scale: int) -> Column:
    return F.transform(F.col(column), lambda x: F.floor(x.cast("double") * scale).cast("int"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list column, all of one length, as int64 rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows and centres, (rows, centres). By doubles' matrix product where every step of it is an integer
    that doubles hold, else by int64."""
    small = max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)) < EXACT
    dots = (x.astype(np.float64) @ centres.T.astype(np.float64)).astype(np.int64) if small else x @ centres.T
    return (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * dots


def slot_sums(partial: DataFrame, slots: int) -> np.ndarray:
    """The sums of the tasks' partial ones (slot int, s long) by slot: as many numbers reach the driver as there are slots, whatever the rows."""
    out = np.zeros(slots, dtype=np.int64)
    for r in partial.groupBy("slot").agg(F.sum("s").alias("s")).collect():
        out[r["slot"]] = r["s"]
    return out


def slot_batch(sums: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], ["slot", "s"])


def moved(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Centres (..., k, d) after a round: floor(sum/count) by component, those without members as they were."""
    n = counts[..., None]
    return np.where(n > 0, sums // np.maximum(n, 1), centres)
