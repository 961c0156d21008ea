"""Vector code compression: product codes of integer vectors. Float32 matrix products screen a codebook's entries, each score with an
interval that surely holds the true one; entries whose interval reaches the best one's are evaluated again in int64, ties go to the
smaller index.

Rows whose vector is null or holds null or non-finite components are dropped; so are, having no codes, vectors whose length isn't `dim`
(default: that of the smallest kept id's vector) or can't be cut into `parts`, and those with a component of 2^27 or more after scaling,
whose distances a long can't hold. Null ids come last in the order of ids; rows that share an id are ordered by their integers. With
fewer than `entries` kept vectors the codebooks have as many entries as there are vectors. Repeated rows count as often as they stand
there. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, id_key, looked_up, written
from .vectors import integers, matrix, moved, slot_batch, slot_sums, small_batches, usable

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Unit roundoff of float32.
UNIT = 2.0**-24


def intervals(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, reach): of each row and entry |entry|^2 - 2 row.entry by float32's matrix product, and how far off it may be.

    Both factors are rounded to float32, multiplied and added up in any order: each term meets at most d + 2 roundings, so that the dot
    product is off by at most g * sum |x_i||c_i| <= g * |x||c| with g = (d + 2)u / (1 - (d + 2)u). Integers of 1 or more don't underflow
    and LIMIT keeps float32 from overflowing. The last term covers the double steps after it."""
    n = (x.shape[1] + 2) * UNIT
    own, norms = (x * x).sum(1).astype(np.float64), (book * book).sum(1).astype(np.float64)
    dots = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    reach = 2 * n / (1 - n) * np.sqrt(own)[:, None] * np.sqrt(norms)[None, :]
    return norms[None, :] - 2 * dots, reach * (1 + 2.0**-40) + 2.0**-48 * (norms[None, :] + 2 * np.abs(dots))


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Of each int64 row the nearest entry's index, exactly; ties to the smaller one."""
    score, reach = intervals(x, book)
    near = score - reach <= (score + reach).min(1)[:, None]
    best = near.argmax(1)
    open_ = np.flatnonzero(near.sum(1) > 1)
    if len(open_):
        row, entry = np.nonzero(near[open_])
        gap = x[open_[row]] - book[entry]
        order = np.lexsort((entry, (gap * gap).sum(1), row))
        first = order[np.searchsorted(row[order], np.arange(len(open_)))]
        best[open_] = entry[first]
    return best


def codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(rows, parts) of x (rows, parts, d) and books (parts, entries, d)."""
    return np.stack([nearest(np.ascontiguousarray(x[:, p]), books[p]) for p in range(len(books))], 1)


def _partial(books: np.ndarray):
    """A task's counts and sums of each part's entries."""
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, d + 1), dtype=np.int64)
        for batch in batches:
            x = matrix(column(batch, "v"), parts * d).reshape(-1, parts, d)
            found = codes(x, books) if len(x) else np.zeros((0, parts), dtype=np.int64)
            for p in range(parts):
                mine = np.zeros((len(x), k))
                mine[np.arange(len(x)), found[:, p]] = 1
                total[p, :, 0] += mine.sum(0).astype(np.int64)
                total[p, :, 1:] += (mine.T @ x[:, p].astype(np.float64)).astype(np.int64)  # a batch's sums are below 2^53
        yield slot_batch(total.ravel())

    return run


def _final(books: np.ndarray):
    parts, _, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(column(batch, "v"), parts * d).reshape(-1, parts, d)
            found = codes(x, books)
            gap = x - books[np.arange(parts), found]
            text = ["".join(f"{i:02x}" for i in row) for row in found.tolist()]
            columns = [column(batch, "vec_id"), column(batch, "lk"), pa.array(text, pa.string()), pa.array((gap * gap).sum((1, 2)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "lk", "code", "error"])

    return run


def learned(kept: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (parts, entries, d) after the rounds. A round is one job whose tasks add up what they assign: parts x entries x
    (d + 1) numbers come to the driver, whatever the number of rows."""
    books = start
    parts, k, d = books.shape
    for _ in range(rounds):
        total = slot_sums(kept.select("v").mapInArrow(_partial(books), "slot int, s long"), books.size + parts * k).reshape(parts, k, d + 1)
        books = moved(books, total[..., 1:], total[..., 0])
    return books


def vector_codes(
    rows: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dim: int | None = None
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, code, error, label_error), codebooks) of rows (vec_id, embedding, label): every kept vector's entries as hex digits, its
    squared distance from them, the distances summed over its label (nulls are one label; null where a long can't hold the sum), and the
    final codebooks (parts, entries, length of a part)."""
    spark = rows.sparkSession
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    ints = rows.where(usable("embedding", scale)).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("lk"), integers("embedding", scale).alias("v"))
    with small_batches(spark):
        kept = written(ints, "vector_codes")
        if dim is None:
            head = kept.orderBy(id_key("vec_id"), "v").select(F.size("v").alias("n")).first()
            dim = head["n"] if head else parts
        fits = kept.where(F.size("v") == dim) if dim % parts == 0 and dim else kept.where("false")
        first = [r["v"] for r in fits.orderBy(id_key("vec_id"), "v").select("v").limit(entries).collect()]
        width = max(1, dim // parts)
        start = np.array(first, dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
        books = learned(fits, start, rounds if first else 0)
        found = written(fits.mapInArrow(_final(books), "vec_id long, lk string, code string, error long"), "vector_codes")
    sums = found.groupBy("lk").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    out = looked_up(found, sums, ["lk"], "n", found.count())
    return out.select("vec_id", "code", "error", "label_error"), books


def digest(numbers: np.ndarray) -> str:
    """sha256 of integers in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, numbers.ravel().tolist())).encode()).hexdigest()
