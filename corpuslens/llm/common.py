"""Shared pieces: written tables, batches bounded by bytes, groups read from a sorted stream, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches, shared_dir  # noqa: F401

#: Stands for a null id inside the operators: the largest, so a null is never the smallest id of a group of others.
NULL_ID = (1 << 63) - 1
#: Bytes of text that a Python worker handles at once; one longer text is handled alone.
SLICE_BYTES = 4 << 20


def fresh_path(folder: str, name: str) -> str:
    return f"{folder}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_bytes: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it cuts lineage and outlives lost executors.

    group_bytes is for rows of some MB: a page ends behind any row that fills it, a row group behind one that brings it over group_bytes. Else
    both last for a hundred rows at least, and the reader and the codec's direct buffers hold them whole."""
    spark = df.sparkSession
    path = fresh_path(shared_dir(spark), name)
    each = {f"parquet.{x}.size.row.check.{y}": "1" for x in ("page", "block") for y in ("min", "max")} | {"parquet.block.size": str(group_bytes)}
    df.write.options(**(each if group_bytes else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def fold(column: str = "doc_id") -> Column:
    """crc32 of an id as text, null as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs whose texts in column add up to about limit bytes; a run has a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("float64")))
        at, done = 0, 0.0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, float(ends[to - 1])


def binary(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column's UTF-8 bytes, null as empty."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return pc.fill_null(texts, b"").to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold only whole groups of a stream sorted by the integer column key."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = ints(batch, key)
        if carry and keys[-1] == ints(carry[-1], key)[-1] and keys[0] == keys[-1]:
            carry.append(batch)
            continue
        start = int(np.searchsorted(keys, keys[-1], side="left"))
        head = [*carry, batch.slice(0, start)]
        if carry or start:
            yield pa.Table.from_batches(head).combine_chunks()
        carry = [batch.slice(start)]
    if carry:
        yield pa.Table.from_batches(carry).combine_chunks()


def arrow_type(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of n items, the smallest of each one's component under the edges a-b: roots are hooked to smaller ones until no edge is left over."""
    least = np.arange(n)
    while True:
        x, y = least[a], least[b]
        open_ = x != y
        if not open_.any():
            return least
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = least[least]
            if (up == least).all():
                break
            least = up


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as the edges a-b: from each item to the smallest of its component, no more of them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    least = joined(at[: len(a)], at[len(a) :], len(ids))
    keep = least != np.arange(len(ids))
    return ids[keep], ids[least[keep]]


class Links:
    """Edges that are kept as stars, so that they take no more memory than their items."""

    def __init__(self, most: int = 1 << 19) -> None:
        self.a, self.b, self.size, self.most = [], [], 0, most

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.size += len(a)
        if self.size > self.most:
            a, b = self.stars()
            self.a, self.b, self.size = [a], [b], 0

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.a:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return stars(np.concatenate(self.a), np.concatenate(self.b))


def _contracted(edges: DataFrame) -> DataFrame:
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = stars(ints(batch, "a"), ints(batch, "b"))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(local, "a long, b long")


#: Keys with more than this part of all rows are met by broadcast; there can't be more of them.
HOT_KEYS = 1024


def looked_up(rows: DataFrame, known: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of known, which has one row for each key `on` and in n how many of the `total` rows have it. Keys with over
    1/HOT_KEYS of the rows are met by broadcast and never gathered in a task; the others by a shuffle. known is written, so that it is
    made once."""
    known = written(known, "lookup")
    few = known.where(F.col(n) * HOT_KEYS > total).collect()  # HOT_KEYS at most
    if not few:
        return rows.join(known, on, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(few, known.schema))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(known, on, how))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge. edges: a and b long, neither null.

    Alternating large and small stars: in turn each item hands its larger neighbours, then all its smaller ones, to its smallest
    neighbour, so that the depth of the trees falls geometrically. Each round is a written table; only a count and a checksum reach
    the driver. The smallest neighbour comes from an aggregation with partial sums, and items with many edges are looked up by
    broadcast, so that an item with a third of all edges doesn't land in one task.
    """
    edges = written(_contracted(edges.where("a <> b")), name)
    seen, n = None, edges.count()
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        large = looked_up(both.where("b > a"), least, ["a"], "n", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.distinct(), name)
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = looked_up(large, lower, ["a"], "n", n)
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen, n = now, now[0]


def typed(rows: list, types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """Columns, given as lists or arrays, as a record batch."""
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, (_, t) in zip(rows, types, strict=True)], [n for n, _ in types])


Maker = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
