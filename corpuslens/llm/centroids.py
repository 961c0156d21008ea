"""Centroid clustering: k-means over integer vectors, by filtering ball trees.

Each partition's vectors become metric trees that are written once: a ball knows its radius, count and integer sum. A round lets the
centroids down each tree: a centroid that the triangle inequality shows to be nearest to no point of a ball leaves it; a ball with one
centroid left goes to it whole, by its count and sum; at a leaf the remaining ones meet its points exactly. Bounds are widened by more
than double precision can be off, so that results are exact, ties included.

Kept are vectors of exactly `dim` components, none null or non-finite, and none of 2^27 or more after scaling (a long can't hold their
distances). Null ids are hashed as an empty id. Rows that share an id are ordered by their integers and each may be a centroid; of equal
centroids the smaller number takes all. With fewer vectors than k all of them are centroids. Repeated rows count as often as they stand
there. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .common import column, fresh_path, typed
from .vector_codes import digest
from .vectors import integers, matrix, moved, slot_batch, slot_sums, small_batches, squared, usable

SCALE, DIM, K, ROUNDS, SEED = 256, 64, 40, 5, 2
#: Vectors of a tree at most, and of a leaf.
BLOCK, LEAF = 2048, 12
#: Bounds of distances are widened by this part of them, many times double precision's rounding.
SLACK = 2.0**-40

TREE = [
    ("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("start", pa.binary()), ("end", pa.binary()),
    ("left", pa.binary()), ("pivot", pa.binary()), ("radius", pa.binary()), ("sums", pa.binary()),
]
TREE_SCHEMA = "ids array<bigint>, points binary, start binary, end binary, left binary, pivot binary, radius binary, sums binary"


class Tree:
    """A ball tree over int64 rows. Nodes are in level order; node i holds points[start[i]:end[i]], its children are left[i] and
    left[i] + 1 (no children: -1)."""

    def __init__(self, points, start, end, left, pivot, radius, sums) -> None:
        self.points, self.start, self.end, self.left, self.pivot, self.radius, self.sums = points, start, end, left, pivot, radius, sums

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """(the tree, the rows' order in it). A ball is halved along the line between two points far apart."""
        order, spans, at = np.arange(len(points)), [(0, len(points))], 0
        left, pivot, radius, sums = [], [], [], []
        while at < len(spans):
            s, e = spans[at]
            own = points[order[s:e]]
            total = own.sum(0)
            centre = total // (e - s)
            gaps = ((own - centre) ** 2).sum(1)
            far = int(gaps.argmax())
            child = -1
            if e - s > leaf and gaps[far]:
                other = own[int(((own - own[far]) ** 2).sum(1).argmax())]
                along = own.astype(np.float64) @ (other - own[far]).astype(np.float64)
                half = (e - s) // 2
                order[s:e] = order[s:e][np.argpartition(along, half)]
                child = len(spans)
                spans += [(s, s + half), (s + half, e)]
            left.append(child)
            pivot.append(centre)
            radius.append(np.sqrt(float(gaps[far])) * (1 + SLACK))
            sums.append(total)
            at += 1
        start, end = np.array(spans, dtype=np.int32).T
        return cls(points[order], start, end, np.array(left, dtype=np.int32), np.array(pivot), np.array(radius), np.array(sums)), order

    def row(self, ids: list) -> list:
        """The tree as a row of TREE, with its points' ids."""
        kinds = ((self.points, "<i4"), (self.start, "<i4"), (self.end, "<i4"), (self.left, "<i4"), (self.pivot, "<i4"), (self.radius, "<f8"), (self.sums, "<i8"))
        return [ids, *(np.ascontiguousarray(x, dtype=kind).tobytes() for x, kind in kinds)]

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int, dim: int) -> Tree:
        raw = lambda name, kind: np.frombuffer(column(batch, name)[i].as_buffer(), dtype=kind)
        wide = lambda name, kind: raw(name, kind).reshape(-1, dim).astype(np.int64)
        return cls(wide("points", "<i4"), raw("start", "<i4"), raw("end", "<i4"), raw("left", "<i4"), wide("pivot", "<i4"), raw("radius", "<f8"), wide("sums", "<i8"))

    def filtered(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(balls, their centroids, points, their centroids): balls that go to one centroid whole, and the points of the leaves that
        don't; together they hold every point once."""
        balls, ball_to, points, point_to = [], [], [], []
        nodes, can = np.zeros(1, dtype=np.int64), np.ones((1, len(centres)), dtype=bool)
        while len(nodes):
            gap = np.sqrt(squared(self.pivot[nodes], centres).astype(np.float64))
            radius = self.radius[nodes][:, None]
            upper = np.where(can, gap, np.inf).min(1)[:, None] * (1 + SLACK) + radius
            can &= gap * (1 - SLACK) - radius <= upper
            one = can.sum(1) == 1
            balls.append(nodes[one])
            ball_to.append(can[one].argmax(1))
            bottom = ~one & (self.left[nodes] < 0)
            if bottom.any():
                sizes = (self.end - self.start)[nodes[bottom]]
                mine = np.repeat(self.start[nodes[bottom]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                far = np.where(np.repeat(can[bottom], sizes, axis=0), squared(self.points[mine], centres), np.iinfo(np.int64).max)
                points.append(mine)
                point_to.append(far.argmin(1))
            down = ~one & ~bottom
            child = self.left[nodes[down]].astype(np.int64)
            nodes, can = np.concatenate([child, child + 1]), np.concatenate([can[down], can[down]])
        joined = lambda x: np.concatenate([np.zeros(0, dtype=np.int64), *x])
        return joined(balls), joined(ball_to), joined(points), joined(point_to)

    def assigned(self, centres: np.ndarray) -> np.ndarray:
        """The centroid of each point."""
        balls, ball_to, points, point_to = self.filtered(centres)
        out = np.zeros(len(self.points), dtype=np.int64)
        out[points] = point_to
        for s, e, c in zip(self.start[balls].tolist(), self.end[balls].tolist(), ball_to.tolist(), strict=True):
            out[s:e] = c
        return out

    def added(self, centres: np.ndarray, total: np.ndarray) -> None:
        """Adds counts and sums of each centroid's points to total (k, 1 + dim)."""
        balls, ball_to, points, point_to = self.filtered(centres)
        np.add.at(total[:, 0], ball_to, (self.end - self.start)[balls])
        np.add.at(total[:, 1:], ball_to, self.sums[balls])
        np.add.at(total[:, 0], point_to, 1)
        np.add.at(total[:, 1:], point_to, self.points[points])


def _trees(dim: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(size: int) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            while whole.num_rows >= size:
                part = whole.slice(0, block).to_batches()[0]
                whole = whole.slice(part.num_rows)
                tree, order = Tree.build(matrix(column(part, "v"), dim))
                ids = column(part, "vec_id").take(pa.array(order)).to_pylist()
                yield typed([[x] for x in tree.row(ids)], TREE)
            held.extend(whole.to_batches())

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= block:
                    yield from made(block)
        if held:
            yield from made(1)

    return run


def _partial(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), centres.shape[1] + 1), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                Tree.read(batch, i, centres.shape[1]).added(centres, total)
        yield slot_batch(total.ravel())

    return run


def _final(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree.read(batch, i, centres.shape[1])
                to = tree.assigned(centres)
                gap = tree.points - centres[to]
                columns = [column(batch, "ids")[i].values, pa.array(to, pa.int32()), pa.array((gap * gap).sum(1), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return run


def clusters(
    rows: DataFrame, scale: int = SCALE, dim: int = DIM, k: int = K, rounds: int = ROUNDS, seed: int = SEED, block: int = BLOCK
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), centroids (k, dim)) of rows (vec_id, embedding).

    A round is one job over the written trees; k x (dim + 1) sums come to the driver, whatever the number of rows. Sums that a long can't
    hold are null."""
    spark = rows.sparkSession
    vectors = rows.where((F.size("embedding") == dim) & usable("embedding", scale))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers("embedding", scale).alias("v"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r["v"] for r in kept.orderBy(name, "v").select("v").limit(k).collect()]
    centres = np.array(first, dtype=np.int64).reshape(len(first), dim)
    out_schema = "vec_id long, cluster int, distance long"
    if not first:
        nothing = spark.createDataFrame([], f"{out_schema}, cluster_inertia long, inertia long, centroid_sha256 string")
        return nothing, centres
    with small_batches(spark):
        place = fresh_path(shared_dir(spark), "trees")
        kept.mapInArrow(_trees(dim, block), TREE_SCHEMA).write.option("parquet.block.size", 16 << 20).parquet(place)
        trees = spark.read.schema(TREE_SCHEMA).parquet(place)
        for _ in range(rounds):
            total = slot_sums(trees.mapInArrow(_partial(centres), "slot int, s long"), len(centres) * (dim + 1)).reshape(len(centres), dim + 1)
            centres = moved(centres, total[:, 1:], total[:, 0])
        place = fresh_path(shared_dir(spark), "clusters")
        trees.mapInArrow(_final(centres), out_schema).write.parquet(place)
    found = spark.read.schema(out_schema).parquet(place)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # k rows
    total = None if None in sums.values() or sum(sums.values()) >= 1 << 63 else sum(sums.values())
    by = spark.createDataFrame([(c, s, total, digest(centres[c])) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centres
