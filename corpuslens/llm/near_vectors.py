"""Embedding near-dedup: iterative quantisation.

1. Rows with equal labels and vectors are one class, handled once: copies never meet each other pair by pair.
2. A rotation is learned on a bounded sample (SAMPLE vectors, chosen by a hash): principal directions, then ITQ's alternation of
   signs and Procrustes rotations, so that the bits of sign(rotated) are balanced and lose little.
3. The codes are cut into `tables` chunks; vectors with the same label and the same chunk meet in a bucket (multi-index hashing).
4. In a bucket, all pairs are reranked by the cosine of the original vectors in double precision, in blocks. A pair counts in the
   first chunk that its codes share only. A bucket gives a number of links for each member and at most one edge for each, never its
   pairs. Buckets over BLOCK members are split into pairs of blocks, each a task's work of its own.
5. Components of the edges come from alternating stars over written tables.

The index holds every vector. Two vectors meet unless all their chunks differ, so some links may be missed near the threshold (recall
is measured in tests/llm; over 0.97 for cosines of 0.98 and more), none is invented. With exact=True all vectors of a label are one
bucket, cut into pairs of blocks: no link is missed, and the work grows with the square of a label's different vectors. Vectors of
unequal length don't link. Norms are taken of vectors scaled by a power of two, so components of any size neither over- nor underflow.

Nulls: vectors that are null, zero or hold null or non-finite components, and those without a label, link with nothing. Null vec_ids
count as the largest id and come back as null. Repeated rows are copies of each other. Extra columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Links, bounded_batches, components, id_key, ints, looked_up, typed, whole_groups, written

SAMPLE = 8192
ROUNDS = 40
TABLES = 6
BLOCK = 4096


def learn(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """(dimensions, bits): principal directions, rotated so that signs lose as little as they can."""
    bits = min(64, x.shape[1])
    _, _, v = np.linalg.svd(x, full_matrices=False)
    base = np.eye(x.shape[1], bits)
    base[:, : min(bits, len(v))] = v[:bits].T
    y = x @ base
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
        r = (u @ w).T
    return base @ r


def chunks(bits: int, tables: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, bits, tables + 1).round().astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def codes(x: np.ndarray, rotation: np.ndarray | None, tables: int) -> np.ndarray:
    """(n, tables): the chunks of unit vectors; without a rotation one that all share."""
    if rotation is None:
        return np.zeros((len(x), 1), dtype=np.int64)
    on = (x @ rotation > 0).astype(np.int64)
    return np.stack([on[:, a:b] @ (1 << np.arange(b - a)) for a, b in chunks(rotation.shape[1], tables)], axis=1)


def vectors(values: pa.ListArray) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows without zero rows, at length 1."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    x = np.ldexp(x, -power)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> Column:
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & F.col("label").isNotNull() & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def compare(left: np.ndarray, right: np.ndarray, lc: np.ndarray, rc: np.ndarray, table: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of unit vectors with cosine `least` or more whose codes agree in no chunk before this one."""
    a, b = np.nonzero(left @ right.T >= least)
    first = (lc[a, :table] != rc[b, :table]).all(axis=1) if table else np.ones(len(a), dtype=bool)
    return a[first], b[first]


def near_vectors(rows: DataFrame, least: float = 0.98, tables: int = TABLES, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row (vec_id, embedding, label)."""
    spark = rows.sparkSession
    bounded_batches(spark)
    given = rows.select(id_key("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("x"), "label")
    given = given.withColumn("ok", usable("x")).withColumn("h", F.when(F.col("ok"), F.xxhash64("x"))).withColumn("g", F.when(F.col("ok"), F.hash("x")))
    fine = given.where("ok").withColumn("width", F.size("x"))
    # copies: the same label and the same 96 bits of hash of the vector
    classes = written(fine.groupBy("label", "h", "g").agg(F.min("v").alias("rep"), F.count("*").alias("copies"), F.min("x").alias("x"), F.min("width").alias("width")), "vector-classes")
    alone = given.select("v", "label", "h", "g", "ok")
    if classes.isEmpty():
        return _result(alone.where(~F.col("ok")), None)
    edges = None
    for (w,) in classes.select("width").distinct().collect():
        own = classes.where(F.col("width") == w)
        sample = own.orderBy(F.xxhash64("h", "label")).limit(0 if exact else SAMPLE).select("x").collect()
        rotation = None if exact else learn(unit(np.array([r[0] for r in sample], dtype=np.float64)))
        found = written(_bucket_links(own, rotation, least, 1 if exact else min(tables, rotation.shape[1])), "vector-links")
        edges = found if edges is None else edges.union(found)
    near = edges.where("b is not null").select("a", "b")
    counts = edges.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    parts = components(near, "vector-edges")
    links = classes.join(counts, F.col("rep") == counts["a"], "left").join(parts, F.col("rep") == F.col("id"), "left")
    links = links.select("rep", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component"), "label", "h", "g", "copies")
    return _result(alone, links)


def _result(alone: DataFrame, links: DataFrame | None) -> DataFrame:
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    n_links = lambda n: n.cast("long").alias("n_links")
    found = alone.where(~F.col("ok")).select("v", n_links(F.lit(0)), F.col("v").alias("c"))
    if links is not None:
        fine = alone.where("ok").select("v", "label", "h", "g")
        both = looked_up(fine, links, ["label", "h", "g"], "copies", fine.count())
        found = found.union(both.select("v", n_links(F.col("n") + F.col("copies") - 1), F.col("component").alias("c")))
    return found.select(back("v").alias("vec_id"), "n_links", back("c").alias("component_id"), (F.col("v") == F.col("c")).alias("kept"))


def _bucket_links(classes: DataFrame, rotation: np.ndarray | None, least: float, tables: int) -> DataFrame:
    """(a, b, n): b null: class a has n more links; else an edge between classes. k is a hash of the bucket, so different buckets may share it;
    label and chunk are compared, too, before anything counts."""
    shared = classes.sparkSession.sparkContext.broadcast(rotation)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = codes(unit(vectors(batch.column(batch.schema.get_field_index("x")))), shared.value, tables)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.tolist(), pa.list_(pa.int64()))], [*batch.schema.names, "chunk"])

    coded = classes.select("rep", "copies", "label", "x").mapInArrow(code, "rep long, copies long, label " + classes.schema["label"].dataType.simpleString() + ", x array<double>, chunk array<long>")
    coded = written(coded.select("rep", "copies", F.xxhash64("label").alias("l"), "x", "chunk"), "vector-codes")
    keys = coded.select("rep", "l", "chunk", F.posexplode("chunk").alias("t", "c")).select("rep", "l", "t", "c")
    large = keys.groupBy("l", "t", "c").count().where(F.col("count") > BLOCK)
    large = large.select(F.col("l").alias("ll"), F.col("t").alias("tt"), F.col("c").alias("cc"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = coded.select("rep", "copies", "l", "x", "chunk", F.posexplode("chunk").alias("t", "c"))
    rows = rows.join(large, (F.col("l") == F.col("ll")) & (F.col("t") == F.col("tt")) & (F.col("c") == F.col("cc")), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), blocks)
    rows = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    rows = rows.select(F.xxhash64("l", "t", "c", low, high).alias("k"), "rep", "copies", "l", "t", "c", "x", "chunk", low.alias("low"), high.alias("high"), "own")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "k"):
            cols = {n: group.column(n).to_numpy() for n in ("k", "rep", "copies", "l", "t", "c", "low", "high", "own")}
            x = unit(vectors(group.column("x").combine_chunks()))
            chunk = np.array(group.column("chunk").to_pylist(), dtype=np.int64)
            place = np.stack([cols[n] for n in ("k", "l", "t", "c", "low", "high")], axis=1)
            order = np.lexsort(place.T[::-1])
            cuts = np.flatnonzero((np.diff(place[order], axis=0) != 0).any(axis=1)) + 1
            links = np.zeros(len(order), dtype=np.int64)
            edges = Links()
            for part in np.split(order, cuts):
                if len(part) < 2:
                    continue
                low, high, t = int(cols["low"][part[0]]), int(cols["high"][part[0]]), int(cols["t"][part[0]])
                left = part if low == high else part[cols["own"][part] == low]
                right = part if low == high else part[cols["own"][part] == high]
                for at in range(0, len(left), 1024):
                    rows_ = left[at : at + 1024]
                    a, b = compare(x[rows_], x[right], chunk[rows_], chunk[right], t, least)
                    a, b = rows_[a], right[b]
                    apart = a != b
                    a, b = a[apart], b[apart]
                    np.add.at(links, a, cols["copies"][b])
                    if low != high:
                        np.add.at(links, b, cols["copies"][a])
                    edges.add(cols["rep"][a], cols["rep"][b])
            a, b = edges.stars()
            some = np.flatnonzero(links)
            yield typed([np.concatenate([a, cols["rep"][some]]), [*b.tolist(), *[None] * len(some)], np.concatenate([0 * a, links[some]])], [("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(meet, "a long, b long, n long")
