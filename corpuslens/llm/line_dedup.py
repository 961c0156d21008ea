"""Line dedup: a sharded minimal perfect hash over the repeated lines' hashes indexes fingerprint, count and owner arrays.

1. A pass over the texts writes one (hash, fingerprint, document) row for each different key of a document.
2. An aggregation with partial sums keeps the keys that lie in two documents or more, with their smallest document.
3. They are dealt to shards of a bounded number of keys. Each shard becomes one index row: a minimal perfect hash in levels of bit
   arrays, and arrays of fingerprints, counts and owners in its order.
4. The rows of step 1 go to the shard of their hash and probe its arrays there; no lines are joined. A shard's rows are salted over
   tasks, each with its copy of the index row: COPIES of them, and one for each TASK_ROWS of its counts, so that a line that lies in
   every document fills no task at any size.
5. Documents get the fingerprints that they lose and are rewritten in one pass.

Nulls: a null or empty text is one empty line. A null doc_id stands for one document that is larger than all others. Rows that share
a doc_id are one document: they keep the same lines. Extra columns pass through; the columns added replace ones of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, binary, column, fresh, id_key, ints, slices, typed, whole_groups, written

BLANK = b" \t\n\x0b\x0c\r"
SEEDS = (0x5BD1E995, 0x27D4EB2F)
SHARD_KEYS = 1 << 18
GAMMA = 2.0
#: Tasks of a shard at least, and rows that one more task is for.
COPIES, TASK_ROWS = 8, 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def line_hashes(key: bytes) -> tuple[int, int]:
    """Two independent signed 64-bit hashes: the place and the fingerprint."""
    a, b = (xxhash.xxh3_64_intdigest(key, s) for s in SEEDS)
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _level_hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + MIX * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash: key k of n goes to its own place in 0..n-1; other keys to any place or -1."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - bits + before)
            before += int(bits.sum())
        self.size = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: all different; equal ones would never part."""
        levels, left = [], keys
        while len(left):
            if len(levels) > 200:
                raise ValueError("a perfect hash of equal keys")
            size = max(8, int(GAMMA * len(left)))
            at = _level_hash(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = _level_hash(keys[open_], level, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def packed(self) -> tuple[list[int], list[bytes]]:
        return [len(x) for x in self.levels], [np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def unpacked(cls, sizes: list[int], packed: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for n, b in zip(sizes, packed, strict=True)])


def _place_keys(h: np.ndarray, f: np.ndarray, seed: int = 0) -> np.ndarray:
    """Both hashes decide the place, so two lines that share one of them don't stop the build."""
    with np.errstate(over="ignore"):
        return h.view(np.uint64) ^ (f.view(np.uint64) * (MIX + np.uint64(2 * seed)))


def different_keys(h: np.ndarray, f: np.ndarray) -> tuple[int, np.ndarray]:
    """(seed, place keys) by the first seed under which different lines have different keys."""
    seed = 0
    while len(np.unique(keys := _place_keys(h, f, seed))) < len(keys):
        seed += 1
    return seed, keys


LINES = [("h", pa.int64()), ("f", pa.int64()), ("d", pa.int64())]
PROBES = T.StructType([T.StructField("task", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("f", T.LongType()), T.StructField("d", T.LongType()), T.StructField("index", T.StructType([T.StructField("seed", T.LongType()), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("levels", T.ArrayType(T.BinaryType())), T.StructField("fingerprints", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("owners", T.BinaryType())]))])


def line_rows(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(h, f, d) for each different key of min_chars code points or more in a row; d: the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, f, d = [], [], []
            for doc, text in zip(ints(batch, "d").tolist(), binary(batch, "text"), strict=True):
                for key in {line_key(x) for x in text.split(b"\n")}:
                    if long_enough(key, min_chars):
                        a, b = line_hashes(key)
                        h.append(a)
                        f.append(b)
                        d.append(doc)
            yield typed([h, f, d], LINES)

    return docs.select(id_key().alias("d"), F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, f long, d long")


def repeated_line_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: the perfect hash and the arrays behind it, and how many rows of lines its keys have."""
    repeated = lines.groupBy("h", "f").agg(F.count("*").alias("n"), F.min("d").alias("owner"), F.max("d").alias("last")).where("owner < last")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "shard"):
            of = group.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(of)) + 1
            for part in np.split(np.arange(len(of)), cuts):
                h, f, n, owner = (group.column(c).to_numpy()[part] for c in ("h", "f", "n", "owner"))
                seed, keys = different_keys(h, f)
                index = PerfectHash.build(keys)
                order = np.argsort(index.places(keys))
                sizes, levels = index.packed()
                item = {"seed": seed, "sizes": sizes, "levels": levels, "fingerprints": f[order].tobytes(), "counts": n[order].astype(np.int64).tobytes(), "owners": owner[order].tobytes()}
                yield pa.RecordBatch.from_pylist([{"shard": int(of[part[0]]), "rows": int(n.sum()), "index": item}], schema=arrow_type(shape))

    shape = T.StructType([T.StructField("shard", T.LongType()), T.StructField("rows", T.LongType()), PROBES["index"]])
    dealt = repeated.select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "f", "n", "owner").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(build, shape)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, held = None, None
    for batch in batches:
        tasks, kinds = ints(batch, "task"), ints(batch, "kind")
        bounds = [0, *(np.flatnonzero((np.diff(tasks) != 0) | (kinds[1:] == 0)) + 1), len(tasks)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            if kinds[a] == 0:
                x = column(batch, "index")[int(a)].as_py()
                task, held = tasks[a], (x["seed"], PerfectHash.unpacked(x["sizes"], x["levels"]), np.frombuffer(x["fingerprints"], np.int64), np.frombuffer(x["counts"], np.int64), np.frombuffer(x["owners"], np.int64))
                a += 1
            if a == b or task != tasks[a]:
                continue
            h, f, d = (ints(batch, c)[a:b] for c in ("h", "f", "d"))
            seed, index, fingerprints, counts, owners = held
            at = index.places(_place_keys(h, f, seed))
            hit = (at >= 0) & (fingerprints[at] == f) & (counts[at] > 1) & (owners[at] != d)
            yield typed([f[hit], d[hit]], [("f", pa.int64()), ("d", pa.int64())])


def lost_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(d, lost): the fingerprints of the lines that document d loses."""
    lines = written(line_rows(docs, min_chars), "lines")
    shards = max(1, lines.count() // SHARD_KEYS) + 15
    index = written(repeated_line_index(lines, shards), "line-index")
    copies = F.greatest(F.lit(COPIES), F.ceil(F.col("rows") / TASK_ROWS)).alias("copies")
    # shards of frequent lines: at most one in COPIES * TASK_ROWS rows
    wide = F.broadcast(index.where(F.col("rows") > COPIES * TASK_ROWS).select("shard", copies))
    task = (F.col("shard") * (1 << 24) + F.col("salt")).alias("task")
    none = F.lit(0).cast("long")
    heads = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"), "index").select(task, F.lit(0).alias("kind"), none.alias("h"), none.alias("f"), none.alias("d"), "index")
    asked = lines.withColumn("shard", F.pmod("h", F.lit(shards))).join(wide, "shard", "left")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("d"), F.coalesce("copies", F.lit(COPIES))))
    probes = asked.select(task, F.lit(1).alias("kind"), "h", "f", "d", F.lit(None).cast(PROBES["index"].dataType).alias("index"))
    dealt = heads.union(probes).repartition("task").sortWithinPartitions("task", "kind")
    return dealt.mapInArrow(_probe, "f long, d long").groupBy("d").agg(F.collect_set("f").alias("lost"))


def line_dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with text rewritten (null text: empty) and n_lines (before), n_dropped long.

    Lines whose key (stripped, A-Z lower-cased) has min_chars code points or more and lies in two documents or more go, except in the
    smallest doc_id that holds it. An empty table gives an empty table.
    """
    base = docs.drop("n_lines", "n_dropped")
    own, other, gone_ = (fresh(base.columns, x) for x in ("own", "other", "gone"))
    lost = lost_lines(docs.select("doc_id", "text"), min_chars).toDF(other, gone_)
    joined = base.withColumn(own, id_key()).join(lost, F.col(own) == F.col(other), "left").drop(own, other)
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in base.schema.fields]
    shape = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = [f.name for f in fields]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_type(shape)
        for batch in slices(batches, "text"):
            texts, total, gone = [], [], []
            for text, drop in zip(binary(batch, "text"), column(batch, gone_).to_pylist(), strict=True):
                lines = text.split(b"\n")
                kept = lines
                if drop:
                    drop = set(drop)
                    kept = [x for x in lines if not (long_enough(k := line_key(x), min_chars) and line_hashes(k)[1] in drop)]
                texts.append(b"\n".join(kept))
                total.append(len(lines))
                gone.append(len(lines) - len(kept))
            text = pa.array(texts, pa.binary()).cast(kinds.field("text").type)
            out = [text if n == "text" else column(batch, n).cast(kinds.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], schema=kinds)

    return joined.mapInArrow(rewrite, shape)
