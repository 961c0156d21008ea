"""SimHash near-dedup: Golay-code fuzzy hashing of 64-bit fingerprints.

A fingerprint is cut into segments of 23, 23 and 18 bits (the last one is filled up with zeros). The binary Golay code is perfect:
each 23-bit word lies within 3 bits of exactly one codeword, whose index is its decoding. Of 3 differing bits, at most one segment
holds two or more, so two of the three segments differ in a bit at most (the pigeonhole). For each pair of segments a fingerprint is
stored under the pair of its decodings and looked up under the decodings of all words within a bit of its own; every link meets
there. Met pairs are verified by their Hamming distance inside the bucket, and a bucket gives no more links than it has members.

Nulls: a null text has no words, so its fingerprint is zero, linked like any other. A null doc_id counts as the largest id and comes
back as null (also as a component if it stands alone). Rows that share a doc_id link by their texts; the row keeps its own
fingerprint, and the component of rows with one doc_id may differ if their texts do. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Links, binary, bounded_batches, components, id_key, ints, looked_up, slices, typed, whole_groups, written

SEED = 42
#: Fixed: the generator polynomial of the (23, 12) Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Rows of one side of a bucket that are compared with all others at once.
BLOCK = 2048
PAIRS_AT_ONCE = 1 << 18


def fingerprint(text: bytes, size: int = 3, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(x) + 1 for x in words])
        starts = np.concatenate([[0], ends[:-size]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(packed), 1 << 16):
        ones += np.unpackbits(packed[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(d, f, t): the fingerprint as a signed long, and the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(x, size) for x in binary(batch, "text")], dtype=np.uint64).view(np.int64)
            yield typed([ints(batch, "d"), found, ints(batch, "t")], [("d", pa.int64()), ("f", pa.int64()), ("t", pa.int64())])

    text = F.col("text").cast("string")
    return docs.select(id_key().alias("d"), text.alias("text"), F.xxhash64(text).alias("t")).mapInArrow(run, "d long, f long, t long")


@cache
def decodings() -> np.ndarray:
    """The index of the codeword within 3 bits, for every 23-bit word."""
    indices = np.arange(1 << 12, dtype=np.int64)
    words = np.zeros(1 << 12, dtype=np.int64)
    for bit in range(12):
        words ^= np.where(indices >> bit & 1, GOLAY << bit, 0)
    one = 1 << np.arange(23)
    errors = {0, *one.tolist()} | {int(a ^ b) for a in one for b in one} | {int(a ^ b ^ c) for a in one for b in one for c in one}
    out = np.zeros(1 << 23, dtype=np.int16)
    for e in sorted(errors):
        out[words ^ e] = indices
    return out


def segment_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' own decodings, and a row of those of all words within a bit, repeats as -1."""
    decode = decodings()
    near = np.sort(decode[np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(bits))[None, :]], axis=1)].astype(np.int32), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near = -np.sort(-near, axis=1)
    return decode[words].astype(np.int32), near[:, : int((near >= 0).sum(axis=1).max(initial=1))]


def keyed(classes: DataFrame) -> DataFrame:
    """(k, f, rep, stored): every bucket of a fingerprint; stored: whether it is the one of its own decodings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                f, rep = ints(part, "f"), ints(part, "rep")
                u = f.view(np.uint64)
                found = [segment_keys((u >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64), n) for a, n in SEGMENTS]
                for p, (i, j) in enumerate(PAIRS):
                    (own_i, near_i), (own_j, near_j) = found[i], found[j]
                    both = (near_i[:, :, None] >= 0) & (near_j[:, None, :] >= 0)
                    keys = (p << 24) + (near_i[:, :, None].astype(np.int64) << 12) + near_j[:, None, :]
                    own = (near_i[:, :, None] == own_i[:, None, None]) & (near_j[:, None, :] == own_j[:, None, None])
                    row = np.nonzero(both)[0]
                    yield typed([keys[both], f[row], rep[row], own[both]], [("k", pa.int64()), ("f", pa.int64()), ("rep", pa.int64()), ("stored", pa.bool_())])

    return classes.select("f", "rep").mapInArrow(run, "k long, f long, rep long, stored boolean")


def bucket_links(k: np.ndarray, f: np.ndarray, rep: np.ndarray, stored: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within most bits between a stored and any other row of a bucket; k is sorted. Of a large bucket, a spanning star."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
    sizes = np.diff(cuts)
    u = f.view(np.uint64)
    found = Links()
    small = (sizes > 1) & (sizes <= BLOCK)
    # each stored row against all rows of its bucket, many buckets at once
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    rows = np.flatnonzero(stored & small[bucket])
    width = sizes[bucket[rows]]
    ends = np.cumsum(width)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        w = width[at:to]
        left = np.repeat(rows[at:to], w)
        right = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(cuts[bucket[rows[at:to]]], w)
        hit = (np.bitwise_count(u[left] ^ u[right]) <= most) & (rep[left] != rep[right])
        found.add(rep[left[hit]], rep[right[hit]])
        at = to
    for g in np.flatnonzero(sizes > BLOCK):
        whole = slice(cuts[g], cuts[g + 1])
        uw, rw = u[whole], rep[whole]
        for row in np.flatnonzero(stored[whole]):
            hit = (np.bitwise_count(uw ^ uw[row]) <= most) & (rw != rw[row])
            found.add(np.full(int(hit.sum()), rw[row]), rw[hit])
    return found.stars()


def links(classes: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): links that connect every two classes (f, rep) whose fingerprints differ in most bits or fewer."""
    if not 0 <= most <= 3:
        raise ValueError("two of three segments differ in a bit at most only up to 3 bits in all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "k"):
            a, b = bucket_links(*(group.column(c).to_numpy() for c in ("k", "f", "rep", "stored")), most)
            yield typed([a, b], [("a", pa.int64()), ("b", pa.int64())])

    return keyed(classes).repartition("k").sortWithinPartitions("k").mapInArrow(run, "a long, b long")


def row_groups(docs: DataFrame, most: int = 3, size: int = 3) -> DataFrame:
    """(d, f, t, g, c) for every row of docs: its id, fingerprint, text hash, the component and the component's smallest id. Components
    are of fingerprints, so rows that share a doc_id stay apart."""
    bounded_batches(docs.sparkSession)
    found = written(fingerprints(docs, size), "fingerprints")
    classes = written(found.groupBy("f").agg(F.min("d").alias("rep"), F.count("*").alias("n")), "fingerprint-classes")
    parts = components(links(classes.select("f", F.col("f").alias("rep")), most), "fingerprint-links")
    of = written(classes.join(parts, F.col("f") == F.col("id"), "left").select("f", "rep", "n", F.coalesce("component", "f").alias("g")), "fingerprint-groups")
    groups = of.groupBy("g").agg(F.min("rep").alias("c"), F.count("*").alias("m"))
    total = of.count()
    least = looked_up(of.select("f", "n", "g"), groups, ["g"], "m", total).select("f", "n", "g", "c")
    return looked_up(found, least, ["f"], "n", found.count()).select("d", "f", "t", "g", "c")


def simhash_groups(docs: DataFrame, most: int = 3, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; an empty table gives no rows."""
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return row_groups(docs, most, size).select(back("d").alias("doc_id"), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), back("c").alias("component_id"))
