"""Exact dedup: counting quotient filters, built for each partition and merged by sorted remainders, say which fingerprints stand more
than once; only texts with such a fingerprint are held against each other, byte by byte.

Texts are equal when identical after replacing each run of blanks ([\\x20\\x09-\\x0D]+) by one space; a null text is an empty one. Of equal
texts one row stays: of the smallest doc_id (null ids are the largest); of rows that share that id and text any one, so that of repeated
rows exactly one stays. Very long texts are handled like any other. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, id_key, ints, looked_up, written
from .vectors import small_batches

#: Bits of a fingerprint.
BITS = 64
#: Fingerprints of one filter at most while it is built, and rows that a shard of the merged filters should get.
FILTER_ROWS, SHARD_ROWS = 1 << 20, 1 << 21
#: Repeated fingerprints that are broadcast at most (8 bytes each); more of them meet the texts by a shuffle.
BROADCAST_KEYS = 1 << 20


class QuotientFilter:
    """A counting quotient filter over fingerprints of `bits` bits, lossless: the upper bits (quotient) are a place in a table of slots, the
    lower ones (remainder) are kept in the slot.

    Slots of one quotient form a run in the order of remainders, pushed on to the next free slots where others stand. Three bits a slot:
    `occupied` (its place is some run's quotient), `runend` (last slot of a run), `counter` (holds a digit of the count of the remainder
    before it). A remainder that stands c times is followed by the digits of c - 1 in base 2^remainder bits, lowest first; none for c = 1."""

    def __init__(self, bits: int, q: int, occupied: np.ndarray, runend: np.ndarray, counter: np.ndarray, slots: np.ndarray) -> None:
        self.bits, self.q, self.occupied, self.runend, self.counter, self.slots = bits, q, occupied, runend, counter, slots

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """The filter of different fingerprints (uint64, ascending) with their counts."""
        q = max(1, min(bits - 1, int(len(prints) * 8 // 7).bit_length()))
        r = bits - q
        mask = np.uint64((1 << r) - 1)
        place, rest = (prints >> np.uint64(r)).astype(np.int64), prints & mask
        row, digit, owner = [np.arange(len(prints))], [rest], [np.zeros(len(prints), dtype=np.int64)]
        left, level = counts.astype(np.uint64) - np.uint64(1), 1
        who = np.flatnonzero(left)
        while len(who):
            row.append(who)
            digit.append(left[who] & mask)
            owner.append(np.full(len(who), level))
            left[who] >>= np.uint64(r)
            who, level = who[left[who] > 0], level + 1
        row, digit, owner = np.concatenate(row), np.concatenate(digit), np.concatenate(owner)
        order = np.lexsort((owner, row))
        row, digit, owner = row[order], digit[order], owner[order]
        runs, first, length = np.unique(place[row], return_index=True, return_counts=True)
        shift = np.maximum.accumulate(runs - first) if len(runs) else runs  # a run starts at its quotient or right after the run before
        at = np.arange(len(row)) + np.repeat(shift, length)
        size = max(1 << q, int(at[-1]) + 1 if len(at) else 0)
        occupied, runend, counter = (np.zeros(size, dtype=bool) for _ in range(3))
        slots = np.zeros(size, dtype=np.uint64)
        occupied[runs] = True
        runend[at[first + length - 1]] = True
        counter[at] = owner > 0
        slots[at] = digit
        return cls(bits, q, occupied, runend, counter, slots)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints ascending, counts). Runs are read in the order of their quotients; a slot is in use if it lies between its run's
        start, known from the run before, and its end."""
        r = self.bits - self.q
        quotients, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        starts = np.maximum(quotients, np.concatenate([[0], ends[:-1] + 1])) if len(ends) else quotients
        length = ends - starts + 1
        at = np.repeat(starts - np.cumsum(length) + length, length) + np.arange(length.sum())
        quotient, counter, slot = np.repeat(quotients, length), self.counter[at], self.slots[at]
        heads = np.flatnonzero(~counter)
        prints = (quotient[heads].astype(np.uint64) << np.uint64(r)) | slot[heads]
        level = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
        worth = np.where(counter, slot << (np.maximum(level - 1, 0) * r).astype(np.uint64), np.uint64(0))
        counts = np.add.reduceat(worth, heads) if len(heads) else worth[:0]
        return prints, (counts + np.uint64(1)).astype(np.int64)

    def to_bytes(self) -> bytes:
        """Slots in as many bytes as a remainder needs."""
        wide = -(-(self.bits - self.q) // 8)
        head = np.array([self.bits, self.q, len(self.slots)], dtype="<i8").tobytes()
        marks = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.counter))
        return head + marks + self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        bits, q, size = (int(x) for x in np.frombuffer(data, dtype="<i8", count=3))
        marks = -(-size // 8)
        bit = lambda k: np.unpackbits(np.frombuffer(data, np.uint8, marks, 24 + k * marks), count=size).astype(bool)
        wide = -(-(bits - q) // 8)
        slots = np.zeros((size, 8), dtype=np.uint8)
        slots[:, :wide] = np.frombuffer(data, np.uint8, size * wide, 24 + 3 * marks).reshape(size, wide)
        return cls(bits, q, bit(0), bit(1), bit(2), slots.view("<u8").ravel())

    def merged(self, other: QuotientFilter) -> QuotientFilter:
        """One filter of both, from their entries in sorted order; its quotient grows with the number of entries. Nothing is lost: quotient
        and remainder are the whole fingerprint."""
        (a, n), (b, m) = self.entries(), other.entries()
        prints, counts = np.concatenate([a, b]), np.concatenate([n, m])
        order = np.argsort(prints, kind="stable")
        return QuotientFilter.of(*summed(prints[order], counts[order]), self.bits)


def summed(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending fingerprints, each once, with their counts added up."""
    if not len(prints):
        return prints, counts
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    return prints[first], np.add.reduceat(counts, first)


class Merger:
    """Filters merged as they come, like with like: at most one filter of each power of two is held, so that a fingerprint is copied as
    often as the number of filters has bits."""

    def __init__(self) -> None:
        self.levels: list[QuotientFilter | None] = []

    def add(self, one: QuotientFilter) -> None:
        for i, held in enumerate(self.levels):
            if held is None:
                self.levels[i] = one
                return
            one, self.levels[i] = held.merged(one), None
        self.levels.append(one)

    def whole(self) -> QuotientFilter | None:
        out = None
        for held in self.levels:
            out = held if out is None else out if held is None else held.merged(out)
        return out


def _built(shard_bits: int):
    """Filters of a task's fingerprints, one for each shard (the upper shard_bits) and FILTER_ROWS rows."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        prints = np.sort(np.concatenate(held))
        prints, counts = summed(prints, np.ones(len(prints), dtype=np.int64))
        shard = (prints >> np.uint64(BITS - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(prints), dtype=np.int64)
        names, first = np.unique(shard, return_index=True)
        mask = np.uint64((1 << (BITS - shard_bits)) - 1)
        for s, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(prints)], strict=True):
            block = QuotientFilter.of(prints[a:b] & mask, counts[a:b], BITS - shard_bits).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([block], pa.binary())], ["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(ints(batch, "fp").astype(np.uint64))
                n += batch.num_rows
            if n >= FILTER_ROWS:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _repeated(shard_bits: int):
    """(fp, n) with n over one from a stream of blocks sorted by shard. One shard's filters are merged at a time."""

    def told(shard: int, merger: Merger) -> pa.RecordBatch:
        prints, counts = merger.whole().entries()
        many = counts > 1
        whole = prints[many] | (np.uint64(shard) << np.uint64(BITS - shard_bits) if shard_bits else np.uint64(0))
        return pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64), pa.int64()), pa.array(counts[many], pa.int64())], ["fp", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, merger = None, Merger()
        for batch in batches:
            for s, block in zip(column(batch, "shard").to_pylist(), column(batch, "block"), strict=True):
                if s != shard and shard is not None:
                    yield told(shard, merger)
                    merger = Merger()
                shard = s
                merger.add(QuotientFilter.from_bytes(block.as_py()))
        if shard is not None:
            yield told(shard, merger)

    return run


def repeated(prints: DataFrame, rows: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp, n) of the fingerprints (fp long) that stand more than once, by the merged filters. Equal fingerprints take one entry in each
    filter, so that a frequent one weighs no more than a rare one in the shuffle; shards split the range of fingerprints evenly."""
    shard_bits = max(0, (max(1, rows) // shard_rows).bit_length())
    with small_batches(prints.sparkSession):
        blocks = prints.select("fp").mapInArrow(_built(shard_bits), "shard long, block binary")
        return written(blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(_repeated(shard_bits), "fp long, n long"), "repeated")


def normalised(text: str = "text") -> Column:
    """Runs of blanks as one space. A space alone needs no replacing, so that only the others are looked for."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of docs, whose columns `id` and `text` are read.

    Texts never travel but those with a repeated fingerprint, and of these one copy from each task: equal ones are brought together before
    the shuffle. Repeated fingerprints reach the texts by broadcast up to broadcast_keys of them, else by a shuffle in which frequent ones
    are still met by broadcast. Rows find their class by digest, those of a large class by broadcast."""
    own = docs.select(F.col(id).alias("doc_id"), normalised(text).alias("t"))
    with_print = own.withColumn("fp", F.xxhash64("t"))
    keyed = written(with_print.select("doc_id", "fp", F.sha2("t", 256).alias("text_sha256")), "keyed")
    total = keyed.count()
    known = repeated(keyed, total)
    texts = with_print.select("fp", "t")
    if known.count() <= broadcast_keys:
        texts = texts.join(F.broadcast(known.select("fp")), "fp", "left_semi")
    else:
        texts = looked_up(texts, known, ["fp"], "n", total)
    # grouped by the bytes of the whole text: the verification
    classes = texts.groupBy("t").agg(F.count("*").alias("group_size")).where("group_size > 1")
    classes = classes.select(F.sha2("t", 256).alias("text_sha256"), "group_size")
    # a row's place in the written table tells rows of one id and text apart
    rows = keyed.select("doc_id", "text_sha256", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    rows = written(looked_up(rows, classes, ["text_sha256"], "group_size", total, "left"), "members")
    place = F.struct(id_key().alias("k"), F.col("at"))
    members = rows.where("group_size is not null")
    first = members.groupBy("text_sha256").agg(F.min(F.struct(place.alias("place"), "doc_id")).alias("first"), F.count("*").alias("n"))
    copies = looked_up(members, first, ["text_sha256"], "n", total)
    single = rows.where("group_size is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return single.unionByName(copies.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (place == F.col("first.place")).alias("kept"), "text_sha256"))
