"""LM scoring: a log-frequency Bloom filter of quantised bigram counts, in segments by the bigrams' hashes.

Fitting. Texts go into slices of a few MB, a written table. Each slice names the different words and bigrams of its training documents
(those whose fold isn't `held`) with their counts, as sorted hashes, and sends them to segments by the hashes' first bits. A
segment adds the counts up; a bigram seen n times goes into its filter once for each of the levels 1..1+log(n, BASE), LEVEL_BITS for each.
What is written of a segment, the model, is the filter's bits, no bigram and no count of one, and the exact counts of its words.

Scoring. Each slice names the different words and bigrams of all its documents, hashes only; they meet the model's segments, where every
bigram is probed level by level, and go back to their slice in the order in which it named them, a byte for a bigram. What a bigram is
worth comes from the filter's bits alone, so that a model scores other corpora as well (`fitted`, `scored`).

The filter of a corpus has no bounded size, so it isn't broadcast whole: the probes travel to its segments. A slice sends a row to those
segments only that its keys fall into, never more rows than keys, so that work grows with the text however many segments there are. Every
word and bigram of a slice is named once, whatever their frequency, so that segments are even; one holds about SHARD_BYTES of text.

p(w|v) = (q(v, w) + b(v) p(w)) / (c(v) + b(v)): q is the filter's count (a level's lower bound), c(v) the exact count, and b(v) =
c(v) ** GROWTH stands for the number of different followers, which grows so with a word's count. p(w) discounts word counts and gives
the rest to one unknown event, so a context's probabilities over the V known tokens and the unknown one add up to 1, less what the
levels round off (nothing for counts up to 4, a third of a count at most), but for false positives (under 0.003 a level).

Nulls: a null text is empty: one end token. A null doc_id belongs to the training part (its id text is empty). Rows that share a doc_id
are separate rows. Extra columns are ignored. An empty table gives no rows; without training tokens every token has probability 1.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, binary, bounded_batches, column, fold, id_key, ints, slices, typed, written

#: Text whose words and bigrams one segment counts, the least number of segments, and text of a slice.
SHARD_BYTES = 32 << 20
SHARDS = 64
SLICE_BYTES = 4 << 20
#: Bits of a word's or bigram's hash beyond those that number the corpus' bytes: of the different ones not one in 6,000 meets another,
#: far fewer than the filter's false positives. Hashes grow by a bit as segments double, so that their steps take as many bytes.
SPARE_BITS = 10
LEAST_BITS = 40
LEVEL_BITS = 16
#: Keys that go into a filter at once.
TOGETHER = 1 << 18
PROBES = 4
BASE = 1.5
GROWTH = 0.7
#: The end token among words; no word holds white space.
END = b"\n"
#: Odd factors that spread hashes over 64 bits.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * MIX
        return x ^ (x >> np.uint64(29))


class Tokens:
    """The tokens of a slice's texts. word, before, pair: of each token, the places of its word, of the word before (an end before a
    text's first) and of both in the sorted different hashes words and pairs; last: each text's end token."""

    def __init__(self, texts: list[bytes], key_bits: int = 64) -> None:
        numbers = Numbers({END: 0})
        ids, size = array("i"), []
        for x in texts:
            before = len(ids)
            ids.extend(map(numbers.__getitem__, words_of(x)))
            ids.append(0)
            size.append(len(ids) - before)
        self.last = np.cumsum(np.array(size, dtype=np.int64)) - 1
        self.first = self.last + 1 - np.array(size, dtype=np.int64)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers)) >> np.uint64(64 - key_bits)
        del numbers
        self.words, place = np.unique(hashes, return_inverse=True)
        self.word = place.astype(np.int32)[np.frombuffer(ids, dtype=np.int32)]
        del ids
        self.before = np.concatenate([self.word[-1:], self.word[:-1]])
        with np.errstate(over="ignore"):
            keys = self.words[self.before]
            keys *= SPREAD
            keys += self.words[self.word]
        self.pairs, self.pair = placed(mixed(keys) >> np.uint64(64 - key_bits))


def placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different keys, and of each key its place among them."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.empty(len(keys), dtype=np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], at


def packed(values: np.ndarray) -> bytes:
    """Byte planes: the rarely used high ones take next to nothing once compressed."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def steps(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "u8"), dtype=np.uint64)


def sliced(given: DataFrame) -> DataFrame:
    """(slice, d, held, texts, size) of given (d, held, text)."""
    kinds = [("slice", pa.int64()), ("d", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("texts", pa.list_(pa.binary())), ("size", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = binary(batch, "text")
            yield typed([[at], [ints(batch, "d")], [column(batch, "held").to_pylist()], [texts], [sum(map(len, texts)) + len(texts)]], kinds)
            at += 1

    return given.mapInArrow(run, "slice long, d array<long>, held array<boolean>, texts array<binary>, size long")


class Model(NamedTuple):
    """A written model: its segments' rows, the bits of a segment's number and of a key."""

    table: DataFrame
    bits: int
    key_bits: int


def runs(keys: np.ndarray, bits: int, key_bits: int) -> Iterator[tuple[int, slice]]:
    """(segment, its keys) of sorted keys, for the segments that have any."""
    found, first = np.unique((keys >> np.uint64(key_bits - bits)).astype(np.int64), return_index=True)
    return zip(found.tolist(), map(slice, first.tolist(), [*first[1:].tolist(), len(keys)]), strict=True)


def read_slices(batches: Iterator[pa.RecordBatch], key_bits: int) -> Iterator[tuple[int, Tokens, np.ndarray]]:
    """(slice, tokens, which of them are training) of slices (slice, held, texts)."""
    for batch in batches:
        for i in range(batch.num_rows):
            t = Tokens([x.as_py() for x in column(batch, "texts")[i].values], key_bits)
            held = np.array(column(batch, "held")[i].as_py(), dtype=bool)
            yield column(batch, "slice")[i].as_py(), t, np.repeat(~held, t.last - t.first + 1)
            del t  # before the next slice's are made


#: What of a segment a row is: its words with their counts, its filter, or what a slice asks of either.
WORDS, PAIRS = 0, 1
COUNTED = [("shard", pa.int64()), ("kind", pa.int8()), ("keys", pa.binary()), ("n", pa.binary())]


def training_counts(rows: DataFrame, bits: int, key_bits: int) -> DataFrame:
    """(shard, kind, keys, n): of each slice and segment the words' and bigrams' hashes in training, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t, train in read_slices(batches, key_bits):
            for kind, keys, at in ((WORDS, t.words, t.word), (PAIRS, t.pairs, t.pair)):
                n = np.bincount(at[train], minlength=len(keys)).astype(np.uint32)
                keys, n = keys[n > 0], n[n > 0]
                out = [(shard, kind, steps(keys[own]), packed(n[own])) for shard, own in runs(keys, bits, key_bits)]
                if out:
                    yield typed(list(zip(*out, strict=True)), COUNTED)
            del t, train, keys, n, at, out

    return rows.select("slice", "held", "texts").mapInArrow(run, "shard long, kind byte, keys binary, n binary")


def levels(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, 1 + np.floor(np.log(np.maximum(n, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def counted(level: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    return np.where(level > 0, np.ceil(BASE ** (level - 1.0) - 1e-6), 0.0)


class Filter:
    """A log-frequency Bloom filter: a key is a member once for each of its levels."""

    def __init__(self, keys: np.ndarray, level: np.ndarray, level_bits: int = LEVEL_BITS) -> None:
        self.bits = max(64, int(level.sum()) * level_bits)
        self.top = int(level.max(initial=0))
        self.data = np.zeros(-(-self.bits // 8), dtype=np.uint8)
        for at in range(0, len(keys), TOGETHER):
            own, high = keys[at : at + TOGETHER], level[at : at + TOGETHER]
            for j in range(1, int(high.max()) + 1):
                for place in self.places(own[high >= j], j):
                    np.bitwise_or.at(self.data, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))

    def places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            x = mixed(keys * SPREAD)
            first, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
            for i in range(PROBES):
                yield ((first + np.uint64(level * PROBES + i) * step) % np.uint64(self.bits)).astype(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which every probe is a member."""
        out, live = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        for level in range(1, self.top + 1):
            on = np.ones(len(live), dtype=bool)
            for place in self.places(keys[live], level):
                on &= (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            live = live[on]
            out[live] = level
        return out


    @classmethod
    def read(cls, data: bytes) -> Filter:
        out = cls.__new__(cls)
        out.bits, out.top = np.frombuffer(data, "<i8", 2).tolist()
        out.data = np.frombuffer(data, np.uint8, -1, 16)
        return out

    def to_bytes(self) -> bytes:
        return np.array([self.bits, self.top], "<i8").tobytes() + self.data.tobytes()


MODEL = [("shard", pa.int64()), ("kind", pa.int8()), ("keys", pa.binary()), ("data", pa.binary()), *((x, pa.int64()) for x in ("n", "v", "once", "twice"))]
MODEL_SCHEMA = "shard long, kind byte, keys binary, data binary, n long, v long, once long, twice long"


def added_up(keys: list[np.ndarray], n: list[np.ndarray], part: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different keys of sorted arrays and their counts added up, a range of about `part` keys at a time: sorting takes several
    times the memory of what it sorts."""
    parts = max(1, sum(map(len, keys)) // part)
    low, high = int(min(k[0] for k in keys)), int(max(k[-1] for k in keys)) + 1
    bounds = np.array([low + (high - low) * p // parts for p in range(1, parts)], dtype=np.uint64)
    cuts = [[0, *np.searchsorted(k, bounds).tolist(), len(k)] for k in keys]
    found, sums = [], []
    for p in range(parts):
        own = np.concatenate([k[c[p] : c[p + 1]] for k, c in zip(keys, cuts, strict=True)])
        if len(own):
            different, at = placed(own)
            weights = np.concatenate([m[c[p] : c[p + 1]] for m, c in zip(n, cuts, strict=True)])
            found.append(different)
            sums.append(np.bincount(at, weights=weights, minlength=len(different)).astype(np.int64))
    return np.concatenate(found), np.concatenate(sums)


def segments(counts: DataFrame, level_bits: int) -> DataFrame:
    """The model: for each segment a row of its words (keys; data: their counts; its tokens, different words, words seen once and twice) and
    a row of its bigrams (no keys; data: the filter)."""

    def made(shard: int, kind: int, keys: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = added_up(keys, n)
        if kind == WORDS:
            row = [shard, kind, steps(keys), packed(n), int(n.sum()), len(n), int((n == 1).sum()), int((n == 2).sum())]
        else:
            row = [shard, kind, None, Filter(keys, levels(n), level_bits).to_bytes(), 0, 0, 0, 0]
        return typed([[x] for x in row], MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, keys, n = None, [], []
        for batch in batches:
            for shard, kind, k, m in zip(*(column(batch, x) for x, _ in COUNTED), strict=True):
                now = (shard.as_py(), kind.as_py())
                if keys and now != label:
                    yield made(*label, keys, n)
                    keys, n = [], []
                label = now
                keys.append(from_steps(k.as_py()))
                n.append(unpacked(m.as_py(), "u4"))
        if keys:
            yield made(*label, keys, n)

    return counts.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, MODEL_SCHEMA)


ASKED = [("shard", pa.int64()), ("kind", pa.int8()), ("slice", pa.int64()), ("keys", pa.binary()), ("data", pa.binary())]
TOLD = [("slice", pa.int64()), ("kind", pa.int8()), ("shard", pa.int64()), ("told", pa.binary())]


def answered(rows: DataFrame, model: Model) -> DataFrame:
    """(slice, kind, shard, told): for each slice and segment that it asks, the words' counts or the bigrams' levels. A segment's model comes
    first in the stream of its questions, so that no more than that and one question is held."""

    bits, key_bits = model.bits, model.key_bits

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, t, _ in read_slices(batches, key_bits):
            for kind, keys in ((WORDS, t.words), (PAIRS, t.pairs)):
                out = [(shard, kind, name, steps(keys[own]), None) for shard, own in runs(keys, bits, key_bits)]
                yield typed(list(zip(*out, strict=True)), ASKED)
            del t, keys, out

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, counts, filter_ = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        for batch in batches:
            out = []
            for shard, kind, name, keys, data in zip(*(column(batch, x).to_pylist() for x, _ in ASKED), strict=True):
                if (shard, kind) != at:
                    at, known, counts, filter_ = (shard, kind), np.zeros(0, np.uint64), np.zeros(0, np.int64), None
                if name is None and kind == WORDS:
                    known, counts = from_steps(keys), unpacked(data, "i8")
                elif name is None:
                    filter_ = Filter.read(data)
                elif kind == WORDS:
                    asked = from_steps(keys)
                    place = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
                    found = np.where(known[place] == asked, counts[place], 0) if len(known) else np.zeros(len(asked), np.int64)
                    out.append((name, kind, shard, packed(found)))
                else:
                    asked = from_steps(keys)
                    out.append((name, kind, shard, (filter_.level(asked) if filter_ else np.zeros(len(asked))).astype(np.uint8).tobytes()))
            if out:
                yield typed(list(zip(*out, strict=True)), TOLD)

    schema = "shard long, kind byte, slice long, keys binary, data binary"
    questions = rows.select("slice", "held", "texts").mapInArrow(ask, schema)
    both = questions.unionByName(model.table.select("shard", "kind", F.lit(None).cast("long").alias("slice"), "keys", "data"))
    dealt = both.repartition("shard").sortWithinPartitions("shard", "kind", F.asc_nulls_first("slice"))
    return dealt.mapInArrow(tell, "slice long, kind byte, shard long, told binary")


def word_probabilities(c: np.ndarray, n: int, v: int, once: int, twice: int) -> np.ndarray:
    """Of words seen c times in training; of n tokens, v different ones; those never seen share one event."""
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    return np.where(c > 0, c - discount, discount * v) / n


def probabilities(seen: np.ndarray, context: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of words of probability p, seen so often behind a context seen `context` times."""
    b = np.where(context > 0, context**GROWTH, 1.0)
    return np.minimum((seen + b * p) / (context + b), 1.0)


SCORES = [("d", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def in_slices(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """A corpus' slices, a written table."""
    given = docs.select(id_key().alias("d"), (fold() % folds == held).alias("held"), F.col("text").cast("string").alias("text"))
    return written(sliced(given), "lm-slices", SLICE_BYTES)


def fitted(rows: DataFrame, level_bits: int = LEVEL_BITS) -> Model:
    size = rows.agg(F.sum("size")).first()[0] or 0
    bits = (max(SHARDS, -(-size // SHARD_BYTES)) - 1).bit_length()
    key_bits = min(64, max(LEAST_BITS, SPARE_BITS + size.bit_length()))
    return Model(written(segments(training_counts(rows, bits, key_bits), level_bits), "lm-model", SLICE_BYTES), bits, key_bits)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """The scores of slices under a model that these or other slices were fitted to."""
    n, v, once, twice = (int(x or 0) for x in model.table.agg(*[F.sum(x) for x in ("n", "v", "once", "twice")]).first())
    whole, key_bits = n + 0.5 * (v + 1), model.key_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = Tokens([x.as_py() for x in column(batch, "texts")[i].values], key_bits)
                told = sorted(column(batch, "told")[i].as_py(), key=lambda x: (x["kind"], x["shard"]))
                c = np.concatenate([unpacked(x["told"], "i8") for x in told if x["kind"] == WORDS])
                seen = counted(np.frombuffer(b"".join(x["told"] for x in told if x["kind"] == PAIRS), np.uint8).astype(np.int64))
                known = np.add.reduceat((c > 0).astype(np.int64)[t.word], t.first)
                base = np.add.reduceat(np.log10((c + 0.5) / whole)[t.word], t.first)
                score = np.zeros(len(t.last))
                if n:
                    p = probabilities(seen[t.pair], c[t.before].astype(float), word_probabilities(c, n, v, once, twice)[t.word])
                    score = np.add.reduceat(np.log10(p), t.first)
                yield typed([column(batch, "d")[i].values, column(batch, "held")[i].values, t.last - t.first + 1, known, base, score], SCORES)
                t = told = c = seen = p = None  # before the next slice's are made

    told = answered(rows, model).groupBy("slice").agg(F.collect_list(F.struct("kind", "shard", "told")).alias("told"))
    joined = rows.join(told, "slice").select("d", "held", "texts", "told")
    out = joined.mapInArrow(run, "d long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, folds: int = 5, held: int = 1, level_bits: int = LEVEL_BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; level_bits: the filter's bits for each level."""
    bounded_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))  # a slice or so at a time
    rows = in_slices(docs, folds, held)
    return scored(rows, fitted(rows, level_bits))
