"""Best-fit packing: pattern packing by non-negative least squares.

Patterns are the multisets of up to three lengths that fill a sequence. Non-negative least squares finds how often to repeat each so
that the repeats explain the length histogram; rounded and cut to what is there they take most pieces, and the residual histogram is
packed best-fit decreasing. Of a few roundings the best one stands. All of that sees the histogram alone (max_tokens numbers), whatever the number of documents.

Pieces find their places without a global sort: a task numbers its pieces of each length, sums over the tasks' counts make the
numbers global, and the plan maps a (length, number) to a sequence and an offset.

Nulls: a null text is empty, so its document is the end token alone. A null doc_id stays null. Rows that share a doc_id are documents
of their own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, column, id_key, ints, slices, typed, written

MAX_TOKENS = 1024
END = 2
#: From these parts of a repeat on, patterns are tried once more after rounding down; 2 never.
ROUNDINGS = (2.0, 0.5, 0.05)
#: Texts with so many white-space characters in a row are encoded by the tokenizer file's own library.
LONG_SPACE = 1000


@cache
def encoder(path: str):
    """The ids that the library tokenizers gives for a text under its file's own settings, without added special tokens.

    Where the same vocabulary lies beside the file as ranks (.tiktoken), that encoder gives the same ids in an eighth of the time: the
    merges, the pattern's character classes and the file's added tokens are the same (tests/llm compares them). Its pattern gives up on
    long runs of white space, so texts with runs of LONG_SPACE, and texts that it refuses, go to the file's own tokenizer.
    """
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    with open(path, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
    long_space = re.compile(r"\s{%d}" % LONG_SPACE)

    def fast(text: str) -> np.ndarray:
        if long_space.search(text):
            return slow(text)
        try:
            return np.asarray(own.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        except ValueError:
            return slow(text)

    return fast


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = [("d", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("block", pa.int64()), ("number", pa.int64()), ("ids", pa.binary())]


def pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end: int = END, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: only documents over max_tokens are cut, into pieces of max_tokens, the first one with what is left over.

    block, number: the task and the count of its earlier pieces of this length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(max_tokens + 1, dtype=np.int64)
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in PIECES]
            for doc, text in zip(ints(batch, "d").tolist(), column(batch, "text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % max_tokens or max_tokens
                cuts = [0, *range(first, len(ids) + 1, max_tokens)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    for x, v in zip(out, (doc, k, a, b - a, zlib.crc32(raw), block, int(seen[b - a]), raw if keep_ids else None), strict=True):
                        x.append(v)
                    seen[b - a] += 1
            yield typed(out, PIECES)

    shape = "d long, piece int, start long, length int, ids_crc32 long, block long, number long, ids binary"
    return docs.select(id_key().alias("d"), F.col("text").cast("string").alias("text")).mapInArrow(run, shape)


def patterns(most: int) -> np.ndarray:
    """Rows of up to three lengths that add up to most, in falling order, filled up with zeros."""
    rows = [np.array([[most, 0, 0]])]
    a = np.arange((most + 1) // 2, most)
    rows.append(np.stack([a, most - a, 0 * a], axis=1))
    for x in range((most + 2) // 3, most - 1):
        y = np.arange((most - x + 1) // 2, min(x, most - x - 1) + 1)
        rows.append(np.stack([0 * y + x, y, most - x - y], axis=1))
    return np.concatenate(rows)


def fit(table: np.ndarray, histogram: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: repeats of the patterns that explain the histogram."""
    n = len(histogram)
    target = histogram.astype(float).copy()
    target[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(table[:, k], weights=x, minlength=n) for k in range(table.shape[1]))
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[table].sum(axis=1)

    v = np.ones(len(table))
    for _ in range(20):
        v = back(forward(v))
        norm = float(np.linalg.norm(v))
        v /= norm
    x = np.zeros(len(table))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(forward(y) - target) / (1.01 * norm))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def plan(histogram: np.ndarray, max_tokens: int = MAX_TOKENS) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, times), ...], repeats), ...]: sequences that hold every piece of the histogram (index: length) just once.

    The fitted repeats are rounded in several ways; the one with the fewest sequences after its residual is packed stands."""
    left = histogram.astype(np.int64).copy()
    whole = [([(max_tokens, 1)], int(left[max_tokens]))] if left[max_tokens] else []
    left[max_tokens] = 0
    if not left.any():
        return whole
    table = patterns(max_tokens)
    repeats = fit(table, left)
    return whole + min((_rounded(table, repeats, left, up, max_tokens) for up in ROUNDINGS), key=lambda made: sum(n for _, n in made))


def _rounded(table: np.ndarray, repeats: np.ndarray, histogram: np.ndarray, up: float, max_tokens: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Repeats rounded down first, strongest patterns first; then those of `up` or more once again where pieces are left."""
    left, out = histogram.copy(), []
    order = np.argsort(-repeats, kind="stable")
    for down in (True, False):
        for i in order[: int((repeats >= (1 if down else up)).sum())]:
            times: dict[int, int] = defaultdict(int)
            for length in table[i].tolist():
                if length:
                    times[length] += 1
            n = min(int(repeats[i]) if down else 1, *(int(left[a]) // m for a, m in times.items()))
            if n > 0:
                out.append((list(times.items()), n))
                for a, m in times.items():
                    left[a] -= n * m
    return out + best_fit(left, max_tokens)


def best_fit(left: np.ndarray, max_tokens: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing over a histogram: equal sequences are handled together."""
    rooms: dict[int, dict[tuple[tuple[int, int], ...], int]] = defaultdict(dict)

    def put(room: int, content: tuple[tuple[int, int], ...], n: int) -> None:
        if n:
            rooms[room][content] = rooms[room].get(content, 0) + n

    for length in range(len(left) - 1, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, max_tokens) if rooms.get(r)), max_tokens)
            each = room // length
            if room == max_tokens:
                content, there = (), -(-n // each)
            else:
                content, there = rooms[room].popitem()
            full = min(there, n // each)
            put(room - each * length, (*content, (length, each)), full)
            n -= full * each
            there -= full
            if n and there:
                some = min(n, each)
                put(room - some * length, (*content, (length, some)), 1)
                n -= some
                there -= 1
            if room != max_tokens:
                put(room, content, there)
    return [(list(content), n) for contents in rooms.values() for content, n in contents.items()]


def slots(made: list[tuple[list[tuple[int, int]], int]], max_tokens: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first number, the first sequence and the offset of its runs of places, by rising number."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for content, n in made:
        offset = 0
        for length, times in content:
            for _ in range(times):
                found[length].append((used[length], sequence, offset))
                used[length] += n
                offset += length
        sequence += n
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def pack(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for every piece; ids: little-endian unsigned 32-bit."""
    cut = written(pieces(docs, path or tokenizer_path(), max_tokens, end, keep_ids), "pieces")
    counts = cut.groupBy("length", "block").agg((F.max("number") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("length").alias("l"), F.col("block").alias("b"), "n", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = np.zeros(max_tokens + 1, dtype=np.int64)
    for length, n in counts.groupBy("l").agg(F.sum("n")).collect():  # max_tokens rows at most
        histogram[length] = n
    shared = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, max_tokens), max_tokens))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            length, number = ints(batch, "length"), ints(batch, "number") + ints(batch, "before")
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                rows = length == x
                first, sequences, offsets = where[x]
                at = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows] = sequences[at] + number[rows] - first[at]
                offset[rows] = offsets[at]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = ["d", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    shape = "d long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * keep_ids + "sequence_id long, offset long"
    joined = cut.join(counts, (F.col("length") == F.col("l")) & (F.col("block") == F.col("b"))).withColumn("length", F.col("length").cast("long"))
    out = joined.select(*kept, "number", "before").mapInArrow(place, shape)
    return out.select(F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id"), *kept[1:5], "sequence_id", "offset", *["ids"] * keep_ids)
