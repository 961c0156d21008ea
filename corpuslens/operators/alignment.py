"""Word streams held against each other: where two versions of a text differ, error rates, corrections that go too far, keys that moved.

Two streams are aligned like this. Words that stand once in each are anchors; the longest chain of anchors in both orders is kept, and each
anchor of it begins a piece. Inside a piece the words that both share are a longest common subsequence, the one that a walk from the start
gives which takes equal words wherever they meet and else drops a word of the first stream if nothing is lost by it, otherwise one of the
second. What lies between shared words are the differences; as a piece begins with a shared word, none crosses pieces, and pieces are
aligned on their own."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import bounded_batches, checkpointed

#: Anchors of a pair that are looked at, at most (those of the smallest hashes), so that a pair's chain fits into one task at any length.
ANCHORS = 1 << 20
#: Words of a pair that are aligned in one row; longer pairs are cut into pieces by joins.
TOGETHER = 200_000
#: Places of a bucket of the pieces' join.
BUCKET = 4096

DIFFERENCE = "tag string, a_from long, a_to long, b_from long, b_to long, n_a long, n_b long, ours array<string>, theirs array<string>"
_TYPES = [pa.string(), *[pa.int64()] * 6, pa.list_(pa.string()), pa.list_(pa.string())]
_NAMES = ["tag", "a_from", "a_to", "b_from", "b_to", "n_a", "n_b", "ours", "theirs"]


def increasing(values: list[int]) -> list[int]:
    """The places of a longest strictly increasing run of values that needn't be neighbours, by patience sorting."""
    tails, at, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def shared_walk(a: list, b: list) -> list[tuple[int, int]]:
    """The pairs of places of a and b's longest common subsequence that the walk from the start takes.

    Rows of the table of lengths are bit vectors in Python's integers, a bit for each word of b (Hyyro's recurrence, from the end of a): a zero
    among the lowest bits counts one. Every sqrt(n)-th row is kept and the rows between are made again as the walk comes to them, so that
    memory is sqrt(n) rows of len(b) bits."""
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    a, b, n, m = a[head:], b[head:], n - head, m - head
    out = [(i, i) for i in range(head)]
    if not n or not m:
        return out
    masks: dict = {}
    for j, w in enumerate(reversed(b)):
        masks[w] = masks.get(w, 0) | 1 << j
    full = (1 << m) - 1

    def rows(v: int, first: int, last: int) -> list[int]:
        """The rows of the suffixes of a with first to last words, from the row before, v."""
        made = []
        for k in range(first, last + 1):
            u = v & masks.get(a[n - k], 0)
            v = (v + u | v - u) & full
            made.append(v)
        return made

    step = max(1, int(n**0.5))
    marks, v = [full], full
    for first in range(1, n + 1, step):
        v = rows(v, first, min(n, first + step - 1))[-1]
        marks.append(v)
    held: list[int] = []
    low = n + 1  # held has the rows low, low + 1, ...

    def row(k: int) -> int:
        nonlocal held, low
        if k == 0:
            return full
        if k < low:
            low = (k - 1) // step * step + 1
            held = rows(marks[(k - 1) // step], low, min(n, low + step - 1))
        return held[k - low]

    length = m - row(n).bit_count()
    i = j = 0
    while length:
        if a[i] == b[j]:
            out.append((i + head, j + head))
            i, j, length = i + 1, j + 1, length - 1
            continue
        left = m - j
        rest = row(n - i - 1) & ((1 << left) - 1)
        if left - rest.bit_count() == length:
            i += 1
        else:
            j += 1
    return out


def differences_of(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> list[tuple]:
    """The differences of two pieces of (place, word), as rows of DIFFERENCE; places needn't be neighbours."""
    both = shared_walk([w for _, w in a], [w for _, w in b])
    out, i, j = [], 0, 0
    for x, y in [*both, (len(a), len(b))]:
        if x > i or y > j:
            ours, theirs = a[i:x], b[j:y]
            tag = "replace" if ours and theirs else "delete" if ours else "insert"
            ends = lambda part: (part[0][0], part[-1][0]) if part else (None, None)
            out.append((tag, *ends(ours), *ends(theirs), len(ours), len(theirs), [w for _, w in ours], [w for _, w in theirs]))
        i, j = x + 1, y + 1
    return out


def chain_of(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of anchors (place in a, place in b)."""
    anchors = sorted(anchors)
    return [anchors[i] for i in increasing([y for _, y in anchors])]


def in_both_orders(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest chain of anchors that are in the order of `at`; where they are in both orders that is all of them."""
    if (to[1:] > to[:-1]).all():
        return at, to
    kept = increasing(to.tolist())
    return at[kept], to[kept]


def whole_differences(a: list[str], b: list[str]) -> list[tuple]:
    """The differences of two streams that fit into one task."""
    both = pa.array([*a, *b], pa.string()).dictionary_encode(null_encoding="encode").indices.to_numpy()
    return numbered_differences(both[: len(a)], both[len(a) :], a.__getitem__, b.__getitem__)


def numbered_differences(a: np.ndarray, b: np.ndarray, ours: Callable, theirs: Callable) -> list[tuple]:
    """The differences of two streams of words' numbers; ours and theirs name the words of a place or of a slice of places. Pieces that are the
    same in both are passed over at once: they have no differences."""
    top = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    once = (np.bincount(a, minlength=top) == 1) & (np.bincount(b, minlength=top) == 1)
    place = np.zeros(top, dtype=np.int64)
    place[b] = np.arange(len(b))
    at = np.flatnonzero(once[a])
    at, to = in_both_orders(at, place[a[at]])
    low_a, low_b = np.concatenate([[0], at]), np.concatenate([[0], to])
    high_a, high_b = np.concatenate([at, [len(a)]]), np.concatenate([to, [len(b)]])
    piece = np.repeat(np.arange(len(low_a)), high_a - low_a)
    other = np.arange(len(a)) + (low_b - low_a)[piece]
    same = (high_a - low_a) == (high_b - low_b)
    wrong = ~same[piece]
    wrong[~wrong] = a[~wrong] != b[other[~wrong]]
    out = []
    for p in np.flatnonzero(~same | (np.bincount(piece[wrong], minlength=len(low_a)) > 0)).tolist():
        i, k, j, m = int(low_a[p]), int(high_a[p]), int(low_b[p]), int(high_b[p])
        x, y = a[i:k].tolist(), b[j:m].tolist()
        u = v = 0
        for s, t in [*shared_walk(x, y), (len(x), len(y))]:
            if s > u or t > v:
                tag = "replace" if s > u and t > v else "delete" if s > u else "insert"
                ends = [(i + u, i + s - 1) if s > u else (None, None), (j + v, j + t - 1) if t > v else (None, None)]
                out.append((tag, *ends[0], *ends[1], s - u, t - v, ours(slice(i + u, i + s)), theirs(slice(j + v, j + t))))
            u, v = s + 1, t + 1
    return out


def _batch(key: pa.Array, rows: list[list[tuple]], name: str) -> pa.RecordBatch:
    """The rows of several keys: their keys repeated beside them."""
    at = pa.array([i for i, r in enumerate(rows) for _ in r], pa.int32())
    flat = [x for r in rows for x in r]
    columns = [pa.array([x[k] for x in flat], t) for k, t in enumerate(_TYPES)]
    return pa.RecordBatch.from_arrays([key.take(at), *columns], [name, *_NAMES])


def differences(pairs: DataFrame, key: str, together: int = TOGETHER, written: bool = False) -> DataFrame:
    """(key, tag, a_from, a_to, b_from, b_to, n_a, n_b, ours, theirs) of pairs (key, a, b) of word lists, one row for each key: a row for each
    difference with the first and last place of either side (null where it has none). A null list is an empty one. Pairs of up to
    `together` words are aligned where they lie; longer ones are exploded into words and aligned by pieces. written: pairs is a table already."""
    kind = pairs.schema[key].dataType.simpleString()
    size = F.coalesce(F.size("a"), F.lit(0)) + F.coalesce(F.size("b"), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(batch.column(k), batch.column(k).offsets.to_numpy()) for k in (1, 2)]
            found = []
            for i in range(batch.num_rows):
                a, b = (own.values[int(at[i]) : int(at[i + 1])] if own[i].is_valid else own.values[:0] for own, at in sides)
                both = pa.concat_arrays([a, b]).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                found.append(numbered_differences(both[: len(a)], both[len(a) :], *(lambda s, x=x: x[s].to_pylist() for x in (a, b))))
            if found:
                yield _batch(batch.column(0), found, key)

    bounded_batches(pairs.sparkSession)
    # both kinds of pairs are cut from one written table, so that the lists are made once
    pairs = pairs if written else checkpointed(pairs.select(key, "a", "b"))
    small = pairs.where(size <= together).select(key, "a", "b").mapInArrow(run, f"{key} {kind}, {DIFFERENCE}")
    long = pairs.where(size > together)
    if long.isEmpty():
        return small
    words = lambda side: long.select(F.col(key).alias("key"), F.posexplode(side).alias("at", "word"))
    return small.unionByName(stream_differences(words("a"), words("b")).withColumnRenamed("key", key))


def anchors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, at, to) of streams (key, at, word): the words that stand once in either, ANCHORS of a key at most, by their hashes."""
    one = lambda df, name: df.groupBy("key", "word").agg(F.count("*").alias("n"), F.min("at").alias(name)).where("n = 1").drop("n")
    met = checkpointed(one(a, "at").join(one(b, "to"), ["key", "word"]).select("key", "at", "to", F.xxhash64("word").alias("h")))
    many = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > ANCHORS)
    limit = many.select("key", (F.lit(ANCHORS) / F.col("n")).alias("share"))  # keys with over ANCHORS anchors: few
    upper = (F.shiftrightunsigned("h", 11) / F.lit(2.0**53)) < F.coalesce("share", F.lit(1.0))
    return met.join(limit, "key", "left").where(upper).select("key", "at", "to")


def stream_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, tag, a_from, a_to, ...) of streams (key, at, word) of any length: the words are rows throughout, a key's anchors go through one
    task to be chained, and a piece's words through one to be aligned. Places needn't be neighbours."""
    a, b = (checkpointed(x.select("key", F.col("at").cast("long").alias("at"), "word").where("word is not null")) for x in (a, b))
    kind = a.schema["key"].dataType.simpleString()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chain = chain_of([(x["at"], x["to"]) for x in batch.column(1)[i].as_py()])
                columns = [batch.column(0).slice(i, 1).take(pa.array([0] * len(chain), pa.int32())), pa.array(range(1, len(chain) + 1), pa.int64())]
                columns += [pa.array([x[k] for x in chain], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "at", "to"])

    groups = anchors(a, b).groupBy("key").agg(F.collect_list(F.struct("at", "to")).alias("x"))
    chain = checkpointed(groups.mapInArrow(chained, f"key {kind}, piece long, at long, to long"))
    after = chain.select("key", (F.col("piece") - 1).alias("piece"), F.col("at").alias("next_at"), F.col("to").alias("next_to"))
    # piece 0 begins before all words of a key; the last one has no end
    firsts = a.select("key").union(b.select("key")).distinct().select("key", F.lit(0).cast("long").alias("piece"), F.lit(-1).cast("long").alias("at"), F.lit(-1).cast("long").alias("to"))
    pieces = checkpointed(chain.unionByName(firsts).join(after, ["key", "piece"], "left"))
    last = a.groupBy("key").agg(F.max("at").alias("end_a")).join(b.groupBy("key").agg(F.max("at").alias("end_b")), "key", "full")
    pieces = pieces.join(last, "key")

    def placed(words: DataFrame, side: int, start: str, stop: str, end: str) -> DataFrame:
        """(key, piece, x): words with their piece; each piece stands in the buckets of places that it covers."""
        upto = F.coalesce(F.col(stop), F.coalesce(end, F.lit(-1)) + 1)
        spans = pieces.select("key", "piece", F.greatest(F.col(start), F.lit(0)).alias("lo"), upto.alias("hi")).where("hi > lo")
        spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / BUCKET), F.floor((F.col("hi") - 1) / BUCKET))))
        met = words.withColumn("bucket", F.floor(F.col("at") / BUCKET)).join(spans, ["key", "bucket"]).where("at >= lo and at < hi")
        return met.select("key", "piece", F.struct(F.lit(side).alias("side"), "at", "word").alias("x"))

    both = placed(a, 0, "at", "next_at", "end_a").unionByName(placed(b, 1, "to", "next_to", "end_b"))
    whole = both.groupBy("key", "piece").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1).to_pylist():
                part = lambda side: [(w["at"], w["word"]) for w in x if w["side"] == side]  # noqa: B023, E731
                rows.append(differences_of(part(0), part(1)))
            yield _batch(batch.column(0), rows, "key")

    return whole.select("key", "x").mapInArrow(run, f"key {kind}, {DIFFERENCE}")


def words(text: Column) -> Column:
    """A text's words between white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "\\s+"), "")


def error_rates(pairs: DataFrame, key: str, **how) -> DataFrame:
    """(key, n, substituted, deleted, inserted, rate) of pairs (key, a, b): a the reference's words, b those heard. Of a difference as many words
    are substituted as both sides have; the rate is of a's words, or of one where a has none."""
    a, b = F.col("n_a"), F.col("n_b")
    pairs = checkpointed(pairs.select(key, "a", "b"))
    found = differences(pairs, key, written=True, **how).groupBy(key).agg(F.sum(F.least(a, b)).alias("substituted"), F.sum(F.greatest(a - b, F.lit(0))).alias("deleted"), F.sum(F.greatest(b - a, F.lit(0))).alias("inserted"))
    all_ = pairs.select(key, F.coalesce(F.size("a"), F.lit(0)).cast("long").alias("n"))
    out = all_.join(found, key, "left").na.fill(0, ["substituted", "deleted", "inserted"])
    wrong = F.col("substituted") + F.col("deleted") + F.col("inserted")
    return out.withColumn("rate", wrong / F.greatest(F.col("n"), F.lit(1)))


def word_changes(pairs: DataFrame, key: str, **how) -> DataFrame:
    """(key, kind, a_from, b_from, ours, theirs): a page's differences as a reader is told them: added, or changed."""
    kind = F.when(F.col("tag") == "insert", "added").otherwise("changed")
    return differences(pairs, key, **how).select(key, kind.alias("kind"), "a_from", "b_from", "ours", "theirs")


def disputes(pairs: DataFrame, key: str, fillers: tuple[str, ...], most: int = 12, **how) -> DataFrame:
    """(key, a_from, b_from, ours, theirs): places where two engines heard different words, fillers and signs aside. A run of over `most` words on
    one side is a slip of the alignment, not a word to settle. Places are those among the words that count."""
    plain = lambda c: F.filter(F.transform(F.col(c), lambda w: F.regexp_replace(F.lower(w), "[^\\p{L}\\p{N}']", "")), lambda w: (w != "") & ~w.isin(*fillers))
    found = differences(pairs.select(key, plain("a").alias("a"), plain("b").alias("b")), key, **how)
    return found.where((F.col("n_a") <= most) & (F.col("n_b") <= most)).select(key, "a_from", "b_from", "ours", "theirs")


def guard(pairs: DataFrame, key: str, least: int = 3, long: int = 20, keep: float = 0.9, **how) -> DataFrame:
    """(key, changed, allowed, problem) of pairs (key, a, b, disputed): what a correction b of a may not do. It may change twice the disputed
    words, `least` at least (the longer side of a difference counts), and must keep 90 % of `long` words or more."""
    found = differences(pairs, key, **how).groupBy(key).agg(F.sum(F.greatest("n_a", "n_b")).alias("changed"), F.sum("n_a").alias("lost"))
    n = F.coalesce(F.size("a"), F.lit(0))
    rows = pairs.select(key, n.alias("n"), F.greatest(2 * F.coalesce("disputed", F.lit(0)), F.lit(least)).cast("long").alias("allowed"))
    rows = rows.join(found, key, "left").na.fill(0, ["changed", "lost"])
    kept_few = (F.col("n") >= long) & (F.col("n") - F.col("lost") < keep * F.col("n"))
    problem = F.when(F.col("changed") > F.col("allowed"), "changed too many words").when(kept_few, "kept too few words")
    return rows.select(key, "changed", "allowed", problem.alias("problem"))


def _grouped(rows: DataFrame, key: str, schema: str, run) -> DataFrame:
    """rows (key, x list) through run(list) -> tuple, one row each."""
    kind = rows.schema[key].dataType.simpleString()
    types = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [run(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([m[k] for m in made], f.type) for k, f in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *types.names])

    return rows.select(key, "x").mapInArrow(each, f"{key} {kind}, {schema}")


def moved_keys(before: DataFrame, after: DataFrame, group: str, name: str, place: str) -> DataFrame:
    """(group, common, moved) of orders (group, name, place) of two builds: of the names in both, how many must move to turn one order into the
    other, which is all but a longest run in the same order. A group is a list that readers see; names are unique in it."""
    new = after.select(group, name, F.col(place).alias("to"))
    both = before.join(new, [group, name]).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, "to"))), lambda x: x["to"]).alias("x"))
    return _grouped(both, group, "common long, moved long", lambda x: (len(x), len(x) - len(increasing(x))))


def ascending(marks: list[tuple[int, int]], gap: int) -> list[int]:
    """The places of a longest chain of marks (place, value) whose values go up by 1 to gap from one to the next, marks between left out; of
    equally long ones that which ends first, by the earliest marks. For each value only the best chain that ends in it is kept."""
    best: dict[int, tuple[int, int]] = {}
    before = [-1] * len(marks)
    top = (0, 0)
    for i, (_, v) in enumerate(marks):
        size, last = min((best[v - d] for d in range(1, gap + 1) if v - d in best), key=lambda x: (-x[0], x[1]), default=(0, -1))
        before[i] = last
        if size + 1 > best.get(v, (0, 0))[0]:
            best[v] = (size + 1, i)
        if size + 1 > top[0]:
            top = (size + 1, i)
    out, i = [], top[1] if top[0] else -1
    while i >= 0:
        out.append(marks[i][0])
        i = before[i]
    return out[::-1]


#: Signs around a page number.
EDGE_SIGNS = "[-\\u2013\\u2014/|\\s.]"
EDGE = f"^{EDGE_SIGNS}+|{EDGE_SIGNS}+$"


def page_number(line: Column) -> Column:
    """The number of a line that is only a page number ("12", "12 / 340", "12 of 340", with signs around), else null."""
    bare = F.regexp_replace(line, EDGE, "")
    number = F.regexp_extract(bare, "^(?i)([0-9]{1,5})(?:\\s*(?:/|of)\\s*[0-9]{1,5})?$", 1)
    return F.when(line.rlike(f"^{EDGE_SIGNS}*+[0-9]") & (F.length(bare) <= 12) & (number != ""), number.cast("long"))


def folios(texts: DataFrame, key: str, gap: int = 3, least: int = 5, share: float = 0.3) -> DataFrame:
    """(key, lines, numbers, longest, places) of texts (key, text): a text's lines, how many of them are a page number alone, how long their
    longest ascending chain is, and the 0-based lines of it if it is a pagination: `least` long and over `share` of the text. Lines are
    told apart in the JVM, where the text lies; only the numbers reach the chain."""
    return _folios(_number_lines(texts, key), key, gap, least, share)


def paginations(texts: DataFrame, key: str, gap: int = 3, least: int = 5, share: float = 0.3) -> DataFrame:
    """(key, places) of the texts with a pagination; those with fewer numbers than it takes reach no chain."""
    rows = _number_lines(texts, key).where(F.size("x.m") >= least)
    return _folios(rows, key, gap, least, share).where(F.size("places") > 0).select(key, "places")


def _number_lines(texts: DataFrame, key: str) -> DataFrame:
    """(key, x): how many lines a text has, and which of them are a page number alone."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), page_number(x).alias("value"))), lambda m: m["value"].isNotNull())
    return texts.select(key, F.struct(F.size(lines).cast("long").alias("lines"), marks.alias("m")).alias("x"))


def _folios(rows: DataFrame, key: str, gap: int, least: int, share: float) -> DataFrame:
    def run(x: dict) -> tuple:
        chain = ascending([(m["at"], m["value"]) for m in x["m"]], gap)
        runs = len(chain) >= least and chain[-1] - chain[0] >= share * x["lines"]
        return x["lines"], len(x["m"]), len(chain), chain if runs else []

    return _grouped(rows, key, "lines long, numbers long, longest long, places array<int>", run)
