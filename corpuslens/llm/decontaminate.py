"""Benchmark decontamination: a distributed positional inverted index over the training texts.

1. `build_index` turns every run of documents of about 4 MB into one index row: for each word that some query holds, its sorted
   positions (as differences), and the documents' ids and sizes. Every document gets a row id there, once for all queries. The rows
   are a written table; their lists are read again, never the texts.
2. The words' frequencies over all index rows order each query's words from the rarest on.
3. `Postings.phrases` takes the postings of a phrase's rarest word and intersects them with the offset-adjusted postings of the next
   ones, for all phrases at once. `phrase_matches` and `proximity_matches` return the places, `contamination` the shares of hit words.

Queries are broadcast in blocks of about QUERY_BYTES of text, each against the same index; what the blocks find meets by the documents'
row ids. Long items are cut into parts that overlap by a window less a word, so no item is too large for a block. The words that the
index keeps are broadcast as 64-bit hashes, up to TERMS of them; with more different words in the queries the index keeps every word.

Nulls: a null text has no words. An item with a null item_id hits words like any other and is listed nowhere; one without words hits
nothing. Rows that share a doc_id are separate rows; a null doc_id comes back as null. Items that share an item_id count as one item
with the windows of all. Extra columns are ignored. An empty table gives no rows; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, binary, column, id_key, ints, slices, typed, written

WINDOW = 13
#: Text of one block of queries: at most about 60 bytes of arrays for each of its words are broadcast.
QUERY_BYTES = 2 << 20
#: Words of one part of a long item, its overlap with the next part aside.
PART_WORDS = 20_000
#: Different words of all queries that are broadcast (8 bytes each).
TERMS = 4 << 20
#: Candidate places that are intersected at once.
CHUNK = 1 << 20
#: Bytes outside words become spaces, A-Z lower case: words are [0-9a-z] and everything from U+0080 on.
TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class _Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n

    def hashes(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w) for w in self], dtype=np.uint64).view(np.int64)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted values in sorted_, -1 where they are missing."""
    if not len(sorted_):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


class Phrases:
    """Phrases of up to `width` words: every window of that many consecutive words of an item, or a shorter item as a whole; each
    different phrase once, with the ids of its items."""

    def __init__(self, items: list[tuple[int | None, bytes]], width: int) -> None:
        numbers, windows, of = _Numbers(), [], []
        for item, text in items:
            ids = np.array(list(map(numbers.__getitem__, words_of(text))), dtype=np.int32)
            if len(ids):
                if len(ids) < width:
                    ids = np.append(ids, np.full(width - len(ids), -1, dtype=np.int32))
                found = np.lib.stride_tricks.sliding_window_view(ids, width)
                windows.append(found)
                of.append(np.full(len(found), NULL_ID if item is None else item, dtype=np.int64))
        self.width = width
        self.terms = numbers.hashes()
        self.words, same = np.zeros((0, width), dtype=np.int32), np.zeros(0, dtype=np.int64)
        if windows:
            self.words, same = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        self.length = (self.words >= 0).sum(axis=1)
        item = np.concatenate(of) if of else np.zeros(0, dtype=np.int64)
        named = np.unique(np.stack([same.reshape(-1), item], axis=1)[item != NULL_ID], axis=0)
        self.ids = named[:, 1]
        self.first = np.searchsorted(named[:, 0], np.arange(len(self.words) + 1))

    def ordered(self, frequency: np.ndarray) -> None:
        """From now on each phrase's words are taken from the rarest on."""
        count = np.where(self.words >= 0, np.append(frequency, 0)[self.words], np.iinfo(np.int64).max)
        self.order = np.argsort(count, axis=1, kind="stable").astype(np.int16)

    def named(self, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into phrase, item id) of all items of the given phrases."""
        n = self.first[phrase + 1] - self.first[phrase]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[phrase], n)
        return np.repeat(np.arange(len(phrase)), n), self.ids[at]


KINDS = [("rid", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("positions", pa.binary())]
INDEX = "rid long, docs array<long>, sizes array<int>, terms array<long>, counts array<int>, positions binary"


def build_index(docs: DataFrame, terms: np.ndarray | None) -> DataFrame:
    """One row for each run of documents: their ids and sizes, and the positions of each term. terms: sorted hashes of the words to
    keep; None: all. The documents' row ids count from rid on."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, rid = shared.value, TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            words = [words_of(x) for x in binary(batch, "text")]
            sizes = np.array([len(x) for x in words], dtype=np.int32)
            numbers = _Numbers()
            local = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
            hashes = numbers.hashes()
            kept = np.flatnonzero(_find(wanted, hashes) >= 0) if wanted is not None else np.arange(len(hashes))
            kept = kept[np.argsort(hashes[kept], kind="stable")]
            rank = np.full(len(hashes), -1, dtype=np.int32)
            rank[kept] = np.arange(len(kept))
            ranks = rank[local]
            order = np.argsort(ranks, kind="stable")
            order = order[int((ranks < 0).sum()) :]
            counts = np.bincount(ranks[order], minlength=len(kept))
            steps = np.diff(order, prepend=0)
            first = (np.cumsum(counts) - counts)[counts > 0]
            steps[first] = order[first]
            yield typed([[rid], [ints(batch, "d").tolist()], [sizes], [hashes[kept]], [counts.astype(np.int32)], [steps.astype(np.int32).tobytes()]], KINDS)
            rid += batch.num_rows

    return docs.select(id_key().alias("d"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


class Postings:
    """One index row."""

    def __init__(self, rid: int, docs: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: bytes) -> None:
        self.rid, self.docs, self.terms = rid, docs, terms
        self.starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.size = int(self.starts[-1])
        steps = np.frombuffer(positions, np.int32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        total = np.cumsum(steps)
        base = np.concatenate([[0], total])[self.first[:-1]]
        self.positions = total - np.repeat(base, counts)
        #: Sorted, as the terms are and each term's positions are.
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64), counts) * (self.size + 1) + self.positions

    def has(self, rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = rank * (self.size + 1) + position
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want) & (rank >= 0) & (position >= 0) & (position < self.size)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1

    def phrases(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place of its first word) of every exact occurrence inside one document."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.terms) or not len(phrases.length):
            return none, none
        rank_of = np.append(_find(self.terms, phrases.terms), -1)
        rarest = phrases.order[:, 0].astype(np.int64)
        live = np.flatnonzero(rank_of[phrases.words[np.arange(len(rarest)), rarest]] >= 0)
        ranks = rank_of[phrases.words[live]]
        whole = ((ranks >= 0) | (phrases.words[live] < 0)).all(axis=1)
        live, ranks = live[whole], ranks[whole]
        rare = rarest[live]
        lists = ranks[np.arange(len(live)), rare]
        widths = self.first[lists + 1] - self.first[lists]
        ends = np.cumsum(widths)
        found, places, at = [], [], 0
        while at < len(live):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            w = widths[at:to]
            own = np.repeat(np.arange(at, to), w)
            entry = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(self.first[lists[at:to]], w)
            place = self.positions[entry] - rare[own]
            for step in range(1, phrases.width):
                if not len(own):
                    break
                phrase = live[own]
                offset = phrases.order[phrase, step].astype(np.int64)
                keep = (offset >= phrases.length[phrase]) | self.has(ranks[own, offset], place + offset)
                own, place = own[keep], place[keep]
            ok = place >= 0
            phrase, place = live[own[ok]], place[ok]
            inside = place + phrases.length[phrase] <= self.starts[self.document(place) + 1]
            found.append(phrase[inside])
            places.append(place[inside])
            at = to
        return np.concatenate(found or [none]), np.concatenate(places or [none])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Postings]:
    for batch in batches:
        for i in range(batch.num_rows):
            x = {n: column(batch, n)[i] for n, _ in KINDS}
            lists = (x[n].values.to_numpy() for n in ("docs", "sizes", "terms", "counts"))
            yield Postings(x["rid"].as_py(), *lists, x["positions"].as_py())


def _parts(items: DataFrame, width: int) -> DataFrame:
    """(item_id, text, hashes): the items' words in parts, each but an item's last one overlapping the next by width - 1 words."""
    kinds = [("item_id", pa.int64()), ("text", pa.binary()), ("hashes", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], []]
            for item, text in zip(column(batch, "item_id").to_pylist(), binary(batch, "text"), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - width + 1), PART_WORDS):
                    part = words[at : at + PART_WORDS + width - 1]
                    numbers = _Numbers((w, 0) for w in part)
                    for x, v in zip(out, (item, b" ".join(part), numbers.hashes()), strict=True):
                        x.append(v)
            yield typed(out, kinds)

    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "item_id long, text binary, hashes array<long>").where(F.length("text") > 0)


def _terms(parts: DataFrame) -> np.ndarray | None:
    """The sorted hashes of all queries' words; None if they are too many to broadcast."""
    known = parts.select(F.explode("hashes").alias("h")).distinct()
    found = known.limit(TERMS + 1).toArrow()["h"].to_numpy()
    return np.sort(found) if len(found) <= TERMS else None


def _blocks(parts: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """All rows (item_id, text), in blocks of about QUERY_BYTES of text."""
    n = 1 + int((parts.agg(F.sum(F.length("text"))).first()[0] or 0) // QUERY_BYTES)
    for i in range(n):
        own = parts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r[0], bytes(r[1])) for r in own.select("item_id", "text").collect()]


def _frequency(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the terms occurs."""
    wanted = np.unique(terms)
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            hashes, counts = (column(batch, n).flatten().to_numpy() for n in ("terms", "counts"))
            at = _find(shared.value, hashes)
            total += np.bincount(at[at >= 0], weights=counts[at >= 0], minlength=len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield typed([some, total[some]], [("t", pa.int64()), ("n", pa.int64())])

    found = index.select("terms", "counts").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a block's words
    out = np.zeros(len(wanted), dtype=np.int64)
    out[found["t"].to_numpy()] = found["n"].to_numpy()
    return out[np.searchsorted(wanted, terms)]


def _indexed(docs: DataFrame, parts: DataFrame) -> DataFrame:
    return written(build_index(docs, _terms(parts)), "postings")


def _phrases(index: DataFrame, block: list[tuple[int | None, bytes]], width: int) -> Phrases:
    phrases = Phrases(block, width)
    phrases.ordered(_frequency(index, phrases.terms))
    return phrases


def _id(values: np.ndarray) -> list[int | None]:
    return [None if x == NULL_ID else x for x in values.tolist()]


MATCHES = "doc_id long, item_id long, position long, length long"


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, position, length): every place where `width` consecutive words of an item stand in a document."""
    parts = _parts(items.where("item_id is not null"), width)
    index = _indexed(docs, parts)
    out = None
    for block in _blocks(parts):
        shared = docs.sparkSession.sparkContext.broadcast(_phrases(index, block, width))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for index in _rows(batches):
                phrase, place = index.phrases(p)
                at, item = p.named(phrase)
                phrase, place = phrase[at], place[at]
                doc = index.document(place)
                yield typed([_id(index.docs[doc]), item, place - index.starts[doc], p.length[phrase], index.rid + doc], [("doc_id", pa.int64()), ("item_id", pa.int64()), ("position", pa.int64()), ("length", pa.int64()), ("rid", pa.int64())])

        found = index.mapInArrow(run, MATCHES + ", rid long")
        out = found if out is None else out.union(found)
    # parts of one item in two blocks may hold the same window
    return out.distinct().select("doc_id", "item_id", "position", "length")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 4, rarest: int = 4) -> DataFrame:
    """(doc_id, item_id, position): places of an item's rarest word near which its next rarest ones (`rarest` in all) stand, each within
    slop words of where the item has it. Items of fewer words take all they have. An item's text goes to the driver whole."""
    whole = items.where("item_id is not null")
    index = _indexed(docs, _parts(whole, 1))
    rows = whole.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    out = None
    for block in _blocks(rows):
        kept = [(item, words) for item, text in block if (words := words_of(text))]
        numbers = _Numbers((w, 0) for _, words in kept for w in words)
        hashes = dict(zip(numbers, numbers.hashes().tolist(), strict=True))
        frequency = dict(zip(hashes, _frequency(index, np.array(list(hashes.values()), dtype=np.int64)).tolist(), strict=True))
        anchors = [(item, sorted((frequency[w], at, hashes[w]) for at, w in enumerate(words))[:rarest]) for item, words in kept]
        shared = docs.sparkSession.sparkContext.broadcast(anchors)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for index in _rows(batches):
                rank = {t: i for i, t in enumerate(index.terms.tolist())}
                docs_, items_, places_ = [], [], []
                for item, words in shared.value:
                    if any(t not in rank for _, _, t in words):
                        continue
                    lists = [(at, index.positions[index.first[rank[t]] : index.first[rank[t] + 1]]) for _, at, t in words]
                    at0, place = lists[0]
                    doc = index.document(place)
                    for at, other in lists[1:]:
                        want = place + (at - at0)
                        low = np.maximum(want - slop, index.starts[doc])
                        high = np.minimum(want + slop, index.starts[doc + 1] - 1)
                        keep = np.searchsorted(other, high, side="right") > np.searchsorted(other, low, side="left")
                        place, doc = place[keep], doc[keep]
                    docs_ += _id(index.docs[doc])
                    items_ += [item] * len(place)
                    places_ += (place - index.starts[doc]).tolist()
                yield typed([docs_, items_, places_], [("doc_id", pa.int64()), ("item_id", pa.int64()), ("position", pa.int64())])

        found = index.mapInArrow(run, "doc_id long, item_id long, position long")
        out = found if out is None else out.union(found)
    return out.distinct()


def _hits(index: DataFrame, phrases: Phrases) -> DataFrame:
    """(rid, spans, item_ids) of the documents with hit words: the hit stretches, as first place << 32 | end, and the items."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    kinds = [("rid", pa.int64()), ("spans", pa.list_(pa.int64())), ("item_ids", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for index in _rows(batches):
            phrase, place = index.phrases(p)
            if not len(phrase):
                continue
            # a free place after each document keeps their stretches apart
            base = index.starts[:-1] + np.arange(len(index.docs))
            first = place + index.document(place)
            edge = np.zeros(index.size + len(index.docs) + 1, dtype=np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + p.length[phrase], -1)
            change = np.flatnonzero(np.diff(np.cumsum(edge) > 0, prepend=False))
            a, b = change[::2], change[1::2]
            doc = np.searchsorted(base, a, side="right") - 1
            spans = (a - base[doc] << 32) | (b - base[doc])
            at, item = p.named(phrase)
            pairs = np.unique(np.stack([index.document(place)[at], item], axis=1), axis=0)
            some = np.unique(doc)
            listed = [np.split(v, np.searchsorted(k, some[1:])) for k, v in ((doc, spans), (pairs[:, 0], pairs[:, 1]))]
            yield typed([index.rid + some, *listed], kinds)

    return index.mapInArrow(run, "rid long, spans array<long>, item_ids array<long>")


def _covered(spans: Column) -> Column:
    """How many places the spans cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(s: Column, x: Column) -> Column:
        first, end = F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))
        more = F.greatest(F.lit(0).cast("long"), end - F.greatest(first, s["end"]))
        return F.struct((s["n"] + more).alias("n"), F.greatest(s["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), start, add, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids array<long>, contaminated) for each row of docs: the words that lie in a window of an item,
    and the items with such windows. contaminated: a word is hit, and a twentieth of the words at least."""
    parts = _parts(items, width)
    index = _indexed(docs, parts)
    found = None
    for block in _blocks(parts):
        hits = _hits(index, _phrases(index, block, width))
        found = hits if found is None else found.union(hits)
    # a row for each block at most; the lists are a document's own
    found = found.groupBy(F.col("rid").alias("r")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("items"))
    rows = index.select("rid", F.posexplode(F.arrays_zip("docs", "sizes")).alias("at", "x"))
    rows = rows.select((F.col("rid") + F.col("at")).alias("rid"), F.col("x.docs").alias("d"), F.col("x.sizes").cast("long").alias("n_words"))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    none = F.array().cast("array<long>")
    out = rows.join(found, F.col("rid") == F.col("r"), "left").select("d", "n_words", n_hit.alias("n_hit"), F.coalesce(F.array_sort(F.array_distinct("items")), none).alias("item_ids"))
    share = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select(F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id"), "n_words", "n_hit", "item_ids", share.alias("contaminated"))
