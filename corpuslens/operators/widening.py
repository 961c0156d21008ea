"""Quotations that stand several times in their text, widened until they are unique.

How long a string must be to be unique, from each place of a text on, is read off the text's suffixes in order: one more than what it shares
with its neighbours there. A span is unique if it is at least that long, so that each way of widening is one comparison and the text is
never searched again."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The source's own bounds, for how="near" only: code points that a quotation is widened by on either side, and places tried on either side.
REACH, TRIES = 60, 12
#: Quotations of a text that are widened in one task.
BLOCK = 2000
#: What ends a sentence.
STOP = re.compile(r"(?<=[.!?])\s+")


def unique_lengths(text: str, most: int) -> np.ndarray:
    """From each place the length of the shortest string that stands nowhere else in the text; most + 1 stands for any length over most, or
    for none that ends inside the text.

    Suffixes are ranked by their first 1, 2, 4, ... code points until that reaches over most, the shortest of which are told apart by the code
    points themselves, put into one number; what neighbours in the last order share is
    then counted down through the ranks."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1]
    size, bits = 1, int(ranks[0].max()).bit_length()
    while size <= most and 2 * bits <= 62:  # so many code points fit into a number as they are
        right = np.zeros(n, dtype=np.int64)
        right[: max(0, n - size)] = ranks[-1][size:]
        ranks.append(ranks[-1] << bits | right)
        size, bits = 2 * size, 2 * bits
    # from here a rank is the place of the first of those alike, and only those that are still alike are ranked on
    _, group, alike = np.unique(ranks[-1], return_inverse=True, return_counts=True)
    ranks[-1] = (np.cumsum(alike) - alike + 1)[group].astype(np.int32 if n < 1 << 31 else np.int64)
    open_ = np.flatnonzero(alike[group] > 1)
    while size <= most and len(open_):
        right = np.zeros(len(open_), dtype=np.int64)
        inside = open_ + size < n
        right[inside] = ranks[-1][open_[inside] + size]
        right += ranks[-1][open_].astype(np.int64) * (n + 1)
        by = np.argsort(right, kind="stable")
        open_, right = open_[by], right[by]
        first = np.flatnonzero(np.diff(right, prepend=-1))
        group = np.flatnonzero(np.diff(right // (n + 1), prepend=-1))
        size_of = np.diff(np.append(first, len(right)))
        ahead = first - group[np.searchsorted(group, first, side="right") - 1]
        ranks.append(ranks[-1].copy())
        ranks[-1][open_] += np.repeat(ahead, size_of).astype(ranks[-1].dtype)
        open_ = open_[np.repeat(size_of > 1, size_of)]
        size *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + shared, b + shared
        inside = (np.maximum(x, y) + (1 << k)) <= n
        same = inside.copy()
        same[inside] = ranks[k][x[inside]] == ranks[k][y[inside]]
        shared += same << k
    need = np.zeros(n, dtype=np.int64)
    need[order[:-1]] = shared
    need[order[1:]] = np.maximum(need[order[1:]], shared)
    need += 1
    need[need > np.minimum(most, n - np.arange(n))] = most + 1
    return need


def places_of(text: str, quote: str) -> list[int]:
    """Where a quotation stands in a text, overlaps included."""
    out, at = [], text.find(quote) if quote else -1
    while at >= 0:
        out.append(at)
        at = text.find(quote, at + 1)
    return out


def cuts(text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """Where a span may begin and end that is wider by whole words on its own line: the nearest places first, the span's own among them; no
    more than TRIES of either and none beyond REACH, as in the source."""
    line = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    stop = len(text) if stop < 0 else stop
    low, high = max(line, start - REACH), min(stop, end + REACH)
    begins = [i for i in range(start - 1, low - 1, -1) if i == line or text[i - 1].isspace()]
    ends = [i for i in range(end + 1, high + 1) if i == stop or text[i].isspace()]
    return [start, *begins][:TRIES], [end, *ends][:TRIES]


def widened(text: str, quote: str, need: np.ndarray) -> tuple[int, int] | None:
    """The smallest unique span around one of the quotation's places, of those that `cuts` has; of equally small ones at the later place,
    then the one that begins nearest to it. None where there is none or the quotation is unique."""
    found = places_of(text, quote)
    best: tuple[int, int, int, int] | None = None
    for start in found if len(found) > 1 else []:
        end = start + len(quote)
        begins, ends = cuts(text, start, end)
        for b in begins:
            fits = next((e for e in ends if e - b >= need[b] and (b, e) != (start, end)), None)
            if fits is not None and (best is None or (fits - b - len(quote), -start, start - b) < best[:3]):
                best = (fits - b - len(quote), -start, start - b, fits)
    return (-best[1] - best[2], best[3]) if best else None


class Lines:
    """A text's spans of whole words. Where a span that begins at a place must end to be unique only moves on with the place, as does the
    first end of a word from there; so of the begins on a quotation's line, all up to one are unique with the quotation's own end, those
    behind need an end of their own, up to the last whose end lies on the line, and the least width among these is read off a table of
    windows. All places of a quotation are looked up at once, over their whole lines."""

    def __init__(self, text: str, need: np.ndarray) -> None:
        """need: unique_lengths, for `reach` at least."""
        self.text, n = text, len(text)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        space = np.flatnonzero(np.isin(codes, [c for c in np.unique(codes).tolist() if chr(c).isspace()]))
        self.breaks, self.ends, self.begins = np.flatnonzero(codes == 10), np.append(space, n), np.append(0, space + 1)
        self.begins = self.begins[self.begins < n]
        self.right = np.where(need <= n - np.arange(n), np.arange(n) + need, 2 * n)
        # what no line is long enough for may count as unique from further on
        own = np.minimum.accumulate(self.right[self.begins][::-1])[::-1]
        self.own, self.to = own, self.end_from(own)
        self.width = self.to - self.begins
        self.least = [np.arange(len(self.begins))]

    @staticmethod
    def reach(text: str, quote: int) -> int:
        """The longest span that may be asked for a quotation of so many code points."""
        return min(len(text), 2 * max(map(len, text.split("\n"))) + quote)

    def end_from(self, places: np.ndarray) -> np.ndarray:
        """The first end of a word at each place or behind it, 3 n where there is none."""
        return np.append(self.ends, 3 * len(self.text))[np.searchsorted(self.ends, places)]

    def narrowest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of the begins low to high - 1 the last of least width."""
        pick = lambda a, b: np.where(self.width[b] <= self.width[a], b, a)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(low), dtype=np.int64)
        for k in range(int(level.max(initial=-1)) + 1):
            if k == len(self.least):
                before = self.least[-1]
                self.least.append(pick(before[: -(1 << k - 1)], before[1 << k - 1 :]))
            on = level == k
            out[on] = pick(self.least[k][low[on]], self.least[k][high[on] - (1 << k)])
        return out

    def widened(self, quote: str) -> tuple[int, int] | None:
        """The smallest unique span around one of the quotation's places, by whole words on its line; of equally small ones at the later place,
        then the one that begins nearest to it. None where there is none or the quotation is unique."""
        at = np.array(places_of(self.text, quote), dtype=np.int64)
        if len(at) < 2:
            return None
        n, end = len(self.text), at + len(quote)
        line = np.append(0, self.breaks + 1)[np.searchsorted(self.breaks, at)]
        stop = np.append(self.breaks, n)[np.searchsorted(self.breaks, end)]
        low, high = np.searchsorted(self.begins, line), np.searchsorted(self.begins, at)
        near = np.minimum(np.searchsorted(self.own, end, side="right"), high)
        # spans that begin with the quotation
        begin, to = at.copy(), self.end_from(self.right[at])
        to[to > stop] = 3 * n
        # those that begin before it and end behind it
        far, up = np.maximum(near, low), np.minimum(high, np.searchsorted(self.to, stop, side="right"))
        some = np.flatnonzero(far < up)
        best = self.narrowest(far[some], up[some])
        less = self.width[best] < (to - begin)[some]
        begin[some[less]], to[some[less]] = self.begins[best[less]], self.to[best[less]]
        # those that end with it
        some = np.flatnonzero(near > low)
        some = some[end[some] - self.begins[near[some] - 1] < (to - begin)[some]]
        begin[some], to[some] = self.begins[near[some] - 1], end[some]
        best = len(at) - 1 - int(np.argmin((to - begin)[::-1]))
        return (int(begin[best]), int(to[best])) if to[best] <= n else None


def by_sentence(text: str, quote: str, need: np.ndarray) -> tuple[int, int] | None:
    """The quotation's first unique span with the sentence before it, the one after it, or both, at its first place where one of them is
    unique. None where there is none or the quotation is unique. White space between sentences belongs to neither."""
    found = places_of(text, quote)
    bounds = [0, *[m.end() for m in STOP.finditer(text)], len(text)]
    spans = [(a, len(text[:b].rstrip())) for a, b in pairwise(bounds) if b > a]
    starts = np.array([a for a, _ in spans], dtype=np.int64)
    for start in found if len(found) > 1 else []:
        end = start + len(quote)
        i, j = int(np.searchsorted(starts, start, side="right")) - 1, int(np.searchsorted(starts, end - 1, side="right")) - 1
        whole = (min(start, spans[i][0]), max(end, spans[j][1]))
        before = (spans[i - 1][0], end) if i else None
        after = (start, max(end, spans[j + 1][1])) if j + 1 < len(spans) else None
        both = (before[0], after[1]) if before and after else None
        for span in (whole, before, after, both):
            if span and span != (start, end) and span[1] - span[0] >= need[span[0]]:
                return span
    return None


def unique_quotes(quotes: DataFrame, texts: DataFrame, key: str, how: str = "words") -> DataFrame:
    """(key, quote_id, places, start, end, quote) of quotes (key, quote_id, quote) and texts (key, text): how often a quotation stands in its text
    (overlaps included), and the span that makes it unique: its own if it stands once, else the smallest widening by whole words on its line
    (how="words"; "near": within the source's bounds, REACH and TRIES) or by whole sentences (how="sentences"); null where there is none. A
    quotation without a text, null or empty stands nowhere.

    A text meets its quotations BLOCK at a time, so that a text with very many of them is several rows."""
    kind, id_kind = quotes.schema[key].dataType.simpleString(), quotes.schema["quote_id"].dataType.simpleString()
    many = quotes.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(key, F.ceil(F.col("n") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("quote_id"), F.coalesce("blocks", F.lit(1)))
    # a few short rows are long work, so that they are dealt by number and not put together by their size
    tasks = int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = quotes.select(key, "quote_id", "quote").join(many, key, "left").repartition(tasks, key).groupBy(key, block.alias("block")).agg(F.collect_list(F.struct("quote_id", "quote")).alias("q"))
    rule = {"words": lambda text, need: Lines(text, need).widened, "near": lambda text, need: partial(widened, text, need=need), "sentences": lambda text, need: partial(by_sentence, text, need=need)}[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                given, text = batch.column(1)[r], batch.column(2)[r].as_py() or ""
                out, widen = [], None
                wanted = [x["quote"] or "" for x in given.as_py()]
                longest = max(map(len, wanted), default=0)
                most = Lines.reach(text, longest) if how == "words" else longest + 2 * (REACH if how == "near" else max(map(len, STOP.split(text))) + 8)
                for quote in wanted:
                    found = places_of(text, quote)
                    span = (found[0], found[0] + len(quote)) if len(found) == 1 else None
                    if len(found) > 1:
                        widen = widen or rule(text, unique_lengths(text, most))
                        span = widen(quote)
                    out.append((len(found), *(span or (None, None)), text[span[0] : span[1]] if span else None))
                ids = given.values.field("quote_id")
                columns = [batch.column(0).slice(r, 1).take(pa.array([0] * len(out), pa.int32())), ids]
                columns += [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [key, "quote_id", "places", "start", "end", "quote"])

    joined = asked.join(texts.select(key, "text"), key, "left").select(key, "q", "text")
    return joined.mapInArrow(run, f"{key} {kind}, quote_id {id_kind}, places long, start long, end long, quote string")
