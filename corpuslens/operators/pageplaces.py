"""Pages and the text made from them: where each page begins in a reading copy, whether such a map can be believed, which page a quotation
stands on.

Pages are found by their letters alone, as a reading copy and a page differ in everything else: wrapped lines, hyphens, spaces, numbers. A
page's fingerprints are its letters 0 to 40, 40 to 80, ... of the first 2,000. One counts at a place of the text's letters if the page's
next letters follow there as well. Fingerprints that stand once in the whole text give places; the longest run of pages whose places go up
with the pages is kept, so that a page quoted elsewhere can't drag others with it. Then pages between two kept ones are looked for again,
by fingerprints that stand once between those two, until no more are found. What is left lies between its located neighbours in proportion
to the letters; a page of under 30 letters is empty and lies there, too."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prints import code_points, rolling
from .alignment import increasing

#: Letters of a fingerprint, letters that a page needs, letters of a page that are looked at.
PROBE, MIN_PAGE, SPAN = 40, 30, 2000


def letters(text: str) -> tuple[str, np.ndarray]:
    """A text's letters and the place of each in the text."""
    codes = code_points(text)
    keep = _alphabetic()[codes]
    return codes[keep].tobytes().decode("utf-32-le", "surrogatepass"), np.flatnonzero(keep)


@cache
def _alphabetic() -> np.ndarray:
    """Of each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Places:
    """The text's fingerprints in order, for looking up many at once."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = rolling(code_points(text), PROBE)
        self.order = np.argsort(found, kind="stable")
        self.sorted = found[self.order]

    def of(self, page: str) -> Iterator[tuple[int, np.ndarray]]:
        """(offset in the page, places in the text, ascending) of each fingerprint whose next letters follow in the text, too; one is looked at
        when it is asked for, as the first ones mostly do."""
        starts = list(range(0, max(1, min(len(page) - PROBE + 1, SPAN)), PROBE))
        if len(page) < PROBE:
            yield 0, np.array([m.start() for m in re.finditer(f"(?={re.escape(page)})", self.text)], dtype=np.int64)
            return
        prints = rolling(code_points(page[: SPAN + PROBE]), PROBE)[starts]
        low, high = np.searchsorted(self.sorted, prints), np.searchsorted(self.sorted, prints, side="right")
        for k, a, b in zip(starts, low.tolist(), high.tolist(), strict=True):
            whole = page[k : k + 2 * PROBE]
            yield k, np.sort([x for x in self.order[a:b].tolist() if self.text.startswith(whole, x)]).astype(np.int64)


class Kept:
    """An iterator's values, made once and only as far as they are asked for."""

    def __init__(self, values: Iterator) -> None:
        self.values, self.made = values, []

    def __iter__(self) -> Iterator:
        yield from self.made
        for x in self.values:
            self.made.append(x)
            yield x


def walked_back(text: str, page: str, at: int, k: int, low: int) -> int:
    """Where a page begins whose letters from k on stand at `at`: back over the letters before, as long as the text has them, too."""
    while k > 0 and at > low and text[at - 1] == page[k - 1]:
        at, k = at - 1, k - 1
    return at


def located(text: str, pages: list[str]) -> list[int | None]:
    """Of each page of letters where it begins in the text's letters, or None."""
    places = Places(text)
    found = [Kept(places.of(p)) if len(p) >= MIN_PAGE else None for p in pages]
    start: list[int | None] = [None] * len(pages)

    def settle(i: int, low: int, high: int) -> tuple[int, int] | None:
        """(page, place of its beginning, fingerprint's place) by the first fingerprint that stands once from low to high."""
        for k, at in found[i] or ():
            inside = at[(at >= low + k) & (at < high)]
            if len(inside) == 1:
                return int(inside[0]), k
        return None

    first = [(i, *hit) for i in range(len(pages)) if (hit := settle(i, 0, len(text)))]
    kept = [first[j] for j in increasing([at - k for _, at, k in first])]
    hits = {i: (at, k) for i, at, k in kept}
    for _ in range(len(pages)):
        new, low = {}, 0
        after = {}  # of each page the place of the next located one
        high = len(text)
        for i in range(len(pages) - 1, -1, -1):
            after[i] = high
            high = hits[i][0] - hits[i][1] if i in hits else high
        for i in range(len(pages)):
            if i in hits:
                low = hits[i][0] - hits[i][1] + 1
            elif found[i] and (hit := settle(i, low, after[i])) and hit[0] - hit[1] < after[i]:
                new[i] = hit
                low = hit[0] - hit[1] + 1
        if not new:
            break
        hits |= new
    low = 0
    for i in sorted(hits):
        start[i] = low = walked_back(text, pages[i], *hits[i], low)
    return start


def first_character(text: str, at: np.ndarray, s: int) -> int:
    """Where a page begins whose first letter is letter s: behind the word of the letter before and the white space after it."""
    if s >= len(at):
        return len(text)
    if s == 0:
        return 0
    between = text[at[s - 1] + 1 : at[s]]
    gap = re.search(r"\s+", between)
    return int(at[s - 1]) + 1 + (gap.end() if gap else len(between))


def locate_pages(texts: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, page, how, letters, start, offset, text_letters) of texts (key, text) and their pages (key, page number, text): how a page was
    placed (located, interpolated, empty), its letters, where it begins among the text's letters and among its code points. A text meets
    its own pages, whose letters are no more than its own, in one row; placing the rest is a window over a text's pages. Pages of a text
    that isn't there are left out; a null text has no letters."""
    kind = texts.schema[key].dataType.simpleString()
    own = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                text, given = batch.column(1)[r].as_py() or "", batch.column(2)[r].as_py()
                whole, at = letters(text)
                parts = [letters(p["text"])[0] for p in given]
                start = located(whole, parts)
                shown, lengths = rest_placed(start, [len(p) for p in parts], len(whole))
                how = ["empty" if n < MIN_PAGE else "interpolated" if s is None else "located" for s, n in zip(start, lengths, strict=True)]
                columns = [
                    batch.column(0).slice(r, 1).take(pa.array([0] * len(parts), pa.int32())), pa.array([p["page"] for p in given], pa.int64()), pa.array(how, pa.string()),
                    pa.array(lengths, pa.int64()), pa.array(shown, pa.int64()), pa.array([first_character(text, at, s) for s in shown], pa.int64()), pa.array([len(whole)] * len(parts), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "page", "how", "letters", "start", "offset", "text_letters"])

    joined = texts.select(key, "text").join(own, key)
    return joined.mapInArrow(run, f"{key} {kind}, page long, how string, letters long, start long, offset long, text_letters long")


def rest_placed(start: list[int | None], lengths: list[int], total: int) -> tuple[list[int], list[int]]:
    """(start of every page, lengths): those without a place between their located neighbours, by the letters before them."""
    n = len(start)
    before = np.concatenate([[0], np.cumsum(lengths)]).astype(np.float64)  # letters before each page
    known = [i for i in range(n) if start[i] is not None]
    x = np.array([0.0, *[before[i] for i in known], before[n]])
    y = np.array([0.0, *[float(start[i]) for i in known], float(total)])
    keep = np.concatenate([[True], np.diff(x) > 0])
    shown = np.minimum(np.round(np.interp(before[:n], x[keep], y[keep])), total).astype(int).tolist() if n else []
    return [s if s is not None else p for s, p in zip(start, shown, strict=True)], lengths


def page_health(placed: DataFrame, key: str) -> DataFrame:
    """(key, pages, with_text, located, interpolated, empty, odd, backwards, ok): whether a map of pages can be believed. No page begins before
    the one before it; 80 % of the pages with text are located; a located page of 200 letters or more whose next one is located too takes
    half to twice its letters of the text, but for a tenth of the pages or one."""
    w = Window.partitionBy(key).orderBy("page")
    rows = placed.withColumns({"next_start": F.coalesce(F.lead("start").over(w), "text_letters"), "next_how": F.coalesce(F.lead("how").over(w), F.lit("located")), "back": F.col("start") < F.lag("start").over(w)})
    taken = F.col("next_start") - F.col("start")
    odd = (F.col("how") == "located") & (F.col("next_how") == "located") & (F.col("letters") >= 200) & ~taken.between(0.5 * F.col("letters"), 2 * F.col("letters"))
    named = lambda how: F.count_if(F.col("how") == how)
    out = rows.groupBy(key).agg(
        F.count("*").alias("pages"), F.count_if(F.col("how") != "empty").alias("with_text"), named("located").alias("located"), named("interpolated").alias("interpolated"),
        named("empty").alias("empty"), F.count_if(odd).alias("odd"), F.count_if(F.coalesce("back", F.lit(False))).alias("backwards"),
    )
    few = F.col("odd") <= F.greatest(F.lit(1), F.floor(F.col("pages") / 10))
    return out.withColumn("ok", (F.col("backwards") == 0) & (F.col("located") >= 0.8 * F.col("with_text")) & few)


def only_letters(text: Column) -> Column:
    return F.regexp_replace(text, "\\P{L}+", "")


def quote_pages(quotes: DataFrame, pages: DataFrame, key: str, n: int = 30, least: int = 12) -> DataFrame:
    """(key, quote_id, page) of quotes (key, quote_id, quote) and pages (key, page, text): the one page whose letters hold the quotation's first n
    letters; else the one that they begin on if they run over its end; null if there is none, or several, or under `least` letters. It
    reads the pages alone, so that it checks a map of pages independently."""
    w = Window.partitionBy(key).orderBy("page")
    own = pages.select(key, "page", only_letters(F.col("text")).alias("own"))
    next_ = F.coalesce(F.lead("own").over(w), F.lit(""))
    seam = F.when(next_ != "", F.concat(F.right("own", F.lit(2 * n)), F.left(next_, F.lit(2 * n))))
    head = quotes.select(key, "quote_id", F.left(only_letters(F.col("quote")), F.lit(n)).alias("q"))
    met = head.where(F.length("q") >= least).join(own.withColumn("seam", seam), key)
    hits = met.groupBy(key, "quote_id").agg(
        F.count_if(F.contains("own", F.col("q"))).alias("inside"), F.min(F.when(F.contains("own", F.col("q")), F.col("page"))).alias("page"),
        F.count_if(F.contains("seam", F.col("q"))).alias("over"), F.min(F.when(F.contains("seam", F.col("q")), F.col("page"))).alias("first"),
    )
    page = F.when(F.col("inside") == 1, F.col("page")).when((F.col("inside") == 0) & (F.col("over") == 1), F.col("first"))
    return head.select(key, "quote_id").join(hits.select(key, "quote_id", page.alias("page")), [key, "quote_id"], "left")
