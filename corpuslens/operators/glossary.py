"""Terms in texts, however many terms there are: where they stand, and texts with each replaced.

Terms are whole words or phrases, whatever their case; where several begin at one place the longest stands, and none begins inside another.
An automaton of a block of terms goes once over every text; larger glossaries are more blocks, whose places meet in one list for a text
before it is settled which of them stand."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ident
from ..sources.shared import checkpointed

#: Code points of the terms of one block, about.
BLOCK_CHARS = 4 << 20


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for t in terms:
        if t:
            machine.add_word(folded(t), t)
    machine.make_automaton()
    return machine


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole_words(machine: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    """(start, end, term) of every place where a term stands that cuts no word in two."""
    if not len(machine) or not text:
        return []
    out = []
    for last, term in machine.iter(folded(text)):
        start, end = last + 1 - len(term), last + 1
        inside = start and _wordy(text[start - 1]) and _wordy(text[start])
        if not inside and not (end < len(text) and _wordy(text[end]) and _wordy(text[end - 1])):
            out.append((start, end, term))
    return out


def standing(places: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of all places those that stand: from the left, the longest of each beginning, none inside another."""
    out, free = [], 0
    for p in sorted(places, key=lambda p: (p[0], -p[1], p[2])):
        if p[0] >= free:
            out.append(p)
            free = p[1]
    return out


def term_places(texts: DataFrame, terms: DataFrame, key: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, start, end, term) of texts (key, text), one row for each key, and terms (term): the places that stand, in code points. Null and
    empty terms are none; of terms that differ by case alone the smallest is named. The driver sees one block of terms at a time."""
    kind = texts.schema[key].dataType.simpleString()
    known = terms.where("term <> ''").groupBy(F.lower("term").alias("low")).agg(F.min("term").alias("term"))
    known = checkpointed(known.select("term", F.length("term").alias("n")))
    blocks = -(-(known.agg(F.sum("n")).first()[0] or 0) // block_chars)
    schema = f"{key} {kind}, start long, end long, term string"

    def batch_of(keys: pa.Array, found: list[list[tuple]]) -> pa.RecordBatch:
        flat = [p for f in found for p in f]
        at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
        columns = [keys.take(at), *(pa.array([p[k] for p in flat], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
        return pa.RecordBatch.from_arrays(columns, [key, "start", "end", "term"])

    made = []
    for b in range(blocks):
        part = [r["term"] for r in known.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).collect()]
        shared = texts.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for batch in batches:
                found = [whole_words(machine, x or "") for x in batch.column(1).to_pylist()]
                yield batch_of(batch.column(0), [standing(f) for f in found] if blocks == 1 else found)

        made.append(texts.select(key, F.col("text").cast("string")).mapInArrow(run, schema))
    if not made:
        return texts.sparkSession.createDataFrame([], schema)
    if len(made) == 1:
        return made[0]
    whole = reduce(DataFrame.unionByName, made).groupBy(key).agg(F.collect_list(F.struct("start", "end", "term")).alias("p"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(batch.column(0), [standing([(x["start"], x["end"], x["term"]) for x in p]) for p in batch.column(1).to_pylist()])

    return whole.mapInArrow(settle, schema)


def replaced(texts: DataFrame, terms: DataFrame, key: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, text, n) of texts (key, text) and terms (term, replacement): the texts with each standing term replaced, and how many were. A null
    text stays null. Of terms that differ by case alone the smallest counts."""
    kind = texts.schema[key].dataType.simpleString()
    places = term_places(texts, terms.select("term"), key, block_chars)
    named = places.join(terms.groupBy("term").agg(F.min("replacement").alias("r")), "term")
    lists = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "r"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pieces, at = [], 0
                for p in found or []:
                    pieces += [text[at : p["start"]], p["r"] or ""]
                    at = p["end"]
                out.append(None if text is None else "".join([*pieces, text[at:]]))
                n.append(len(found or []))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64())], [key, "text", "n"])

    joined = texts.select(key, F.col("text").cast("string").alias("text")).join(lists, key, "left").select(key, "text", "p")
    return joined.mapInArrow(run, f"{key} {kind}, text string, n long")


def pseudonymised(texts: DataFrame, names: DataFrame, key: str, secret: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, text, n): texts with each of the names (name) replaced by its keyed pseudonym, whole words only, longest names first."""
    terms = names.where("name <> ''").select(F.col("name").alias("term"), ident.pseudonym(F.col("name"), secret).alias("replacement")).distinct()
    return replaced(texts, terms, key, block_chars)
