"""Anchoring: proposed quotations find their one place in a text, exactly or with typesetting undone; children after a text's revision."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ident import char_range_json, mint_ext_id
from ..functions.prints import SURE, chosen
from ..sources.shared import bounded_batches, checkpointed

#: Short quotations that one pass over the texts looks for, and the candidates of a text that one row holds.
TOGETHER, CANDIDATES = 50_000, 2_000
#: Rows that share a run of code points with over 1/HOT of all rows are spread over SPREAD tasks.
HOT, SPREAD = 1024, 32


def _runs(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, w): the runs of code points that stand for each text in a join."""
    kind = rows.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chosen(x or "") for x in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
            w = np.concatenate([np.zeros(0, dtype=np.int64), *found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(w)], ["id", "w"])

    return rows.select(F.col(id_).alias("id"), F.col(text).cast("string")).mapInArrow(run, f"id {kind}, w long")


def _long_pairs(texts: DataFrame, quotes: DataFrame, key: str) -> DataFrame:
    """(k, quote_id): texts that share with a quotation of SURE code points or more the rarest of its runs. An equi-join whatever the script,
    as runs need no word ends; rows of a frequent run are spread."""
    asked = checkpointed(_runs(quotes, "quote_id", "quote").select(F.col("id").alias("quote_id"), "w"))
    found = _runs(texts, key, "text").select(F.col("id").alias("k"), "w").join(asked.select("w").distinct(), "w", "left_semi")
    found = checkpointed(found)
    often = found.groupBy("w").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "w", "left").groupBy("quote_id").agg(F.min_by(F.struct("w", "n"), F.struct(F.coalesce("n", F.lit(0)), "w")).alias("x"))
    rarest = checkpointed(rarest.where("x.n is not null").select("quote_id", F.col("x.w").alias("w"), F.col("x.n").alias("n")))
    spread = F.when(F.col("n") * HOT > found.count(), SPREAD).otherwise(1)
    rarest = rarest.withColumn("spread", spread)
    wide = rarest.select("quote_id", "w", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"))
    rows = found.join(rarest.groupBy("w").agg(F.max("spread").alias("spread")), "w")
    return rows.withColumn("salt", F.pmod(F.xxhash64("k"), "spread").cast("int")).join(wide, ["w", "salt"]).select("k", "quote_id")


def _short_pairs(texts: DataFrame, quotes: DataFrame, key: str) -> DataFrame | None:
    """(k, quote_id): texts that hold a quotation of under SURE code points. An automaton of TOGETHER quotations goes once over every text,
    however many they are; more of them are further passes. None if there is none."""
    kind, id_kind = texts.schema[key].dataType.simpleString(), quotes.schema["quote_id"].dataType.simpleString()
    by_text = checkpointed(quotes.groupBy("quote").agg(F.count("*").alias("n")).select("quote"))
    total = by_text.count()
    if not total:
        return None
    blocks = -(-total // TOGETHER)
    made = []
    for b in range(blocks):
        part = [r["quote"] for r in by_text.where(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == b).collect()]  # about TOGETHER, of SURE code points each
        shared = texts.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for q in shared.value:
                machine.add_word(q, q)
            machine.make_automaton()
            for batch in batches:
                found = [sorted({q for _, q in machine.iter(x)}) if x else [] for x in batch.column(1).to_pylist()]
                at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([q for f in found for q in f], pa.string())], ["k", "quote"])

        if part:
            made.append(texts.select(key, F.col("text").cast("string")).mapInArrow(run, f"k {kind}, quote string"))
    met = reduce(DataFrame.unionByName, made)
    return met.join(quotes.select(F.col("quote_id").cast(id_kind).alias("quote_id"), "quote"), "quote").select("k", "quote_id")


def hits(texts: DataFrame, quotes: DataFrame, key: str = "doc_id") -> DataFrame:
    """texts joined with the quotes (quote_id, quote) that stand in them; the text itself decides.

    Quotations of SURE code points or more meet texts by a run of code points that both have chosen, shorter ones by an automaton; no text is
    held against every quotation. A text meets its candidates as a list, CANDIDATES at a time, so that it is shuffled once for them all."""
    bounded_batches(texts.sparkSession)
    given = quotes.where("quote <> ''").select("quote_id", "quote")
    size = F.char_length("quote")
    pairs = _long_pairs(texts, given.where(size >= SURE), key)
    short = _short_pairs(texts, given.where(size < SURE), key)
    pairs = checkpointed((pairs if short is None else pairs.unionByName(short)).distinct())
    many = pairs.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > CANDIDATES).select("k", F.ceil(F.col("n") / CANDIDATES).alias("blocks"))
    block = F.pmod(F.xxhash64("quote_id"), F.coalesce("blocks", F.lit(1)))
    lists = pairs.join(given, "quote_id").join(many, "k", "left").groupBy(F.col("k").alias(key), block.alias("b")).agg(F.collect_list(F.struct("quote_id", "quote")).alias("q")).drop("b")
    # candidates are unfolded before the text decides: a condition on both sides' columns inside a lambda can't be bound in a sort-merge join
    met = texts.join(lists, key).select(*texts.columns, F.explode("q").alias("q")).select(*texts.columns, "q.quote_id", "q.quote")
    return met.where(F.contains(F.col("text"), F.col("quote")))


def anchor(texts: DataFrame, candidates: DataFrame, normalize: bool = False) -> DataFrame:
    """(doc_id, quote_id, status, start, end, candidates) of candidates (doc_id, quote_id, quote), each for its own text.

    status: anchored (one exact place), ambiguous, not_found, invalid (empty); with normalize also refound."""
    joined = candidates.join(texts.select("doc_id", "text"), "doc_id")
    n = tx.occurrences(F.col("text"), F.col("quote"))
    again = tx.refind_status(F.col("text"), F.col("quote"))
    rows = joined.withColumn("n", n).withColumn("again", F.when((F.col("n") == 0) & (F.col("quote") != ""), again) if normalize else F.lit(None).cast("struct<status:string,candidates:int>"))
    status = F.when(F.coalesce("quote", F.lit("")) == "", "invalid").when(F.col("n") == 1, "anchored").when(F.col("n") > 1, "ambiguous").otherwise(F.coalesce("again.status", F.lit("not_found")))
    start = F.when(F.col("status") == "anchored", F.instr("text", F.col("quote")).cast("long") - 1)
    rows = rows.withColumn("status", status)
    return rows.select("doc_id", "quote_id", "status", start.alias("start"), (start + F.length("quote")).alias("end"), F.greatest("n", F.coalesce("again.candidates", F.lit(0))).cast("long").alias("candidates"))


def tally(anchored: DataFrame) -> DataFrame:
    return anchored.groupBy("status").agg(F.count("*").alias("n"))


def minted(anchored: DataFrame, texts: DataFrame) -> DataFrame:
    """Extractions for the anchored rows: the stored quotation is the text's own span."""
    rows = anchored.where("status = 'anchored'").join(texts.select("doc_id", "text", "source_id", "representation_id"), "doc_id")
    quote = tx.span(F.col("text"), F.col("start"), F.col("end"))
    locator = char_range_json(F.col("representation_id"), F.col("start"), F.col("end"))
    return rows.select(mint_ext_id(F.col("source_id"), F.col("representation_id"), locator, quote).alias("extraction_id"), "doc_id", "quote_id", "start", "end", quote.alias("direct_quote"))


def reanchor(extractions: DataFrame, texts: DataFrame) -> DataFrame:
    """(extraction_id, status, start, end): extractions (extraction_id, doc_id, direct_quote) against their text's present form. One exact
    place: reanchored; else needs_review."""
    joined = extractions.join(texts.select("doc_id", "text"), "doc_id")
    n = tx.occurrences(F.col("text"), F.col("direct_quote"))
    start = F.when(F.col("n") == 1, F.instr("text", F.col("direct_quote")).cast("long") - 1)
    return joined.withColumn("n", n).select("extraction_id", F.when(F.col("n") == 1, "reanchored").otherwise("needs_review").alias("status"), F.col("n").cast("long").alias("candidates"), start.alias("start"), (start + F.length("direct_quote")).alias("end"))


def narrow(extractions: DataFrame, texts: DataFrame) -> DataFrame:
    """Sub-spans (sub_start, sub_end, inside the parent's own c_start, c_end) as quotations of their own; null where they leave the parent."""
    inside = (F.col("sub_start") >= F.col("c_start")) & (F.col("sub_end") <= F.col("c_end")) & (F.col("sub_start") < F.col("sub_end"))
    return extractions.join(texts.select("doc_id", "text"), "doc_id").select("extraction_id", "sub_start", "sub_end", F.when(inside, tx.span(F.col("text"), F.col("sub_start"), F.col("sub_end"))).alias("direct_quote"))
