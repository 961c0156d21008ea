"""Additions to a corpus as tables: which records are new, which exist, which are refused, and what they become."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ident
from . import reports


def add_sources(records: DataFrame, existing: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(record, source_id, status, slug) of records (record, url, title, sha256: of the first file's bytes) against existing sources
    (source_id, slug). A source's id comes from its URL, else from its bytes. status: refused without a file, exists, repeated within the
    records (the first one stands), or added, with a slug that no source before it has."""
    url = ident.canonical_url(F.col("url"), ascii_only)
    rows = records.withColumn("source_id", F.when(F.col("sha256").isNotNull(), ident.mint_src_id(url, F.col("sha256"))))
    known = existing.select("source_id", F.lit(True).alias("known"))
    first = F.row_number().over(Window.partitionBy("source_id").orderBy("record"))
    rows = rows.join(known, "source_id", "left").withColumn("n", first)
    status = F.when(F.col("source_id").isNull(), "refused").when(F.col("known"), "exists").when(F.col("n") > 1, "repeated").otherwise("added")
    rows = rows.withColumn("status", status).withColumn("base", F.when(F.col("status") == "added", ident.slugify(F.coalesce(F.nullif("title", F.lit("")), "source_id"), ascii_only)))
    taken = existing.groupBy(F.lower("slug").alias("base")).agg(F.count("*").alias("taken"))
    rows = rows.join(taken, "base", "left")
    before = F.when(F.col("base").isNotNull(), F.coalesce("taken", F.lit(0)) + F.row_number().over(Window.partitionBy("base").orderBy("record")) - 1)
    return rows.withColumn("before", before).select("record", "source_id", "status", F.when(F.col("base").isNotNull(), ident.slug_with_suffix(F.col("base"), F.col("source_id"), F.col("before"))).alias("slug"))


def code(records: DataFrame, current: DataFrame, codes: DataFrame, targets: DataFrame) -> DataFrame:
    """(record, result) of proposed codings (record, codebook, code, value, target, coder) against the active ones (codebook, target, coder,
    label), the codebooks' codes (codebook, closed, code) and the known targets (target): unknown codebook, both or neither, closed, open,
    unknown code, unknown target; else unchanged, replaced (the coder had another label there), or added."""
    books = codes.groupBy("codebook").agg(F.max(F.coalesce("closed", F.lit(True))).alias("closed"), F.collect_set("code").alias("known"))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    rows = records.withColumn("label", F.coalesce(F.nullif("code", F.lit("")), F.nullif("value", F.lit(""))))
    rows = rows.join(books, "codebook", "left").join(targets.select("target").distinct().withColumn("there", F.lit(True)), "target", "left")
    rows = rows.join(current.select("codebook", "target", "coder", F.col("label").alias("old")), ["codebook", "target", "coder"], "left")
    result = (
        F.when(F.col("closed").isNull(), "unknown codebook").when(has("code") == has("value"), "both or neither").when(F.col("closed") & has("value"), "closed").when(~F.col("closed") & has("code"), "open")
        .when(F.col("closed") & ~F.array_contains("known", F.col("code")), "unknown code").when(F.col("there").isNull(), "unknown target")
        .when(F.col("old") == F.col("label"), "unchanged").when(F.col("old").isNotNull(), "replaced").otherwise("added")
    )
    return rows.select("record", result.alias("result"))


def journal_ids(events: DataFrame, order: list[str], last: int) -> DataFrame:
    """events with their ids evt-%06d, in order, counted on from `last`."""
    placed = reports.numbered(events, order, "place")
    return placed.withColumn("event_id", F.concat(F.lit("evt-"), F.lpad((F.col("place") + last + 1).cast("string"), F.greatest(F.lit(6), F.length((F.col("place") + last + 1).cast("string"))), F.lit("0")))).drop("place")


def pending(units: DataFrame, done: DataFrame) -> DataFrame:
    """units (unit, digest) that aren't done, or were done from another digest."""
    return units.join(done.select("unit", "digest").distinct(), ["unit", "digest"], "left_anti")
