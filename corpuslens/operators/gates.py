"""Integrity gates: stored hashes against bytes, quotations against their spans, markers of derived texts against quotations, badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ident import bare_hash, sha256_hex
from . import anchoring


def hop_a(reps: DataFrame, stored: str = "sha256", content: str = "content") -> DataFrame:
    """Representations whose bytes don't have the stored hash."""
    return reps.where(bare_hash(F.col(stored)) != sha256_hex(F.col(content)))


def hop_b_code(text: Column, utf8_ok: Column, locator_type: Column, start: Column, end: Column, quote: Column) -> Column:
    """null where the quotation equals its span, else the first reason why not."""
    inside = start.isNotNull() & end.isNotNull() & (start >= 0) & (start <= end) & (end <= F.length(text))
    return (
        F.when(~F.coalesce(utf8_ok, F.lit(False)), F.lit("invalid_utf8"))
        .when(F.coalesce(locator_type, F.lit("")) != "char_range", F.lit("quote_locator_missing"))
        .when(~F.coalesce(inside, F.lit(False)), F.lit("locator_range_invalid"))
        .when(tx.span(text, start, end) != quote, F.lit("quote_gate_failed"))
    )


def hop_b(extractions: DataFrame, reps: DataFrame, *keep: str) -> DataFrame:
    """(extraction_id, code, drift): code as hop_b_code; drift: where a failed quotation stands instead, or null. Only quoted extractions; of
    the representations only the columns needed are joined."""
    ext = extractions.where(F.col("direct_quote").isNotNull()).select("extraction_id", "representation_ref", "locator_type", "c_start", "c_end", "direct_quote", *keep)
    text = reps.select(F.col("representation_id").alias("representation_ref"), "text", "utf8_ok")
    code = hop_b_code(F.col("text"), F.col("utf8_ok"), F.col("locator_type"), F.col("c_start"), F.col("c_end"), F.col("direct_quote"))
    place = F.instr("text", F.col("direct_quote")) - 1
    drift = F.when((F.col("code") == "quote_gate_failed") & (place >= 0), place.cast("long"))
    return ext.join(text, "representation_ref").withColumn("code", code).select("extraction_id", "code", drift.alias("drift"), *keep)


def is_textual(media: Column) -> Column:
    m = F.lower(F.coalesce(media, F.lit("")))
    return m.startswith("text/") | m.isin("application/json", "application/xml")


def is_transcript_role(role: Column) -> Column:
    r = F.coalesce(role, F.lit(""))
    return (r == "transcript") | r.contains("ocr")


def derivations(reps: DataFrame) -> DataFrame:
    """(representation_id, derived, rewritten): texts made from bytes that were no text, and texts that a model made from a text."""
    parent = reps.select(F.col("representation_id").alias("pid"), F.col("media_type").alias("parent_media"))
    joined = reps.join(parent, F.col("parent_representation_ref") == F.col("pid"), "left")
    derived = is_transcript_role(F.col("role")) | (F.col("pid").isNotNull() & ~is_textual(F.col("parent_media")))
    rewritten = (F.coalesce(F.col("method"), F.lit("")) == "model") & F.col("pid").isNotNull() & is_textual(F.col("parent_media"))
    return joined.select("representation_id", derived.alias("derived"), rewritten.alias("rewritten"))


def badge(quote: Column, media: Column, has_bytes: Column, locator_type: Column, code: Column, derived: Column, rewritten: Column) -> Column:
    return (
        F.when(quote.isNull(), F.lit("paraphrase"))
        .when(~has_bytes | ~is_textual(media) | (F.coalesce(locator_type, F.lit("")) != "char_range"), "unverifiable")
        .when(code.isNotNull(), "failed")
        .when(derived, "verified-to-transcript")
        .when(rewritten, "verified-to-rewrite")
        .otherwise("verified")
    )


def hop_c(outputs: DataFrame, extractions: DataFrame) -> DataFrame:
    """(object_id, ext_id, form, code, severity) for every marker of the outputs (object_id, output_text) that doesn't hold."""
    marks = outputs.select("object_id", F.explode(tx.quote_markers(F.col("output_text"))).alias("m")).select("object_id", "m.*")
    known = extractions.select(F.col("extraction_id").alias("ext_id"), "direct_quote", F.coalesce("status", F.lit("active")).alias("status"), F.lit(True).alias("known"))
    code = (
        F.when(F.col("known").isNull(), "output_cites_unknown_extraction")
        .when(F.col("direct_quote").isNull(), "cited_extraction_not_quotable")
        .when(F.col("direct_quote") != F.col("quote"), "output_quote_mismatch")
        .when(F.col("status") == "retracted", "cites_retracted")
        .when(F.col("status") == "superseded", "cites_superseded")
    )
    found = marks.join(known, "ext_id", "left").withColumn("code", code).where("code is not null")
    return found.select("object_id", "ext_id", "form", "code", F.when(F.col("code") == "cites_superseded", "warning").otherwise("error").alias("severity"))


def timestamp_problem(start: Column, end: Column, duration: Column, grace: float = 0.5) -> Column:
    shape = start.isNull() | end.isNull() | F.isnan(start) | F.isnan(end)
    return F.when(shape, "shape").when(start < 0, "before start").when(end < start, "reversed").when(duration.isNotNull() & (end > duration + grace), "past end")


def structure_problems(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, ord, problem) of blocks (doc, ord, c0, c1): out of order, outside the text, or text between two blocks."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc").orderBy("ord")
    before = F.coalesce(F.lag("c1").over(w), F.lit(0))
    gap = tx.span(F.col("text"), F.col("before"), F.col("c0"))
    problem = F.when((F.col("c0") < 0) | (F.col("c1") < F.col("c0")) | (F.col("c1") > F.length("text")), "outside").when(F.col("c0") < F.col("before"), "order").when(~gap.rlike("^\\s*$"), "gap")
    return blocks.withColumn("before", before).join(texts.select("doc", "text"), "doc").select("doc", "ord", problem.alias("problem")).where("problem is not null")


def leaks(texts: DataFrame, hidden: DataFrame, share: float = 0.6, width: int = 40, stride: int = 20) -> DataFrame:
    """(doc_id, item_id, found, windows): hidden passages (item_id, hidden) of which `share` of the windows or more stand in a text (doc_id,
    text); a passage of 20 code points or more that is shorter than a window is one as a whole. White space is folded in both, so that a
    re-wrapped passage is found; case isn't."""
    one_line = lambda c: F.btrim(F.regexp_replace(c, f"[{tx.SPACE}]+", " "))
    hidden = hidden.select("item_id", one_line(F.col("hidden")).alias("hidden"))
    texts = texts.select("doc_id", one_line(F.col("text")).alias("text"))
    n = F.length("hidden")
    starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1, F.lit(stride))).when(n >= 20, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    windows = hidden.select("item_id", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("hidden"), i, F.lit(width)))).alias("i", "quote"))
    different = windows.select(F.xxhash64("quote").alias("quote_id"), "quote").distinct()
    met = anchoring.hits(texts, different).select("doc_id", "quote").distinct().join(windows, "quote").groupBy("doc_id", "item_id").agg(F.count("*").alias("found"))
    return met.join(windows.groupBy("item_id").agg(F.count("*").alias("windows")), "item_id").where(F.col("found") >= share * F.col("windows"))


def level(findings: DataFrame, has_outputs: Column, has_extractions: Column) -> DataFrame:
    """(status, level): the level reached given the errors (severity, level). Level 0 is named even where its rules fail."""
    top = F.when(has_outputs, 2).when(has_extractions, 1).otherwise(0)
    err = lambda n: F.coalesce(F.bool_or((F.col("severity") == "error") & (F.col("level") <= n)), F.lit(False))
    any_ = F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False))
    return findings.agg(F.when(any_, "failed").otherwise("passed").alias("status"), F.when(err(1), 0).when(err(2), F.least(top, F.lit(1))).otherwise(top).alias("level"))
