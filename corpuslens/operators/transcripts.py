"""Transcripts: turns, answers, offsets, times; spans that contain, overlap or precede others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turns(segments: DataFrame, rec: str = "rec", order: str = "ord", speaker: str = "speaker") -> DataFrame:
    """segments with turn: consecutive ones of one speaker. An aside (column aside, if there) belongs to the turn around it, and one left out
    (left_out) ends a turn."""
    aside = F.coalesce("aside", F.lit(False)) if "aside" in segments.columns else F.lit(False)
    out = F.coalesce("left_out", F.lit(False)) if "left_out" in segments.columns else F.lit(False)
    w = Window.partitionBy(rec).orderBy(order)
    heard = F.when(~aside, F.struct(F.col(speaker).alias("s"), out.alias("o")))
    before = F.last(heard, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    change = ~aside & (before.isNull() | ~before["s"].eqNullSafe(F.col(speaker)) | before["o"] | out)
    marked = segments.withColumn("__c", F.coalesce(change, F.lit(False)).cast("int"))
    return marked.withColumn("turn", F.sum("__c").over(w)).drop("__c")


def answers(labelled: DataFrame, rec: str = "rec", order: str = "ord") -> DataFrame:
    """(rec, question, first, last, text length...) of turns (kind: question, answer or other): the answers that follow a question."""
    w = Window.partitionBy(rec).orderBy(order)
    q = F.last(F.when(F.col("kind") == "question", F.col(order)), ignorenulls=True).over(w)
    return labelled.withColumn("question", q).where("kind = 'answer' and question is not null").groupBy(rec, "question").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum(F.length("text")).alias("chars"))


def offsets(parts: DataFrame, rec: str, order: str, text: str, gap: int = 1) -> DataFrame:
    """parts with c0 and c1: their code points in the joined text, `gap` characters between parts."""
    w = Window.partitionBy(rec).orderBy(order)
    n = F.length(text)
    before = F.coalesce(F.sum(n + gap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("c0", before).withColumn("c1", F.col("c0") + n)


def asides(segments: DataFrame, rec: str = "rec", order: str = "ord", most_words: int = 3, most_seconds: float = 2.0) -> DataFrame:
    """segments with aside: a few words inside another speaker's turn."""
    w = Window.partitionBy(rec).orderBy(order)
    before, after = F.lag("speaker").over(w), F.lead("speaker").over(w)
    short = (F.size(F.split(F.btrim("text"), "\\s+")) <= most_words) & (F.col("end") - F.col("start") <= most_seconds)
    return segments.withColumn("aside", F.coalesce(short & (before == after) & (before != F.col("speaker")), F.lit(False)))


def interviewer(turns_: DataFrame, rec: str = "rec") -> DataFrame:
    """(rec, interviewer): the speaker who asks most."""
    marks = F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit("")))
    per = turns_.groupBy(rec, "speaker").agg(F.sum(marks).alias("asked"))
    return per.groupBy(rec).agg(F.max_by("speaker", F.struct("asked", F.col("speaker"))).alias("interviewer"))


def not_rising(segments: DataFrame, rec: str, order: str, at: str) -> DataFrame:
    w = Window.partitionBy(rec).orderBy(order)
    return segments.withColumn("before", F.lag(at).over(w)).where(F.col(at) < F.col("before"))


def bins(low: Column, high: Column, width: int) -> Column:
    """The bins of a span: what a range join is an equi-join on, so that no pairs of far spans are looked at."""
    return F.explode(F.sequence(F.floor(low / width), F.floor(F.greatest(low, high) / width)))


def contained(outer: DataFrame, inner: DataFrame, on: str, width: int = 4096) -> DataFrame:
    """Pairs (outer columns, inner columns) with inner's s..e inside outer's lo..hi, in the same `on`. An inner span needs its first bin only."""
    a = outer.withColumn("__b", bins(F.col("lo"), F.col("hi"), width))
    b = inner.withColumn("__b", F.floor(F.col("s") / width))
    return a.join(b, [on, "__b"]).where("s >= lo and e <= hi").drop("__b")


def overlapping(left: DataFrame, right: DataFrame, on: str, width: int = 4096) -> DataFrame:
    """Pairs with lo < e and s < hi; a pair that shares several bins counts in the first one."""
    a = left.withColumn("__b", bins(F.col("lo"), F.col("hi"), width))
    b = right.withColumn("__b", bins(F.col("s"), F.col("e"), width))
    first = F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("s") / width))
    return a.join(b, [on, "__b"]).where((F.col("lo") < F.col("e")) & (F.col("s") < F.col("hi")) & (F.col("__b") == first)).drop("__b")


def as_of(rows: DataFrame, marks: DataFrame, on: str, at: str, value: str) -> DataFrame:
    """rows with the value of the last mark at or before their place: one sort over the union of both, no pairs."""
    kinds = dict(marks.dtypes)
    a = marks.select(F.col(on), F.col(at), F.lit(0).alias("__k"), F.col(value))
    b = rows.withColumns({"__k": F.lit(1), value: F.lit(None).cast(kinds[value])})
    w = Window.partitionBy(on).orderBy(at, "__k").rowsBetween(Window.unboundedPreceding, 0)
    both = b.unionByName(a, allowMissingColumns=True)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__k = 1").drop("__k")


def interpolated(rows: DataFrame, on: str, at: str, value: str) -> DataFrame:
    """value filled between its neighbours in proportion to `at`; outside them as it is."""
    w = Window.partitionBy(on).orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).cast("double").alias("y")))
    low = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    mid = low["y"] + (high["y"] - low["y"]) * (F.col(at) - low["x"]) / F.nullif(high["x"] - low["x"], F.lit(0))
    return rows.withColumn("filled", F.coalesce(F.col(value).cast("double"), mid))
