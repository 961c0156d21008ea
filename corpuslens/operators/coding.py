"""Codings: usage, co-occurrence, disagreement, supersession, corrections. A coding has codebook, target, coder, code, at, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def active(codings: DataFrame) -> DataFrame:
    return codings.where(F.coalesce("status", F.lit("active")) == "active") if "status" in codings.columns else codings


def usage(codings: DataFrame, codes: DataFrame) -> DataFrame:
    """(codebook, code, applied) for every code of the books, unused ones with 0."""
    used = active(codings).groupBy("codebook", "code").agg(F.count("*").alias("applied"))
    return codes.select("codebook", "code").join(used, ["codebook", "code"], "left").select("codebook", "code", F.coalesce("applied", F.lit(0)).alias("applied"))


def index(codings: DataFrame) -> DataFrame:
    """(codebook, code, passages, sources, coders): how many different ones carry the code."""
    return active(codings).groupBy("codebook", "code").agg(F.countDistinct("target").alias("passages"), F.countDistinct("source").alias("sources"), F.countDistinct("coder").alias("coders"))


def matrix(codings: DataFrame) -> DataFrame:
    """(a, b, passages): passages that carry both codes, a < b. Each passage's codes are few, so pairs are made inside its row: no join."""
    sets = active(codings).groupBy("target").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    pairs = F.flatten(F.transform("codes", lambda a: F.transform(F.filter("codes", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("passages"))


def disagreement(codings: DataFrame) -> DataFrame:
    """(codebook, target, labels, coders) where more than one coder gives more than one label."""
    found = active(codings).groupBy("codebook", "target").agg(F.countDistinct("code").alias("labels"), F.countDistinct("coder").alias("coders"))
    return found.where("labels > 1 and coders > 1")


def newest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def superseded(codings: DataFrame, *order: str) -> DataFrame:
    """Every coding with status and superseded_by: of a (codebook, target, coder)'s answers the last stands; one that repeats the answer before
    it changes nothing (unchanged)."""
    w = Window.partitionBy("codebook", "target", "coder").orderBy(*order)
    last = F.lead("coding_id").over(w)
    before = F.lag("code").over(w)
    state = F.when(last.isNull(), "active").otherwise("superseded")
    return codings.withColumns({"superseded_by": last, "status": state, "unchanged": F.coalesce(F.col("code") == before, F.lit(False))})


def revived(codings: DataFrame, *order: str) -> DataFrame:
    """(codebook, target, coder, code, answers, revivals): the standing answer of each key, and how often an earlier one came back."""
    w = Window.partitionBy("codebook", "target", "coder").orderBy(*order)
    changed = codings.withColumn("__new", F.coalesce(F.col("code") != F.lag("code").over(w), F.lit(True)))
    first = F.min(F.struct(*order)).over(Window.partitionBy("codebook", "target", "coder", "code"))
    back = changed.withColumn("__back", F.col("__new") & (F.struct(*order) != first))
    return back.groupBy("codebook", "target", "coder").agg(F.max_by("code", F.struct(*order)).alias("code"), F.count_if("__new").alias("answers"), F.count_if("__back").alias("revivals"))


def recode(codings: DataFrame, changes: DataFrame) -> DataFrame:
    """(coding_id, result, code) for changes (coding_id, to, retract, why): refused without a reason or with both or neither of `to` and
    `retract`, missing where there is no active coding, else recoded or retracted."""
    known = active(codings).select(F.col("coding_id").alias("k"), F.col("code").alias("old"))
    rows = changes.join(known, F.col("coding_id") == F.col("k"), "left")
    retract = F.coalesce("retract", F.lit(False))
    one = F.col("to").isNotNull() != retract
    result = F.when(F.coalesce(F.btrim("why"), F.lit("")) == "", "refused").when(~one, "refused").when(F.col("k").isNull(), "missing").when(retract, "retracted").when(F.col("to") == F.col("old"), "unchanged").otherwise("recoded")
    return rows.select("coding_id", result.alias("result"), F.when(result == "recoded", F.col("to")).otherwise(F.col("old")).alias("code"))


def ancestors(codes: DataFrame) -> DataFrame:
    """(code, ancestor, depth): each code and all above it, to any depth. codes (code, parent) is a codebook, a small driver-sized table by
    definition; the walk is joins by level, and a code met again (a cycle) ends it, so there are no more levels than codes."""
    step = codes.where("parent is not null").select(F.col("code").alias("c"), F.col("parent").alias("p"))
    now = codes.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("depth"), F.array("code").alias("seen"))
    out = now
    while not now.isEmpty():
        now = now.join(F.broadcast(step), F.col("ancestor") == F.col("c")).where(~F.array_contains("seen", F.col("p"))).select("code", F.col("p").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("p")).alias("seen"))
        now = checkpointed(now)
        out = out.union(now)
    return out.select("code", "ancestor", "depth")


def cycles(codes: DataFrame) -> DataFrame:
    """Codes that are above themselves."""
    step = codes.where("parent is not null")
    up = ancestors(codes).select(F.col("code").alias("c"), "ancestor")
    return step.join(up, (F.col("parent") == F.col("c")) & (F.col("code") == F.col("ancestor"))).select("code").distinct()


def rollup(codings: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, own, total): passages coded with a code, and with it or any code below it."""
    up = ancestors(codes)
    total = active(codings).join(up, "code").groupBy(F.col("ancestor").alias("code")).agg(F.countDistinct("target").alias("total"))
    own = active(codings).groupBy("code").agg(F.countDistinct("target").alias("own"))
    return total.join(own, "code", "left").select("code", F.coalesce("own", F.lit(0)).alias("own"), "total")
