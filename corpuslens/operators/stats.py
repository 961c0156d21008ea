"""Agreement statistics as aggregations: pairs of labels become small count tables, and the formulas run over those."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Counts of (a, b): after this the work is over labels, not rows."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))



def kappa(pairs: DataFrame, by: list[str] | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(by..., n, agreement, kappa): null where chance agreement is total."""
    by = by or []
    c = cells(pairs, by, a, b).groupBy(*by).agg(F.collect_list(F.struct("a", "b", "n")).alias("c"), F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    total = lambda x, side: F.aggregate(F.filter("c", lambda y: y[side] == x), F.lit(0).cast("bigint"), lambda s, y: s + y["n"])
    labels = F.array_distinct(F.transform("c", lambda x: x["a"]))
    chance = F.aggregate(labels, F.lit(0.0), lambda s, x: s + total(x, "a").cast("double") * total(x, "b")) / (F.col("n").cast("double") * F.col("n"))
    agree = F.col("same") / F.col("n")
    c = c.where("n > 0").withColumns({"po": agree, "pe": chance})
    return c.select(*by, "n", F.col("po").alias("agreement"), F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def weighted_kappa(pairs: DataFrame, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Linear weights over a numeric scale low..high; null where chance gives no distance."""
    by = by or []
    c = cells(pairs, by).groupBy(*by).agg(F.collect_list(F.struct("a", "b", "n")).alias("c"), F.sum("n").alias("n"), F.sum(F.abs(F.col("a") - F.col("b")) * F.col("n")).alias("seen"))
    side = lambda s: F.aggregate(F.array_distinct(F.transform("c", lambda x: x[s])), F.array().cast("array<struct<v:double,n:double>>"), lambda acc, v: F.concat(acc, F.array(F.struct(v.cast("double").alias("v"), F.aggregate(F.filter("c", lambda y: y[s] == v), F.lit(0.0), lambda t, y: t + y["n"]).alias("n")))))
    far = F.aggregate(side("a"), F.lit(0.0), lambda s, x: s + F.aggregate("__b", F.lit(0.0), lambda t, y: t + F.abs(x["v"] - y["v"]) * x["n"] * y["n"]))
    span = high - low
    c = c.where("n > 0").withColumn("__b", side("b")).withColumn("expected", far / (F.col("n").cast("double") * F.col("n") * span))
    seen = F.col("seen") / (F.col("n") * F.lit(span))
    return c.select(*by, "n", F.when(F.col("expected") != 0, 1 - seen / F.col("expected")).alias("kappa"))


def alpha_nominal(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Krippendorff's alpha for two coders and nominal labels; null where one label alone occurs."""
    by = by or []
    c = cells(pairs, by)
    both = c.select(*by, F.col("a").alias("v"), "n").union(c.select(*by, F.col("b"), "n")).groupBy(*by, "v").agg(F.sum("n").alias("n"))
    expected = both.groupBy(*by).agg(F.sum("n").alias("values"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    seen = c.groupBy(*by).agg(F.sum("n").alias("pairs"), F.sum(F.when(F.col("a") != F.col("b"), 2 * F.col("n")).otherwise(0)).alias("off"))
    joined = seen.join(expected, by) if by else seen.crossJoin(expected)
    v = F.col("values").cast("double")
    de = (v * v - F.col("squares")) / (v * (v - 1))
    return joined.select(*by, F.col("pairs").alias("n"), F.when(de != 0, 1 - F.col("off") / v / de).alias("alpha"))


def fleiss_ac1(ratings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., items, all_agree, fleiss, ac1) of ratings (item, label), null labels left out; items with two ratings or more count."""
    by = by or []
    per = ratings.where("label is not null").groupBy(*by, "item", "label").agg(F.count("*").alias("n"))
    items = per.groupBy(*by, "item").agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"), F.max("n").alias("top")).where("r > 1")
    shares = per.join(items.select(*by, "item", "r"), [*by, "item"]).groupBy(*by, "label").agg(F.sum(F.col("n") / F.col("r")).alias("w"))
    overall = items.groupBy(*by).agg(F.count("*").alias("items"), F.avg(F.col("agree") / (F.col("r") * (F.col("r") - 1))).alias("pa"), F.avg((F.col("top") == F.col("r")).cast("int")).alias("all_agree"))
    marks = shares.groupBy(*by).agg(F.collect_list("w").alias("ws"), F.greatest(F.lit(2), F.count("*")).alias("q"))
    joined = overall.join(marks, by) if by else overall.crossJoin(marks)
    p = lambda f: F.aggregate("ws", F.lit(0.0), lambda s, w: s + f(w / F.col("items")))
    pe, pg = p(lambda x: x * x), p(lambda x: x * (1 - x)) / (F.col("q") - 1)
    ratio = lambda e: F.when(e < 1, (F.col("pa") - e) / (1 - e))
    return joined.withColumns({"pe": pe, "pg": pg}).select(*by, "items", "all_agree", ratio(F.col("pe")).alias("fleiss"), ratio(F.col("pg")).alias("ac1"))


def majority(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., votes, majority): the label with more than half of the non-null votes, else null."""
    per = ratings.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    votes = F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0))
    top = F.max_by(F.when(F.col("label").isNotNull(), F.col("label")), F.when(F.col("label").isNotNull(), F.col("n")))
    most = F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0))
    return per.groupBy(*keys).agg(votes.alias("votes"), F.when(2 * most > votes, top).alias("majority"))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of a share's interval, clipped to 0..1; null without trials."""
    p, m = hits / n, n.cast("double")
    mid = p + z * z / (2 * m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    scale = 1 + z * z / m
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), (mid - half) / scale).alias("low"), F.least(F.lit(1.0), (mid + half) / scale).alias("high")))


def gate(measure: Column, top_share: Column, agreement: Column, ac1: Column, n: Column) -> Column:
    """Whether runs agree: 0.8 alike, and from 10 items on a measure of 0.4 (AC1 where one label holds 0.7 or more of them)."""
    used = F.when(top_share >= 0.7, ac1).otherwise(measure)
    return (agreement >= 0.8) & ((n < 10) | (F.coalesce(used, F.lit(1.0)) >= 0.4))


def bootstrap(pairs: DataFrame, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """(low, high): the 2.5 and 97.5 % places of kappa over resamples of the pairs (a, b), with replacement. Drawing the pairs anew is
    drawing how often each pair of labels comes, a multinomial draw over the table of label pairs, which is as small as a codebook's
    square; tasks draw the replicates, each with a seed of its own."""
    spark = pairs.sparkSession
    table = pairs.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).orderBy("a", "b").toPandas()
    labels = sorted({*table["a"], *table["b"]})
    left, right = (np.searchsorted(labels, table[c].to_numpy()) for c in ("a", "b"))
    shared = spark.sparkContext.broadcast((left, right, table["n"].to_numpy(), len(labels)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, n, k = shared.value
        total = int(n.sum())
        for batch in batches:
            out = []
            for run in batch["id"]:
                drawn = np.random.default_rng((seed, int(run))).multinomial(total, n / max(1, total)) if total else n
                same = drawn[left == right].sum() / max(1, total)
                pe = (np.bincount(left, drawn, k) * np.bincount(right, drawn, k)).sum() / max(1, total) ** 2
                if total and pe < 1:
                    out.append((same - pe) / (1 - pe))
            yield pd.DataFrame({"k": np.array(out, dtype=float)})

    ranked = spark.range(replicates).mapInPandas(draw, "k double").agg(F.sort_array(F.collect_list("k")).alias("k"))  # as many as there are replicates
    place = lambda p: F.when(F.size("k") > 0, F.element_at("k", F.greatest(F.lit(1), F.ceil(F.size("k") * p).cast("int"))))
    return ranked.select(place(0.025).alias("low"), place(0.975).alias("high"))
