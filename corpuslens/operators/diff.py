"""Differences between two builds: keyed, by field, by set, and inputs that changed since they were recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def keyed(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, state, changed): gone, new, same or changed, and the names of the fields that changed, in order."""
    a = before.select(F.col(key), F.struct(*fields).alias("a"))
    b = after.select(F.col(key), F.struct(*fields).alias("b"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    state = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").when(F.size("changed") == 0, "same").otherwise("changed")
    both = a.join(b, key, "full_outer").withColumn("changed", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), names).otherwise(F.array().cast("array<string>")))
    return both.select(key, state.alias("state"), F.array_join("changed", ";").alias("changed"))


def sets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(side, n): how many different rows are only in one or in both."""
    a, b = before.distinct().withColumn("__a", F.lit(1)), after.distinct().withColumn("__b", F.lit(1))
    names = before.columns
    cond = [a[n].eqNullSafe(b[n]) for n in names]
    both = a.join(b, cond, "full_outer")
    side = F.when(F.col("__b").isNull(), "only before").when(F.col("__a").isNull(), "only after").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def drift(recorded: DataFrame, now: DataFrame, key: str, hash_: str = "sha256") -> DataFrame:
    """(key, state) of inputs that changed or went since their hash was recorded."""
    joined = recorded.select(key, F.col(hash_).alias("__h")).join(now.select(key, F.col(hash_).alias("__n")), key, "left")
    return joined.select(key, F.when(F.col("__n").isNull(), "missing").when(F.col("__n") != F.col("__h"), "changed").alias("state")).where("state is not null")


def chains(links: DataFrame, most: int = 64) -> DataFrame:
    """(id, first, current, revisions) of supersession links (id, supersedes): by doubling, so long chains take few joins."""
    now = links.select("id", F.coalesce("supersedes", "id").alias("up"), F.when(F.col("supersedes").isNotNull(), 1).otherwise(0).alias("d"))
    for _ in range(most):
        step = now.select(F.col("id").alias("up"), F.col("up").alias("upper"), F.col("d").alias("more"))
        moved = F.coalesce(F.col("upper") != F.col("up"), F.lit(False))  # told in the round itself, without a join of both rounds
        nxt = checkpointed(now.join(step, "up", "left").select("id", F.coalesce("upper", "up").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), moved.alias("moved")))
        if nxt.where("moved").isEmpty():
            break
        now = nxt.drop("moved")
    last = now.groupBy("up").agg(F.max_by("id", F.struct("d", "id")).alias("current"), F.count("*").alias("revisions"))
    return now.join(last, "up").select("id", F.col("up").alias("first"), "current", "revisions")
