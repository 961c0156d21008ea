"""Units of tables: linked rows over several hops, neighbours, windows, samples, exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import list_cell
from .profile import without_prefix


def resolve_path(start: DataFrame, key: str, hops: list[tuple[str, DataFrame, str, str]], transform: bool = False) -> DataFrame:
    """(start, target, ord) along hops (from column, table, its key column, its next column): list cells are split, a target counts once for each
    start, at its first place."""
    change = without_prefix if transform else (lambda c: c)
    now = start.select(F.col(key).cast("string").alias("start"), F.col(hops[0][0]).cast("string").alias("at")).withColumn("ord", F.array().cast("array<bigint>"))
    for i, (_, table, to, nxt) in enumerate(hops):
        parts = now.select("start", "ord", F.posexplode(list_cell(F.col("at"))).alias("p", "at"))
        row = table.select(change(F.col(to).cast("string")).alias("k"), F.col(nxt).cast("string").alias("next"))
        now = parts.withColumn("at", change(F.col("at"))).join(row, F.col("at") == F.col("k")).select("start", F.concat("ord", F.array(F.col("p").cast("bigint"))).alias("ord"), F.col("next").alias("at"))
    return now.groupBy("start", F.col("at").alias("target")).agg(F.min("ord").alias("first"))


def joined_export(units: DataFrame, key: str, links: DataFrame, coded: DataFrame, coded_key: str) -> DataFrame:
    """units with the codes of each one's first linked unit, and all linked ids in order, joined by semicolons. links: start, target, first."""
    per = links.groupBy("start").agg(F.min_by("target", F.struct("first", "target")).alias("linked"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "target"))), lambda x: x["target"]), ";").alias("linked_ids"))
    out = units.join(per, F.col(key).cast("string") == F.col("start"), "left").drop("start")
    return out.join(coded.withColumnRenamed(coded_key, "__k"), F.col("linked") == F.col("__k").cast("string"), "left").drop("__k")


def where_in(rows: DataFrame, column: str, values: DataFrame, value: str, negate: bool = False) -> DataFrame:
    """Rows one of whose listed cells is (or none is) among the values. Each different cell is split once and stands for its rows."""
    known = values.select(F.explode(list_cell(F.col(value).cast("string"))).alias("__v")).distinct()
    cell = F.col(column).cast("string")
    cells = rows.select(cell.alias("__c")).distinct().select("__c", F.explode(list_cell(F.col("__c"))).alias("__v"))
    hit = cells.join(known, "__v", "left_semi").select("__c").distinct()
    return rows.join(hit, cell == F.col("__c"), "left_anti" if negate else "left_semi")


def unit_rows(parts: list[DataFrame], key: str) -> DataFrame:
    """The tables' rows in one; a key's later table replaces its row but keeps the first place (ord)."""
    whole = None
    for i, p in enumerate(parts):
        rows = p.withColumn("__table", F.lit(i))
        whole = rows if whole is None else whole.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col("__table").desc())
    return whole.withColumns({"__n": F.row_number().over(w), "first_table": F.min("__table").over(Window.partitionBy(key))}).where("__n = 1").drop("__n", "__table")


def neighbours(rows: DataFrame, group: str, order: list[str], before: int, after: int, keep: Column | None = None) -> DataFrame:
    """rows with the ids of up to `before` and `after` others around each in its group, in order. keep: which rows count as neighbours at all;
    it holds before any are counted off. The last column of order is the id."""
    chosen = rows if keep is None else rows.withColumn("__keep", keep)
    value = F.col(order[-1]) if keep is None else F.when(F.col("__keep"), F.col(order[-1]))
    w = Window.partitionBy(group).orderBy(*order)
    if keep is None:
        ahead = F.collect_list(value).over(w.rowsBetween(-before, -1)) if before else F.array()
        behind = F.collect_list(value).over(w.rowsBetween(1, after)) if after else F.array()
        return chosen.withColumns({"before": ahead, "after": behind})
    # the kept rows are numbered; a row takes those whose numbers lie around its own place, by a join on bounded ranges
    place = F.sum(F.col("__keep").cast("int")).over(w)
    placed = chosen.withColumn("__p", place)
    kept = placed.where("__keep").select(F.col(group).alias("__g"), F.col("__p").alias("__q"), F.col(order[-1]).alias("__id"))
    wants = placed.withColumn("__q", F.explode(F.sequence(F.col("__p") - before + F.when(F.col("__keep"), 0).otherwise(1), F.col("__p") + after)))
    met = wants.join(kept.withColumnRenamed("__q", "__r"), (F.col(group) == F.col("__g")) & (F.col("__q") == F.col("__r")), "left").where(F.col("__id").isNull() | (F.col("__id") != F.col(order[-1])))
    is_before = F.when(F.col("__keep"), F.col("__q") < F.col("__p")).otherwise(F.col("__q") <= F.col("__p"))
    side = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond & F.col("__id").isNotNull(), F.struct("__q", "__id")))), lambda x: x["__id"])
    lists = met.groupBy(group, *order).agg(side(is_before).alias("before"), side(~is_before).alias("after"))
    return rows.join(lists, [group, *order], "left")


def screen_windows(rows: DataFrame, group: str, order: list[str], size: str, most: int, overlap: int = 1) -> DataFrame:
    """(group, window, order...) of whole rows packed in order into windows of `most` characters at most, always a row or more; the last
    `overlap` rows of a window open the next one and count in it.

    The state (window, its size, its last rows) passes through a stream of sorted rows, so a group of any length needs no more memory."""
    names = [group, *order]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window, used, tail = None, 0, 0, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                key, rest, n = row[0], row[:-1], row[-1]
                if key != now:
                    now, window, used, tail = key, 0, 0, []
                if used and used + n > most:
                    window += 1
                    again = tail[-overlap:] if overlap else []
                    if sum(x[1] for x in again) + n > most:
                        again = []
                    out += [(*x[0], window) for x in again]
                    used, tail = sum(x[1] for x in again), again
                out.append((*rest, window))
                used += n
                tail = [*tail[-overlap:], (rest, n)] if overlap else []
            yield pd.DataFrame(out, columns=[*names, "window"])

    kinds = dict(rows.dtypes)
    sized = rows.select(*names, F.col(size).cast("long").alias("__n")).repartition(group).sortWithinPartitions(*names)
    return sized.mapInPandas(pack, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", window long")


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows in turn over the strata, inside a stratum by a seeded hash: the feature is the sample. Each stratum first keeps its own n best,
    so that the ranking sees little."""
    h = F.xxhash64(F.lit(seed), F.col(key).cast("string"))
    w = Window.partitionBy(stratum).orderBy(h, key)
    ranked = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return ranked.orderBy("__n", stratum).limit(n).drop("__n")


def spread(rows: DataFrame, source: str, key: str) -> DataFrame:
    """rows with turn and place: one of each source, then a second of each, sources in order."""
    turn = F.row_number().over(Window.partitionBy(source).orderBy(key))
    return rows.withColumn("turn", turn)


def rank_cap(rows: DataFrame, source: str, best: list[Column], per_source: int, cap: int) -> DataFrame:
    """Best rows first: at most per_source of a source, sources by their best, `cap` in all (the feature is the cap)."""
    w = Window.partitionBy(source).orderBy(*best)
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_source)
    tops = F.min(F.struct(*[b.alias(f"b{i}") for i, b in enumerate(best)])).over(Window.partitionBy(source))
    return ranked.withColumn("__top", tops).orderBy("rank", "__top", source).limit(cap).drop("__top")
