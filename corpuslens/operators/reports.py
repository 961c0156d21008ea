"""Reports over coded and screened rows: counts, tallies, calibration, agreement of runs, evidence maps, time lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_marks
from ..sources.shared import checkpointed
from . import stats

#: Names of places by region; a place outside them is elsewhere.
US_NAMES = ("united states", "usa", "us", "u.s.", "u.s.a.", "united states of america", "america")
US_STATES = (
    "california", "new york", "texas", "massachusetts", "oregon", "washington", "colorado", "minnesota", "illinois", "vermont", "maine",
    "hawaii", "arizona", "michigan", "pennsylvania", "florida",
)
EUROPE_NAMES = (
    "europe", "european union", "eu", "uk", "united kingdom", "great britain", "britain", "england", "scotland", "wales", "northern ireland",
    "ireland", "netherlands", "the netherlands", "belgium", "luxembourg", "france", "germany", "austria", "switzerland", "italy", "spain",
    "portugal", "greece", "denmark", "sweden", "norway", "finland", "iceland", "estonia", "latvia", "lithuania", "poland", "czech republic",
    "czechia", "slovakia", "hungary", "slovenia", "croatia", "romania", "bulgaria", "serbia", "cyprus", "malta", "scandinavia",
    "nordic countries",
)
#: Confidence in the words that readers see.
SUPPORT = {"very high": "well", "high": "well", "medium": "some", "low": "limited", "very low": "weak"}


def counts(owners: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """owners' keys with how many rows of each part (a table with that key) they have, none included."""
    out = owners.select(key)
    for name, part in parts.items():
        out = out.join(part.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.na.fill(0, list(parts))


def coding_report(codings: DataFrame, codes: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of codings (code, source, coder): (code, codings, sources, coders, per_source) for every code of codes, those never used with
    zeros; and the sources without any coding."""
    per = codings.groupBy("code").agg(F.count("*").alias("codings"), F.countDistinct("source").alias("sources"), F.countDistinct("coder").alias("coders"))
    table = codes.select("code").distinct().join(per, "code", "left").na.fill(0, ["codings", "sources", "coders"])
    table = table.withColumn("per_source", F.round(F.when(F.col("sources") > 0, F.col("codings") / F.col("sources")).otherwise(0.0), 3))
    return table, sources.join(codings.select("source").distinct(), "source", "left_anti")


def tally(rows: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """(keys..., n), the commonest first, ties by key; most: the number of lines of the report."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), *keys).limit(most) if most else out


def relevance_by_year(rows: DataFrame, least: int = 2) -> DataFrame:
    """(year, relevant, screened, share) of screened rows (year, r): relevant ones have a rating of `least` or more."""
    out = rows.where("year is not null").groupBy("year").agg(F.count_if(F.col("r") >= least).alias("relevant"), F.count("*").alias("screened"))
    return out.withColumn("share", F.round(F.col("relevant") / F.col("screened"), 4))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place from 0 in the whole order: ranges are numbered on their own, then shifted by the sizes of those before them.
    order must be unique."""
    parted = checkpointed(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parted.withColumn(name, inside.cast("long")).join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def strata(rows: DataFrame, score: str, id_: str, parts: int = 5) -> DataFrame:
    """rows with their stratum: fifths of the order by score and id, from the least."""
    n = rows.count()
    placed = numbered(rows, [score, id_], "place")
    return placed.withColumn("stratum", F.least(F.lit(parts - 1), F.floor(F.col("place") * parts / F.lit(max(1, n)))).cast("int")).drop("place")


def calibration(rows: DataFrame, least: int = 2) -> DataFrame:
    """(rescreened, missed, low, high, weighted) of rows left out that were rated again (stratum, stratum_size, row_r): those rated `least`
    or more were missed. weighted: each stratum's share of misses by its size."""
    per = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("row_r") >= least).alias("missed"), F.max("stratum_size").alias("size"))
    out = per.agg(F.sum("n").alias("rescreened"), F.sum("missed").alias("missed"), (F.sum(F.col("missed") / F.col("n") * F.col("size")) / F.sum("size")).alias("weighted"))
    ci = stats.wilson(F.col("missed"), F.col("rescreened"))
    return out.select("rescreened", "missed", F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"), F.round("weighted", 6).alias("weighted"))


def precision_recall(rows: DataFrame, keys: list[str], positive: int = 2) -> DataFrame:
    """(keys..., precision, recall and their intervals) of rows (truth, found): ratings of `positive` or more count as such."""
    t, f = F.col("truth") >= positive, F.col("found") >= positive
    n = rows.groupBy(*keys).agg(F.count_if(t & f).alias("both"), F.count_if(f).alias("found"), F.count_if(t).alias("true"))
    out = n.select(*keys, "both", "found", "true")
    for name, of in (("precision", "found"), ("recall", "true")):
        ci = stats.wilson(F.col("both"), F.col(of))
        out = out.withColumns({name: F.round(F.col("both") / F.nullif(F.col(of), F.lit(0)), 6), f"{name}_low": F.round(ci["low"], 6), f"{name}_high": F.round(ci["high"], 6)})
    return out.drop("both", "found", "true")


def same_answers(answers: DataFrame) -> DataFrame:
    """(field, units, same, rate) of answers (unit, field, run, value): units that were answered twice or more, and those answered alike each
    time; a list's parts are compared as a set."""
    parts = F.filter(F.transform(F.split(F.coalesce("value", F.lit("")), ";"), lambda x: F.btrim(x)), lambda x: x != "")
    per = answers.groupBy("field", "unit").agg(F.count("*").alias("n"), F.countDistinct(F.array_join(F.array_sort(F.array_distinct(parts)), ";")).alias("kinds")).where("n > 1")
    out = per.groupBy("field").agg(F.count("*").alias("units"), F.count_if(F.col("kinds") == 1).alias("same"))
    return out.withColumn("rate", F.round(F.col("same") / F.col("units"), 6))


def votes(runs: DataFrame, unit: str, fields: list[str]) -> DataFrame:
    """(unit, field, votes, majority) of runs with a column for each field: each field's value with more than half of the votes."""
    long = runs.select(unit, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("label")) for f in fields])).alias("x")).select(unit, "x.*")
    return stats.majority(long, [unit, "field"])


def evidence_map(statements: DataFrame, thin: int = 3) -> DataFrame:
    """(theme, well, some, limited, weak, statements, good_share, thin) of statements (theme, confidence)."""
    word = F.create_map(*[F.lit(x) for pair in SUPPORT.items() for x in pair])[F.col("confidence")]
    per = statements.withColumn("support", word).groupBy("theme").agg(*[F.count_if(F.col("support") == s).alias(s) for s in ("well", "some", "limited", "weak")], F.count("*").alias("statements"))
    good = F.round((F.col("well") + F.col("some")) / F.col("statements"), 4)
    return per.withColumns({"good_share": good, "thin": F.col("statements") < thin})


def single_source(claims: DataFrame) -> DataFrame:
    """(claims, single, share) of claims (source_ids array)."""
    out = claims.agg(F.count("*").alias("claims"), F.count_if(F.size(F.array_distinct("source_ids")) == 1).alias("single"))
    return out.withColumn("share", F.round(F.col("single") / F.nullif(F.col("claims"), F.lit(0)), 6))


def timeline(events: DataFrame, threads: list[str]) -> DataFrame:
    """(year, a column for each thread, total) of events (year, thread)."""
    cols = [F.count_if(F.col("thread") == x).alias(x) for x in threads]
    return events.groupBy("year").agg(*cols, F.count("*").alias("total"))


def sparse_merged(years: DataFrame, least: int) -> DataFrame:
    """(first, last, total) of (year, total): runs of neighbouring years that have under `least` events each are one row; a table of years."""
    w = Window.orderBy("year")
    few = F.col("total") < least
    new = F.when(few & F.lag(few).over(w) & (F.lag("year").over(w) == F.col("year") - 1), 0).otherwise(1)
    return years.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("run").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.sum("total").alias("total")).drop("run")


def running_lines(pages: DataFrame, edge: int = 3, share: float = 0.34) -> DataFrame:
    """(doc, key, pages) of pages (doc, page, text): lines that stand among the first or last `edge` lines of a third of a document's pages,
    three at least; white space and numbers don't tell them apart. Documents of under three pages have none. A page is a row for each of
    its edge lines, so that a document's pages never meet but as counts."""
    rows = pages.select("doc", "page", F.filter(F.split("text", "\n"), lambda x: F.btrim(x) != "").alias("lines"))
    places = rows.select("doc", "page", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    at_edge = places.where((F.col("i") < edge) | (F.col("n") - F.col("i") <= edge)).where(F.length(F.btrim("line")) > 3)
    as_key = F.lower(F.btrim(F.regexp_replace(F.regexp_replace("line", "[0-9]+", "#"), "\\s+", " ")))
    met = at_edge.groupBy("doc", as_key.alias("key")).agg(F.countDistinct("page").alias("pages"))
    needed = pages.groupBy("doc").agg(F.count("*").alias("n")).where("n >= 3").select("doc", F.greatest(F.lit(3), F.floor(F.col("n") * share)).alias("needed"))
    return met.join(needed, "doc").where("pages >= needed").select("doc", "key", "pages")


def fingerprint(rows: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """(keys..., n, sha256): a group's lines in order as one hash; a group is an export's part, small by definition."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"))


#: What stands between several places in one cell.
BETWEEN_PLACES = ("[,;/&()]", "\\band\\b")
#: The regions, the one that decides first.
REGIONS = ("us", "europe", "elsewhere")


def country_parts(country: Column) -> Column:
    """The places that a cell names: a country with its state, or several countries."""
    cell = F.coalesce(country, F.lit(""))
    for between in BETWEEN_PLACES:
        cell = F.regexp_replace(cell, between, "\n")
    return F.array_compact(F.transform(F.split(cell, "\n"), lambda x: F.nullif(F.btrim(x), F.lit(""))))


def region_of(country: Column) -> Column:
    """The region of a cell's places, by the order of REGIONS; marks and case don't count. A cell without a place is elsewhere."""
    names = F.transform(country_parts(country), fold_marks)
    own = {name: region for region, known in (("europe", EUROPE_NAMES), ("us", US_NAMES + US_STATES)) for name in known}
    known = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    rank = lambda x: F.array_position(F.array(*map(F.lit, REGIONS)), F.when(x.contains("united states"), "us").otherwise(F.coalesce(F.try_element_at(known, x), F.lit("elsewhere"))))
    return F.element_at(F.array(*map(F.lit, REGIONS)), F.coalesce(F.array_min(F.transform(names, rank)), F.lit(len(REGIONS))).cast("int"))


def setting_of(sector: Column, countries: Column, sectors: list[str], places: list[str]) -> Column:
    """target, near or other: whether a study lies in the sectors, in the places, in both or in neither."""
    here = F.coalesce(F.exists(countries, lambda c: (F.btrim(c) != "") & region_of(c).isin(*places)), F.lit(False))
    there = F.coalesce(sector.isin(*sectors), F.lit(False))
    return F.when(here & there, "target").when(here | there, "near").otherwise("other")


def citation_tier(published: Column, asof: Column, percentile: Column, top1: Column, top10: Column) -> Column:
    """A cited work's tier: too recent under 24 whole months, not indexed without a percentile, else by its flags and the median."""
    months = (F.year(asof) - F.year(published)) * 12 + F.month(asof) - F.month(published) - F.when(F.day(asof) < F.day(published), 1).otherwise(0)
    return F.when(published.isNull(), "not-indexed").when(months < 24, "too-recent").when(percentile.isNull(), "not-indexed").when(top1, "top-1").when(top10, "top-10").when(percentile >= 0.5, "above-median").otherwise("below-median")
