"""Exports: mirrors as CSV, citations, JSON lines, derivation nodes, annotation selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ident import char_range_json


def csv_field(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*columns: Column) -> Column:
    parts = [csv_field(c) for c in columns]
    return F.concat_ws(",", *parts)


def cite_key(family: Column, year: Column, object_id: Column) -> Column:
    return F.concat(F.lower(F.regexp_replace(F.coalesce(family, F.lit("anon")), "[^A-Za-z0-9]", "")), F.coalesce(year.cast("string"), F.lit("nd")), F.substring(object_id, 5, 4))


def bibtex(kind: Column, key: Column, fields: dict[str, Column]) -> Column:
    lines = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {k} = {{"), v.cast("string"), F.lit("}"))) for k, v in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(F.array_compact(F.array(*lines)), ",\n"), F.lit("\n}"))


def ris(kind: Column, fields: list[tuple[str, Column]]) -> Column:
    lines = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}  - "), v.cast("string"))) for k, v in fields]
    return F.array_join(F.array_compact(F.array(F.concat(F.lit("TY  - "), kind), *lines, F.lit("ER  - "))), "\n")


def csl(object_id: Column, fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(object_id.alias("id"), *[v.alias(k) for k, v in fields.items()]))


def tagged_lines(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(ord, kind, line): objects of several kinds as JSON lines, kinds in the given order."""
    out = None
    for i, (kind, df) in enumerate(parts):
        rows = df.select(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("line"))
        out = rows if out is None else out.union(rows)
    return out


def generated_by(events: DataFrame) -> DataFrame:
    """(id, event_id): of the events (event_id, outputs) that list an id, the first."""
    return events.select("event_id", F.explode("outputs").alias("id")).groupBy("id").agg(F.min("event_id").alias("event_id"))


def prov_nodes(entities: DataFrame, events: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, type, was_generated_by, was_quoted_from): entities with the event that made them and, for active quotations, their source."""
    made = generated_by(events)
    active = quotes.where(F.coalesce("status", F.lit("active")) == "active").select(F.col("extraction_id").alias("id"), F.col("source_id").alias("was_quoted_from"))
    nodes = entities.select("id", F.lit("Entity").alias("type")).union(events.select(F.col("event_id").alias("id"), F.lit("Activity").alias("type")))
    return nodes.join(made.withColumnRenamed("event_id", "was_generated_by"), "id", "left").join(active, "id", "left")


def fragment(kind: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """A locator as a fragment: pages, boxes, times, lines (whose start counts from 0)."""
    return (
        F.when(kind == "page_range", F.concat(F.lit("page="), a.cast("string")))
        .when(kind == "bbox", F.concat(F.lit("xywh=pixel:"), F.concat_ws(",", a.cast("string"), b.cast("string"), c.cast("string"), d.cast("string"))))
        .when(kind == "timestamp", F.concat(F.lit("t="), F.concat_ws(",", a.cast("string"), b.cast("string"))))
        .when(kind == "line_range", F.concat(F.lit("line="), F.concat_ws(",", (a - 1).cast("string"), b.cast("string"))))
        .when(kind == "char_range", F.concat(F.lit("char="), F.concat_ws(",", a.cast("string"), b.cast("string"))))
    )


def quote_selector(text: Column, start: Column, end: Column, around: int = 32) -> Column:
    from ..functions.text import span

    low = F.greatest(F.lit(0), start - around)
    return F.struct(span(text, start, end).alias("exact"), span(text, low, start).alias("prefix"), span(text, end, F.least(F.length(text), end + around)).alias("suffix"))


def write_single_csv(lines: DataFrame, header: str, path: str) -> None:
    """A mirror as Spark text files under path: the header, then lines (ord, line) in order of ord, range-partitioned rather than in one task."""
    lines.sparkSession.createDataFrame([(header,)], "line string").write.mode("overwrite").text(f"{path}/header")
    lines.orderBy("ord").select("line").write.mode("overwrite").text(f"{path}/rows")


def extraction_lines(extractions: DataFrame) -> DataFrame:
    """(extraction_id, line): the CSV mirror of passages, the locator as canonical JSON. extractions: extraction_id, source_id,
    representation_ref, type, start, end, direct_quote, status."""
    locator = char_range_json(F.col("representation_ref"), F.col("start"), F.col("end"))
    return extractions.select("extraction_id", csv_line(F.col("extraction_id"), F.col("source_id"), F.col("representation_ref"), F.col("type"), locator, F.col("direct_quote"), F.coalesce("status", F.lit("active"))).alias("line"))


def markdown_entry(authors: Column, year: Column, title: Column, container: Column, url: Column) -> Column:
    """A bibliography's line: authors (year). *Title*. Container. <url>; what is missing is left out."""
    has = lambda c: F.coalesce(c.cast("string") != "", F.lit(False))
    who = F.when(has(authors), F.concat(authors, F.when(has(year), F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""), F.lit(". "))).otherwise(F.when(has(year), F.concat(F.lit("("), year.cast("string"), F.lit("). "))).otherwise(""))
    rest = F.concat(F.when(has(title), F.concat(F.lit("*"), title, F.lit("*. "))).otherwise(""), F.when(has(container), F.concat(container, F.lit(". "))).otherwise(""), F.when(has(url), F.concat(F.lit("<"), url, F.lit(">"))).otherwise(""))
    return F.concat(F.lit("- "), F.rtrim(F.concat(who, rest)))
