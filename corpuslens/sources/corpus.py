"""Corpora as folders of object files, read as one table for each kind of object; many corpora at once.

Every row carries its corpus (the folder's name). Files are listed and read by Spark as bytes; JSON is parsed under given schemas, JSON
lines by line, and what can't be parsed becomes a finding. Containment is lexical: Spark's readers don't tell links from files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ident import lexically_inside
from .shared import checkpointed

#: Fixed value: the format's key of an object's stamp (what made it, when, from what), and of the journal's section. It is read as `stamp`.
STAMP_KEY = "provenance"
STAMP = "stamp struct<produced_by: struct<tool: string, model: string, method: string>, created_at: string, input_digest: string, derived_from: struct<source_ids: array<string>, representation_refs: array<string>, extraction_ids: array<string>, generation_ids: array<string>, synthesis_ids: array<string>>>"
OUTPUT = "output struct<path: string, media_type: string, sha256: string, value: string>"
LOCATOR = "struct<type: string, representation_ref: string, value: string>"
REPRESENTATION = "struct<representation_id: string, role: string, media_type: string, path: string, sha256: string, parent_representation_ref: string, dimensions: struct<width: double, height: double>, duration_seconds: double, " + STAMP.replace(" struct", ": struct", 1) + ">"
#: A manifest's version of the format, whatever the format is called.
VERSION = '"[a-z]+_spec_version"\\s*:\\s*"([^"]*)"'
#: Each kind's schema; fields of codes stand in the order of canonical JSON.
SCHEMAS = {
    "corpora": "spec_version string, corpus_id string, sections map<string, string>, counts map<string, long>, sources array<struct<source_id: string, path: string>>, syntheses array<struct<synthesis_id: string, path: string>>",
    "sources": f"source_id string, source_kind string, title string, representations array<{REPRESENTATION}>, extractions_path string, retrieval struct<original_url: string, final_url: string>, bibliographic struct<item_type: string, title: string, url: string>, identifiers array<struct<scheme: string, value: string>>, relations array<struct<type: string, target: string>>, aliases map<string, string>, {STAMP}",
    "extractions": f"extraction_id string, source_id string, representation_ref string, type string, status string, text string, direct_quote string, locator {LOCATOR}, secondary_locators array<{LOCATOR}>, anchoring struct<method: string, rules: array<string>>, confidence string, confidence_score double, {STAMP}",
    "generations": f"generation_id string, type string, {OUTPUT}, {STAMP}",
    "syntheses": f"synthesis_id string, type string, question string, supersedes string, superseded_by string, claims array<struct<claim_id: string, text: string, evidence_ids: array<string>, source_ids: array<string>>>, {OUTPUT}, {STAMP}",
    "codebooks": f"codebook_id string, namespace string, slug string, closed boolean, multi_label boolean, revision_digest string, codes array<struct<code: string, definition: string, deprecated: boolean, examples: array<string>, label: string, parent: string>>, {STAMP}",
    "codings": f"coding_id string, codebook_ref string, code string, value string, target struct<kind: string, id: string>, coder string, status string, codebook_revision_digest string, {STAMP}",
    "coding_sets": "set_id string, codebook_refs array<string>, coders array<struct<coder: string, kind: string>>",
    "events": "event_id string, activity_type string, tool string, started_at string, status string, inputs map<string, array<string>>, outputs map<string, array<string>>",
}


@dataclass
class Corpora:
    """One table for each kind of object, each with `corpus` and `at` (the file); representations come from the sources. files: (corpus, rel,
    content); findings: (corpus, code, object_id, detail) of what the reader met."""

    corpora: DataFrame
    sources: DataFrame
    representations: DataFrame
    extractions: DataFrame
    generations: DataFrame
    syntheses: DataFrame
    codebooks: DataFrame
    codings: DataFrame
    coding_sets: DataFrame
    events: DataFrame
    files: DataFrame
    findings: DataFrame


def representations_of(sources: DataFrame) -> DataFrame:
    return sources.select("corpus", "source_id", F.explode("representations").alias("r")).select("corpus", "source_id", "r.*")


def _text() -> Column:
    return F.try_validate_utf8(F.col("content").cast("string"))


def _lines(files: DataFrame) -> DataFrame:
    """(corpus, at, raw, last, whole): lines that aren't blank; last: the file's last one; whole: whether the file ends in a line feed."""
    text = F.coalesce(_text(), F.lit(""))
    lines = files.select("corpus", F.col("rel").alias("at"), F.col("content").isNotNull().alias("there"), text.endswith("\n").alias("whole"), F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("raw"))), lambda x: F.btrim(x["raw"]) != "").alias("lines"))
    return lines.select("corpus", "at", "whole", F.posexplode("lines").alias("i", "x"), (F.size("lines") - 1).alias("n")).select("corpus", "at", "x.raw", (F.col("i") == F.col("n")).alias("last"), "whole", F.col("x.i").alias("line"))


def _parsed(rows: DataFrame, kind: str) -> DataFrame:
    shape = f"{SCHEMAS[kind]}, __bad string"
    row = F.from_json("raw", re.sub(r"\bstamp\b", STAMP_KEY, shape), {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}).cast(StructType.fromDDL(shape))
    return rows.withColumn("row", row).withColumn("bad", F.col("row").isNull() | F.col("row.__bad").isNotNull())


def load(spark: SparkSession, base: str) -> Corpora:
    """The corpora whose folders lie in base."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    root = base.split(":", 1)[-1].strip("/") + "/"
    inner = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", ""), root, -1)
    files = raw.select(F.substring_index(inner, "/", 1).alias("corpus"), F.regexp_replace(inner, "^[^/]+/", "").alias("rel"), "content").where("corpus <> rel")
    files = checkpointed(files)
    findings = []

    def objects(kind: str, rows: DataFrame, needs: str | None = None) -> DataFrame:
        """Whole JSON files; those without `needs` are no objects of the kind."""
        parsed = _parsed(rows.select("corpus", F.col("rel").alias("at"), F.coalesce(_text(), F.lit("")).alias("raw")), kind)
        findings.append(parsed.where("bad").select("corpus", F.lit("load_error" if kind == "corpora" else "schema_invalid").alias("code"), F.col("at").alias("object_id"), F.lit("no JSON object").alias("detail")))
        good = parsed.where("not bad").select("corpus", "at", "raw", F.col("row").dropFields("__bad").alias("row")).select("corpus", "at", "raw", "row.*")
        if kind == "corpora":
            good = good.withColumn("spec_version", F.nullif(F.regexp_extract("raw", VERSION, 1), F.lit("")))
        good = good.drop("raw")
        return checkpointed(good.where(f"{needs} is not null") if needs else good)

    def lines(kind: str, rows: DataFrame) -> DataFrame:
        parsed = _parsed(_lines(rows), kind)
        torn = F.col("last") & ~F.col("whole")
        findings.append(parsed.where("bad").select("corpus", F.when(torn, "jsonl_torn_tail").otherwise("jsonl_invalid").alias("code"), F.col("at").alias("object_id"), F.concat(F.lit("line "), F.col("line") + 1).alias("detail")))
        return checkpointed(parsed.where("not bad").select("corpus", "at", F.col("row").dropFields("__bad").alias("row")).select("corpus", "at", "row.*"))

    corpora = objects("corpora", files.where("rel = 'corpus.json'"))
    section = lambda name, default: F.coalesce(F.try_element_at("sections", F.lit(STAMP_KEY if name == "journal" else name)), F.lit(default))
    places = {"sources": "sources/", "extractions": None, "generations": None, "syntheses": None, "codebooks": None, "codings": None, "journal": f"{STAMP_KEY}/events.jsonl"}
    dirs = corpora.select("corpus", *[section(n, d).alias(f"s_{n}") for n, d in places.items()])
    known = files.join(dirs, "corpus")
    inside = lambda name, rest: F.col("rel").startswith(F.col(f"s_{name}")) & F.substring(F.col("rel"), F.length(f"s_{name}") + 1, F.lit(1 << 20)).rlike(rest)
    listed = corpora.select("corpus", F.explode("sources").alias("x")).select("corpus", F.regexp_replace("x.path", "/+$", "").alias("dir"), F.col("x.source_id").alias("listed"))
    out = listed.where(~lexically_inside(F.col("dir")))
    findings.append(out.select("corpus", F.lit("path_escape").alias("code"), F.col("listed").alias("object_id"), F.col("dir").alias("detail")))
    wanted = listed.select("corpus", F.concat("dir", F.lit("/source.json")).alias("rel"))
    findings.append(listed.where(lexically_inside(F.col("dir"))).join(files.select("corpus", F.regexp_replace("rel", "/source.json$", "").alias("dir")), ["corpus", "dir"], "left_anti").select("corpus", F.lit("missing_source_json"), "dir", F.lit("listed")))
    sources = objects("sources", known.where(inside("sources", "^[^/]+/source\\.json$")).select("corpus", "rel", "content").union(files.join(wanted, ["corpus", "rel"], "left_semi").select("corpus", "rel", "content")).dropDuplicates(["corpus", "rel"]))
    paths = sources.where("extractions_path is not null").select("corpus", F.col("extractions_path").alias("rel"), "source_id")
    findings.append(paths.where(~lexically_inside(F.col("rel"))).select("corpus", F.lit("path_escape"), "source_id", "rel"))
    findings.append(paths.where(lexically_inside(F.col("rel"))).join(files, ["corpus", "rel"], "left_anti").select("corpus", F.lit("missing_file"), "source_id", "rel"))
    own = files.join(paths, ["corpus", "rel"], "left_semi").select("corpus", "rel", "content")
    extractions = lines("extractions", own.union(known.where(inside("extractions", "^[^/]+/items\\.jsonl$")).select("corpus", "rel", "content")).dropDuplicates(["corpus", "rel"]))
    made = F.when(F.col("s_generations").isNotNull(), inside("generations", "^[^/]+\\.json$")).otherwise(inside("sources", "^[^/]+/generated/[^/]+\\.json$"))
    generations = objects("generations", known.where(made), "generation_id")
    indexed = corpora.select("corpus", F.explode("syntheses").alias("x")).select("corpus", F.concat(F.regexp_replace("x.path", "/+$", ""), F.lit("/synthesis.json")).alias("rel"))
    syntheses = objects("syntheses", known.where(inside("syntheses", "^[^/]+/synthesis\\.json$")).select("corpus", "rel", "content").union(files.join(indexed, ["corpus", "rel"], "left_semi").select("corpus", "rel", "content")).dropDuplicates(["corpus", "rel"]))
    codebooks = objects("codebooks", known.where(inside("codebooks", "^[^/]+\\.json$")), "codebook_id")
    coding_sets = objects("coding_sets", known.where(inside("codings", "^[^/]+/manifest\\.json$")))
    codings = lines("codings", known.where(inside("codings", "^[^/]+/items\\.jsonl$")))
    events = lines("events", known.where("rel = s_journal"))
    found = findings[0]
    for x in findings[1:]:
        found = found.union(x)
    return Corpora(corpora, sources, representations_of(sources), extractions, generations, syntheses, codebooks, codings, coding_sets, events, files, found)


def empty(spark: SparkSession, **given: DataFrame) -> Corpora:
    """Corpora of the given tables; kinds not given have no rows, columns not given are null."""
    schemas = {k: f"corpus string, at string, {v}" for k, v in SCHEMAS.items()} | {"files": "corpus string, rel string, content binary", "findings": "corpus string, code string, object_id string, detail string"}
    tables = {}
    for f in fields(Corpora):
        if f.name != "representations":
            blank = spark.createDataFrame([], schemas[f.name])
            tables[f.name] = blank.unionByName(given[f.name], allowMissingColumns=True) if f.name in given else blank
    return Corpora(representations=representations_of(tables["sources"]), **tables)
