"""Readers: object files, JSON lines with their broken lines told apart, tables as strings, texts with their bytes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clock_seconds

#: Schemas of the object files, given rather than inferred.
EXTRACTION = "extraction_id string, source_id string, representation_ref string, type string, status string, text string, direct_quote string, locator struct<type: string, representation_ref: string, value: struct<start: long, end: long>>, supersedes string, superseded_by string"
CODING = "coding_id string, codebook_ref string, code string, value string, target struct<kind: string, id: string>, coder string, status string, supersedes string, superseded_by string"
EVENT = "event_id string, activity_type string, tool string, model string, person string, started_at string, ended_at string, status string, outputs map<string, array<string>>"


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with file and raw, findings (file, code, n)): lines that aren't JSON objects are findings. Whether only a file's last piece is
    broken (a write that was cut off) shows in the bytes: such a file doesn't end in a line feed."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("raw")).where(F.btrim("raw") != "")
    parsed = lines.withColumn("row", F.from_json("raw", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}))
    bad = parsed.where(F.col("row.__bad").isNotNull() | F.col("row").isNull())
    cut = spark.read.format("binaryFile").load(path).select(F.col("path"), (F.substring("content", -1, 1) != F.lit(b"\n")).alias("cut"))
    name = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    per = bad.groupBy(name(F.col("file")).alias("file")).agg(F.count("*").alias("n"))
    found = per.join(cut.select(name(F.col("path")).alias("file"), "cut"), "file").select("file", F.when(F.col("cut") & (F.col("n") == 1), "jsonl_torn_tail").otherwise("jsonl_invalid").alias("code"), "n")
    good = parsed.where(F.col("row.__bad").isNull() & F.col("row").isNotNull())
    return good.select("file", "raw", F.col("row").dropFields("__bad").alias("row")).select("file", "raw", "row.*"), found


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file, with its path and raw text."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    return whole.withColumn("row", F.from_json("raw", schema)).select("file", "raw", "row.*")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, utf8_ok, text, char_count): files as bytes; text is null where they aren't UTF-8."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), text.isNotNull().alias("utf8_ok"), text.alias("text"), F.length(text).alias("char_count"))


def table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV table whose cells are all strings, null for none: headers, quotes doubled, line feeds inside cells; a byte-order mark goes. As cells may
    hold line feeds a file can't be split: each is one task's work, so large tables come as folders of files."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', inferSchema=False, emptyValue="")
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def sniffed(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The delimiter of a text table: of comma, tab, semicolon and bar the one that stands equally often, and most often, in its first lines (of
    the first file, if path is a folder)."""
    head = [r[0] for r in spark.read.text(path).limit(lines).collect() if r[0].strip()]
    counts = {d: [_outside_quotes(x).count(d) for x in head] for d in (",", "\t", ";", "|")}
    even = {d: n[0] for d, n in counts.items() if n and n[0] and len(set(n)) == 1}
    return max(even, key=even.get) if even else max(counts, key=lambda d: counts[d][0] if counts[d] else 0)


def _outside_quotes(line: str) -> str:
    return "".join(line.split('"')[::2])


def any_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings from a file by its ending: .csv with a sniffed delimiter, .tsv, .jsonl or .ndjson (cells by profile.cell; its
    columns are all keys that occur, by name)."""
    from ..operators.profile import as_strings

    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("jsonl", "ndjson"):
        return as_strings(spark.read.json(path))
    if ending == "tsv":
        return table(spark, path, "\t").na.fill("")
    if ending == "csv":
        return table(spark, path, sniffed(spark, path)).na.fill("")
    raise ValueError(f"no table format: {path}")


def table_files(spark: SparkSession, folders: list[str]) -> list[str]:
    """The table files that lie directly in the folders, in order."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,tsv,jsonl,ndjson}").load(folders).select("path")
    return sorted(r[0] for r in found.where(~F.col("path").rlike("/\\.[^/]*$")).collect())


def table_names(paths: list[str]) -> dict[str, str]:
    """A name for each file: its stem, with its folder's before it where several files share one."""
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    stems = [stem(p) for p in paths]
    folder = lambda p: re.sub(r"[^a-z0-9]+", "-", p.rsplit("/", 2)[-2].lower()).strip("-")
    return {p: s if stems.count(s) == 1 else f"{folder(p)}_{s}" for p, s in zip(paths, stems, strict=True)}


def captions(texts: DataFrame, key: str) -> DataFrame:
    """(key, cue, start, end, speaker, text) of caption files (key, text), WebVTT or SRT: cue times in seconds, tags removed, `Name: words`
    told apart unless the name looks like a time; cues without words are left out."""
    shape = "(?m)^[ \\t]*(\\S+)[ \\t]*-->[ \\t]*(\\S+)[^\\n]*\\n((?:[^\\n]*\\S[^\\n]*(?:\\n|\\z))*)"
    text = F.concat(F.regexp_replace("text", "\r\n?", "\n"), F.lit("\n"))
    part = lambda i: F.regexp_extract_all(text, F.lit(shape), F.lit(i))
    rows = texts.select(key, F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("t"))).alias("cue", "x"))
    said = F.btrim(F.regexp_replace(F.regexp_replace("x.t", "<[^>]+>", ""), "\\s+", " "))
    rows = rows.select(key, "cue", clock_seconds(F.col("x.a")).alias("start"), clock_seconds(F.col("x.b")).alias("end"), said.alias("said"))
    name = F.regexp_extract("said", "^([^:]{1,60}):\\s+(.*)$", 1)
    named = (name != "") & ~name.rlike("\\d:\\d")
    words = F.when(named, F.regexp_extract("said", "^([^:]{1,60}):\\s+(.*)$", 2)).otherwise(F.col("said"))
    return rows.select(key, "cue", "start", "end", F.when(named, F.btrim(name)).alias("speaker"), words.alias("text")).where("text <> ''")
