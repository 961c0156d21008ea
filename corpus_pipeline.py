"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage works on all rows that its predecessor kept; all but the last return the columns of documents. Rows that share a doc_id are
treated as each operator says; the near-dedup and the decontamination decide row by row. An empty table goes through as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, langid, line_dedup, packing, simhash
from corpuslens.llm.common import fresh, id_key, shared_dir, table


#: From this probability on a prediction counts against a label.
CONFIDENT = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts and texts without letters, and texts whose label is another language than the
    one that is predicted with CONFIDENT probability or more: filed under a language that they aren't in. Unlabelled texts, and all texts of
    a corpus without any label, go only for the former."""
    own = {c: fresh([*docs.columns, *langid.COLUMNS], f"own_{c}") for c in docs.columns if c.lower() in langid.COLUMNS}
    found = langid.language_id(docs.withColumnsRenamed(own))
    letters = (F.col("lang_pred") != langid.UNKNOWN) | F.coalesce(F.col("text").cast("string").rlike("\\p{L}"), F.lit(False))
    misfiled = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_pred") != F.col("lang")) & (F.col("score") >= CONFIDENT)
    kept = found.where(letters & ~F.coalesce(misfiled, F.lit(False)))
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds go; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the smallest id, of that id's texts the one with the smallest hash."""
    groups = simhash.row_groups(docs.select("doc_id", "text"))
    own, other, text, other_text = (fresh(docs.columns, x) for x in ("own", "other", "own_text", "other_text"))
    kept = groups.groupBy("g").agg(F.min(F.struct("d", "t")).alias("x")).select(F.col("x.d").alias(other), F.col("x.t").alias(other_text))
    keyed = docs.withColumns({own: id_key(), text: F.xxhash64(F.col("text").cast("string"))})
    same = (F.col(own) == F.col(other)) & (F.col(text) == F.col(other_text))
    return keyed.join(kept, same, "left_semi").dropDuplicates([own, text]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose texts benchmark passages contaminate go; a text's hash stands for it."""
    text = F.xxhash64(F.col("text").cast("string"))
    found = decontaminate.contamination(docs.select(text.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    own, other = fresh(docs.columns, "own"), fresh(docs.columns, "other")
    bad = found.where("contaminated").select(id_key().alias(other))
    return docs.withColumn(own, text).join(bad, F.col(own) == F.col(other), "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("decontamination", decontamination), ("packing", packed)]

#: Language ID, fingerprints and tokenization have no SQL form; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a written table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
