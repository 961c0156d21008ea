"""The pipeline's stages, each against a plain version on its own input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import langid

from . import plain
from .test_texts import check_packing


def test_stages_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            check_packing(given, out.collect())
            break
        assert out.columns == columns
        assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        kept = sorted((r["doc_id"], r["text"]) for r in out.collect())
        if name == "language":
            found = langid.language_id(docs).collect()
            wrong = {r["doc_id"] for r in found if r["lang"] not in (None, r["lang_pred"]) and r["score"] >= corpus_pipeline.CONFIDENT}
            assert kept == sorted((d, t) for d, t in given if any(map(str.isalpha, t or "")) and d not in wrong)
            assert len(wrong) < 0.01 * len(given)
        elif name == "lines":
            assert kept == sorted((d, t) for d, _, _, t in plain.line_dedup(given))
        elif name == "near_copies":
            first = {d for d, _, c in plain.simhash(given) if d == c}
            assert kept == sorted(x for x in given if x[0] in first)
        else:
            bad = {d for d, _, _, _, c in plain.contamination(given, items) if c}
            assert kept == sorted(x for x in given if x[0] not in bad)
        docs = spark.createDataFrame(out.collect(), out.schema)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_messy_and_empty_rows(spark, sf_dir, no_docs, messy_docs, stage):
    assert stage(spark, no_docs, sf_dir).collect() == []
    out = stage(spark, messy_docs, sf_dir)
    assert out.count() > 0
    if stage is not corpus_pipeline.packed:
        assert out.columns == messy_docs.columns


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_decide_row_by_row(spark, sf_dir):
    """Rows that share a doc_id, a null one included, go only for their own texts."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    given = [(5, a), (3, a), (5, b), (None, c), (None, item), (None, "quite another text"), (None, "quite another text")]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    one_each = [(3, a), (5, b), (None, c), (None, item), (None, "quite another text")]
    assert rows(corpus_pipeline.near_copies(spark, docs, sf_dir)) == sorted(one_each, key=repr)
    assert rows(corpus_pipeline.decontamination(spark, docs, sf_dir)) == sorted((x for x in given if x[1] != item), key=repr)


def test_language_stage_keeps_an_unlabelled_corpus(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, sf_dir).collect()] == [1]


def test_language_stage_follows_the_prediction(spark, sf_dir, monkeypatch):
    """A confident prediction of another language than the label's rejects a row; an unsure one, or a row without label, stays."""
    docs = spark.createDataFrame([(i, f"some text {i}", lang, "kept") for i, lang in enumerate(["en", "en", "de", "de", None])], "doc_id long, text string, lang string, score string")
    told = [("en", 0.99), ("de", 0.95), ("en", 0.5), ("de", 0.99), ("en", 0.99)]

    def answer(rows):
        pick = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in told]), (F.col("doc_id") + 1).cast("int"))
        return rows.withColumns({"lang_pred": pick(0), "score": pick(1), "held_out": F.lit(False)})

    monkeypatch.setattr(corpus_pipeline.langid, "language_id", answer)
    out = corpus_pipeline.language(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3, 4]
    assert out.columns == docs.columns and {r["score"] for r in out.collect()} == {"kept"}


def test_language_stage_rejects_misfiled_texts(spark, sf_dir):
    """Of a corpus in two vocabularies, the few texts filed under the other language go, all others stay."""
    r = random.Random(1)
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "zug wagen strasse br\u00fccke \u00fcber".split()}
    text = lambda lang: " ".join(r.choice(words[lang]) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 150)]
    rows += [(1000 + i, text("aa"), "bb") for i in range(3)] + [(2000 + i, text("bb"), "aa") for i in range(3)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), sf_dir)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(300))
