"""Rows that break careless code: nulls, empty and very long texts, copies, repeated rows, columns whose names clash."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside; docs may have such columns.
CLASHING = ("d", "f", "h", "k", "w", "c", "n", "id", "rep", "lost", "__lost", "index", "task", "kind", "score", "held", "held_out", "component", "number", "block", "n_lines", "n_dropped", "lang_pred", "fingerprint")


def texts(seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang) of different ids, one of them null."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß日Zq7") for _ in range(r.randint(1, 9))) for _ in range(300)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [line(8) for _ in range(5)]
    rows: list[tuple] = [(0, None, None), (1, "", "en"), (2, " \t\x0b ", "en"), (3, "\n\n", None), (4, "12 34 !!", "de"), (5, "é", "fr")]
    for i in range(10, 60):
        lines = [r.choice(shared).upper() if r.random() < 0.3 else line(r.randint(0, 12)) for _ in range(r.randint(1, 8))]
        rows.append((i, "\n".join(lines), r.choice(["en", "de", None])))
    base = line(400)
    rows += [(100 + i, base.replace(" a", f" {i}", i), "en") for i in range(6)]  # near copies
    rows += [(200 + i, base, "de") for i in range(3)]  # copies
    rows.append((300, line(60_000), "en"))
    rows.append((301, "x" * 500_000, "en"))
    rows.append((-5, shared[0] + "\r\n" + shared[1] + "  ", "de"))
    rows.append((None, shared[2] + "\n" + base, "en"))
    return rows


@pytest.fixture(scope="session")
def messy() -> list[tuple]:
    return texts()


@pytest.fixture(scope="session")
def messy_docs(spark, messy):
    docs = spark.createDataFrame(messy, "doc_id long, text string, lang string").repartition(5)
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def plain_documents(documents) -> list[tuple]:
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]
