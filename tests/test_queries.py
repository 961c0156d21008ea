"""Every registered query of the library itself against DuckDB over the same files."""

from __future__ import annotations

import datetime
import decimal
import math
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from corpuslens import plans

from .conftest import ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL = {"pseudonyms", "bootstrap_kappa", "screen_windows_overlap", "stratified_sample", "text_chunks", "model_parts"} | {"word_errors", "word_changes", "engine_disputes", "correction_guard", "page_places", "page_maps", "widened_quotes", "sentence_quotes", "forum_quotes", "cell_units", "reference_lists", "pseudonymised", "named_speakers"}


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    found = plans.queries()[name](spark, sf_dir)
    result = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(plain(tuple(r)) for r in found.select(*columns).collect()) == Counter(plain(r) for r in result.fetchall())


def test_all_but_a_few_have_sql():
    assert set(plans.queries()) - set(plans.oracle_sql()) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry_without_the_training_data_operators():
    """With those files gone the registry still imports and has the library's own queries."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('corpuslens.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from corpuslens import plans
assert set(e.queries()) == set(plans.queries()) and set(e.oracle_sql()) == set(plans.oracle_sql())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
