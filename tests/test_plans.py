"""The registry, plan shapes and independence of row order."""

import sys
from pathlib import Path

import pytest
from conftest import ROOT, rows

import __spark_entry__
from marlstone import queries as registered

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def test_every_oracle_has_a_query():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and len(registered.queries()) > 120


def test_entry_stands_without_the_optional_parts(monkeypatch):
    """With the optional package and pipeline gone, the module imports and offers the rest."""
    import importlib

    for name in [m for m in sys.modules if m.startswith("marlstone.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "marlstone.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    fresh = importlib.reload(__spark_entry__)
    try:
        assert set(fresh.queries()) == set(registered.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_nothing_else_imports_the_optional_package():
    for path in Path(ROOT, "marlstone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "marlstone.llm" not in path.read_text(), path


@needs_data
def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[:2] == ["canonical_id", "recommended_id"] and df.count() > 0


@needs_data
@pytest.mark.parametrize("name", ["f04_recommendations", "d08_blocked_candidates", "j07_records", "d01_training_frame", "c21_review_selections", "j09_anomalies", "e05_bayesian_ratings", "b03_merge_pairs", "j01_rawg_attributes", "i28_tfidf_cosine"])
def test_plans_stay_native(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


@needs_data
@pytest.mark.parametrize("name", ["f04_recommendations", "d04_shared_alias_pairs", "f01_latest_per_key", "c21_review_selections", "f06_balanced_matches", "j02_wikidata_entities", "f05_search_candidates"])
def test_row_order_does_not_matter(spark, name, monkeypatch):
    from pyspark.sql import DataFrameReader

    query = __spark_entry__.queries()[name]
    first = rows(query(spark, SF))
    read = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **more: read(self, *paths, **more).repartition(7) if "/testdata/" in str(paths) else read(self, *paths, **more))
    assert rows(query(spark, SF)) == first
