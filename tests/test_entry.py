"""The catalogue on the smallest tables, against DuckDB; and the entry points without the text operators."""

import shutil
import subprocess
import sys

import duckdb
import pytest

from conftest import ROOT
from isospan.plans.catalog import QUERIES
from isospan.plans.oracles import ORACLE

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", ["walk_edges", "isochrone_bands", "hourly_profile", "stop_removal", "route_replacement", "impact_population", "paths", "shape_polylines", "facility_delta_by_type"])
def test_same_rows(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = QUERIES[name](spark, sf), db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    rows = sorted(str([r[c] for c in columns]) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(str([r[k] for k in at]) for r in want.fetchall())


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()


def test_without_the_text_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE)), "False"], out.stderr


def test_only_queries_that_ask_for_edges_build_them(spark, sf, monkeypatch):
    from isospan.plans import catalog

    def none(*args):
        raise AssertionError("edges are built")

    monkeypatch.setattr(catalog.network, "build_walk_edges", none)
    monkeypatch.setattr(catalog, "_edges", {}, raising=False)
    monkeypatch.setattr(catalog, "_built", {})
    assert QUERIES["area_summary"](spark, sf).count() == 1
    assert QUERIES["gtfs_shapes"](spark, sf).count() > 0
    assert {r.n for r in QUERIES["feed_tables"](spark, sf).where("name = 'calendar_dates'").collect()} == {None}
