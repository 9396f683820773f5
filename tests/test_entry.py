"""The entry points agree with each other, and queries with their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TINY = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["w1_rolling_p90", "g2_benchmark_table", "g8_compare_lines", "j1_j2_j4_map_lines"])
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, TINY).toPandas()
    db = duckdb.connect()
    for f in os.listdir(TINY):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TINY}/{f}'")
    want = db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted(str([None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) else str(x)[:10] if "date" in c else str(x) for c, x in zip(sorted(df.columns), row, strict=True)]) for row in df[sorted(df.columns)].itertuples(index=False))
    assert text(got.astype(object)) == text(want.astype(object))


def test_lines_are_joined_once_for_rolling_p90(spark):
    from repairbench.plans.price_queries import QUERIES

    for name in ("w1_p90_exceptions", "g15_graph_totals"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" not in plan, name
    assert "ArrowPython" not in plan and "FlatMapGroups" not in plan
