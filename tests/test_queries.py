import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())
    assert Counter(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_every_oracle_has_a_query(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).limit(1).count() == 1


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry_points.queries()["running_score_state"](spark, SF))
    assert "props" not in text and "ts#" not in text
    text = plan(entry_points.queries()["rest_days"](spark, SF))
    assert "o_orderpriority" not in text and "c_acctbal" not in text


def test_no_query_uses_a_nested_loop_or_python(spark):
    for name in ("pregame_features_full", "live_features_full", "series_running_state",
                 "full_outer_reconcile", "momentum_swings_top50", "team_accuracy", "evaluation_summary",
                 "live_report_counts", "classifier_metrics", "season_coverage_status"):
        text = plan(entry_points.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "Python" not in text, name
