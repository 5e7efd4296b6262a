"""Every query that has SQL gives DuckDB's rows."""

from __future__ import annotations

import decimal
import os

import duckdb
import pytest

from stratalog.plans import core

from .conftest import DATA


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    want = duck.sql(core.oracle_sql()[name])
    got = core.queries()[name](spark, DATA)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a = sorted(repr([plain(v) for v in r]) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
    b = sorted(repr([plain(v) for v in r]) for r in got.select(*[f"`{c}`" for c in cols]).collect())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert core.queries()[name](spark, DATA).count() > 0


def test_bloom_rates(spark):
    rates = {r.there: r.match_rate for r in core.bloom_false_positive_rate(spark, DATA).collect()}
    assert rates[True] == 1.0
    assert rates[False] <= 0.02


def _orders(spark, path, rows):
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    c = duckdb.connect()
    c.sql(f"create view orders as select * from '{path}/orders.parquet/*.parquet'")
    want = c.sql(core.oracle_sql()["bloom_false_positive_rate"]).select("there", "match_rate", "n").fetchall()
    return core.queries()["bloom_false_positive_rate"](spark, path), sorted(want)


def test_bloom_of_null_and_repeated_keys(spark, tmp_path):
    """A null key sets no bit and matches nothing, also where a part has no other; a row without a customer is in no part."""
    rows = [(i if i % 3 else None, i) for i in range(4000) if i % 16 < 6] + [(None, 7), (8, 8), (8, 8), (9, None), (-5, -3)]
    got, want = _orders(spark, str(tmp_path), rows)
    assert sorted((r.there, r.match_rate, r.n) for r in got.collect()) == want


def _sent(plan) -> int:
    """Bytes that the operators of a run plan sent to Python."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _sent(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _sent(plan.plan())
    below, sent = plan.children(), plan.metrics().get("pythonDataSent")
    return (sent.get().value() if sent.isDefined() else 0) + sum(_sent(below.apply(i)) for i in range(below.size()))


def test_bloom_filters_do_not_travel_with_each_key(spark, tmp_path):
    """20,000 orders in one part have a filter of 25 KB; by each of 40,000 asked rows that would be 1 GB."""
    got, want = _orders(spark, str(tmp_path), [(i, 16 * (i % 5)) for i in range(20_000)])
    assert sorted((r.there, r.match_rate, r.n) for r in got.collect()) == want
    assert 0 < _sent(got._jdf.queryExecution().executedPlan()) < 10_000_000


def test_sketch_is_never_too_low(spark):
    assert core.cms_estimate(spark, DATA).where("estimate < exact").count() == 0


def test_every_deeper_file_keeps_markers(spark, tmp_path):
    """Level 2 has two disjoint files, of keys 0 to 9 and 100 to 109; later markers lie in the first, in the second, in neither."""
    markers = {250: 105, 260: 500, 270: 5}
    keys = lambda i: markers.get(i, i % 10 if i < 100 else 100 + i % 10 if i < 200 else 900)
    rows = [(i, keys(i), "error" if i in markers else "view", 1.0) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = core.queries()["compaction_tombstone_elision"](spark, str(tmp_path)).where("vtype = 0").collect()
    assert sorted((r.user_key, r.seq) for r in got) == [(5, 270), (105, 250)]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
