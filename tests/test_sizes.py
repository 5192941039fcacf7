"""Plans whose tasks hold no more as tables grow."""

from palimpsest.operators import writes
from palimpsest.plans import tables as t
from palimpsest.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_roles_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(t, "TASK_ROWS", 100)
    lines = t.read(spark, sf_dir, "lineitem").count()
    assert t.roles(spark, sf_dir).rdd.getNumPartitions() == -(-lines // 100)
    assert sorted((r["error"], r["n"]) for r in QUERIES["app_validate"](spark, sf_dir).collect()) == [(e, 0) for e in ("no id", "no name", "no such actor", "no such movie", "no title", "two roles")]


def test_versions_are_combined_before_they_meet_a_batch(spark, sf_dir):
    p = plan(writes.current(t.write_ops(spark, sf_dir), t.cells(spark, sf_dir)))
    assert "LeftSemi" not in p and p.count("Join") == 1
