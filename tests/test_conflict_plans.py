"""Conflicts take one shuffle by package and value, and no join."""

from catalogspark.operators import conflicts
from catalogspark.plans.queries import _distinct_claims

ROWS = [("P", "a", "d1", "1.2", ""), ("P", "a", "d2", "1.10", "beta"), ("P", "a", "d2", "1.10", "beta"), ("P", "b", "d1", "1.2", ""), (None, "a", "d3", "1", ""), (None, "a", "d4", "2", ""), ("P", None, "d1", "1.2", ""), ("P", None, "d2", "1.10", "beta")]


def test_one_shuffle_and_the_same_rows(spark):
    df = spark.createDataFrame(ROWS, "package_id string, value string, version_dir string, package_version string, channel string")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    for made in (conflicts.resolve_conflicts(df), conflicts.conflict_report(df), conflicts.winners(df, "latest"), conflicts.find_conflicts(df), conflicts.losing_claims(df, "oldest")):
        assert plan(made).count("Exchange hashpartitioning") == 1 and "Join" not in plan(made)
    key = lambda r: tuple("" if x is None else x for x in r)
    assert sorted(map(tuple, conflicts.resolve_conflicts(df).collect()), key=key) == sorted(ROWS[1:], key=key)  # null packages and values never fight
    assert {tuple(r) for r in conflicts.conflict_report(df.where("package_id = 'P'")).collect()} == {("P", "a", "1.10 [beta]", "1.2")}
    assert {r.claimants for r in conflicts.find_conflicts(df.where("package_id = 'P'")).collect()} == {2}


def test_rows_are_read_once_and_nulls_are_dealt_out(spark, tmp_path):
    spark.createDataFrame(ROWS, "package_id string, value string, version_dir string, package_version string, channel string").write.parquet(f"file://{tmp_path}/c")
    df = spark.read.parquet(f"file://{tmp_path}/c")
    for made in (conflicts.resolve_conflicts(df, "oldest"), conflicts.resolve_conflicts(_distinct_claims(df))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    key = lambda r: tuple("" if x is None else x for x in r)
    assert sorted(map(tuple, conflicts.resolve_conflicts(_distinct_claims(df)).collect()), key=key) == sorted({*ROWS[1:]}, key=key)
