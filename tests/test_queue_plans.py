"""The queue and the hashes of children share one shuffle of each side's children."""

from pyspark.sql import functions as F

from catalogspark.operators import diff
from catalogspark.plans.queries import _queue


def test_children_are_shuffled_once(spark):
    now = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g1", "b"), ("g2", "c"), ("g4", "e")], "version_dir string, child_sha string")
    was = spark.createDataFrame([("g1", "a"), ("g3", "d"), ("g4", "e")], "version_dir string, child_sha string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = _queue(now, was)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert plan.count(" Exchange hashpartitioning") - plan.count("ReusedExchange") == 3  # children now, children before, kinds of change
    assert {tuple(r) for r in _queue(now, was).collect()} == {("g1", "b", "installer-changed"), ("g2", "c", "added")}
    assert diff.validation_queue(spark.createDataFrame([("g2", "remove")], "version_dir string, change_kind string"), now, was).count() == 0


def test_hashes_are_shuffled_as_bytes_and_any_text_comes_back(spark):
    texts = ["", "0", "0a", "0A", "ab" * 32, "größe", "zz", "\x01", "a b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", diff.packed(F.col("t")).alias("p"))
    rows = df.select("t", diff.unpacked(F.col("p")).alias("back"), F.length("p").alias("n")).collect()
    assert [(r.t, r.back) for r in rows] == [(t, t) for t in texts] and {r.t: r.n for r in rows}["ab" * 32] == 33
    assert df.select("p").distinct().count() == len(texts)
    now, was = (spark.createDataFrame([("g", c) for c in cs], "version_dir string, child_sha string") for cs in (["0A", "0a", "x"], ["0a"]))
    assert {tuple(r) for r in _queue(now, was).collect()} == {("g", "0A", "installer-changed"), ("g", "x", "installer-changed")}
