"""Values counted by versions, moved by what changed versions held and hold, against counts from scratch."""

import random
import re

import pytest

from catalogspark.operators import counted
from catalogspark.plans import build as bd
from catalogspark.sources import state as st
from tests.test_build import write

SCHEMA = "package_id string, version_dir string, tags array<string>, extra array<string>"
NAMES = {"t": "tags", "x": "extra"}


def frame(spark, versions):
    return spark.createDataFrame([(p, d, *v) for d, (p, *v) in versions.items()], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_random_changes_equal_counting_again(spark):
    rnd = random.Random(9)
    some = lambda: rnd.choice([None, [], *[[rnd.choice(["a", "b", "c", "", None]) for _ in range(3)] for _ in range(4)]])
    package = lambda: rnd.choice(["P", "Q", "R", None])
    now = {f"v{i}": (package(), some(), some()) for i in range(12)}
    counts = counted.count_holdings(counted.holdings(frame(spark, now), NAMES))
    for turn in range(3):
        lost = rnd.sample(sorted(now), 3)
        new = {d: (package(), some(), some()) for d in [*rnd.sample(sorted({*now} - {*lost}), 3), f"n{turn}"]}
        was = frame(spark, {d: now[d] for d in [*lost, *new] if d in now})  # changed versions and no others
        moved = counted.moved_counts(counts, counted.count_changes(counted.holdings(was, NAMES), counted.holdings(frame(spark, new), NAMES)))
        before = {r[:3]: r[3] for r in rows(counts)}
        now = {d: v for d, v in now.items() if d not in lost} | new
        want = rows(counted.count_holdings(counted.holdings(frame(spark, now), NAMES)))
        after = {r[:3]: r[3] for r in want}
        signs = {r[:3]: r[4] for r in rows(moved)}
        assert signs == {k: (k in after) - (k in before) for k in {*before, *after} if before.get(k) != after.get(k)}
        assert rows(counted.apply_moved(counts, moved)) == want
        counts = spark.createDataFrame(want, "package_id string, attribute string, value string, n long")
    held = {p for p, *_ in want}
    rolled = {r.package_id: (r.t, r.x) for r in counted.rollup_counted(counts, ["t", "x"]).collect()}
    assert rolled == {p: tuple(sorted(v for q, a, v, _ in want if (q, a) == (p, n)) for n in NAMES) for p in held}


def test_empty_tables_and_contradictions(spark):
    none = counted.holdings(spark.createDataFrame([], SCHEMA), NAMES)
    counts = counted.count_holdings(none)
    assert counts.count() == 0 and counted.count_changes(none, none).count() == 0
    held = counted.holdings(frame(spark, {"v": ("P", ["a", "a"], None)}), NAMES)
    assert rows(held) == [("P", "v", "t", "a")]
    assert rows(counted.moved_counts(counts, counted.count_changes(none, held))) == [("P", "t", "a", 1, 1)]
    with pytest.raises(Exception, match="taken back"):
        counted.moved_counts(counts, counted.count_changes(held, none)).collect()


def test_a_build_moves_counts_of_changed_versions_only(spark, tmp_path):
    corpus = tmp_path / "c" / "manifests"
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/c", state=f"file://{tmp_path}/s", buckets=4)
    for i in range(3):
        for v in ("1.0", "2.0"):
            write(corpus, f"Ex.P{i}", v, d=f"{i}.{v}", items=(("x64", "AB", f"run{v}"),))
    bd.incremental_build(spark, cfg)
    store = st.StateStore(spark, cfg.state)
    read = lambda: {(r.package_id, r.attribute, r.value): r.n for r in store.read("values", bd.VALUES).collect()}
    assert read()["Ex.P0", "tags", "a"] == 2 and read()["Ex.P0", "commands", "run1.0"] == 1
    for f in (corpus / "E/Ex/P0/1.0").iterdir():
        f.unlink()
    write(corpus, "Ex.P1", "2.0", d="1.2.0", items=(("x64", "AB", "other"),))
    second = bd.incremental_build(spark, cfg)["build"]
    now = read()
    assert now["Ex.P0", "tags", "a"] == 1 and ("Ex.P0", "commands", "run1.0") not in now  # 2.0 still holds the tag
    assert now["Ex.P1", "commands", "other"] == 1 and ("Ex.P1", "commands", "run2.0") not in now and now["Ex.P1", "tags", "a"] == 2
    written = [r.package_id for p in (tmp_path / f"s/snapshots/{second:08d}").glob("values") for r in spark.read.parquet(str(p)).collect()]
    assert written and "Ex.P2" not in written
    names = spark.createDataFrame([("Ex.P0",), ("Ex.P0",), (None,), ("no",)], "package_id string")
    (one,) = bd.package_rollups(spark, cfg, names).collect()
    assert one.package_version == "2.0" and one.tags == ["a", "b"] and one.commands == ["run2.0"] and one.pfns == []
    full = bd.BuildConfig(**{**cfg.__dict__, "state": cfg.state + "2"})
    bd.incremental_build(spark, full)
    assert now == {(r.package_id, r.attribute, r.value): r.n for r in st.StateStore(spark, full.state).read("values", bd.VALUES).collect()}
    store._move(tables={n: t for n, t in store.current()["tables"].items() if n != "values"})  # a state from before there was the table
    write(corpus, "Ex.P2", "2.0", d="2.2.0", items=(("x64", "AB", "late"),))
    bd.incremental_build(spark, cfg)
    late = {k: n for k, n in now.items() if k != ("Ex.P2", "commands", "run2.0")} | {("Ex.P2", "commands", "late"): 1}
    assert read() == late
    bd.incremental_build(spark, bd.BuildConfig(**{**cfg.__dict__, "force": True}))
    assert read() == late


def test_changes_are_applied_without_a_join(spark):
    was, now = (counted.holdings(frame(spark, v), NAMES) for v in ({"v": ("P", ["a", "b"], None), "w": ("P", ["b"], ["c"])}, {"v": ("P", ["b", "d"], None), "w": ("Q", ["b"], [])}))
    made = counted.apply_changes(counted.count_holdings(was), counted.count_changes(was, now))
    assert rows(made) == rows(counted.count_holdings(now)) and "Join" not in made._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="taken back"):
        counted.apply_changes(counted.count_holdings(now), counted.count_changes(was, now)).collect()


def test_values_are_counted_where_their_packages_rows_are(spark):
    """Rows are shuffled by package, and neither versions, counts nor rollups are shuffled after that; rows are made distinct there."""
    from catalogspark.plans.queries import QUERIES

    plan = QUERIES["a2_rollup_counted"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)
    assert [re.sub(r"#\d+L?", "", k) for k in keys if "key" not in k] == ["package_id"] * 3  # the earlier rows twice, of which one is reused
