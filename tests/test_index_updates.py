"""State tables changed by segments, and an index kept up to date, against full ones."""

import random

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import index
from catalogspark.plans import build as bd
from catalogspark.sources import state as st
from tests.test_build import write

SCHEMA = "path string, version_dir string, size long"


def frame(spark, rows):
    return spark.createDataFrame([(p, d, n) for (p, d), n in rows.items()], SCHEMA)


def test_segments_read_as_the_whole_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "SEGMENTS", 2)
    rnd = random.Random(4)
    store = st.StateStore(spark, f"file://{tmp_path}/s", 3)
    want = {(f"g{i}/x", f"g{i}"): i for i in range(12)}
    store.begin()
    store.commit({"files": frame(spark, want)})
    for turn in range(6):
        lost = dict(rnd.sample(sorted(want.items()), 2))
        new = {k: rnd.randrange(1000) for k in [*rnd.sample(sorted(want), 2), (f"n{turn}/x", f"n{turn}")] if k not in lost}
        moved = next(k for k in sorted(want) if k not in lost and k not in new)  # the same path in another group, hence another bucket
        new[moved[0], f"to{turn}"] = want[moved]
        store.begin()
        store.commit({}, deltas={"files": (frame(spark, new), frame(spark, lost | {moved: 0}))})
        want = {k: n for k, n in want.items() if k not in lost and k != moved} | new
        assert {(r.path, r.version_dir): r.size for r in store.read("files", SCHEMA).collect()} == want
        assert all(len(st.parts_of(p)) <= 4 for p in store.current()["tables"]["files"].values())
    some = store.buckets_of(frame(spark, want).limit(1), "version_dir")
    assert {r.version_dir for r in store.read("files", SCHEMA, some).collect()} == {d for (_, d) in want if store.buckets_of(spark.createDataFrame([(d,)], "version_dir string"), "version_dir") == some}
    assert store.read("files", "path string, later int").where("later is null").count() == len(want)
    before = {(r.path, r.version_dir): r.size for r in store.read("files", SCHEMA).collect()}
    store.prune(store.builds().where("build_id < 6"))
    assert {(r.path, r.version_dir): r.size for r in store.read("files", SCHEMA).collect()} == before
    store.begin()
    with pytest.raises(ValueError, match="repeats"):
        store.commit({}, deltas={"files": (frame(spark, {("a", "d"): 1}).union(frame(spark, {("a", "d"): 2})), frame(spark, {}))})
    store.fail("on purpose")
    store.begin()
    store.commit({}, deltas={"files": (frame(spark, {}), frame(spark, want))})
    assert store.read("files", SCHEMA).count() == 0


def test_bytes_follow_the_changed_rows(spark, tmp_path):
    store = st.StateStore(spark, f"file://{tmp_path}/s", 4)
    rows = spark.range(100_000).selectExpr("concat(sha2(cast(id as string), 256), '/x') path", "concat('g', id) version_dir", "id size")
    store.begin()
    store.commit({"files": rows})
    size = lambda build: store._size(f"{store.root}/snapshots/{build:08d}")
    store.begin()
    store.commit({}, deltas={"files": (rows.where("size % 2000 = 7").withColumn("size", F.lit(-1)), rows.limit(0))})
    assert size(2) < size(1) / 100  # 50 rows in all 4 buckets
    assert store.read("files", SCHEMA).where("size = -1").count() == 50 and store.read("files", SCHEMA).count() == 100_000


def by_value(packages, words, bridge):
    ids = {r.id: r.value for r in words}
    names = {r.package: r.package_id for r in packages}
    assert len(ids) == len(words) and len(names) == len(packages) and len({r.value for r in words}) == len(words)
    return sorted((names[r.package], ids[r.id]) for r in bridge)


def test_dictionary_keeps_ids_and_takes_back_only_the_last(spark):
    words = spark.createDataFrame([("a", 1, 2), ("b", 2, 1), ("c", 3, 1)], "value string, id long, n long")
    before = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (None, "x")], "package long, value string")
    after = spark.createDataFrame([(1, "a"), (1, "d"), (1, "d"), (3, "e"), (3, "c"), (3, None)], "package long, value string")
    made = {k: sorted(tuple(r) for r in v.collect()) for k, v in index.update_words(words, index.changed_pairs(before, after), 10).items()}
    assert made["words"] == [("a", 1, 1), ("c", 3, 2), ("d", 10, 1), ("e", 11, 1)] and made["words_gone"] == [("b", 2, 0)]
    assert made["bridge"] == [(1, 10), (3, 3), (3, 11)] and made["bridge_gone"] == [(1, 2), (2, 1)]
    empty = index.update_words(words, index.changed_pairs(before.limit(0), after.limit(0)), 10)
    assert all(v.count() == 0 for v in empty.values())


def test_an_updated_index_equals_a_full_one(spark, tmp_path):
    corpus = tmp_path / "c" / "manifests"
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/c", state=f"file://{tmp_path}/s", buckets=4)
    for i in range(4):
        write(corpus, f"Ex.P{i}", "1.0", d=f"{i}", items=(("x64", "AB", f"run{i % 2}"),))
    first = bd.incremental_build(spark, cfg)["build"]
    store = st.StateStore(spark, cfg.state)
    ids = {r.value: r.id for r in store.read("index_commands2", "value string, id long").collect()}
    write(corpus, "Ex.A", "1.0", d="a", items=(("x64", "AB", "added"),))  # sorts before all others, yet is numbered last
    write(corpus, "Ex.P1", "1.0", d="1", items=(("x64", "AB", "run0"),))  # P3 still holds run1
    for f in (corpus / "E/Ex/P2/1.0").iterdir():
        f.unlink()
    second = bd.incremental_build(spark, cfg)["build"]
    full = bd.BuildConfig(**{**cfg.__dict__, "state": cfg.state + "2"})
    bd.incremental_build(spark, full)
    other = st.StateStore(spark, full.state)

    def seen(s):
        packages = s.read("index_packages", bd.INDEX_PACKAGES).collect()
        out = {"packages": sorted((r.package_id, r.version_dir, r.name) for r in packages), "metadata": sorted(tuple(r) for r in s.read("index_metadata", "name string, value string").where("name = 'rows'").collect())}
        for n in index.V2_MAPPED:
            words = s.read(f"index_{n}2", "value string, id long, n long").collect()
            out[n] = by_value(packages, words, s.read(f"index_{n}2_map", "package long, id long").collect())
            out[n + " counts"] = sorted((r.value, r.n) for r in words)
        names = {r.package: r.package_id for r in packages}
        for n in index.V2_DIRECT:
            out[n] = sorted((names[r.package], r.value) for r in s.read(f"index_{n}2", "value string, package long").collect())
        return out

    assert seen(store) == seen(other)
    now = {r.value: r.id for r in store.read("index_commands2", "value string, id long").collect()}
    assert {v: now[v] for v in ids} == ids and now["added"] == max(ids.values()) + 1
    held = {r.package_id: r.package for r in store.read("index_packages", bd.INDEX_PACKAGES).collect()}
    assert held["Ex.A"] == 5 and held["Ex.P0"] == 1
    written = sum(spark.read.parquet(str(p)).count() for p in (tmp_path / f"s/snapshots/{second:08d}").glob("index_*_map"))
    assert first == 1 and written == 3 + 2 + 3  # gained and lost pairs of A, P1 and P2, none of the others
