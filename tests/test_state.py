"""Writers are fenced, the log is told by pointers, and pruning frees what nothing needs."""

import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import lookup
from catalogspark.sources import state as st
from catalogspark.sources.lease import Fenced, Lease

FILES = "path string, version_dir string, size long"


def table(spark, rows):
    return spark.createDataFrame([(p, p.split("/")[0], n) for p, n in rows], FILES)


def rows_of(store, tables=None):
    return {r.path: r.size for r in store.read("files", FILES, tables=tables).collect()}


def test_a_writer_that_lost_its_lock_commits_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    a = st.StateStore(spark, root, 2)
    a.begin()
    b = st.StateStore(spark, root, 2, lease=-1)
    b.begin()
    with pytest.raises(Fenced):
        a.commit({"files": table(spark, [("a/1", 1)])})
    a.fail("what it says comes too late")
    assert b.current()["build"] == 2 and b.current()["tables"] == {}
    assert not (tmp_path / "s/snapshots/00000002").exists() and (tmp_path / "s/lock").exists()
    b.commit({"files": table(spark, [("b/1", 2)])})
    assert rows_of(a) == {"b/1": 2} and not (tmp_path / "s/lock").exists()
    assert [(r.build_id, r.status, r.error) for r in b.builds().orderBy("build_id").collect()] == [(1, "failed", "abandoned"), (2, "staged", None)]
    with pytest.raises(RuntimeError, match="begin"):
        a.commit({"files": table(spark, [("a/1", 1)])})


def test_one_that_lost_it_after_the_other_had_ended(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    a = st.StateStore(spark, root, 2)
    a.begin()
    b = st.StateStore(spark, root, 2, lease=-1)
    b.begin()
    b.commit({"files": table(spark, [("b/1", 2)])})
    with pytest.raises(Fenced):  # the lock is gone, the number is used
        a.commit({"files": table(spark, [("a/1", 1)])})
    assert rows_of(b) == {"b/1": 2}
    c = st.StateStore(spark, root, 2)
    assert c.begin() == 3
    c.close("staged")


def test_a_build_longer_than_its_lease_is_not_evicted(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    a = st.StateStore(spark, root, 2, lease=1.5)
    a.begin()
    time.sleep(4)
    with pytest.raises(RuntimeError, match="locked"):
        st.StateStore(spark, root, 2, lease=1.5).begin()
    a.commit({"files": table(spark, [("a/1", 1)])})
    assert rows_of(a) == {"a/1": 1}
    dead = st.StateStore(spark, root, 2, lease=1.5)
    dead.begin()
    dead._lock.ended.set()  # its process is gone: nobody renews
    time.sleep(3)
    assert st.StateStore(spark, root, 2, lease=1.5).begin() == 3


def test_pointers_are_created_once(spark, tmp_path):
    store = st.StateStore(spark, f"file://{tmp_path}/s", 2)
    store.set_meta(x=1)
    with pytest.raises(Fenced):
        store._put(1, {"build": 9})
    store.set_meta(y=2)
    assert store.get_meta("x") == 1 and store.numbers() == [1, 2] and store.current()["build"] == 0
    lease = Lease(spark, f"file://{tmp_path}/s/lock", 100)
    lease.start()
    with pytest.raises(RuntimeError, match="locked"), store.locked():
        pass
    lease.stop()
    with store.locked():
        assert (tmp_path / "s/lock").exists()
    assert not (tmp_path / "s/lock").exists()


def commit(store, rows, touched=None, status="staged"):
    build = store.begin()
    store.commit({"files": table(store.spark, rows)}, status, touched)
    return build


def folders(tmp_path):
    return {str(p.relative_to(tmp_path / "s/snapshots")) for p in pathlib.Path(tmp_path, "s/snapshots").glob("*/*/bucket=*")}


def test_pruning_keeps_what_is_reached(spark, tmp_path):
    store = st.StateStore(spark, f"file://{tmp_path}/s", 4)
    commit(store, [(f"g{i}/x", i) for i in range(12)])
    now = dict(rows_of(store))
    for i in (1, 2, 3):
        b = store.buckets_of(table(spark, [(f"g{i}/x", 0)]), "version_dir")
        kept = store.read("files", FILES, b).where(F.col("path") != f"g{i}/x").collect()
        commit(store, [(r.path, r.size) for r in kept] + [(f"g{i}/x", 100 + i)], {"files": b})
        now[f"g{i}/x"] = 100 + i
    assert rows_of(store) == now
    old = lookup.prune_builds(store.builds(), 1)
    with store.reading() as pointer:
        plan = store.prune(old, dry_run=True)
        assert plan["builds"] == 3 and plan["bytes"] > 0 and rows_of(store) == now
        commit(store, [("only/x", 1)])
        freed = store.prune(lookup.prune_builds(store.builds(), 1))
        assert rows_of(store, pointer["tables"]) == now and freed["builds"] == 3  # what the reader holds is no build's any more, and stays
    assert store.prune(lookup.prune_builds(store.builds(), 1))["bytes"] > 0
    assert rows_of(store) == {"only/x": 1} and folders(tmp_path) == {str(pathlib.Path(p[len("file:"):]).relative_to(tmp_path / "s/snapshots")) if not p.startswith("file://") else p[len(f"file://{tmp_path}/s/snapshots/"):] for p in store.current()["tables"]["files"].values()}
    with pytest.raises(ValueError, match="never staged"):
        store.tables_of(1)
    assert [r.build_id for r in store.builds().collect()] == [5]
    assert store.prune(lookup.prune_builds(store.builds(), 1)) == {"builds": 0, "pointers": 0, "folders": 0, "bytes": 0}


def test_pruning_that_dies_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    store = st.StateStore(spark, f"file://{tmp_path}/s", 2)
    for i in range(3):
        commit(store, [(f"g{j}/x", i) for j in range(5)])
    real, seen = st.delete, []

    def dies(spark, path):
        if "/snapshots/" in path:
            raise OSError("gone")
        seen.append(path)
        return real(spark, path)

    monkeypatch.setattr(st, "delete", dies)
    with pytest.raises(OSError):
        store.prune(lookup.prune_builds(store.builds(), 1))
    monkeypatch.undo()
    assert seen and rows_of(store) == {f"g{j}/x": 2 for j in range(5)} and not (tmp_path / "s/lock").exists()
    assert store.prune(lookup.prune_builds(store.builds(), 1))["bytes"] > 0
    assert {f.split("/")[0] for f in folders(tmp_path)} == {"00000003"}


def test_builds_and_pruning_in_any_order(spark, tmp_path):
    rnd = random.Random(3)
    store = st.StateStore(spark, f"file://{tmp_path}/s", 2)
    want = {}
    for _ in range(9):
        move = rnd.choice(["commit", "commit", "fail", "prune"])
        if move == "commit":
            rows = {f"g{rnd.randrange(4)}/x": rnd.randrange(99) for _ in range(4)}
            want[commit(store, sorted(rows.items()))] = rows
        elif move == "fail":
            store.begin()
            store.fail("on purpose")
        elif want:
            keep = rnd.randrange(1, 4)
            newest = [r.build_id for r in store.builds().orderBy(F.desc("build_id")).limit(keep).collect()]
            store.prune(lookup.prune_builds(store.builds(), keep))
            want = {b: r for b, r in want.items() if b in newest or b == max(want)}
        for build, rows in want.items():
            if build == max(want) or build in {r.build_id for r in store.builds().collect()}:
                assert rows_of(store, store.tables_of(build)) == rows
        if want:
            assert rows_of(store) == want[max(want)]
