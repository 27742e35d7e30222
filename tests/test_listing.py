"""Listing by tasks gives what Spark's own listing gives."""

import os

import pytest
from pyspark.sql import functions as F

from catalogspark.plans import build as bd
from catalogspark.sources import files as fl
from catalogspark.sources import listing as ls
from tests.test_build import write


def tree(root, names):
    for i, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * (i + 1))


NAMES = [
    "a/b/c/d/one.yaml", "a/b/two.yaml", "a/b/two.yml", "top.yaml", "a/k=1/_v=2/three.yaml", "a/_tmp/no.yaml", "a/.git/no.yaml", "a/_no.yaml", "a/.no.yaml", "a/no.yaml._COPYING_",
    "ü ö%20/[1] {x} *.yaml", "a/b/c/UP.YAML", *(f"many/{i}/f{j}.yaml" for i in range(7) for j in range(5)),
]


@pytest.mark.parametrize("glob", ["*.yaml", "*", "t?o.[xy]*ml", "none"])
def test_equals_the_listing_of_the_driver(spark, tmp_path, glob):
    tree(tmp_path / "c", NAMES)
    (tmp_path / "c/empty/er").mkdir(parents=True)
    (tmp_path / "c/a/nothing.yaml").touch()  # without bytes: in neither
    root = f"file://{tmp_path}/c"
    ours = sorted(map(tuple, ls.list_files(spark, root, f"file://{tmp_path}/out", glob).collect()))
    theirs = sorted(map(tuple, fl.scan_files(spark, root, glob).collect()))
    assert ours == theirs and len(ours) == {"*.yaml": 40, "*": 42, "t?o.[xy]*ml": 2, "none": 0}[glob]


def test_roots(spark, tmp_path):
    tree(tmp_path / "c/manifests", ["p/1/a.yaml"])
    assert [r.path for r in ls.list_files(spark, f"file://{tmp_path}/c/", f"file://{tmp_path}/o1").collect()] == ["p/1/a.yaml"]
    assert [r.path for r in ls.list_files(spark, f"{tmp_path}/c", f"file://{tmp_path}/o2").collect()] == ["p/1/a.yaml"]  # of the default file system
    (tmp_path / "empty").mkdir()
    assert ls.list_files(spark, f"file://{tmp_path}/empty", f"file://{tmp_path}/o3").count() == 0
    with pytest.raises(FileNotFoundError):
        ls.list_files(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/o4")
    with pytest.raises(ValueError, match="braces"):
        ls.list_files(spark, f"file://{tmp_path}/c", f"file://{tmp_path}/o5", "*.{a,b}")


def test_folders_are_opened_by_several_tasks_and_not_by_the_driver(spark, tmp_path):
    (tmp_path / "c").mkdir()
    driver, seen = os.getpid(), tmp_path / "seen"
    seen.mkdir()

    def made_up(uri):
        """Three levels of eight folders, each with a file; every call says which task opened the folder."""
        from pyspark import TaskContext

        assert os.getpid() != driver

        def entries(folder):
            (seen / f"{folder.replace('/', '-')}@{TaskContext.get().partitionId()}").touch()
            if folder.count("/") < 2:
                yield from ((f"d{i}", True, 0, 0) for i in range(8))
            yield "f.yaml", False, 3, 1_000_000

        return entries

    rows = ls.list_files(spark, f"file://{tmp_path}/c", f"file://{tmp_path}/out", tasks=5, make=made_up)
    assert rows.agg(F.count("path"), F.count_distinct("path"), F.sum("size")).first() == (585, 585, 3 * 585)
    opened = [name.rsplit("@", 1) for name in os.listdir(seen)]
    assert len(opened) == len({f for f, _ in opened}) == 585 and {t for f, t in opened if f.count("-") == 2} == set("01234")


def test_a_large_folder_comes_in_batches(spark, tmp_path):
    (tmp_path / "c").mkdir()
    flat = lambda uri: lambda folder: ((f"{i}.yaml", False, 1, 0) for i in range(2 * ls.BATCH + 1))
    assert ls.list_files(spark, f"file://{tmp_path}/c", f"file://{tmp_path}/out", make=flat).count() == 2 * ls.BATCH + 1


def test_a_build_lists_by_tasks(spark, tmp_path):
    """The same builds whoever lists; times are the same to the letter, so nothing is read again."""
    corpus = tmp_path / "c" / "manifests"
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/c", state=f"file://{tmp_path}/s", index_format=0, buckets=2, listing="tasks")
    for i in range(3):
        write(corpus, f"Ex.P{i}", "1.0", d=f"{i}")
    assert bd.incremental_build(spark, cfg)["added"] == 3
    assert bd.incremental_build(spark, bd.BuildConfig(**{**cfg.__dict__, "listing": "driver"}))["status"] == "staged_reused"
    write(corpus, "Ex.P1", "1.0", d="new")
    assert bd.incremental_build(spark, cfg)["updated"] == 1
    with pytest.raises(ValueError, match="listing"):
        bd.incremental_build(spark, bd.BuildConfig(**{**cfg.__dict__, "listing": "guess"}))
