"""A staged build that contradicts itself is told, and packages with their files come out of the state."""

import pytest
from pyspark.sql import functions as F

from catalogspark.plans import build as bd
from tests.test_publish import stage

ITEMS = {("Ex.A", "1.0"): "one", ("Ex.A", "2.0"): "two", ("Ex.B", "1.0"): "three"}


@pytest.fixture
def built(spark, tmp_path):
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/c", state=f"file://{tmp_path}/s", index_format=0, buckets=3)
    return cfg, stage(spark, cfg, ITEMS)


def commit(spark, cfg, **tables):
    store = bd.st.StateStore(spark, cfg.state, cfg.buckets)
    build = store.begin()
    store.commit(tables)
    return build


def problems(spark, cfg, build=None):
    return sorted((r.relpath.split("/")[1] if "/" in r.relpath else r.relpath, r.drift_kind) for r in bd.verify_build(spark, cfg, build).collect())


def test_a_sound_build_and_none(spark, built):
    cfg, first = built
    assert problems(spark, cfg) == problems(spark, cfg, first) == []
    with pytest.raises(ValueError, match="never staged"):
        bd.verify_build(spark, cfg, 77)


def test_texts_that_changed_or_went(spark, built):
    cfg, first = built
    rows = bd.st.StateStore(spark, cfg.state, cfg.buckets).read("versions", bd.VERSIONS)
    text = F.when(F.col("version_dir") == "Ex.A/2.0", "other").when(F.col("version_dir") != "Ex.B/1.0", F.col("record"))
    commit(spark, cfg, versions=rows.withColumn("record", text))
    assert problems(spark, cfg) == [("Ex.A", "mismatched"), ("Ex.B", "mismatched")]
    assert problems(spark, cfg, first) == []  # the build before is as it was


def test_packages_that_do_not_follow_from_versions(spark, built):
    cfg, _ = built
    store = bd.st.StateStore(spark, cfg.state, cfg.buckets)
    rows, packages = store.read("versions", bd.VERSIONS), store.read("packages", bd.PACKAGES)
    commit(spark, cfg, versions=rows.where("package_id <> 'Ex.B'"), packages=packages.where("package_id <> 'Ex.A'"))
    assert problems(spark, cfg) == [("Ex.A", "extra"), ("Ex.B", "missing")]


def test_packages_with_their_files(spark, built):
    cfg, first = built
    files = [(f"{d}/{n}.yaml", d, 1, None, f"hash of {d}/{n}") for d, n in (("Ex.A/1.0", "b"), ("Ex.A/1.0", "a"), ("Ex.B/1.0", "c"), ("Ex.Z/1.0", "z"))]
    commit(spark, cfg, files=spark.createDataFrame(files, bd.FILES))
    names = spark.createDataFrame([("Ex.A",), ("Ex.A",), (None,), ("Ex.None",)], "package_id string")
    seen = {r.version_dir: [tuple(f) for f in r.files] for r in bd.package_files(spark, cfg, names).collect()}
    assert seen == {"Ex.A/1.0": [("Ex.A/1.0/a.yaml", "hash of Ex.A/1.0/a"), ("Ex.A/1.0/b.yaml", "hash of Ex.A/1.0/b")], "Ex.A/2.0": []}
    assert [r.files for r in bd.package_files(spark, cfg, names.where("package_id = 'Ex.None'")).collect()] == []
    assert {len(r.files) for r in bd.package_files(spark, cfg, names, first).collect()} == {0}
