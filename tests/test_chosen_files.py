"""Only chosen files are opened: by blocks of paths, in builds, and whatever else lies in the corpus."""

import os

import pytest
from pyspark.sql import functions as F

from catalogspark.plans import build as bd
from catalogspark.sources import files as fl
from tests.test_build import write


def bytes_read(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalInputBytes()


@pytest.fixture
def limit(spark):
    """Files above 4,000 bytes can't be read at all."""
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "4000")
    yield
    spark.conf.unset(key)


def test_unwanted_files_are_not_opened(spark, tmp_path, limit):
    (tmp_path / "a/b").mkdir(parents=True)
    for name, size in (("a/b/small.yaml", 5), ("a/b/huge.yaml", 9_000), ("a/other.yaml", 9_000), ("a/b/odd [1]*{x}?.yaml", 7), ("a/b/ü ö%20.yaml", 3)):
        (tmp_path / name).write_bytes(b"x" * size)
    root = f"file://{tmp_path}"
    paths = fl.scan_files(spark, root).where("size < 4000").select("path")
    rows = {r.path: r.n for r in fl.read_chosen(spark, root, paths, lambda c: c.select("path", F.length("content").alias("n")), f"file://{tmp_path}/out").collect()}
    assert rows == {"a/b/small.yaml": 5, "a/b/odd [1]*{x}?.yaml": 7, "a/b/ü ö%20.yaml": 3}
    with pytest.raises(Exception):  # what a join after the scan does
        fl.read_contents(spark, root).join(paths, "path", "left_semi").collect()
    assert fl.read_chosen(spark, root, paths.where("false"), lambda c: c, f"file://{tmp_path}/none") is None
    odd = spark.createDataFrame([(None,), ("a/b/small.yaml",), ("a/b/small.yaml",)], "path string")
    assert fl.read_chosen(spark, root, odd, lambda c: c, f"file://{tmp_path}/odd").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fl.read_chosen(spark, root, spark.createDataFrame([("a/none.yaml",)], "path string"), lambda c: c, f"file://{tmp_path}/missing")


def test_blocks_hold_every_path_once(spark, tmp_path):
    for i in range(23):
        (tmp_path / f"d{i % 4}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 4}/f{i}.yaml").write_text(str(i))
    root = f"file://{tmp_path}"
    paths = fl.scan_files(spark, root).select("path")
    assert [len(b) for b in fl.blocks_of_paths(paths, 10)] == [10, 10, 3]
    rows = fl.read_chosen(spark, root, paths, lambda c: c.select("path", F.col("content").cast("string").alias("t")), f"file://{tmp_path}-out", block=10).collect()
    assert sorted(int(r.t) for r in rows) == list(range(23)) and len({r.path for r in rows}) == 23


def test_a_build_opens_the_files_of_its_groups(spark, tmp_path, limit):
    corpus = tmp_path / "c" / "manifests"
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/c", state=f"file://{tmp_path}/s", index_format=0, buckets=4, quarantine=True)
    for i in range(12):
        write(corpus, f"Ex.P{i}", "1.0", d=f"{i}")
    assert bd.incremental_build(spark, cfg)["added"] == 12
    for i in range(1, 12):  # bytes that no build may touch from now on, under the size and time that are known
        for f in (corpus / f"E/Ex/P{i}/1.0").iterdir():
            was = f.stat()
            f.write_bytes(b"\xff" * was.st_size)
            os.utime(f, ns=(was.st_atime_ns, was.st_mtime_ns))
    write(corpus, "Ex.P0", "1.0", d="0", items=(("x64", "AB", "run"), ("arm64", "CD", "run")))
    done = bd.incremental_build(spark, cfg)
    assert (done["added"], done["updated"], done["removed"]) == (0, 1, 0)
    versions = bd.st.StateStore(spark, cfg.state).read("versions", bd.VERSIONS)
    assert versions.count() == 12 and versions.where("children_sha is null").count() == 0

    huge = corpus / "E/Ex/Q/1.0"  # pending beside a targeted build: neither opened nor in its way
    huge.mkdir(parents=True)
    (huge / "Q.yaml").write_bytes(b"x" * 9_000)
    write(corpus, "Ex.R", "1.0", d="r")
    assert bd.apply_targets(spark, cfg, {"directories": ["E/Ex/R/1.0"]})["added"] == 1
    with pytest.raises(Exception):  # a build that has to open it says so
        bd.incremental_build(spark, cfg)


def test_bytes_follow_the_change(spark, tmp_path):
    corpus = tmp_path / "c"
    for i in range(40):
        (corpus / f"g{i}").mkdir(parents=True)
        (corpus / f"g{i}/x.yaml").write_bytes(b"#" * 100_000)
    root, want = f"file://{corpus}", spark.createDataFrame([("g7/x.yaml",)], "path string")
    before = bytes_read(spark)
    fl.read_chosen(spark, root, want, lambda c: c.select("path", F.sha2("content", 256).alias("h")), f"file://{tmp_path}/one")
    one = bytes_read(spark) - before
    assert 100_000 <= one < 150_000
    fl.read_contents(spark, root).join(want, "path", "left_semi").select(F.sha2("content", 256)).collect()
    assert bytes_read(spark) - before - one >= 40 * 100_000


def test_backfill_reads_no_column_without_nulls(spark, tmp_path):
    from catalogspark.operators import diff

    rows = spark.range(20_000).selectExpr("concat('d', id) version_dir", "repeat(sha2(cast(id as string), 256), 4) record", "array('a') claimed")
    rows.coalesce(1).write.parquet(f"{tmp_path}/full")
    versions = spark.read.parquet(f"{tmp_path}/full")
    plan = diff.needs_backfill(versions, versions, ["record", "claimed"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNull(record)" in plan
    before = bytes_read(spark)
    assert versions.where("record is null").select("version_dir").count() == 0
    assert bytes_read(spark) - before < 200_000 < os.path.getsize(next(tmp_path.glob("full/*.parquet")))
    holed = versions.selectExpr("version_dir", "nullif(record, record) record", "claimed").limit(3)
    assert diff.needs_backfill(versions, holed.unionByName(versions), ["record", "claimed"]).count() == 3
