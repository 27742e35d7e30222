"""Builds list and open files by tasks where these can; groups are checked in the shuffle that assembles them."""

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import records
from catalogspark.plans import build as bd
from catalogspark.plans import state_queries as sq
from catalogspark.plans.fixtures import view
from catalogspark.sources import files as fl
from catalogspark.sources import fragments as fr
from catalogspark.sources import listing as ls
from tests.test_build import write

SF = "/root/testdata/sf0.001"


def test_no_path_of_a_build_passes_through_the_driver(spark, tmp_path, monkeypatch):
    def fails(*a, **k):
        raise AssertionError("on the driver")

    for name in ("blocks_of_paths", "scan_files"):
        monkeypatch.setattr(fl, name, fails)
    for i in range(3):
        write(tmp_path / "c/manifests", f"Ex.P{i}", "1.0", d=f"{i}")
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/c", state=f"file://{tmp_path}/s", index_format=0, buckets=2)
    assert bd.incremental_build(spark, cfg)["added"] == 3
    write(tmp_path / "c/manifests", "Ex.P1", "1.0", d="new")
    assert bd.incremental_build(spark, cfg)["updated"] == 1
    with pytest.raises(AssertionError, match="driver"):
        bd.incremental_build(spark, bd.BuildConfig(**{**cfg.__dict__, "listing": "driver"}))


def test_other_file_systems_are_left_to_spark(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.reading.link./in", f"file://{tmp_path}")
    assert ls.tasks_can_open(spark, "/tmp") and ls.tasks_can_open(spark, "file:///tmp") and not ls.tasks_can_open(spark, "viewfs://reading/in")


def test_files_are_read_by_the_tasks_they_are_dealt_to(spark, tmp_path, monkeypatch):
    sizes = {"a/b/small.yaml": 5, "a/b/odd [1]*{x}?.yaml": 7, "a/b/ü ö%20.yaml": 3, **{f"m/f{i}.yaml": 11 for i in range(9)}}
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "m").mkdir()
    for name, size in (sizes | {"m/huge.yaml": 9_000}).items():
        (tmp_path / name).write_bytes(b"\xff" * size)
    read = lambda names: ls.read_files(spark, f"file://{tmp_path}", spark.createDataFrame([(n,) for n in names], "path string"))
    monkeypatch.setattr(ls, "FILES", 4)
    monkeypatch.setattr(ls, "BYTES", 20)
    rows = read([*sizes, *sizes, None])
    assert sorted((r.path, r.n) for r in rows.select("path", F.length("content").alias("n")).collect()) == sorted(sizes.items())
    assert read([]).count() == 0
    with pytest.raises(Exception, match="none.yaml"):
        read(["a/none.yaml"]).collect()
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4000")
    try:
        assert read(sizes).count() == len(sizes)
        with pytest.raises(Exception, match="9000 bytes"):
            read(["m/huge.yaml"]).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_folders_are_opened_by_few_tasks(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/x.yaml").write_text("a: 1")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "777")
    spark.sparkContext.setJobGroup("folders", "folders")
    (tmp_path / "c/d").mkdir()
    try:
        assert ls.list_files(spark, f"file://{tmp_path}/c", f"file://{tmp_path}/out").count() == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", was)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("folders") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= ls.FOLDER_TASKS * spark.sparkContext.defaultParallelism


def test_groups_are_checked_and_assembled_in_one_shuffle(spark):
    frag = fr.parse_fragments(sq.yaml_text(view(spark, SF, "frag")).select("path", F.col("content").cast("binary").alias("content"))).cache()
    both = records.checked_records(frag)
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rules = both.select("version_dir", F.explode("rules").alias("rule"))
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert not rules.isEmpty() and same(rules, records.check_groups(frag))
    text = lambda df: df.select("version_dir", "record", "package_id", "source_file_count", F.to_json("child_fields").alias("c"), F.to_json("installers").alias("i"))
    assert same(text(both), text(records.assemble_records(frag)))
    frag.unpersist()


def test_a_publishing_is_planned_once(spark, tmp_path, monkeypatch):
    """What is wanted and what is to do are tables that counting, copying and the commit read; a dry run leaves nothing behind."""
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/c", state=f"file://{tmp_path}/s", index_format=0, buckets=2)
    write(tmp_path / "c/manifests", "Ex.P", "1.0", d="x")
    bd.incremental_build(spark, cfg)
    names, planned, was, plan = [], [], bd.Work.table, bd.inventory.published_inventory
    monkeypatch.setattr(bd.Work, "table", lambda self, df, name: names.append(name) or was(self, df, name))
    monkeypatch.setattr(bd.inventory, "published_inventory", lambda *a: planned.append(1) or plan(*a))
    assert bd.publish(spark, cfg, f"file://{tmp_path}/site", dry_run=True) == {"copy": 3, "status": "dry-run"}
    assert not [*(tmp_path / "s/work").iterdir()] and not (tmp_path / "site").exists()
    assert bd.publish(spark, cfg, f"file://{tmp_path}/site") == {"copy": 3, "status": "published"}
    assert names == ["wanted", "actions"] * 2 and planned == [1, 1]
    assert bd.verify_published(spark, cfg, f"file://{tmp_path}/site").isEmpty()
