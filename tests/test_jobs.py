"""The composite jobs run no further than a query needs, and their corpus is written and listed by few jobs of many tasks."""

import threading
import time

import pytest
import yaml
from pyspark.sql import functions as F

from catalogspark.operators import records
from catalogspark.plans import build as bd
from catalogspark.plans import state_queries as sq
from catalogspark.sources import files as fl
from catalogspark.sources import fragments as fr
from catalogspark.sources import state as st
from catalogspark.sources.scratch import together
from catalogspark.sources.listing import write_files

SF = "/root/testdata/sf0.001"


def test_every_fragment_is_a_file_and_many_tasks_write(spark):
    jobs = sq._Jobs(spark, SF)
    jobs._add("turn <> 99")
    paths = [r.path for r in fl.scan_files(spark, jobs.cfg.corpus, "part-*").collect()]
    assert len(paths) == jobs.text.where("turn <> 99").count()
    assert len({p.rpartition("/")[2].split("-")[1] for p in paths}) > 3


def test_a_query_runs_its_own_steps_only(spark):
    sq._jobs.cache_clear()
    sq.QUERIES["b3_full_rebuild"](spark, SF).collect()
    jobs = sq._jobs(spark, SF)
    assert jobs.passed == ["b3"] and st.StateStore(spark, jobs.cfg.state).current()["build"] == 1


def test_listing_starts_few_tasks(spark, tmp_path):
    for k in range(150):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "x.yaml").write_text("a: 1")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        assert fl.scan_files(spark, f"file://{tmp_path}").count() == 150
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= fl.LISTING_TASKS * spark.sparkContext.defaultParallelism


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "x.yaml").write_text(f"a: {k}")
    root, most = f"file://{tmp_path}", fl.READING_TASKS * spark.sparkContext.defaultParallelism
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file each, by its cost
    try:
        listed = fl.scan_files(spark, root)
        seen = fl.read_chosen(spark, root, listed, lambda c: c.select("path", F.col("content").cast("string").alias("text")), f"{root}-out")
        assert listed.rdd.getNumPartitions() <= most and len(seen.inputFiles()) <= most
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert {(r.path, r.text) for r in seen.collect()} == {(f"d{k}/x.yaml", f"a: {k}") for k in range(60)}


def test_files_are_written_once_whatever_runs_again(spark, tmp_path):
    rows = spark.createDataFrame([(f"p={k % 3}/v=1/f{k}.yaml", f"größe: {k}\n") for k in range(9)], "path string, content string")
    assert [write_files(rows, f"file://{tmp_path}/c") for _ in range(2)] == [9, 9]
    assert {p.relative_to(tmp_path / "c").as_posix(): p.read_text() for p in tmp_path.glob("c/**/*.yaml")} == {r.path: r.content for r in rows.collect()}
    assert write_files(rows.limit(0), f"file://{tmp_path}/none") == 0


def test_names_of_chosen_files_are_no_calls_each(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"f{k},a b.yaml").write_text(f"a: {k}")
    files = [f"file://{tmp_path}/f{k},a b.yaml" for k in range(300)]
    client, calls = spark.sparkContext._gateway._gateway_client, []
    was = client.send_command
    client.send_command = lambda command, *a, **k: calls.append(command[:2]) or was(command, *a, **k)
    try:
        opened = fl._open_files(spark, files)
    finally:
        client.send_command = was
    assert 0 < sum(c in ("c\n", "l\n") for c in calls) < 100  # others free what went before
    assert sorted(int(r.t) for r in opened.select(F.substring(F.col("content").cast("string"), 4, 9).alias("t")).collect()) == list(range(300))


TEXTS = ("a: 1", "a: [1, {b: 'x''y', c: \"u\\n\"}]\nPackageVersion: 1.10", "a: [x\nb: 1", "a: 1\na: 2", "a: b: c", "a: {b:c}", "a: x\n  y\nb:\n- 1\n-  c: ~", "a: [u?v]", "a: &x 1\nb: *x", "a: \t1", "größe: 1", "a: 1\n---\nb: 2", "")


@pytest.mark.parametrize("text", TEXTS)
def test_plain_texts_are_parsed_alike_and_fast(text):
    slow, fast = fr.loader(), fr.fast_loader()
    assert fr.parse("d/f", text.encode(), slow, fast) == fr.parse("d/f", text.encode(), slow)


def test_plain_texts_take_the_fast_parser():
    class Never:
        def __init__(self, _):
            raise AssertionError("not for this text")

    assert yaml.__with_libyaml__ and fr.tree_of(b"a: [1, {b: c}]\n", Never, fr.fast_loader()) == {"a": [1, {"b": "c"}]}


def test_steps_run_together_and_end_before_an_error(spark):
    meet, ended = threading.Barrier(2, timeout=20), []

    def met(k):
        meet.wait()
        return k

    assert together(spark, [lambda: met(1), lambda: met(2)]) == [1, 2]

    def late():
        time.sleep(0.5)
        ended.append(1)

    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1 // 0, late])
    assert ended == [1]


def test_tables_of_a_commit_are_written_together(spark, tmp_path, monkeypatch):
    """The first and the second commit of a build: every table waits for another one to be under way."""
    meet, was = threading.Barrier(2, timeout=60), st.StateStore._written

    def written(self, rows, path):
        if not path.endswith(("-segments", "-merged")):
            meet.wait()
        return was(self, rows, path)

    store = st.StateStore(spark, f"file://{tmp_path}/s", buckets=2)
    rows = spark.createDataFrame([("d", "p", "1")], "version_dir string, package_id string, path string")
    monkeypatch.setattr(st.StateStore, "_written", written)
    store.begin()
    store.commit({"versions": rows.drop("path"), "files": rows.drop("package_id")})
    more = spark.createDataFrame([("e", "p", "2")], rows.schema)
    store.begin()
    store.commit({}, deltas={"versions": (more.drop("path"), rows.drop("path").limit(0)), "files": (more.drop("package_id"), rows.drop("package_id").limit(0))})
    assert store.read("versions", "version_dir string").count() == 2 and store.read("files", "path string").count() == 2


def test_a_first_build_works_out_no_changed_rows(spark, tmp_path, monkeypatch):
    """What only later builds write (changed rows, moved counts, rows of other packages) isn't planned by the first one."""
    seen = []
    was = bd._packages
    monkeypatch.setattr(bd, "_packages", lambda rows: seen.append(1) or was(rows))
    jobs = sq._Jobs(spark, SF)
    jobs.upto("b3")
    assert seen == [1]


def test_a_first_build_writes_no_copies(spark, tmp_path, monkeypatch):
    """All files are new and all groups dirty: neither is worked out by joins with a state that is empty, nor written twice."""
    for group, text in (("p=A/v=1", "PackageIdentifier: A\nPackageVersion: 1\nManifestVersion: 1.1.0\nManifestType: merged\nInstallers:\n- Architecture: x64\n"), ("p=B/v=1", "ManifestType: [")):
        (tmp_path / "corpus" / group).mkdir(parents=True)
        (tmp_path / "corpus" / group / "x.yaml").write_text(text)
    names, was = [], bd.Work.table
    monkeypatch.setattr(bd.Work, "table", lambda self, df, name: names.append(name) or was(self, df, name))
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/corpus", state=f"file://{tmp_path}/state", quarantine=True, index_format=0, buckets=2)
    got = bd.incremental_build(spark, cfg)
    assert (got["added"], got["status"]) == (1, "staged")
    assert not {"fresh", "siblings", "dirty-fragments"} & {*names}
    assert [r.version_dir for r in st.StateStore(spark, cfg.state).read("versions", bd.VERSIONS).collect()] == ["p=A/v=1"]
    (tmp_path / "corpus" / "p=B/v=1" / "x.yaml").write_text("PackageIdentifier: B\nPackageVersion: 1\nManifestVersion: 1.1.0\nManifestType: merged\nInstallers:\n- Architecture: x64\n")
    names.clear()
    assert bd.incremental_build(spark, cfg)["added"] == 1 and "dirty-fragments" in names


def test_groups_are_checked_in_one_shuffle(spark):
    rows = spark.createDataFrame([("d", "d/x", "x", "version", {"PackageIdentifier": '"A"'}), ("d", "d/y", "y", "installer", {"PackageIdentifier": '"B"'}), ("d", "d/z", "z", "defaultlocale", {})], "version_dir string, path string, file_name string, frag_type string, fields map<string,string>").withColumn("error", F.lit(None).cast("string"))
    broken = records.check_groups(rows)
    plan = broken._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1
    rules = {r.rule for r in broken.collect()}
    assert "PackageIdentifier differs" in rules and "PackageVersion differs" not in rules


def test_writers_follow_the_cores(spark, monkeypatch):
    monkeypatch.setattr(sq, "WRITERS", 1)
    jobs, seen = sq._Jobs(spark, SF), []
    monkeypatch.setattr(sq, "write_files", lambda rows, root: seen.append(rows.rdd.getNumPartitions()))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "333")
    try:
        jobs._add("turn <> 99")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen == [4 * spark.sparkContext.defaultParallelism]
