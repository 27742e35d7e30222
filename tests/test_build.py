import pathlib

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import conflicts, records
from catalogspark.plans import build as bd
from catalogspark.sources import files as fl
from catalogspark.sources import fragments as fr
from catalogspark.sources import state as st

VERSION = "PackageIdentifier: {id}\nPackageVersion: {v}\nDefaultLocale: en-US\nManifestType: version\nManifestVersion: 1.6.0\n"
LOCALE = "PackageIdentifier: {id}\nPackageVersion: {v}\nPackageLocale: {l}\nPackageName: {id} App x64\nPublisher: Example Holdings LLC\nTags: [b, a, a]\nManifestType: {t}\nManifestVersion: 1.6.0\n"
INSTALLER = "PackageIdentifier: {id}\nPackageVersion: {v}\nInstallerType: exe\nCommands: []\nDependencies: null\nInstallers:\n{i}ManifestType: installer\nManifestVersion: 1.6.0\n"
ITEM = "- Architecture: {a}\n  InstallerUrl: https://h/{a}\n  InstallerSha256: {s}\n  Commands: [{c}]\n  AppsAndFeaturesEntries:\n  - DisplayName: Some x86 Tool\n    DisplayVersion: '{d}'\n    ProductCode: '{{P}}'\n"


def write(root, pid, v, d="1", items=(("x64", "AB", "run"),), extra=()):
    folder = pathlib.Path(root, pid[0], *pid.split("."), v)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{pid}.yaml").write_text(VERSION.format(id=pid, v=v))
    (folder / f"{pid}.locale.en-US.yaml").write_text(LOCALE.format(id=pid, v=v, l="en-US", t="defaultLocale"))
    for x in extra:
        (folder / f"{pid}.locale.{x}.yaml").write_text(LOCALE.format(id=pid, v=v, l=x, t="locale"))
    (folder / f"{pid}.installer.yaml").write_text(INSTALLER.format(id=pid, v=v, i="".join(ITEM.format(a=a, s=s, c=c, d=d) for a, s, c in items)))
    return folder


@pytest.fixture
def cfg(tmp_path):
    corpus = tmp_path / "corpus" / "manifests"
    for i in range(6):
        write(corpus, f"Ex.P{i}", "1.0.0", d=f"{i}.1", extra=("fr-FR", "de-DE") if i % 2 else ())
        write(corpus, f"Ex.P{i}", "1.10", d=f"{i}.1" if i == 3 else f"{i}.2")
    return bd.BuildConfig(corpus=f"file://{tmp_path}/corpus", state=f"file://{tmp_path}/state", buckets=4)


def test_fragments_and_records(spark, cfg):
    assert fl.scan_files(spark, cfg.corpus).count() == 6 * 6 + 3 * 2
    frags = fr.parse_fragments(fl.read_contents(spark, cfg.corpus))
    rows = {r.path: r for r in frags.collect()}
    r = rows["E/Ex/P1/1.10/Ex.P1.installer.yaml"]
    assert r.fields["PackageVersion"] == '"1.10"' and r.warnings == ["PackageVersion 1.10 is a number"] and "Commands" not in r.fields and "Dependencies" not in r.fields
    assert rows["E/Ex/P1/1.0.0/Ex.P1.locale.en-US.yaml"].fields["Tags"] == '["a","a","b"]'
    assert records.check_groups(frags).count() == 0
    made = records.assemble_records(frags).persist()
    one = made.where("version_dir = 'E/Ex/P1/1.0.0'").first()
    assert one.package_id == "Ex.P1" and one.package_version == "1.0.0" and one.source_file_count == 5
    assert one.fields["ManifestType"] == '"merged"' and one.fields["Localization"].index("de-DE") < one.fields["Localization"].index("fr-FR")
    assert one.record.startswith('{"DefaultLocale"') is False and one.record.startswith('{"InstallerType":"exe","Installers":')
    p = records.project_index(made).where("version_dir = 'E/Ex/P1/1.0.0'").first()
    assert p.tags == ["a", "b"] and p.commands == ["run"] and p.norm_publishers == ["example"] and p.norm_names == ["exp1app", "sometool", "sometool(X86)"] and p.product_codes == ["{P}"]
    kids = records.child_records(made).where("version_dir = 'E/Ex/P1/1.0.0'").collect()
    assert len(kids) == 1 and kids[0].architecture == "x64" and kids[0].url == "https://h/x64" and kids[0].product_codes == ["{P}"]
    assert [r.files for r in records.fragment_warnings(frags).collect()] == [18]


def test_rules(spark, tmp_path):
    root = tmp_path / "c"
    a = write(root, "A.A", "1")
    (a / "A.A.installer.yaml").unlink()
    b = write(root, "B.B", "1")
    (b / "B.B.yaml").write_text(VERSION.format(id="B.X", v="1").replace("en-US", "de-DE"))
    c = root / "C/C/1"
    c.mkdir(parents=True)
    (c / "C.yaml").write_text("PackageIdentifier: C\nPackageIdentifier: D\n")
    d = root / "D/D/2"
    d.mkdir(parents=True)
    (d / "D.yaml").write_text("PackageIdentifier: D\nPackageVersion: yes\nManifestVersion: 1:30\nManifestType: Singleton\nInstallers: [{Architecture: x}]\n")
    frags = fr.parse_fragments(fl.read_contents(spark, f"file://{root}"))
    rules = {(r.version_dir, r.rule) for r in records.check_groups(frags).collect()}
    assert ("A/A/A/1", "not exactly one installer fragment") in rules and ("A/A/A/1", "Installers is missing") in rules
    assert {("B/B/B/1", "PackageIdentifier differs"), ("B/B/B/1", "default locale differs")} <= rules
    assert ("C/C/1", "unreadable fragment") in rules and not any(v == "D/D/2" for v, _ in rules)
    made = records.assemble_records(frags.where("version_dir = 'D/D/2'")).first()
    assert made.fields["ManifestVersion"] == '"1:30"' and made.package_version == "2" and made.fields["ManifestType"] == '"Singleton"'


def test_incremental_equals_full(spark, cfg, tmp_path):
    corpus = tmp_path / "corpus" / "manifests"
    first = bd.incremental_build(spark, cfg)
    assert (first["added"], first["status"], first["build"]) == (12, "staged", 1)

    write(corpus, "Ex.P0", "1.10", d="0.2", items=(("x64", "AB", "run"), ("arm64", "CD", "run")))  # one installer more
    write(corpus, "Ex.P1", "1.10", d="1.2", items=(("x64", "AB", "other"),))  # commands only: no new installer
    write(corpus, "Ex.P9", "3.0")
    for f in (corpus / "E/Ex/P2/1.0.0").iterdir():
        f.unlink()
    seen = bd.incremental_build(spark, bd.BuildConfig(**{**cfg.__dict__, "dry_run": True}))
    second = bd.incremental_build(spark, cfg)
    assert (second["added"], second["updated"], second["removed"], second["revalidations"]) == (1, 2, 1, 2)
    assert seen == {k: second[k] for k in ("added", "updated", "removed", "revalidations")} | {"status": "dry-run"}
    store = st.StateStore(spark, cfg.state)
    queue = {(r.version_dir, r.reason) for r in spark.read.json(f"{store.root}/snapshots/{second['build']:08d}/queue").collect()}
    assert queue == {("E/Ex/P0/1.10", "installer-changed"), ("E/Ex/P9/3.0", "added")}

    full = bd.BuildConfig(**{**cfg.__dict__, "state": cfg.state + "2", "force": True})
    bd.incremental_build(spark, full)
    other = st.StateStore(spark, full.state)
    for name, ddl in (("versions", bd.VERSIONS), ("children", bd.CHILDREN), ("packages", bd.PACKAGES), ("index_tags2_map", "package bigint, id bigint"), ("index_norm_names2", "value string, package bigint")):
        a, b = (sorted(map(repr, s.read(name, ddl).collect())) for s in (store, other))
        assert a == b and a
    assert [r.status for r in store.builds().orderBy("build_id").collect()] == ["staged", "staged"]
    assert store.read("versions", "version_dir string, later_column int").where("later_column is null").count() == 12


def test_targets_publish_and_failures(spark, cfg, tmp_path):
    cfg.index_format = 0
    corpus = tmp_path / "corpus" / "manifests"
    bd.incremental_build(spark, cfg)
    write(corpus, "Ex.P0", "2.0")
    write(corpus, "Ex.P1", "2.0")
    done = bd.apply_targets(spark, cfg, {"directories": ["E/Ex/P0/2.0"]})
    assert done["added"] == 1 and bd.pending_diff(spark, cfg)["added"] == 1  # the other change is still pending
    gone = bd.apply_targets(spark, cfg, {"packages": ["Ex.P5"]}, remove=True)
    assert (gone["removed"], gone["added"]) == (2, 0)
    target = f"file://{tmp_path}/site"
    assert bd.publish(spark, cfg, target, dry_run=True)["copy"] == 11 + 5 + 1
    assert bd.publish(spark, cfg, target)["status"] == "published"
    assert bd.publish(spark, cfg, target, dry_run=True) == {"status": "dry-run"}
    assert bd.verify_published(spark, cfg, target).count() == 0

    rows = spark.read.parquet(target)
    bad = spark.createDataFrame([(r.relpath, r.kind, "CORRUPT" if r.kind == "package" else r.body, r.bucket) for r in rows.collect()][1:], rows.schema)
    bad.write.partitionBy("bucket").parquet(target + "-x")
    fs, path = bd.fl.filesystem(spark, target)
    fs.delete(path, True)
    fs.rename(bd.fl.filesystem(spark, target + "-x")[1], path)
    with pytest.raises(ValueError, match="mismatched"):
        bd.publish(spark, cfg, target)
    assert {r.drift_kind for r in bd.verify_published(spark, cfg, target).collect()} == {"mismatched", "missing"}
    assert bd.publish(spark, cfg, target, force=True)["copy"] == 17 and bd.verify_published(spark, cfg, target).count() == 0

    write(corpus, "Ex.P2", "7.0", d="2.7")
    bd.incremental_build(spark, cfg)
    before = {r.relpath for r in spark.read.parquet(target).collect()}
    done = bd.publish(spark, cfg, target)
    assert done["copy"] == 4 + 3 + 1 and done["delete"] == 2  # 2.0 of P1, 7.0 of P2, both of P5 again; their sidecars; the catalogue
    after = {r.relpath for r in spark.read.parquet(target).collect()}
    assert len(after - before) == 7 and len(before - after) == 2 and bd.verify_published(spark, cfg, target).count() == 0
    assert bd.publish(spark, cfg, target, build_id=gone["build"])["delete"] == 7
    assert {r.relpath for r in spark.read.parquet(target).collect()} == before

    bd.clear_published(spark, cfg)
    assert st.StateStore(spark, cfg.state).read("published", bd.PUBLISHED).count() == 0
    (corpus / "E/Ex/P4/1.0.0/Ex.P4.yaml").write_text("a: [")
    with pytest.raises(ValueError, match="unreadable"):
        bd.incremental_build(spark, cfg)
    log = st.StateStore(spark, cfg.state).builds().orderBy(F.desc("build_id")).first()
    assert log.status == "failed" and "unreadable" in log.error


def test_losers_are_rewritten_and_come_back(spark, tmp_path):
    corpus = tmp_path / "c" / "manifests"
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/c", state=f"file://{tmp_path}/s", index_format=0, buckets=4)
    write(corpus, "Ex.A", "1.0", d="3.1")
    write(corpus, "Ex.A", "2.0", d="3.1")
    write(corpus, "Ex.B", "1.0", d="3.1")
    bd.incremental_build(spark, cfg)
    seen = lambda: {r.version_dir[-9:]: r for r in st.StateStore(spark, cfg.state).read("versions", bd.VERSIONS).collect()}
    rows = seen()
    by = {r.relpath.split("/")[3] + r.package_version: r for r in rows.values()}
    assert '"3.1"' not in by["A1.0"].record and '"3.1"' in by["A2.0"].record and by["A1.0"].claimed_versions == ["3.1"] and by["A1.0"].display_versions == []
    import hashlib

    assert all(r.content_sha == hashlib.sha256(r.record.encode()).hexdigest() for r in rows.values())
    write(corpus, "Ex.A", "3.0", d="3.1")  # takes the value over: 2.0 loses it and is read again
    done = bd.incremental_build(spark, cfg)
    assert (done["added"], done["updated"]) == (1, 1)
    for f in (corpus / "E/Ex/A/3.0").iterdir():
        f.unlink()
    done = bd.incremental_build(spark, cfg)  # and gets it back
    assert (done["removed"], done["updated"]) == (1, 1)
    assert {k: (r.content_sha, r.children_sha) for k, r in seen().items()} == {k: (r.content_sha, r.children_sha) for k, r in rows.items()}
    with pytest.raises(Exception, match="conflicting value 3.1"):
        bd.incremental_build(spark, bd.BuildConfig(**{**cfg.__dict__, "strategy": "error", "force": True}))
    bd.incremental_build(spark, bd.BuildConfig(**{**cfg.__dict__, "strategy": "oldest", "force": True}))
    by = {r.relpath.split("/")[3] + r.package_version: r for r in seen().values()}
    assert by["A1.0"].display_versions == ["3.1"] and by["A2.0"].display_versions == []


def test_a_run_writes_what_it_touches(spark, tmp_path):
    corpus = tmp_path / "c" / "manifests"
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/c", state=f"file://{tmp_path}/s", index_format=0)
    for i in range(40):
        write(corpus, f"Ex.P{i}", "1.0", d=f"{i}")
    bd.incremental_build(spark, cfg)
    size = lambda build, name: len(list((tmp_path / "s" / "snapshots" / f"{build:08d}" / name).glob("bucket=*")))
    write(corpus, "Ex.P7", "2.0", d="77")
    second = bd.incremental_build(spark, cfg)
    assert size(1, "versions") > 20 and [size(second["build"], n) for n in ("versions", "packages", "children", "files")] == [1, 1, 1, 1]
    third = bd.incremental_build(spark, cfg)
    assert third["status"] == "staged_reused" and not (tmp_path / "s" / "snapshots" / f"{third['build']:08d}").exists()
    fourth = bd.incremental_build(spark, bd.BuildConfig(**{**cfg.__dict__, "index_format": 1}))
    store = st.StateStore(spark, cfg.state)
    assert fourth["status"] == "staged" and store.get_meta("format") == 1 and store.read("index_manifest", "version_dir string, ordinal long").count() == 41
    names = [n for n in store.current()["tables"] if n.startswith("index_")]
    assert len(names) == 21


def test_a_dead_writers_lock_is_taken_over(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    st.StateStore(spark, root).begin()
    with pytest.raises(RuntimeError, match="locked"):
        st.StateStore(spark, root).begin()
    store = st.StateStore(spark, root, lease=-1)
    store.begin()
    store.close("staged")
    assert [(r.status, r.error) for r in store.builds().orderBy("build_id").collect()] == [("failed", "abandoned"), ("staged", None)]


def test_child_identity_keeps_types(spark):
    from catalogspark.sources import fragments as fr

    text = "PackageIdentifier: A\nPackageVersion: '1'\nManifestVersion: 1.6.0\nManifestType: merged\nInstallers:\n- Architecture: x64\n  Scope: {}\n"
    rows = [(f"a/{i}/x.yaml", text.format(v).encode()) for i, v in enumerate(("1", "'1'", "true", "'true'"))]
    frags = fr.parse_fragments(spark.createDataFrame(rows, "path string, content binary")).withColumn("version_dir", F.lit("a/1"))
    kids = [records.child_records(records.assemble_records(frags.where(F.col("path") == p))).first() for p, _ in rows]
    assert len({k.child_sha for k in kids}) == 4 and [k.scope for k in kids] == ["1", "1", "true", "true"]


def test_conflict_strategies(spark):
    rows = [("p", "d1", "3.15.2", "", "3.14.4"), ("p", "d2", "3.16.2", "", "3.14.4"), ("p", "d2", "3.16.2", "", "other")]
    df = spark.createDataFrame(rows, "package_id string, version_dir string, package_version string, channel string, value string")
    kept = lambda s: {(r.version_dir, r.value) for r in conflicts.resolve_conflicts(df, s).collect()}
    assert kept("latest") == {("d2", "3.14.4"), ("d2", "other")}
    assert kept("oldest") == {("d1", "3.14.4"), ("d2", "other")}
    assert kept("strip-all") == {("d2", "other")}
    with pytest.raises(Exception, match="conflicting value 3.14.4"):
        conflicts.resolve_conflicts(df, "error").collect()
    report = conflicts.conflict_report(df, "latest").first()
    assert (report.retained, report.stripped) == ("3.16.2", "3.15.2")
