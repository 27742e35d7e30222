"""Publishing that dies at any step leaves the old site or the new one."""

import hashlib

import pytest

from catalogspark.plans import build as bd
from catalogspark.sources.lease import Fenced
from catalogspark.sources.site import Site


class Died(Exception):
    pass


def dying(step, times=1):
    seen = []

    def on_step(s):
        seen.append(s)
        if seen.count(step) == times:
            raise Died(step)

    return on_step


def content(spark, target):
    return {r.relpath: r.body for r in Site(spark, target).rows().collect()}


def stage(spark, cfg, items):
    """A staged build of these versions: (package, version) to the text of the record."""
    names = [f.split()[0] for f in bd.VERSIONS.replace("array<string>", "a").split(", ")]
    rows = []
    for (pid, v), body in items.items():
        sha = hashlib.sha256(body.encode()).hexdigest()
        known = {"version_dir": f"{pid}/{v}", "package_id": pid, "package_version": v, "channel": "", "content_sha": sha, "children_sha": "c", "record": body, "relpath": f"manifests/{pid}/{v}/{sha[:8]}.yaml", "source_file_count": 1}
        rows.append(tuple(known.get(n) for n in names))
    versions = spark.createDataFrame(rows, bd.VERSIONS)
    store = bd.st.StateStore(spark, cfg.state, cfg.buckets)
    build = store.begin()
    store.commit({"versions": versions, "packages": bd._packages(versions)})
    return build


@pytest.fixture
def built(spark, tmp_path):
    cfg = bd.BuildConfig(corpus=f"file://{tmp_path}/c", state=f"file://{tmp_path}/s", index_format=0, buckets=3)
    items = {(f"Ex.P{i}", "1.0"): f"record {i}" for i in range(3)}
    first = stage(spark, cfg, items)
    del items["Ex.P2", "1.0"]
    second = stage(spark, cfg, items | {("Ex.P0", "2.0"): "another"})
    return cfg, f"file://{tmp_path}/site", first, second


def test_every_step_leaves_the_old_site_or_the_new_one(spark, built):
    cfg, target, first, second = built
    assert bd.publish(spark, cfg, target, build_id=first)["status"] == "published"
    at, to, sites = first, second, {first: content(spark, target)}
    for step in ("staged", "moved a file", "moved", "committed", "pointed"):
        with pytest.raises(Died):
            bd.publish(spark, cfg, target, build_id=to, on_step=dying(step))
        assert bd.verify_published(spark, cfg, target).count() == 0, step  # nothing has drifted: no force is needed
        seen = content(spark, target)
        assert (seen == sites[at]) == (step not in ("pointed", "swept")), step
        done = bd.publish(spark, cfg, target, build_id=to)
        assert done["status"] == "published" and ("copy" in done) != (step in ("committed", "pointed", "swept"))
        after = content(spark, target)
        assert after == sites.setdefault(to, after) != sites[at]
        assert step not in ("pointed", "swept") or seen == after
        assert {r.relpath: r.body for r in spark.read.parquet(target).collect()} == after  # and a plain read agrees
        at, to = to, at
    assert {r.status for r in bd.st.StateStore(spark, cfg.state).builds().where("build_id > 2").collect()} == {"published", "failed"}


def test_a_first_and_a_forced_publishing_that_die(spark, built, tmp_path):
    cfg, target, first, second = built
    with pytest.raises(Died):
        bd.publish(spark, cfg, target, on_step=dying("moved a file", 2))
    assert content(spark, target) == {}
    assert bd.publish(spark, cfg, target)["status"] == "published"
    old = content(spark, target)
    bd.clear_published(spark, cfg)  # now all files are extra
    with pytest.raises(ValueError, match="extra"):
        bd.publish(spark, cfg, target)
    for step in ("staged", "moved"):
        with pytest.raises(Died):
            bd.publish(spark, cfg, target, force=True, build_id=first, on_step=dying(step))
        assert content(spark, target) == old
    bd.publish(spark, cfg, target, force=True, build_id=first)
    assert content(spark, target) != old and bd.verify_published(spark, cfg, target).count() == 0


def test_sites_have_one_pointer_at_a_time(spark, tmp_path):
    site = Site(spark, f"file://{tmp_path}/site")
    assert site.pointer() is None and site.rows().count() == 0 and site.sweep() == 0
    assert site.adopt()["begins"] == {}
    rows = spark.createDataFrame([(f"r{i}", "k", "b", i % 2) for i in range(6)], "relpath string, kind string, body string, bucket int")
    begins = site.add(rows, "one", lambda s: None)
    assert site.rows().count() == 0 and begins == {"0": "one-", "1": "one-"}
    site.point("one", begins, 1)
    with pytest.raises(Fenced):
        site.point("late", begins, 1)
    assert site.rows().count() == 6
    site.add(rows, "dead", lambda s: None)
    assert site.rows().count() == 6 and spark.read.parquet(site.target).count() == 12
    assert site.sweep() > 0 and spark.read.parquet(site.target).count() == 6
    site.point("less", {"1": "one-"})
    site.sweep()
    assert site.rows().count() == spark.read.parquet(site.target).count() == 3
