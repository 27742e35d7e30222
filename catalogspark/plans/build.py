"""The incremental job: scan, find dirty groups, assemble, resolve conflicts, compare, index, commit; and publishing.

What a run reads of contents, assembles and writes follows what has changed: only new and altered files are opened, once,
for hash and fragment alike, then the other files of the groups that turn out dirty; a run without dirty groups ends
there, and of the state only the buckets of touched groups and packages are read.  State and the index by packages are
changed by segments with the rows that are new, altered or gone; the index by versions is built from the projections of
all versions.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions import normalize as nz
from catalogspark.operators import conflicts, counted, diff, index, inventory, lookup, records, rollup
from catalogspark.sources import files as fl
from catalogspark.sources import fragments as fr
from catalogspark.sources import state as st
from catalogspark.sources.lease import Mark
from catalogspark.sources.listing import list_files, read_files, tasks_can_open
from catalogspark.sources.scratch import together
from catalogspark.sources.site import Site

FILES = "path string, version_dir string, size bigint, mtime timestamp, raw_sha256 string"
SETS = ("tags", "commands", "families", "product_codes", "upgrade_codes", "display_versions", "claimed_versions", "norm_names", "norm_publishers")
VERSIONS = (
    "version_dir string, package_id string, package_version string, channel string, content_sha string, children_sha string, record string, relpath string, source_file_count bigint, package_name string, publisher string, "
    "moniker string, " + ", ".join(f"{c} array<string>" for c in SETS)
)
CHILDREN = "version_dir string, child_sha string, url string, architecture string, type string, locale string, scope string, family string, product_codes array<string>"
PACKAGES = "package_id string, package_sha string, version_count bigint, relpath string, sha256 string"
PUBLISHED = "relpath string, kind string, sha256 string"
VALUES = "package_id string, attribute string, value string, n long"
#: Version-level values of each index table (fixed names).
V1_VALUES = {"tags": "tags", "commands": "commands", "pfns": "families", "productcodes": "product_codes", "norm_names": "norm_names", "norm_publishers": "norm_publishers"}
V2_VALUES = V1_VALUES | {"upgradecodes": "upgrade_codes"}
CATALOGUE_PARTS = 4096


@dataclass
class BuildConfig:
    corpus: str
    state: str
    strategy: str = "latest"
    index_format: int = 2  # 1, 2, or 0 for none
    buckets: int = 64
    force: bool = False
    dry_run: bool = False
    trust_mtime: bool = True
    quarantine: bool = False
    targets: dict = field(default_factory=dict)
    remove: bool = False
    glob: str = "*.yaml"
    #: Who lists the corpus and opens its files: "tasks" themselves, by Arrow, or Spark's own reader ("driver"), whose listing and
    #: blocks of paths pass through the driver; "auto": tasks where Arrow opens what Hadoop does.
    listing: str = "auto"


class Work:
    """Tables of one run below the state's work folder: steps that several others read.

    A mark of the same name says that the run lives, and which pointer it may be reading.
    """

    def __init__(self, spark: SparkSession, store: st.StateStore):
        name = uuid.uuid4().hex
        self.spark, self.root = spark, f"{store.root}/work/{name}"
        self.mark = Mark(spark, f"{store.root}/readers/{name}", store.lease, str((store.numbers() or [0])[-1]))
        self.mark.start()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def tables(self, **made: Callable[[], DataFrame]) -> list[DataFrame]:
        """Tables that don't need each other, in their order, made and written at the same time."""
        return together(self.spark, [lambda n=n, m=m: self.table(m(), n) for n, m in made.items()])

    def drop(self) -> None:
        fs, path = fl.filesystem(self.spark, self.root)
        fs.delete(path, True)
        self.mark.stop()


def _projected(made: DataFrame) -> DataFrame:
    """Rows of the state for records: the hash is that of the record's text, children count by their hash."""
    sha = F.sha2("record", 256)
    children = records.children_hash(records.child_records(made))
    rows = made.join(records.project_index(made), "version_dir").join(children, "version_dir", "left").withColumn("content_sha", sha)
    return rows.withColumn("relpath", nz.record_relpath(F.col("package_id"), F.col("package_version"), sha))


def _claims(versions: DataFrame) -> DataFrame:
    return versions.select("package_id", "version_dir", "package_version", "channel", F.explode("claimed_versions").alias("value"))


def _by_tasks(spark: SparkSession, cfg: BuildConfig) -> bool:
    if cfg.listing not in ("auto", "driver", "tasks"):
        raise ValueError(f"listing by {cfg.listing}")
    return cfg.listing == "tasks" or cfg.listing == "auto" and "{" not in cfg.glob and tasks_can_open(spark, cfg.corpus)


def _listed(spark: SparkSession, cfg: BuildConfig, work: Work) -> DataFrame:
    if _by_tasks(spark, cfg):
        return list_files(spark, cfg.corpus, f"{work.root}/listing", cfg.glob)
    return work.table(fl.scan_files(spark, cfg.corpus, cfg.glob), "listing")  # several steps read it


def scan_changes(spark: SparkSession, cfg: BuildConfig, store: st.StateStore, work: Work) -> dict:
    """What there is to do.

    listed (the inventory without hashes), prev, fragments (of the files that were opened), hashed (new and altered files),
    gone (files that are no more), groups (dirty), chosen (targets or None), all (whether all files were opened and all groups
    are dirty, as in a first build).
    """
    prev = store.read("files", FILES)
    listed = _listed(spark, cfg, work)
    chosen = None
    if cfg.targets:
        known = store.read("versions", "version_dir string, package_id string, package_version string")
        new = listed.select("version_dir").distinct().join(known.select("version_dir"), "version_dir", "left_anti").select("version_dir", F.lit(None).cast("string").alias("package_id"), nz.last_segment(F.col("version_dir")).alias("package_version"))
        chosen = work.table(lookup.select_targets(known.unionByName(new), **cfg.targets), "targets")
        if cfg.remove:
            listed = lookup.exclude_targets(listed, chosen)
    everything = chosen is None and not store.holds("files")
    fresh = listed.join(prev.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti") if cfg.trust_mtime and not everything else listed
    if chosen is not None:  # other pending changes stay pending, unread
        fresh = fresh.join(chosen, "version_dir", "left_semi")
    if not everything:
        fresh = work.table(fresh, "fresh")
    opened = _opened(spark, cfg, fresh, work, "fresh-fragments")
    hashes = diff.fill_hashes(fresh, prev.limit(0), opened).drop("reused")
    gone = prev.join(listed.select("path"), "path", "left_anti")
    hashed, groups = work.tables(files=lambda: hashes, groups=lambda: listed.select("version_dir").distinct() if everything else _dirty(cfg, store, listed, prev, hashes, gone, chosen))
    return {"listed": listed, "prev": prev, "fragments": opened, "hashed": hashed, "gone": gone, "groups": groups, "chosen": chosen, "all": everything}


def _dirty(cfg: BuildConfig, store: st.StateStore, listed: DataFrame, prev: DataFrame, hashed: DataFrame, gone: DataFrame, chosen: DataFrame | None) -> DataFrame:
    """Groups with changed files, and those that need a refresh."""
    before = prev.join(hashed.select("path"), "path", "left_semi").unionByName(gone)
    groups = diff.dirty_groups(hashed, before)
    if not cfg.force:
        held = store.read("versions", "version_dir string, record string, claimed_versions array<string>")
        groups = groups.unionByName(diff.needs_backfill(listed, held, ["record", "claimed_versions"])).distinct()
    groups = diff.groups_to_refresh(groups, listed, cfg.force)
    return groups if chosen is None else groups.join(chosen, "version_dir", "left_semi")


def _opened(spark: SparkSession, cfg: BuildConfig, files: DataFrame, work: Work, name: str) -> DataFrame:
    """Fragments of some files, with the hash of their bytes; no other file of the corpus is opened."""
    parsed = lambda contents: fr.parse_fragments(contents, hashes=True)
    if _by_tasks(spark, cfg):
        return work.table(parsed(read_files(spark, cfg.corpus, files)), name)
    made = fl.read_chosen(spark, cfg.corpus, files, parsed, f"{work.root}/{name}")
    return spark.createDataFrame([], fr.HASHED) if made is None else made


def _assembled(spark: SparkSession, cfg: BuildConfig, scan: dict, groups: DataFrame, work: Work, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, violations, fragments) of the files of some groups."""
    if scan["all"] and groups is scan["groups"]:
        fragments = scan["fragments"].drop("raw_sha256")
    else:
        files = scan["listed"].join(diff.still_present(groups, scan["listed"]), "version_dir", "left_semi").select("path")
        unread = _opened(spark, cfg, files.join(scan["fragments"].select("path"), "path", "left_anti"), work, f"{name}-opened")
        fragments = work.table(scan["fragments"].join(files, "path", "left_semi").unionByName(unread).drop("raw_sha256"), f"{name}-fragments")
    # groups are checked in the shuffle that assembles them; what is made of broken ones is left out
    checked = work.table(records.checked_records(fragments), f"{name}-checked")
    return checked.where("size(rules) = 0").drop("rules"), checked.select("version_dir", F.explode("rules").alias("rule")), fragments


def _packages(versions: DataFrame) -> DataFrame:
    """Rows of the packages table for all versions of some packages."""
    data = rollup.version_data(versions).select("package_id", F.sha2(F.to_json("versions"), 256).alias("sha256"))
    rows = rollup.package_hash(versions).join(rollup.version_counts(versions), "package_id").join(data, "package_id")
    return rows.withColumn("relpath", nz.sidecar_relpath(F.col("package_id"), F.col("package_sha"))).select(*[f.split()[0] for f in PACKAGES.split(", ")])


def plan_build(spark: SparkSession, cfg: BuildConfig, store: st.StateStore, work: Work, scan: dict) -> dict:
    """The changes and the queue, and functions that give what a commit writes; the state is not touched.

    ``tables`` gives the touched part of every state table, and with it ``buckets``; ``deltas`` the same as changed rows and
    keys that are gone, ``moved`` the values that packages have gained and lost (None in a state without their counts).
    """
    groups = scan["groups"]
    made, broken, fragments = _assembled(spark, cfg, scan, groups, work, "dirty")
    names = made.select("version_dir", "package_id")

    # conflicts are resolved on what the files claim; siblings that keep other values than before are read again
    touched, claimed = work.tables(
        touched=lambda: diff.touched_packages(groups, names, store.read("versions", "version_dir string, package_id string")),
        claimed=lambda: records.claimed_versions(made).select("package_id", "version_dir", "package_version", "channel", "claimed_versions"),
    )
    buckets = {"versions": store.buckets_of(touched, "package_id")}
    buckets["packages"] = buckets["values"] = buckets["versions"]
    prev = store.read("versions", VERSIONS, buckets["versions"])
    siblings = prev.limit(0) if not store.holds("versions") else work.table(diff.expand_siblings(touched, prev, groups), "siblings")
    lost = work.table(conflicts.losing_claims(_claims(claimed.unionByName(siblings.select(*claimed.columns))), cfg.strategy).select("version_dir", "value"), "lost")
    gives_up = lost.groupBy("version_dir").agg(F.collect_set("value").alias("_lost"))
    keeps = F.array_sort(F.array_except("claimed_versions", F.coalesce("_lost", F.array().cast("array<string>"))))
    again = siblings.join(gives_up, "version_dir", "left").where(keeps != F.array_sort(F.coalesce("display_versions", F.array().cast("array<string>")))).select("version_dir")
    again, final = work.tables(again=lambda: again, records=lambda: records.strip_display_versions(made, lost))
    kept = claimed.select("version_dir", "claimed_versions")
    if not again.isEmpty():
        more = _assembled(spark, cfg, scan, again, work, "siblings")[0]
        final = work.table(final.unionByName(records.strip_display_versions(more, lost)), "all-records")
        kept = kept.unionByName(records.claimed_versions(more).select(*kept.columns))
    columns = [f.split()[0] for f in CHILDREN.split(", ")]
    computed, made_children, compared = work.tables(
        computed=lambda: _projected(final).join(kept, "version_dir").select(*prev.columns),
        made_children=lambda: records.child_records(final).select(*columns),
        compared=lambda: groups.unionByName(again).distinct(),
    )
    buckets["children"] = store.buckets_of(compared, "version_dir")
    prev_children = store.read("children", CHILDREN, buckets["children"])

    def all_changes() -> DataFrame:
        looked_at = compared.unionByName(siblings.select("version_dir")).distinct()
        unread = siblings.join(again, "version_dir", "left_anti")
        now, was = computed.unionByName(unread.select(*computed.columns)), prev.join(looked_at, "version_dir", "left_semi")
        return diff.diff_records(now, was, "version_dir", ["content_sha", "children_sha"])

    changes, kids, versions = work.tables(
        changes=all_changes,
        children=lambda: diff.apply_changes(prev_children, made_children, compared),
        versions=lambda: diff.apply_changes(prev, computed, compared),
    )
    done = groups if scan["chosen"] is not None else None
    hashed, gone = (x if done is None else x.join(done, "version_dir", "left_semi") for x in (scan["hashed"], scan["gone"]))
    held = lambda rows: counted.holdings(rows, V2_VALUES)

    def tables() -> dict[str, DataFrame]:
        buckets["files"] = store.buckets_of(hashed.select("version_dir").union(gone.select("version_dir")).union(scan["prev"].join(hashed.select("path"), "path", "left_semi").select("version_dir")), "version_dir")
        kept_files = store.read("files", FILES, buckets["files"]).join(hashed.select("path").union(gone.select("path")), "path", "left_anti")
        files = kept_files.unionByName(hashed.select(*kept_files.columns))
        return {"files": files, "versions": versions, "children": kids, "packages": _packages(versions), "values": counted.count_holdings(held(versions))}

    def moved() -> DataFrame | None:
        """Values that packages hold: moved by what the compared versions held and hold."""
        if not store.holds("values"):
            return None
        shifts = counted.count_changes(held(prev.join(compared, "version_dir", "left_semi")), held(computed))
        counts = store.read("values", VALUES, buckets["values"]).join(touched, "package_id", "left_semi")
        return counted.moved_counts(counts, shifts)

    def deltas() -> dict[str, tuple[DataFrame, DataFrame]]:
        mine = _packages(versions.join(touched, "package_id", "left_semi"))
        was = lambda df, key: df.join(compared, "version_dir", "left_semi").select(*key)
        return file_deltas() | {
            "versions": (computed, was(prev, ["version_dir", "package_id"]).join(computed.select("version_dir", "package_id"), ["version_dir", "package_id"], "left_anti")),
            "children": (made_children, was(prev_children, ["version_dir", "child_sha"]).join(made_children.select("version_dir", "child_sha"), ["version_dir", "child_sha"], "left_anti")),
            "packages": (mine, touched.select("package_id").join(versions.select("package_id"), "package_id", "left_anti")),
        }

    def file_deltas() -> dict[str, tuple[DataFrame, DataFrame]]:
        return {"files": (hashed.select(*[f.split()[0] for f in FILES.split(", ")]), gone.select("path", "version_dir"))}

    queue = diff.validation_queue(changes, kids, prev_children)
    return {"tables": tables, "moved": moved, "deltas": deltas, "file_deltas": file_deltas, "versions": versions, "changes": changes, "queue": queue, "violations": broken, "warnings": records.fragment_warnings(fragments), "buckets": buckets, "touched": touched}


def index_tables(versions: DataFrame, fmt: int = 2, now: int = 0, base: int = 0) -> index.Tables:
    """All tables of an index format over all versions."""
    if fmt == 1:
        rows = versions.select("version_dir", "package_id", "package_version", "channel", F.col("package_name").alias("name"), "moniker", "publisher", F.col("relpath").alias("path"))
        return index.build_index_v1(rows, {t: versions.select("version_dir", F.explode(c).alias("value")) for t, c in V1_VALUES.items()}, now, base)
    latest = rollup.latest_version(versions.select("package_id", "version_dir", "package_version", "channel", "package_name", "moniker"))
    named = latest.withColumn("name", F.coalesce(F.nullif("package_name", F.lit("")), "package_id")).drop("package_name")
    return index.build_index_v2(named, {t: versions.select("package_id", F.explode(c).alias("value")) for t, c in V2_VALUES.items()}, versions.select("package_id"), now, base)


INDEX_PACKAGES = "package_id string, version_dir string, package_version string, channel string, name string, moniker string, package long"


def full_index(versions: DataFrame, fmt: int, base: int) -> tuple[dict[str, DataFrame], dict]:
    """(state tables, meta) of a whole index; of format 2 with counts and the next ids, by which later builds keep it up to date."""
    made = index_tables(versions, fmt, base=base)
    tables = {f"index_{n}": df for n, df in made.items()}
    if fmt != 2:
        return tables, {"index": None}
    names = [f"{n}2" for n in index.V2_MAPPED]
    tables |= {f"index_{n}": index.counted(made[n], made[f"{n}_map"]) for n in names}
    tops = {n: made[n].agg(F.max("id")).first()[0] or 0 for n in names}
    packages, top = made["packages"].agg(F.count(F.lit(1)), F.max("package")).first()
    return tables, {"index": {"next": {n: t + 1 for n, t in tops.items()} | {"packages": (top or 0) + 1}, "packages": packages}}


def index_deltas(store: st.StateStore, work: Work, after: DataFrame, touched: DataFrame, moved: DataFrame, base: int) -> tuple[dict, dict, dict]:
    """(deltas, tables, meta): what changes in the index when some packages have the versions ``after`` and have gained and
    lost values (``moved``); the rest of it is not read but for its dictionaries."""
    spark, state = work.spark, store.get_meta("index")
    following, buckets = dict(state["next"]), store.buckets_of(touched, "package_id")
    held = work.table(store.read("index_packages", INDEX_PACKAGES, buckets).join(touched, "package_id", "left_semi"), "index-held")
    fresh = work.table(index.dictionary(after.select("package_id").distinct().join(held.select("package_id"), "package_id", "left_anti"), "package_id").withColumn("package", F.col("id") + F.lit(following["packages"] - 1)).drop("id"), "index-fresh")
    added = fresh.count()
    following["packages"] += added
    owners = held.select("package_id", "package").unionByName(fresh)
    named = index_tables(after, 2)  # names and latest versions of these packages only
    rows = named["packages"].drop("package").join(owners, "package_id")
    lost = held.join(after.select("package_id").distinct(), "package_id", "left_anti")
    deltas = {"index_packages": (rows.select(*[c.split()[0] for c in INDEX_PACKAGES.split(", ")]), lost)}
    shifts = work.table(moved.where("sign <> 0").join(owners, "package_id").select("attribute", "package", "value", "sign"), "index-pairs")
    shifted = {r["attribute"] for r in shifts.select("attribute").distinct().collect()}  # names of attributes
    for name in [n for n in V2_VALUES if n in shifted]:
        changes = shifts.where(F.col("attribute") == name).drop("attribute")
        if name in index.V2_MAPPED:
            made = {k: work.table(df, f"index-{name}-{k}") for k, df in index.update_words(store.read(f"index_{name}2", "value string, id long, n long"), changes, following[f"{name}2"]).items()}
            following[f"{name}2"] += made["fresh"].count()
            deltas |= {f"index_{name}2": (made["words"], made["words_gone"]), f"index_{name}2_map": (made["bridge"], made["bridge_gone"])}
        else:
            deltas[f"index_{name}2"] = tuple(changes.where(f"sign = {sign}").select("value", "package") for sign in (1, -1))
    packages = state["packages"] + added - lost.count()
    metadata = spark.createDataFrame([("majorVersion", "2"), ("lastWriteTime", "0"), ("trackingBase", str(max(0, base))), ("rows", str(packages))], "name string, value string")
    return deltas, {"index_metadata": metadata}, {"index": {"next": following, "packages": packages}}


def pending_diff(spark: SparkSession, cfg: BuildConfig) -> dict:
    """What a build would do: added, updated, removed, revalidations.  The state is not touched."""
    store = st.StateStore(spark, cfg.state, cfg.buckets)
    work = Work(spark, store)
    try:
        scan = scan_changes(spark, cfg, store, work)
        if scan["groups"].isEmpty():
            return {"added": 0, "updated": 0, "removed": 0, "revalidations": 0}
        plan = plan_build(spark, cfg, store, work, scan)
        return diff.diff_summary(plan["changes"], plan["queue"]).first().asDict()
    finally:
        work.drop()


def incremental_build(spark: SparkSession, cfg: BuildConfig) -> dict:
    """Run a build; returns its counts, its number and its status (``dry-run``, ``staged``, ``staged_reused``)."""
    store = st.StateStore(spark, cfg.state, cfg.buckets)
    if cfg.dry_run:
        return pending_diff(spark, cfg) | {"status": "dry-run"}
    work = Work(spark, store)
    build = store.begin()
    try:
        if store.get_meta("format", cfg.index_format) != cfg.index_format:  # another format: everything is built again
            cfg = BuildConfig(**{**cfg.__dict__, "force": True})
        first = not store.current()["tables"]
        scan = scan_changes(spark, cfg, store, work)
        summary = {"added": 0, "updated": 0, "removed": 0, "revalidations": 0}
        if not first and not cfg.force and scan["groups"].isEmpty():
            store.close("staged_reused")
            return summary | {"build": build, "status": "staged_reused"}
        plan = plan_build(spark, cfg, store, work, scan)
        if not cfg.quarantine and (bad := plan["violations"].limit(5).collect()):
            raise ValueError("; ".join(f"{r.version_dir}: {r.rule}" for r in bad))
        whole = first or cfg.force
        summarise = lambda: diff.diff_summary(plan["changes"], plan["queue"]).first().asDict()
        summary = {} if whole else summarise()
        if not whole and not any(summary.values()):
            store.commit({}, "staged_reused", deltas=plan["file_deltas"]())
            return summary | {"build": build, "status": "staged_reused"}
        moved = None if whole else plan["moved"]()
        made = together(spark, [
            lambda: st.write_changes(plan["changes"], f"{store.root}/changes", build),
            lambda: st.write_queue(plan["queue"], f"{store.root}/snapshots/{build:08d}/queue", "version_dir", "child_sha"),
            plan["tables"] if whole else plan["deltas"],
            lambda: moved if moved is None else work.table(moved, "moved-values"),
            summarise if whole else lambda: summary,
        ])
        tables, deltas, moved, meta, summary = made[2] if whole else {}, {} if whole else made[2], made[3], {}, made[4]
        touched = {n: None if first else b for n, b in plan["buckets"].items()}
        if moved is not None:
            deltas["values"] = (moved.where("n > 0").drop("sign"), moved.where("n = 0"))
        everything = lambda: store.read("versions", VERSIONS, [k for k in range(store.buckets) if k not in plan["buckets"]["versions"]]).unionByName(plan["versions"])
        if not first and moved is None:  # forced, or a state without the table
            tables["values"], touched["values"] = counted.count_holdings(counted.holdings(everything(), V2_VALUES)), None
        if cfg.index_format == 2 and store.get_meta("index") and moved is not None:
            after = plan["versions"].join(plan["touched"], "package_id", "left_semi")
            more, small, meta = index_deltas(store, work, after, plan["touched"], moved, build)
            deltas |= more
            tables |= small
        elif cfg.index_format:
            whole_index, meta = full_index(everything(), cfg.index_format, build)
            tables |= whole_index
        store.commit(tables, "staged", touched, deltas, staged=build, format=cfg.index_format, **meta)
        return summary | {"build": build, "status": "staged"}
    except Exception as e:
        store.fail(str(e))
        raise
    finally:
        work.drop()


def apply_targets(spark: SparkSession, cfg: BuildConfig, targets: dict, remove: bool = False) -> dict:
    """Add or remove some groups only; targets that match nothing do nothing."""
    return incremental_build(spark, BuildConfig(**{**cfg.__dict__, "targets": targets, "remove": remove}))


def _catalogue(packages: DataFrame) -> DataFrame:
    """relpath, body: the catalogue file, a list of hashes over parts of the packages, so that no task gathers them all."""
    part = F.pmod(F.xxhash64("package_id"), F.lit(CATALOGUE_PARTS))
    line = F.concat_ws("|", "package_id", "package_sha")
    parts = packages.groupBy(part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha"))
    listed = F.array_sort(F.collect_list(F.struct("part", "sha")))
    return parts.agg(F.to_json(listed).alias("body")).select(F.lit("catalog.idx").alias("relpath"), "body")  # CATALOGUE_PARTS hashes at most


def _bodies(versions: DataFrame, packages: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """relpath, body of records, sidecars and the catalogue, or of those whose path is in ``touched``."""
    only = lambda df: df if touched is None else df.join(touched.select("relpath"), "relpath", "left_semi")
    side = only(packages.select("package_id", "relpath"))
    data = rollup.version_data(versions, None if touched is None else side).select("package_id", F.to_json("versions").alias("body"))
    return only(versions.select("relpath", F.col("record").alias("body"))).unionByName(side.join(data, "package_id").select("relpath", "body")).unionByName(only(_catalogue(packages)))


def _begins(store: st.StateStore, site: Site) -> dict | None:
    """What the site holds: by its pointer, or by the state if a publishing died after its commit and before it has pointed."""
    now, told = site.pointer(), store.get_meta("site")
    if now and told and told["target"] == site.target and told["after"] == now["number"]:
        return told
    return now


def published_files(spark: SparkSession, target: str, begins: dict | None = None) -> DataFrame:
    """relpath, sha256 of the bodies that are really there."""
    return Site(spark, target).rows(begins and begins["begins"]).select("relpath", F.sha2("body", 256).alias("sha256"))


def verify_published(spark: SparkSession, cfg: BuildConfig, target: str) -> DataFrame:
    """relpath, drift_kind: published files that are missing, changed or not tracked."""
    store = st.StateStore(spark, cfg.state, cfg.buckets)
    return inventory.drift(store.read("published", PUBLISHED), published_files(spark, target, _begins(store, Site(spark, target))))


def verify_build(spark: SparkSession, cfg: BuildConfig, build_id: int | None = None) -> DataFrame:
    """relpath, drift_kind: where the state of the current or a chosen build contradicts itself; nothing is changed.

    All records are hashed and all packages rolled up again.  ``mismatched``: a record's text has another hash than noted, a
    null text included; ``missing``: a package's file is noted that does not follow from its versions; ``extra``: one that
    follows is not noted.  A sound build gives no rows; one that was never staged is an error.
    """
    wanted, _, versions, packages = plan_publish(spark, cfg, build_id)
    again = _packages(versions)
    bodies = versions.select("relpath", F.sha2("record", 256).alias("sha256"))
    catalogue = _catalogue(packages).select("relpath", F.sha2("body", 256).alias("sha256"))
    return inventory.drift(wanted, inventory.published_inventory(bodies, again.select("relpath", "sha256"), catalogue))


def package_files(spark: SparkSession, cfg: BuildConfig, packages: DataFrame, build_id: int | None = None) -> DataFrame:
    """package_id, version_dir, package_version, channel, relpath, files (path, sha256; in order of path) of some packages.

    Only the buckets of these packages and of their groups are read.  Packages that are null, unknown or named twice add
    no rows; a version without tracked files has an empty list.
    """
    store = st.StateStore(spark, cfg.state, cfg.buckets)
    tables = None if build_id is None else store.tables_of(build_id)
    wanted = packages.select("package_id").where("package_id IS NOT NULL").distinct()
    columns = ["package_id", "version_dir", "package_version", "channel", "relpath"]
    mine = store.read("versions", VERSIONS, store.buckets_of(wanted, "package_id"), tables=tables).join(wanted, "package_id", "left_semi").select(*columns)
    tracked = store.read("files", FILES, store.buckets_of(mine.select("version_dir"), "version_dir"), tables=tables)
    files = F.array_sort(F.collect_list(F.struct("path", F.col("raw_sha256").alias("sha256"))))
    held = tracked.join(mine.select("version_dir"), "version_dir", "left_semi").groupBy("version_dir").agg(files.alias("files"))
    none = F.array().cast("array<struct<path:string,sha256:string>>")
    return mine.join(held, "version_dir", "left").select(*columns, F.coalesce("files", none).alias("files"))


def package_rollups(spark: SparkSession, cfg: BuildConfig, packages: DataFrame, build_id: int | None = None) -> DataFrame:
    """package_id, version_dir, package_version, channel of the latest version of some packages, and all values that any of
    their versions holds, a sorted array for each attribute.

    Only the buckets of these packages are read, values from their counts.  Packages that are null, unknown or named twice
    add no rows.
    """
    store = st.StateStore(spark, cfg.state, cfg.buckets)
    tables = None if build_id is None else store.tables_of(build_id)
    wanted = packages.select("package_id").where("package_id IS NOT NULL").distinct()
    buckets = store.buckets_of(wanted, "package_id")
    columns = ["package_id", "version_dir", "package_version", "channel"]
    latest = rollup.latest_version(store.read("versions", VERSIONS, buckets, tables=tables).select(*columns).join(wanted, "package_id", "left_semi"))
    names = [*V2_VALUES]
    values = counted.rollup_counted(store.read("values", VALUES, buckets, tables=tables).join(wanted, "package_id", "left_semi"), names)
    return latest.join(values, "package_id", "left").withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in names})


def plan_publish(spark: SparkSession, cfg: BuildConfig, build_id: int | None = None, work: Work | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(wanted, actions, versions, packages) for publishing the current or a chosen build; with ``work`` the first two as tables."""
    store = st.StateStore(spark, cfg.state, cfg.buckets)
    tables = None if build_id is None else store.tables_of(build_id)
    versions, packages = store.read("versions", VERSIONS, tables=tables), store.read("packages", PACKAGES, tables=tables)
    catalogue = _catalogue(packages).select("relpath", F.sha2("body", 256).alias("sha256"))
    wanted = inventory.published_inventory(versions.select("relpath", F.col("content_sha").alias("sha256")), packages.select("relpath", "sha256"), catalogue)
    if work:
        wanted = work.table(wanted.hint("rebalance"), "wanted")  # in no order
    actions = inventory.plan_publish(wanted, store.read("published", PUBLISHED))
    return wanted, work.table(actions, "actions") if work else actions, versions, packages


def _finish(store: st.StateStore, site: Site) -> None:
    """Complete a publishing that died after its commit: point to what it has committed."""
    told = _begins(store, site)
    if told and "after" in told:
        site.point(told["name"], told["begins"], told["after"])


def publish(
    spark: SparkSession, cfg: BuildConfig, target: str, force: bool = False, dry_run: bool = False, build_id: int | None = None, on_step: Callable[[str], None] = lambda step: None
) -> dict:
    """Publish a build's records and sidecars at ``target`` (a table in buckets), unless what is there drifted from what is tracked.

    Only buckets with files to copy or delete are written again.  Files are added beside the old ones, the state commits
    what is tracked and where it is, the site's pointer follows, and the old files go last: whenever this dies, readers of
    the site see the old one or the new one, nothing has drifted, and the next publishing completes or clears what is left.
    ``on_step`` is called after each step.
    """
    store, site = st.StateStore(spark, cfg.state, cfg.buckets), Site(spark, target)
    off = verify_published(spark, cfg, target).groupBy("drift_kind").count().collect()
    if off and not force:
        raise ValueError("published files drifted: " + ", ".join(f"{r['count']} {r.drift_kind}" for r in off))
    work = Work(spark, store)
    try:
        wanted, actions, versions, packages = plan_publish(spark, cfg, build_id, work)
        if off:  # whatever is there, all files are written again
            actions = wanted.select("relpath", F.lit("copy").alias("action")).unionByName(actions.where("action = 'delete'"))
        counts = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}
        if dry_run:
            return counts | {"status": "dry-run"}
        return counts | _published(spark, cfg, store, site, work, (wanted, actions, versions, packages), bool(off), build_id, on_step)
    finally:
        work.drop()


def _published(
    spark: SparkSession, cfg: BuildConfig, store: st.StateStore, site: Site, work: Work, plan: tuple[DataFrame, DataFrame, DataFrame, DataFrame], off: bool, build_id: int | None, on_step: Callable[[str], None]
) -> dict:
    """Carry out what ``publish`` has planned."""
    wanted, actions, versions, packages = plan
    build = store.begin()
    try:
        _finish(store, site)
        held = site.adopt()
        site.sweep()
        on_step("began")
        buckets = store.buckets_of(actions, "relpath")
        bodies = _bodies(versions, packages, actions.where("action = 'copy'"))
        rows = bodies.join(wanted.select("relpath", "kind"), "relpath").select("relpath", "kind", "body")
        if not off:
            there = site.rows(held["begins"]).where(F.col("bucket").isin(buckets)).select("relpath", "kind", "body")
            rows = rows.unionByName(there.join(actions.select("relpath"), "relpath", "left_anti"))
        name = f"site-{build:08d}-{uuid.uuid4().hex[:8]}"
        added = site.add(rows.withColumn("bucket", store.bucket("relpath")), name, on_step)
        begins = ({} if off else {k: b for k, b in held["begins"].items() if int(k) not in buckets}) | added
        on_step("moved")
        told = {"target": site.target, "name": name, "begins": begins, "after": held["number"]}
        store.commit({"published": wanted}, "published", {"published": buckets}, published=build if build_id is None else build_id, site=told)
        on_step("committed")
        site.point(name, begins, held["number"])
        on_step("pointed")
        site.sweep()
        on_step("swept")
        return {"status": "published"}
    except Exception as e:
        store.fail(str(e))
        raise


def clear_published(spark: SparkSession, cfg: BuildConfig) -> None:
    """Forget what is tracked as published."""
    store = st.StateStore(spark, cfg.state, cfg.buckets)
    store.begin()
    try:
        store.commit({"published": spark.createDataFrame([], PUBLISHED)}, "published", published=None)
    except Exception as e:
        store.fail(str(e))
        raise


def clean(spark: SparkSession, cfg: BuildConfig, keep_last: int, older_than: str | None = None, dry_run: bool = False) -> dict:
    """Forget all but the newest builds (with ``older_than``, as ``30d``, only those that ended before), free what only they needed.

    The current and the published build stay whatever their age.
    """
    store = st.StateStore(spark, cfg.state, cfg.buckets)
    cutoff = None if older_than is None else lookup.age_cutoff(int(time.time()), older_than)
    return store.prune(lookup.prune_builds(store.builds(), keep_last, cutoff), dry_run)
