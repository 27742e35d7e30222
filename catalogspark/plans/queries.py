"""One registered query for each operator of the catalogue, on views over the given tables, with DuckDB's SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions import normalize as nz
from catalogspark.functions.version import version_key, version_parts
from catalogspark.operators import conflicts, counted, diff, index, inventory, lookup, records, rollup
from catalogspark.plans.fixtures import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str, sql: str | None):
    """Register a function of the named views; ``sql`` reads the same views."""
    names = views.split()

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, n) for n in names))
        if sql is not None:
            ORACLE[name] = duck(names, sql)
        return fn

    return register


def sql_on(name: str, views: str, sql: str) -> None:
    ORACLE[name] = duck(views.split(), sql)


NUM = "list_transform(string_split(package_version, '.'), lambda x: x::bigint)"
ORDER = f"channel, {NUM} desc, version_dir"
LATEST = f"select * exclude (rn) from (select *, row_number() over (partition by package_id order by {ORDER}) rn from ver_now) where rn = 1"
DIFF = """select coalesce(n.version_dir, o.version_dir) version_dir, case when o.version_dir is null then 'add' when n.version_dir is null then 'remove'
 when n.content_sha = o.content_sha then 'noop' else 'update' end change_kind, n.content_sha new_content_sha, o.content_sha old_content_sha from ver_now n full join ver_prev o on n.version_dir = o.version_dir"""
DIRTY = """select distinct unnest(list_filter([n.version_dir, p.version_dir], lambda x: x is not null)) version_dir from files_now n full join files_prev p on n.path = p.path
 where n.raw_sha256 is distinct from p.raw_sha256 or n.version_dir is distinct from p.version_dir"""
PSHA = """select package_id, sha256(string_agg(concat_ws('|', package_version, channel, content_sha), chr(10) order by {o})) package_sha from {t} group by package_id"""


def _hash(t: str) -> str:
    return PSHA.format(t=t, o=ORDER)


def _diff(now: DataFrame, prev: DataFrame) -> DataFrame:
    return diff.diff_records(now, prev, "version_dir", ["content_sha"])


# versions and windows
@query("o1_version_key", "ver_now", f"select version_dir, row_number() over (partition by package_id order by {NUM} desc, version_dir) nth from ver_now")
def _(v):
    from pyspark.sql import Window

    order = Window.partitionBy("package_id").orderBy(F.desc("k"), "version_dir")
    return v.withColumn("k", version_key(F.col("package_version"))).select("version_dir", F.row_number().over(order).cast("long").alias("nth"))


@query("f8_version_parts", "ver_now", f"select version_dir, {NUM}[1] major, {NUM}[2] minor, {NUM}[3] patch from ver_now")
def _(v):
    num = lambda i: F.coalesce(F.nullif(F.get(version_parts(F.col("package_version")), i)["number"], F.lit("")), F.lit("0")).cast("long")
    return v.select("version_dir", num(0).alias("major"), num(1).alias("minor"), num(2).alias("patch"))


query("w1_latest_version", "ver_now", LATEST)(rollup.latest_version)
query("w2_rank_versions", "ver_now", f"select *, row_number() over (partition by package_id order by {ORDER}) ordinal from ver_now")(rollup.rank_versions)
query("a1_version_counts", "ver_now", "select package_id, count(*) version_count from ver_now group by 1")(rollup.version_counts)

# change detection
REUSE = "select n.path, n.version_dir, n.size, n.mtime, case when p.size = n.size and p.mtime = n.mtime then p.raw_sha256 else n.raw_sha256 end raw_sha256, coalesce(p.size = n.size and p.mtime = n.mtime, false) reused from files_now n left join files_prev p on n.path = p.path"
query("j1_fill_hashes", "files_now files_prev", REUSE)(diff.fill_hashes)
query("j2_dirty_groups", "files_now files_prev", DIRTY)(diff.dirty_groups)
query("j3_diff_records", "ver_now ver_prev", DIFF)(_diff)
query("j4_added_children", "child_now child_prev", "select version_dir, child_sha from child_now except select version_dir, child_sha from child_prev")(lambda n, o: diff.added_children(n, o, "version_dir", "child_sha"))
query(
    "j4_children_changed",
    "child_now child_prev",
    """select version_dir, count(*) filter (where o is null) added, count(*) filter (where o is null) > 0 or count(n) <> count(o) changed from (
 select coalesce(a.version_dir, b.version_dir) version_dir, a.child_sha n, b.child_sha o from child_now a full join child_prev b on a.version_dir = b.version_dir and a.child_sha = b.child_sha) group by 1 having count(n) > 0 and count(o) > 0""",
)(lambda n, o: diff.children_changed(n, o, "version_dir", "child_sha"))
DIRTY_VERSIONS = f"select version_dir from ({DIFF}) where change_kind <> 'noop'"
TOUCHED = f"select distinct package_id from (select package_id, version_dir from ver_now union all select package_id, version_dir from ver_prev) where version_dir in ({DIRTY_VERSIONS})"


def _dirty_versions(n, o):
    return _diff(n, o).where("change_kind <> 'noop'").select("version_dir")


query("j5_touched_packages", "ver_now ver_prev", TOUCHED)(lambda n, o: diff.touched_packages(_dirty_versions(n, o), n, o))
query("j6_expand_siblings", "ver_now ver_prev", f"select package_id, version_dir, package_version, channel, content_sha from ver_now where package_id in ({TOUCHED}) and version_dir not in ({DIRTY_VERSIONS})")(
    lambda n, o: diff.expand_siblings(diff.touched_packages(_dirty_versions(n, o), n, o), n, _dirty_versions(n, o))
)
query("j9_needs_backfill", "ver_now ver_prev", "select distinct version_dir from ver_prev where channel = 'beta' and version_dir in (select version_dir from ver_now)")(
    lambda n, o: diff.needs_backfill(n, o.withColumn("projection", F.when(F.col("channel") != "beta", F.col("content_sha"))), ["projection"])
)
query("u1_groups_to_refresh", "files_now files_prev", f"select version_dir from ({DIRTY}) union select version_dir from files_now")(lambda n, o: diff.groups_to_refresh(diff.dirty_groups(n, o), n, True))
query("u2_union_groups", "ver_now ver_prev", f"select version_dir from ({DIRTY_VERSIONS}) union select version_dir from ver_now where channel = 'beta'")(
    lambda n, o: diff.groups_to_refresh(_dirty_versions(n, o), n.where("channel = 'beta'"), True)
)
query("u3_still_present", "files_now files_prev", f"select version_dir from ({DIRTY}) intersect select version_dir from files_now")(lambda n, o: diff.still_present(diff.dirty_groups(n, o), n))
query("u4_apply_changes", "ver_now ver_prev", f"select * from ver_prev where version_dir not in ({DIRTY_VERSIONS}) union all select * from ver_now where version_dir in ({DIRTY_VERSIONS})")(lambda n, o: _applied(n, o))


def _applied(n, o):
    dirty = _dirty_versions(n, o)
    return diff.apply_changes(o, n.join(dirty, "version_dir", "left_semi"), dirty)


QUEUE = """select c.version_dir, c.child_sha, case when b.version_dir is null then 'added' else 'installer-changed' end reason from child_now c
 left join (select distinct version_dir from child_prev) b on b.version_dir = c.version_dir left join child_prev p on p.version_dir = c.version_dir and p.child_sha = c.child_sha where p.child_sha is null"""


def _queue(n, o):
    n, o = (c.where("version_dir IS NOT NULL") for c in (n, o))  # as the joins ask for: so hashes and queue read the same shuffles
    return diff.validation_queue(diff.diff_records(records.children_hash(n), records.children_hash(o), "version_dir", ["children_sha"]), n, o)


query("b7_validation_queue", "child_now child_prev", QUEUE)(_queue)
query("o2_queue_order", "child_now child_prev", QUEUE)(lambda n, o: diff.queue_order(_queue(n, o), "version_dir", "child_sha"))
query(
    "a4_diff_summary",
    "ver_now ver_prev child_now child_prev",
    f"select count(*) filter (where change_kind = 'add') added, count(*) filter (where change_kind = 'update') updated, count(*) filter (where change_kind = 'remove') removed, (select count(*) from ({QUEUE})) revalidations from ({DIFF})",
)(lambda n, o, cn, co: diff.diff_summary(_diff(n, o), _queue(cn, co)))
query("a9_children_hash", "child_now", "select version_dir, sha256(string_agg(distinct child_sha, '' order by child_sha)) children_sha from child_now group by 1")(records.children_hash)

# rollups
query("a2_rollup_packages", "ver_now attrs", f"""select l.*, {', '.join(f"coalesce((select list_sort(list(distinct {c})) from attrs a where a.package_id = l.package_id), []) {c}s" for c in ('brand', 'type', 'name'))} from ({LATEST}) l""")(
    lambda v, a: rollup.rollup_packages(v, {f"{c}s": a.select("package_id", F.col(c).alias("value")) for c in ("brand", "type", "name")})
)


def _held(attrs: DataFrame) -> DataFrame:
    """Holdings out of rows with a value of each attribute.

    Rows are dealt by package once; grouping by package and more needs no other shuffle, so what follows counts where they are.
    """
    listed = attrs.repartition("package_id").groupBy("package_id", "version_dir").agg(*(F.collect_set(c).alias(c) for c in ("brand", "type", "name")))
    return counted.holdings(listed, {c: c for c in ("brand", "type", "name")})


def _moved(now: DataFrame, prev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts of the earlier rows, what moves in them when the versions become the later ones)."""
    counts = counted.count_holdings(_held(prev))
    return counts, counted.moved_counts(counts, counted.count_changes(_held(prev), _held(now)))


def _counted(now: DataFrame, prev: DataFrame) -> DataFrame:
    """The counts of the earlier rows, brought to the later ones."""
    held = _held(prev)
    return counted.apply_changes(counted.count_holdings(held), counted.count_changes(held, _held(now)))


LONG = "select package_id, version_dir, unnest([{{'a': 'brand', 'v': brand}}, {{'a': 'type', 'v': type}}, {{'a': 'name', 'v': name}}], recursive := true) from {t}"
COUNTS = "select package_id, a attribute, v \"value\", count(distinct version_dir) n from ({l}) where v is not null group by all"
NOW_COUNTS, PREV_COUNTS = (COUNTS.format(l=LONG.format(t=t)) for t in ("attrs", "attrs_prev"))
HELD_ROWS = "attrs_rows attrs_prev_rows"  # made distinct where they are gathered
sql_on("u4_value_counts_updated", "attrs attrs_prev", NOW_COUNTS)
query("u4_value_counts_updated", HELD_ROWS, None)(lambda n, o: counted.apply_moved(*_moved(n, o)))
sql_on("a2_moved_values", "attrs attrs_prev", f"""select coalesce(n.package_id, o.package_id) package_id, coalesce(n.attribute, o.attribute) attribute, coalesce(n.value, o.value) "value", coalesce(n.n, 0) n,
 case when o.n is null then 1 when n.n is null then -1 else 0 end sign from ({NOW_COUNTS}) n full join ({PREV_COUNTS}) o on n.package_id = o.package_id and n.attribute = o.attribute and n.value = o.value
 where n.n is distinct from o.n""")
query("a2_moved_values", HELD_ROWS, None)(lambda n, o: _moved(n, o)[1])
sql_on("a2_rollup_counted", "attrs attrs_prev", f"""select package_id, {', '.join(f"list_sort(list(distinct {c})) {c}" for c in ('brand', 'type', 'name'))} from attrs group by 1""")
query("a2_rollup_counted", HELD_ROWS, None)(lambda n, o: counted.rollup_counted(_counted(n, o), ["brand", "type", "name"]))
query("a7_package_hash", "ver_now", _hash("ver_now"))(rollup.package_hash)
query("s10_version_data", "ver_now ver_prev", f"""select package_id, list({{'ordinal': ordinal, 'package_version': package_version, 'channel': channel, 'version_dir': version_dir, 'content_sha': content_sha}} order by ordinal) versions
 from (select *, row_number() over (partition by package_id order by {ORDER}) ordinal from ver_now where package_id in ({TOUCHED})) group by 1""")(
    lambda n, o: rollup.version_data(n, diff.touched_packages(_dirty_versions(n, o), n, o))
)
query("j7_package_artifacts", "ver_now", f"select package_id, package_sha, package_id like '%7' carried from ({_hash('ver_now')})")(
    lambda v: rollup.package_artifacts(rollup.package_hash(v).where("package_id NOT LIKE '%7'"), rollup.package_hash(v), v)
)
query(
    "a5_package_changes",
    "ver_now ver_prev",
    f"""select coalesce(n.package_id, o.package_id) package_id, case when o.package_id is null then 'add' when n.package_id is null then 'remove' when n.package_sha = o.package_sha then 'noop' else 'update' end change_kind,
 o.package_sha old_hash, n.package_sha new_hash, n.package_sha is distinct from o.package_sha publish_changed, coalesce(n.package_id, o.package_id) like '%3' revalidate from ({_hash('ver_now')}) n full join ({_hash('ver_prev')}) o on n.package_id = o.package_id""",
)(lambda n, o: rollup.package_changes(rollup.package_hash(n), rollup.package_hash(o), n.where("package_id LIKE '%3'").unionByName(o.where("package_id LIKE '%3'"))))
query("j13_flag_queue", "ver_now", "select package_id, package_id in (select package_id from ver_now where channel = 'beta') revalidate from ver_now group by package_id")(
    lambda v: rollup.flag_queue(v.select("package_id").distinct(), v.where("channel = 'beta'"))
)

# conflicts
CLAIMED = "select package_id, value, count(*) claimants from claims group by 1, 2 having count(*) > 1"
KEY = f"{{'v': {NUM}, 'c': channel, 'd': version_dir}}"
LABEL = "case when channel = '' then package_version else package_version || ' [' || channel || ']' end"
WON = f"select *, row_number() over (partition by package_id, value order by {NUM} {{d}}, channel {{d}}, version_dir {{d}}) rn, count(*) over (partition by package_id, value) n from claims"


def _distinct_claims(rows: DataFrame) -> DataFrame:
    """Distinct rows, dealt as conflicts are found: Spark then shuffles them once for both."""
    return rows.repartition("package_id", "value").distinct()


query("a3_find_conflicts", "claims", CLAIMED)(conflicts.find_conflicts)
for _name, _d, _keep in (("latest", "desc", "n = 1 or rn = 1"), ("oldest", "", "n = 1 or rn = 1"), ("strip-all", "", "n = 1")):
    query(f"w4_resolve_{_name.replace('-', '_')}", "claims_rows", None)(lambda c, s=_name: conflicts.resolve_conflicts(_distinct_claims(c), s))
    sql_on(f"w4_resolve_{_name.replace('-', '_')}", "claims", f"select package_id, value, version_dir, package_version, channel from ({WON.format(d=_d)}) where {_keep}")
query("w3_conflict_winners", "claims", f"select package_id, value, n claimants, {{'version_dir': version_dir, 'package_version': package_version, 'channel': channel}} keeper from ({WON.format(d='desc')}) where n > 1 and rn = 1")(lambda c: conflicts.winners(c, "latest"))
query("w5_conflict_report", "claims", f"select package_id, value, max(case when rn = 1 then {LABEL} end) retained, string_agg(case when rn > 1 then {LABEL} end, ', ' order by {LABEL}) stripped from ({WON.format(d='desc')}) where n > 1 group by 1, 2")(conflicts.conflict_report)

# index tables
IDS = "select {c}, row_number() over (order by {c}) id from (select distinct {c} from {t})"
query("x1_dictionary", "attrs", IDS.format(c="name", t="attrs"))(lambda a: index.dictionary(a, "name"))
query("x2_map_table", "attrs", f"select distinct package_id, id from attrs join ({IDS.format(c='brand', t='attrs')}) using (brand)")(lambda a: index.map_table(a, "package_id", "brand", index.dictionary(a, "brand")))
query("x3_inverted_table", "attrs", "select distinct type, package_id from attrs")(lambda a: index.inverted_table(a, "package_id", "type"))
TREE = f"with recursive p as (select distinct array_to_string(s[1:n], '/') path from (select string_split(path, '/') s, unnest(range(1, len(string_split(path, '/')) + 1)) n from paths)), i as ({IDS.format(c='path', t='p')})"
sql_on("x4_path_tree", "paths", f"select a.id, b.id parent, string_split(a.path, '/')[-1] name, a.path from ({TREE} select * from i) a left join ({TREE} select * from i) b on b.path = array_to_string(string_split(a.path, '/')[1:-2], '/') and contains(a.path, '/')")
QUERIES["x4_path_tree"] = lambda spark, sf_dir: index.path_tree(view(spark, sf_dir, "paths"), "path")
query(
    "x5_fact_table",
    "ver_now",
    f"""select version_dir, row_number() over (partition by package_id order by {ORDER}) ordinal, p.id package_id_ref, v.id package_version_ref, c.id channel_ref from ver_now
 join ({IDS.format(c='package_id', t='ver_now')}) p using (package_id) join ({IDS.format(c='package_version', t='ver_now')}) v using (package_version) join ({IDS.format(c='channel', t='ver_now')}) c using (channel)""",
)(lambda v: index.fact_table(v, {c: index.dictionary(v, c) for c in ("package_id", "package_version", "channel")}))
query("x6_metadata_rows", "ver_now", "select version_dir, 5 kind, content_sha \"value\" from ver_now union all select version_dir, 6, channel from ver_now where channel <> ''")(
    lambda v: index.metadata_rows(v.withColumn("channel", F.nullif("channel", F.lit(""))), "version_dir", {5: "content_sha", 6: "channel"})
)
query("x7_owner_ids", "ver_now", IDS.format(c="package_id", t="ver_now"))(lambda v: index.dictionary(v, "package_id"))
query("j14_index_lookup", "attrs", "select distinct brand, package_id from attrs")(lambda a: index.index_lookup(d := index.dictionary(a, "brand"), index.map_table(a, "package_id", "brand", d), "brand", "package_id"))


#: What each index table holds: an expression of its own, the same in both engines.
INDEXED = {"tags": "brand", "commands": "type", "pfns": "brand || '_' || type", "productcodes": "name", "upgradecodes": "upper(type)", "norm_names": "lower(name)", "norm_publishers": "lower(brand)"}


def _v2(v, a):
    return index.build_index_v2(rollup.latest_version(v), {t: a.select("package_id", F.expr(e).alias("value")) for t, e in INDEXED.items()}, v.select("package_id"), 1700000000)


OWNERS = f"({IDS.format(c='package_id', t='ver_now')}) o"
query("s11_index_v2_packages", "ver_now attrs", f"select package_id, id package, package_version, channel, version_dir, content_sha from ({LATEST}) join {OWNERS} using (package_id)")(lambda v, a: _v2(v, a)["packages"])
query("s11_index_v2_metadata", "ver_now attrs", "select unnest(['majorVersion', 'lastWriteTime', 'trackingBase', 'rows']) name, unnest(['2', '1700000000', '0', (select count(distinct package_id) from ver_now)::varchar]) \"value\"")(lambda v, a: _v2(v, a)["metadata"])
for _t, _c in (("tags", "brand"), ("commands", "type")):
    query(f"s11_index_v2_{_t}", "ver_now attrs", IDS.format(c=_c, t="attrs").replace(f"select {_c},", f'select {_c} "value",', 1))(lambda v, a, t=_t: _v2(v, a)[f"{t}2"])
    query(f"s11_index_v2_{_t}_map", "ver_now attrs", f"select distinct o.id package, d.id from attrs join {OWNERS} using (package_id) join ({IDS.format(c=_c, t='attrs')}) d using ({_c})")(lambda v, a, t=_t: _v2(v, a)[f"{t}2_map"])
for _t in index.V2_DIRECT:
    query(f"s11_index_v2_{_t}", "ver_now attrs", f"select distinct {INDEXED[_t]} \"value\", o.id package from attrs join {OWNERS} using (package_id)")(lambda v, a, t=_t: _v2(v, a)[f"{t}2"])


def _v1(v, a):
    rows = v.withColumns({"name": F.when(F.col("channel") == "", F.col("package_version")), "moniker": F.nullif("channel", F.lit("")), "publisher": F.nullif("channel", F.lit("")), "path": F.col("version_dir")})
    return index.build_index_v1(rows, {t: a.select("version_dir", F.expr(INDEXED[t]).alias("value")) for t in index.V1_MAPPED}, 1700000000)


V1_COLUMN = {"ids": ("package_id", "package_id"), "names": ("name", "case when channel = '' then package_version else package_id end"), "monikers": ("moniker", "nullif(channel, '')"), "versions": ("package_version", "package_version"), "channels": ("channel", "channel")}
for _t, (_c, _e) in V1_COLUMN.items():
    query(f"s12_index_v1_{_t}", "ver_now attrs", f"select {_c}, row_number() over (order by {_c}) id from (select distinct {_e} {_c} from ver_now) where {_c} is not null")(lambda v, a, t=_t: _v1(v, a)[t])
for _t in index.V1_MAPPED:
    _words = f"(select v \"value\", row_number() over (order by v) id from (select distinct {INDEXED[_t]} v from attrs) where v is not null)"
    query(f"s12_index_v1_{_t}", "ver_now attrs", f"select * from {_words}")(lambda v, a, t=_t: _v1(v, a)[t])
    query(f"s12_index_v1_{_t}_map", "ver_now attrs", f"select distinct version_dir, d.id from attrs join {_words} d on d.\"value\" = {INDEXED[_t]}")(lambda v, a, t=_t: _v1(v, a)[f"{t}_map"])
query("s12_index_v1_manifest_metadata", "ver_now attrs", "select version_dir, 5 kind, channel \"value\" from ver_now where channel <> ''")(lambda v, a: _v1(v, a)["manifest_metadata"])
query("s12_index_v1_metadata", "ver_now attrs", "select unnest(['majorVersion', 'lastWriteTime', 'trackingBase', 'rows']) name, unnest(['1', '1700000000', '0', (select count(*) from ver_now)::varchar]) \"value\"")(lambda v, a: _v1(v, a)["metadata"])
V1_TREE = TREE.replace("from paths)", "from (select version_dir path from ver_now))")
query("s12_index_v1_pathparts", "ver_now attrs", f"select a.id, b.id parent, string_split(a.path, '/')[-1] name, a.path from ({V1_TREE} select * from i) a left join ({V1_TREE} select * from i) b on b.path = array_to_string(string_split(a.path, '/')[1:-2], '/') and contains(a.path, '/')")(lambda v, a: _v1(v, a)["pathparts"])
query(
    "s12_index_v1_manifest",
    "ver_now attrs",
    f"select version_dir, package_id, case when channel = '' then package_version else package_id end name, nullif(channel, '') moniker, package_version, channel, row_number() over (partition by package_id order by {ORDER}) ordinal from ver_now v",
)(lambda v, a: _v1_by_value(_v1(v, a)))


def _v1_by_value(t):
    out = t["manifest"].drop("version_dir")
    for table, (c, _) in V1_COLUMN.items():
        out = out.join(t[table].withColumnRenamed("id", f"{c}_ref"), f"{c}_ref", "left").drop(f"{c}_ref")
    leaf = t["pathparts"].select(F.col("id").alias("path_ref"), F.col("path").alias("version_dir"))
    return out.join(leaf, "path_ref").select("version_dir", "package_id", "name", "moniker", "package_version", "channel", "ordinal")


query("s13_index_metadata", "ver_now", "select unnest(['majorVersion', 'lastWriteTime', 'trackingBase', 'rows']) name, unnest(['2', '1700000000', '0', (select count(*) from ver_now)::varchar]) \"value\"")(lambda v: index.index_metadata(v, 2, 1700000000, -5))

# names and paths
ARCH_SQL = "case when ({x86}) and not ({x64}) then 'X86' when ({x64}) and not ({x86}) then 'X64' end".format(x86=" or ".join(f"contains(l, '{t}')" for t in nz.X86_TOKENS), x64=" or ".join(f"contains(l, '{t}')" for t in nz.X64_TOKENS))
BARE = "l"
for _t in nz.ARCH_TOKENS:
    BARE = f"replace({BARE}, '{_t}', ' ')"
BASE = rf"regexp_replace(array_to_string(list_filter(regexp_split_to_array({BARE}, '[\s()\[\]]'), lambda w: not regexp_full_match(w, '[a-z][a-z]-[a-z][a-z]') and w <> ''), ' '), '[^a-z0-9]', '', 'g')"
LOW = "(select *, lower(display) l from names)"
query("f1_normalize_name", "names", f"select id, {BASE} base from {LOW}")(lambda n: n.select("id", nz.normalize_name(F.col("display"))["base"].alias("base")))
query("f2_architecture", "names", f"select id, {ARCH_SQL} architecture from {LOW}")(lambda n: n.select("id", nz.architecture(F.lower("display")).alias("architecture")))
query("f3_name_variants", "names", f"select id, list_filter([case when b <> '' then b end, b || '(' || a || ')'], lambda x: x is not null) variants from (select id, {BASE} b, {ARCH_SQL} a from {LOW})")(
    lambda n: n.select("id", nz.name_variants(F.col("display"), True).alias("variants"))
)
SUFFIX = "[" + ", ".join(f"'{x}'" for x in nz.LEGAL_SUFFIXES) + "]"
query("f4_normalize_publisher", "publishers", f"select id, array_to_string(w[1:coalesce(list_filter(range(1, len(w)), lambda i: list_contains({SUFFIX}, w[i + 1]))[1], len(w))], '') publisher from (select id, list_filter(regexp_split_to_array(lower(publisher), '[^a-z0-9]'), lambda x: x <> '') w from publishers)")(
    lambda p: p.select("id", nz.normalize_publisher(F.col("publisher")).alias("publisher"))
)
query("f1_normalize_name_any_script", "titles", f"select id, {BASE.replace('[^a-z0-9]', '[^\\pL\\pN]')} base from (select *, lower(display) l from titles)")(lambda n: n.select("id", nz.normalize_name(F.col("display"))["base"].alias("base")))
query("f4_normalize_publisher_any_script", "titles", f"select id, array_to_string(w[1:coalesce(list_filter(range(1, len(w)), lambda i: list_contains({SUFFIX}, w[i + 1]))[1], len(w))], '') publisher from (select id, list_filter(regexp_split_to_array(lower(display), '[^\\pL\\pN]'), lambda x: x <> '') w from titles)")(
    lambda p: p.select("id", nz.normalize_publisher(F.col("display")).alias("publisher"))
)
query("f5_sanitize", "names", "select id, regexp_replace(display, '[^A-Za-z0-9._-]', '_', 'g') segment from names")(lambda n: n.select("id", nz.sanitize(F.col("display")).alias("segment")))
query("f7_sha256", "names", "select id, sha256(display) sha, left(sha256(display), 8) prefix from names")(lambda n: n.select("id", nz.sha256(F.col("display")).alias("sha"), F.substring(nz.sha256(F.col("display")), 1, 8).alias("prefix")))
query("f9_set_functions", "attrs", "select package_id, list_sort(list_distinct(list_concat(list(brand), list(type)))) \"values\" from attrs group by 1")(
    lambda a: rollup.union_sets(a.select("package_id", F.explode(F.array("brand", "type")).alias("value")), "package_id", "value")
)
query("f13_path_parts", "paths", "select path, regexp_replace(path, '/?[^/]*$', '') parent, string_split(path, '/')[-1] last from paths")(lambda p: p.select("path", nz.parent(F.col("path")).alias("parent"), nz.last_segment(F.col("path")).alias("last")))
query("p8_record_relpath", "ver_now", "select version_dir, 'manifests/c/' || replace(package_id, '.', '/') || '/' || package_version || '/' || left(content_sha, 8) || '-' || package_id || '.yaml' relpath from ver_now")(
    lambda v: v.select("version_dir", nz.record_relpath(F.col("package_id"), F.col("package_version"), F.col("content_sha")).alias("relpath"))
)
query("p9_sidecar_relpath", "ver_now", "select version_dir, 'packages/' || package_id || '/' || left(content_sha, 8) || '/versionData.json' relpath from ver_now")(
    lambda v: v.select("version_dir", nz.sidecar_relpath(F.col("package_id"), F.col("content_sha")).alias("relpath"))
)
query("p3_override_version", "ver_now", "select version_dir, string_split(version_dir, '/')[-1] package_version from ver_now")(lambda v: v.select("version_dir", nz.last_segment(F.col("version_dir")).alias("package_version")))

# inventory of published files
FULL = "published t full join actual a on t.relpath = a.relpath"
query("j11_drift", "published actual", f"select coalesce(t.relpath, a.relpath) relpath, case when a.relpath is null then 'missing' when t.relpath is null then 'extra' else 'mismatched' end drift_kind from {FULL} where t.sha256 is distinct from a.sha256")(inventory.drift)
query("j10_plan_publish", "published actual", f"select coalesce(t.relpath, a.relpath) relpath, case when t.relpath is null then 'delete' else 'copy' end action from {FULL} where t.sha256 is distinct from a.sha256")(inventory.plan_publish)
query("j12_verify_stage", "published actual", "select relpath from published except select relpath from actual")(inventory.verify_stage)
query("u6_extra_files", "published actual", "select relpath from actual except select relpath from published")(inventory.extra_files)
query("u5_wanted_paths", "published actual", "select relpath from published union select relpath from actual union select 'index.bin'")(lambda p, a: inventory.wanted_paths(p, a, "index.bin"))
query("j8_carry_forward", "published actual", "select * from published p where relpath in (select relpath from actual) and relpath not in (select relpath from actual where sha256 like 'a%')")(lambda p, a: inventory.carry_forward(p, a, a.where("sha256 LIKE 'a%'")))
query("o5_published_inventory", "published actual", "select relpath, 'manifest' kind, sha256 from published where relpath like 'en%' union all select relpath, 'package', sha256 from published where relpath not like 'en%' union all select relpath, 'catalog', sha256 from actual where sha256 like '0f%'")(
    lambda p, a: inventory.published_inventory(p.where("relpath LIKE 'en%'"), p.where("relpath NOT LIKE 'en%'"), a.where("sha256 LIKE '0f%'"))
)

# lookups, logs and status
def _one_version(v):
    """The first pair of package and version that names one version."""
    key = v.groupBy("package_id", "package_version").count().where("count = 1").orderBy("package_id", "package_version").first()
    return lookup.select_targets(v, package_version=(key.package_id, key.package_version))


query("p10_select_by_package", "ver_now", "select distinct version_dir from ver_now where package_id in ('C.1', 'C.2', 'C.40')")(lambda v: lookup.select_targets(v, packages=["C.1", "C.2", "C.40"]))
query("p10_select_by_directory", "ver_now", "select distinct version_dir from ver_now where version_dir in ('c/1/1', 'c/2/2') or version_dir = (select min(version_dir) from ver_now)")(
    lambda v: lookup.select_targets(v, directories=["c/1/1", "c/2/2", v.agg(F.min("version_dir")).first()[0]])
)
query("p10_select_by_file", "files_now", "select distinct version_dir from files_now where path in ((select min(path) from files_now), (select max(path) from files_now))")(lambda f: lookup.select_targets(f, files=list(f.agg(F.min("path"), F.max("path")).first())))
query("p10_select_by_version", "ver_now", "select version_dir from (select version_dir, package_id, package_version, count(*) over (partition by package_id, package_version) n from ver_now) where n = 1 order by package_id, package_version limit 1")(_one_version)
query("p11_exclude_targets", "ver_now", "select * from ver_now where package_id not in ('C.1', 'C.2', 'C.40')")(lambda v: lookup.exclude_targets(v, lookup.select_targets(v, packages=["C.1", "C.2", "C.40"])))
query("p12_package_detail", "ver_now attrs", """select package_id, brands, versions from (select package_id, list({'version_dir': version_dir, 'package_version': package_version, 'channel': channel} order by version_dir) versions from ver_now group by 1)
 join (select package_id, list_sort(list(distinct brand)) brands from attrs group by 1) using (package_id)""")(lambda v, a: lookup.package_detail(v, rollup.union_sets(a, "package_id", "brand").withColumnRenamed("values", "brands")))
query("p13_find_child", "child_now", "select distinct version_dir, child_sha from child_now where child_sha in (select child_sha from child_now where version_dir = 'o/7')")(
    lambda c: lookup.find_child(c, c.where("version_dir = 'o/7'").select(F.upper("child_sha").alias("h")))
)
query("p14_list_builds", "builds", "select * from builds where status in ('staged', 'staged_reused', 'failed')")(lambda b: lookup.list_builds(b, ["staged", "failed"]))
query("o3_newest_builds", "builds", "select * from builds order by build_id desc limit 25")(lambda b: lookup.list_builds(b, limit=25))
query("p15_hash_report", "ver_now", "select package_id, version_dir, content_sha, sha256(concat_ws('|', package_id, package_version, channel, content_sha)) record_sha from ver_now")(lookup.hash_report)
query("w6_prune_builds", "builds", "select * from builds where build_id not in (select build_id from builds order by build_id desc limit 20) and coalesce(finished, started) < (select avg(coalesce(finished, started)) from builds)")(
    lambda b: lookup.prune_builds(b.crossJoin(b.agg(F.avg(F.coalesce("finished", "started")).alias("cut"))), 20, F.col("cut")).drop("cut")
)
query("s6_current_builds", "build_events", "select build_id, status, at_s from (select *, row_number() over (partition by build_id order by at_s desc, seq desc) rn from build_events) where rn = 1")(lookup.current_builds)
query("w7_pointers", "builds", "select case when status = 'published' then 'published' else 'staged' end pointer, max(build_id) build_id from builds where status in ('published', 'staged', 'staged_reused') group by 1")(lookup.pointers)
query("a6_status", "ver_now files_now published", "select 'versions' name, count(*) \"rows\" from ver_now union all select 'files', count(*) from files_now union all select 'published', count(*) from published")(
    lambda v, f, p: lookup.status_counts({"versions": v, "files": f, "published": p})
)
query("f12_age_cutoff", "builds", "select * from builds where build_id not in (select build_id from builds order by build_id desc limit 5) and coalesce(finished, started) < (select max(coalesce(finished, started)) from builds) - 2 * 86400")(
    lambda b: lookup.prune_builds(b.crossJoin(b.agg(F.max(F.coalesce("finished", "started")).alias("last"))), 5, lookup.age_cutoff(F.col("last"), "2d")).drop("last")
)

# versions that look like none of the above: suffixes, words, approximations, numbers beyond 64 bits
ODD = """case l_linenumber % 7 when 0 then 'latest' when 1 then '1.' || l_partkey || '-beta' when 2 then 'v1.' || l_partkey when 3 then '< 1.' || l_partkey when 4 then '18446744073709551616.' || l_partkey when 5 then '1.' || l_partkey || '.0' else 'Unknown' end"""
RANKED = """case l_linenumber % 7 when 0 then 9 when 6 then 0 when 4 then 5 else 3 end"""
for _strategy, _agg in (("latest", "max_by"), ("oldest", "min_by")):
    query(
        f"o1_odd_versions_{_strategy}",
        "child_lines",
        f"select owner, {_agg}(version, {{'rank': {RANKED}, 'part': case when l_linenumber % 7 in (0, 6) then 0 else l_partkey end, 'kind': case l_linenumber % 7 when 1 then 0 when 3 then 1 when 4 then 0 when 0 then 0 when 6 then 0 else 2 end, 'v': version}}) version from (select *, {ODD} version from child_lines) group by owner",
    )(lambda c, agg=_agg: c.selectExpr("*", f"{ODD} AS version").groupBy("owner").agg(getattr(F, agg)("version", F.struct(version_key(F.col("version")).alias("k"), F.col("version").alias("v"))).alias("version")))


# fragments and records
def fragments(f: DataFrame) -> DataFrame:
    """The flat view as rows of ``sources.fragments``."""
    plain = {"PackageIdentifier": "id", "PackageVersion": "ver", "ManifestVersion": "mver", "ManifestType": "frag_type", "DefaultLocale": "dl", "PackageLocale": "pl", "Publisher": "pub", "PackageName": "name", "InstallerType": "itype"}
    pairs = [x for k, c in plain.items() for x in (F.lit(k), F.when(F.col(c).isNotNull(), records.json_of(F.col(c))))]
    fields = F.map_filter(F.create_map(*pairs, F.lit("Tags"), "tags", F.lit("Installers"), "inst"), lambda _, v: v.isNotNull())
    own = F.transform(F.from_json("inst", "array<map<string,string>>"), lambda m: F.transform_values(m, lambda _, v: records.json_of(v)))
    warned = F.when(F.col("conv_id") % 7 == 1, F.array(F.concat(F.lit("PackageVersion "), F.col("ver"), F.lit(" is a number")))).otherwise(F.array().cast("array<string>"))
    return f.select("version_dir", F.concat_ws("/", "version_dir", "file_name").alias("path"), "file_name", "frag_type", fields.alias("fields"), fields.alias("child_fields"), own.alias("installers"), warned.alias("warnings"), F.lit(None).cast("string").alias("error"))


def _text(key: str, column: str, quote: str = '"') -> str:
    return f"""'"{key}":{quote}' || {column} || '{quote}'"""


CANONICAL = "'{' || concat_ws(',', " + ", ".join(
    (_text("DefaultLocale", "dl"), _text("InstallerType", "itype"), _text("Installers", "inst", ""), _text("ManifestType", "frag_type"), _text("ManifestVersion", "mver"), _text("PackageIdentifier", "id"), _text("PackageLocale", "pl"), _text("PackageName", "name"), _text("PackageVersion", "ver"), _text("Publisher", "pub"), _text("Tags", "tags", ""))
) + ") || '}'"


def record_sql(view_name: str) -> str:
    """version_dir, conv_id, package_id, package_version, record, source_file_count of every group of a view of fragments."""
    one = lambda c, t: f"max(case when frag_type = '{t}' then {c} end)"
    bare = "'{' || concat_ws(',', " + ", ".join((_text("PackageLocale", "pl"), _text("PackageName", "name"), _text("Publisher", "pub"))) + ") || '}'"
    rows = [_text("InstallerType", "itype"), _text("Installers", "inst", ""), "'\"Localization\":[' || others || ']'", "'\"ManifestType\":\"merged\"'", _text("ManifestVersion", "mver"), _text("PackageIdentifier", "package_id"), _text("PackageLocale", "pl"), _text("PackageName", "name"), _text("PackageVersion", "package_version"), _text("Publisher", "pub"), _text("Tags", "tags", "")]
    return f"""select version_dir, conv_id, package_id, package_version, '{{' || concat_ws(',', {', '.join(rows)}) || '}}' record, source_file_count, name, pub, tags from (
 select version_dir, conv_id, string_split(version_dir, '/')[-1] package_version, count(*) source_file_count, {one('id', 'installer')} package_id, {one('itype', 'installer')} itype, {one('inst', 'installer')} inst, {one('mver', 'installer')} mver,
  {one('pl', 'defaultlocale')} pl, {one('name', 'defaultlocale')} name, {one('pub', 'defaultlocale')} pub, {one('tags', 'defaultlocale')} tags,
  string_agg(case when frag_type = 'locale' then {bare} end, ',' order by lower(pl), pl, file_name) others from {view_name} group by version_dir, conv_id)"""


def child_sql(view_name: str) -> str:
    """version_dir, child_sha, url, architecture of the distinct children of every group."""
    return f"""select distinct version_dir, sha256('{{"Installer":{{"Architecture":"' || architecture || '","InstallerType":"exe","InstallerUrl":"' || url || '"}},"PackageIdentifier":"' || id || '","PackageVersion":"' || string_split(version_dir, '/')[-1] || '"}}') child_sha, url, architecture
 from (select version_dir, id, 'u/' || (conv_id % 13) url, unnest(list_transform(range(0, n_inst), lambda i: case when i = 1 then 'x86' else 'x64' end)) architecture from {view_name} where inst is not null)"""


def rules_sql(view_name: str) -> str:
    """version_dir, rule of every group that breaks one."""
    kinds = {"PackageIdentifier differs": "count(distinct id) > 1", "not exactly one defaultlocale fragment": "count(*) filter (where frag_type = 'defaultlocale') <> 1", "unknown fragment type": "count(*) filter (where frag_type = 'mystery') > 0", "ManifestVersion is missing": "count(mver) < count(*)", "Installers is missing": "count(inst) = 0", "default locale differs": "max(lower(dl)) is distinct from max(case when frag_type = 'defaultlocale' then lower(pl) end)"}
    return " union all ".join(f"select version_dir, '{rule}' rule from {view_name} group by version_dir having {cond}" for rule, cond in kinds.items())


def _assembled(f):
    return records.assemble_records(fragments(f))


query("p1_assemble_records", "frag", f"select version_dir, package_id, package_version, '' channel, record, source_file_count from ({record_sql('frag')})")(lambda f: _assembled(f).select("version_dir", "package_id", "package_version", "channel", "record", "source_file_count"))
query("p2_check_groups", "frag", rules_sql("frag"))(lambda f: records.check_groups(fragments(f)))
query("p4_canonical_json", "frag", f"select version_dir || '/' || file_name path, {CANONICAL} record from frag")(lambda f: fragments(f).select("path", records.canonical_json(F.col("fields")).alias("record")))
query(
    "p5_project_index",
    "frag",
    f"""select r.version_dir, r.name package_name, r.pub publisher, case when r.tags is null then [] else ['a', 't' || (r.conv_id % 5)] end tags, case when n > 0 then ['name' || (r.conv_id % 11)] else [] end norm_names, coalesce(pubs, []) norm_publishers from ({record_sql('frag')}) r
 join (select version_dir, count(name) n, list_sort(list(distinct replace(pub, ' Inc', '')) filter (where pub is not null)) pubs from frag where frag_type <> 'mystery' group by 1) g using (version_dir)""",
)(lambda f: records.project_index(_assembled(f)).select("version_dir", "package_name", "publisher", "tags", "norm_names", "norm_publishers"))
query("p6_child_records", "frag", child_sql("frag"))(lambda f: records.child_records(_assembled(f)).select("version_dir", "child_sha", "url", "architecture"))
query("p7_child_list", "frag", f"select version_dir, list_sort(list(child_sha)) children from ({child_sql('frag')}) group by 1")(lambda f: rollup.union_sets(records.child_records(_assembled(f)), "version_dir", "child_sha").withColumnRenamed("values", "children"))
query("u7_distinct_children", "frag", f"select version_dir, count(*) children from ({child_sql('frag')}) group by 1")(lambda f: records.child_records(_assembled(f)).groupBy("version_dir").agg(F.count(F.lit(1)).alias("children")))
query("p16_render_records", "frag", f"select version_dir, package_id, record from ({record_sql('frag')}) where package_id in ('V.1', 'V.2', 'V.30')")(
    lambda f: records.render_records(r := _assembled(f), lookup.select_targets(r, packages=["V.1", "V.2", "V.30"]))
)
query("a8_source_file_count", "frag", "select version_dir, count(*) source_file_count from frag group by 1")(lambda f: _assembled(f).select("version_dir", "source_file_count"))
query("a10_fragment_warnings", "frag", "select 'PackageVersion ' || ver || ' is a number' warning, count(*) files from frag where conv_id % 7 = 1 group by 1")(lambda f: records.fragment_warnings(fragments(f)))
query("f6_scalar_text", "scalars", "select id, case id % 5 when 0 then trim(json, '\"') when 1 then json when 2 then json end \"text\" from scalars")(lambda s: s.select("id", records.text_of(F.col("json")).alias("text")))
query("f10_overlay", "names", "select id, '{\"a\":\"' || display || '\",\"b\":\"2\",\"c\":\"' || id || '\"}' record from names")(
    lambda n: n.select("id", records.canonical_json(records.overlay(F.create_map(F.lit("c"), records.json_of(F.col("id").cast("string")), F.lit("a"), F.lit('"1"')), F.create_map(F.lit("b"), F.lit('"2"'), F.lit("a"), records.json_of(F.col("display"))))).alias("record"))
)
query("f11_parse_defaulted", "frag", "select version_dir, turn, case when tags is null then [] else ['a', 't' || (conv_id % 5)] end tags from frag")(lambda f: f.select("version_dir", "turn", records.strings_of(F.coalesce("tags", F.lit(" "))).alias("tags")))
for _s in ("latest", "oldest", "strip-all"):
    # each group claims the value of its url; a group that loses it is written again without
    CLAIM = "select r.package_id, r.version_dir, r.record, r.package_version, 'D' || (r.conv_id % 3) \"value\" from ({r}) r".format(r=record_sql("frag"))
    WIN = "row_number() over (partition by package_id, \"value\" order by string_split(package_version, '.')[2]::int {d}, version_dir {d})".format(d="desc" if _s == "latest" else "")
    KEEP = "n = 1" if _s == "strip-all" else "n = 1 or rn = 1"
    query(
        f"w4_rewrite_{_s.replace('-', '_')}",
        "frag",
        f"""select version_dir, '{{' || case when {KEEP} then '"AppsAndFeaturesEntries":[{{"DisplayVersion":"' || "value" || '","ProductCode":"P"}}],' else '"AppsAndFeaturesEntries":[{{"ProductCode":"P"}}],' end || substr(record, 2) record from (select *, {WIN} rn, count(*) over (partition by package_id, "value") n from ({CLAIM}))""",
    )(lambda f, s=_s: _rewritten(f, s))


def _rewritten(f, strategy):
    value = F.concat(F.lit("D"), F.col("conv_id") % 3)
    entry = F.concat(F.lit('[{"DisplayVersion":"'), value, F.lit('","ProductCode":"P"}]'))
    rows = fragments(f).join(f.select("version_dir", "file_name", "conv_id"), ["version_dir", "file_name"])
    more = F.when(F.col("frag_type") == "installer", F.create_map(F.lit("AppsAndFeaturesEntries"), entry))
    made = records.assemble_records(rows.withColumns({c: records.overlay(F.col(c), more) for c in ("fields", "child_fields")}))
    claimed = made.join(records.project_index(made).select("version_dir", F.explode("display_versions").alias("value")), "version_dir")
    return records.strip_display_versions(made, conflicts.losing_claims(claimed, strategy).select("version_dir", "value")).select("version_dir", "record")
