"""Registered queries for sources, sinks, state and the composite jobs: each runs them over files that Spark writes from the given tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.operators import index, lookup, records
from catalogspark.plans import build as bd
from catalogspark.plans.fixtures import duck, view
from catalogspark.plans.queries import CANONICAL, DIFF, ORACLE, QUERIES, QUEUE, _diff, _queue, child_sql, fragments, query, record_sql, rules_sql
from catalogspark.sources import files as fl
from catalogspark.sources import fragments as fr
from catalogspark.sources import state as st
from catalogspark.sources.lease import Fenced
from catalogspark.sources.listing import list_files, write_files
from catalogspark.sources.scratch import new_path, written
from catalogspark.sources.site import Site


def _root(df: DataFrame, label: str) -> str:
    return new_path(df.sparkSession, label)


# one table each
LINES = (("PackageIdentifier: ", "id"), ("PackageVersion: ", "ver"), ("ManifestVersion: ", "mver"), ("ManifestType: ", "frag_type"), ("DefaultLocale: ", "dl"), ("PackageLocale: ", "pl"), ("Publisher: ", "pub"), ("PackageName: ", "name"), ("InstallerType: ", "itype"), ("Tags: ", "tags"), ("Installers: ", "inst"))


def yaml_text(f: DataFrame) -> DataFrame:
    """version_dir, file_name, content: the fragments as YAML."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(k), F.col(c))) for k, c in LINES]
    return f.select("version_dir", "turn", "conv_id", F.concat_ws("/", "version_dir", "file_name").alias("path"), F.concat_ws("\n", *lines).alias("content"))


query("s3_parse_fragments", "frag", f"select version_dir || '/' || file_name path, frag_type, {CANONICAL} record, ['PackageVersion ' || ver || ' is a number'] warnings from frag")(
    lambda f: fr.parse_fragments(yaml_text(f).select("path", F.col("content").cast("binary").alias("content"))).select("path", "frag_type", records.canonical_json(F.col("fields")).alias("record"), "warnings")
)


def _text_files(d: DataFrame) -> str:
    root = _root(d, "corpus")
    d.where("text IS NOT NULL").select("lang", "source", "text").write.partitionBy("lang", "source").option("lineSep", "\n").text(root)
    return root


TREE = "select 'lang=' || lang || '/source=' || source version_dir, text from documents where text is not null"


def on_documents(name: str, sql: str):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
        ORACLE[name] = sql
        return fn

    return register


@on_documents("s1_scan_files", f"select version_dir, sum(strlen(text) + 1)::bigint bytes from ({TREE}) group by 1")
def _(spark, d):
    return fl.scan_files(spark, _text_files(d), "part-*").groupBy("version_dir").agg(F.sum("size").alias("bytes"))


@on_documents("s1_list_by_tasks", f"select version_dir, sum(strlen(text) + 1)::bigint bytes from ({TREE}) group by 1")
def _(spark, d):
    return list_files(spark, _text_files(d), new_path(spark, "listing"), "part-*").groupBy("version_dir").agg(F.sum("size").alias("bytes"))


@on_documents("s3_read_chosen", f"select version_dir, sum(strlen(text) + 1)::bigint bytes, sum(length(text) + 1)::bigint letters from ({TREE}) where version_dir like 'lang=en/%' or version_dir like '%/source=src7' group by 1")
def _(spark, d):
    root = _text_files(d)
    wanted = fl.scan_files(spark, root, "part-*").where("version_dir LIKE 'lang=en/%' OR version_dir LIKE '%/source=src7'")
    seen = fl.read_chosen(spark, root, wanted, lambda c: c.select("path", F.length("content").alias("bytes"), F.length(F.col("content").cast("string")).alias("letters")), new_path(spark, "chosen"))
    return seen.groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("version_dir")).agg(F.sum("bytes").alias("bytes"), F.sum("letters").alias("letters"))


@on_documents("s14_scan_inventory", "select 'source=' || source package_id, sha256(string_agg(text, chr(10) order by doc_id) || chr(10)) sha256 from documents where text is not null and source is not null group by lang, source")
def _(spark, d):
    """One file for each language and source, its texts in order of their ids: the hashes of its bytes are compared."""
    root = _root(d, "inventory")
    rows = d.where("text IS NOT NULL AND source IS NOT NULL").repartition("lang", "source").sortWithinPartitions("lang", "source", "doc_id")
    rows.select("lang", "source", "text").write.partitionBy("lang", "source").option("lineSep", "\n").text(root)
    return fl.scan_inventory(spark, root, "part-*").select("package_id", "sha256")


def _store(df: DataFrame) -> st.StateStore:
    return st.StateStore(df.sparkSession, _root(df, "state"), buckets=8)


STATE = "version_dir string, package_id string, package_version string, channel string, content_sha string"


@query("s4_load_state", "ver_now", "select version_dir, package_id, package_version, channel, content_sha from ver_now")
def _(v):
    store = _store(v)
    store.begin()
    store.commit({"versions": v})
    return store.read("versions", STATE)


@query("s5_replace_touched", "ver_now ver_prev", "select version_dir, package_id, package_version, channel, content_sha from ver_now where package_id like '%3' union all select version_dir, package_id, package_version, channel, content_sha from ver_prev where package_id not like '%3'")
def _(n, o):
    """A second commit replaces the buckets of the touched packages and leaves the others as they were."""
    store = _store(n)
    store.begin()
    store.commit({"versions": o})
    touched = n.where("package_id LIKE '%3'").select("package_id").union(o.where("package_id LIKE '%3'").select("package_id"))
    buckets = store.buckets_of(touched, "package_id")
    kept = store.read("versions", STATE, buckets).where("package_id NOT LIKE '%3'")
    store.begin()
    store.commit({"versions": kept.unionByName(n.where("package_id LIKE '%3'").select(*kept.columns))}, touched={"versions": buckets})
    return store.read("versions", STATE)


@query("s5_segments", "ver_now ver_prev", "select version_dir, package_id, package_version, channel, content_sha from ver_now")
def _(n, o):
    """The earlier table is changed into the later one by three segments: changed and new rows, and keys of rows that are gone."""
    store = _store(n)
    store.begin()
    store.commit({"versions": o})
    changed = n.join(o.select("version_dir", "content_sha"), ["version_dir", "content_sha"], "left_anti").select(*o.columns)
    gone = o.join(n.select("version_dir"), "version_dir", "left_anti")
    third = lambda df, k: df.where(F.pmod(F.xxhash64("version_dir"), F.lit(3)) == k)
    for k in range(3):
        store.begin()
        store.commit({}, deltas={"versions": (third(changed, k), third(gone, k))})
    return store.read("versions", STATE)


@query("s11_index_updated", "attrs", "select brand \"value\", package_id, count(*) over (partition by brand) n from (select distinct brand, package_id from attrs)")
def _(a):
    """A dictionary and its bridge over other pairs, brought to those of today by what was gained and lost, joined back to values."""
    store, owners = _store(a), index.dictionary(a, "package_id").withColumnRenamed("id", "package")
    now = written(a.join(owners, "package_id").select("package", F.col("brand").alias("value")).distinct(), "pairs")  # the view is worked out twice, not for every table
    part = F.pmod(F.xxhash64("package", "value"), F.lit(5))
    before = now.where(part != 0).unionByName(now.where(part == 1).withColumn("value", F.concat(F.lit("old "), F.col("value"))))
    words = index.dictionary(before, "value")
    bridge = written(index.map_table(before, "package", "value", words), "bridge")
    store.begin()
    store.commit({"index_tags2": index.counted(words, bridge), "index_tags2_map": bridge})
    held = store.read("index_tags2", "value string, id long, n long")
    made = index.update_words(held, written(index.changed_pairs(before, now), "changed-pairs"), held.agg(F.max("id")).first()[0] + 1)
    store.begin()
    store.commit({}, deltas={"index_tags2": (made["words"], made["words_gone"]), "index_tags2_map": (made["bridge"], made["bridge_gone"])})
    pairs = index.index_lookup(store.read("index_tags2", "value string, id long"), store.read("index_tags2_map", "package long, id long"), "value", "package")
    return pairs.join(owners, "package").join(store.read("index_tags2", "value string, n long"), "value").select("value", "package_id", "n")


@query("s5_fenced_writer", "ver_now ver_prev", "select version_dir, package_id, package_version, channel, content_sha from ver_now")
def _(n, o):
    """A writer that lost its lock commits last: what the one that took over has committed stays."""
    first = _store(n)
    first.begin()
    second = st.StateStore(n.sparkSession, first.root, buckets=8, lease=-1)
    second.begin()
    second.commit({"versions": n})
    try:
        first.commit({"versions": o})
    except Fenced:
        pass
    return second.read("versions", STATE)


@query(
    "w6_clean", "ver_now ver_prev",
    "select 2::bigint builds, 2::bigint was, (select count(*) from ver_now where package_id like '%3') + (select count(*) from ver_prev where package_id not like '%3') \"rows\", (select count(distinct package_id) from (select package_id from ver_now where package_id like '%3' union all select package_id from ver_prev where package_id not like '%3')) packages",
)
def _(n, o):
    """Three builds, of which the first is forgotten but for the buckets that the last one still names."""
    store = _store(n)
    store.begin()
    store.commit({"versions": o})
    hot = [n.where("package_id LIKE '%3'"), o.where("package_id LIKE '%3'")]
    buckets = store.buckets_of(hot[0].select("package_id").union(hot[1].select("package_id")), "package_id")
    for _ in range(2):
        kept = store.read("versions", STATE, buckets).where("package_id NOT LIKE '%3'")
        store.begin()
        store.commit({"versions": kept.unionByName(hot[0].select(*kept.columns))}, touched={"versions": buckets})
    gone = store.prune(lookup.prune_builds(store.builds(), 2))
    left = store.builds().count()
    store.prune(lookup.prune_builds(store.builds(), 1))
    rows = store.read("versions", STATE)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("package_id").alias("packages")).withColumns({"builds": F.lit(left).cast("long"), "was": F.lit(left + gone["builds"] - 1).cast("long")})


@query("s16_schema_evolution", "ver_now", "select version_dir, channel, null::varchar later from ver_now")
def _(v):
    store = _store(v)
    store.begin()
    store.commit({"versions": v})
    return store.read("versions", "version_dir string, channel string, later string")


@query("s7_change_log", "ver_now ver_prev", f"select version_dir, change_kind, 1 build_id from ({DIFF}) union all select version_dir, change_kind, 2 from ({DIFF}) where change_kind = 'add'")
def _(n, o):
    path = _root(n, "changes")
    rows = _diff(n, o)
    for build, part in ((1, rows.where("change_kind = 'update'")), (2, rows.where("change_kind = 'add'")), (1, rows)):  # the log of build 1 is written twice
        st.write_changes(part.select("version_dir", "change_kind"), path, build)
    return n.sparkSession.read.parquet(path).select("version_dir", "change_kind", F.col("build_id").cast("int").alias("build_id"))


@query("s8_queue_sink", "child_now child_prev", f"select reason, count(*) n, (select count(*) from ({QUEUE})) total from ({QUEUE}) group by 1")
def _(n, o):
    path = _root(n, "queue")
    st.write_queue(_queue(n, o), path, "version_dir", "child_sha")
    total = st.queue_count(n.sparkSession, path)
    return n.sparkSession.read.json(path).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.lit(total).cast("long"))


@query("s9_record_sink", "frag", f"select version_dir relpath, sha256(record) sha256, record body from ({record_sql('frag')})")
def _(f):
    path = _root(f, "records")
    made = records.assemble_records(fragments(f)).withColumn("content_sha", F.sha2("record", 256)).withColumnRenamed("version_dir", "relpath")
    st.write_records(made, path)
    return f.sparkSession.read.parquet(path)


@query("s15_meta_upsert", "builds", "select 'first' key, count(*) \"value\" from builds union all select 'second', max(build_id) from builds")
def _(b):
    store = _store(b)
    n, top = b.agg(F.count(F.lit(1)), F.max("build_id")).first()
    store.set_meta(first=n, second=0)
    store.set_meta(second=top)
    return b.sparkSession.createDataFrame([(k, store.get_meta(k)) for k in ("first", "second")], "key string, value long")


# the composite jobs: one run of them over a corpus written from the fragments


#: Tasks that write the corpus where few cores are known.
WRITERS = 48


class _Jobs:
    """Builds and publishing over one corpus, in their order: each runs when a query first asks for it or for one after it.

    ``out`` is what they have returned.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.root, self.out, self.passed = spark, new_path(spark, "jobs"), {}, []
        self.cfg = bd.BuildConfig(corpus=f"{self.root}/corpus", state=f"{self.root}/state", quarantine=True, index_format=0, buckets=8, glob="part-*")
        self.text, self.added = yaml_text(view(spark, sf_dir, "frag_files")), 0
        self._steps = self._run()

    def upto(self, step: str) -> dict:
        while step not in self.passed:
            try:
                self.passed.append(next(self._steps))
            except BaseException:
                _jobs.cache_clear()  # what has failed is begun anew
                raise
        return self.out

    def _add(self, rows: str) -> None:
        """Every fragment becomes a file of its own in its group's folder: one job, whatever the number of turns.

        What takes time is files, not bytes, so tasks have a fixed number, which Spark does not lower for small rows; a few for
        each core, as each starts a Python function (WRITERS at least, for cores that have not reported yet).  A
        group's fragments are in one task and numbered there in their order, so a task that is run again gives the same names.
        """
        tasks = max(4 * self.spark.sparkContext.defaultParallelism, min(WRITERS, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = self.text.where(rows).repartition(tasks, "version_dir")
        nth = F.row_number().over(Window.partitionBy("version_dir").orderBy("turn", "content"))
        name = F.format_string(f"part-%05d-{self.added:03d}-%06d", F.spark_partition_id(), nth)
        nowhere = "p=__HIVE_DEFAULT_PARTITION__/v=__HIVE_DEFAULT_PARTITION__"
        write_files(dealt.select(F.concat_ws("/", F.coalesce("version_dir", F.lit(nowhere)), name).alias("path"), F.concat("content", F.lit("\n")).alias("content")), self.cfg.corpus)
        self.added += 1

    def _store(self) -> st.StateStore:
        return st.StateStore(self.spark, self.cfg.state)

    def _run(self) -> Iterator[str]:
        spark, cfg, out, site = self.spark, self.cfg, self.out, f"{self.root}/site"
        self._add("conv_id % 10 <> 0 AND turn <> 99")
        out["b3"] = bd.incremental_build(spark, bd.BuildConfig(**{**cfg.__dict__, "force": True}))
        yield "b3"
        self._add("conv_id % 10 = 0 OR turn = 99")
        yield "grown"
        out["b1"] = bd.incremental_build(spark, cfg)
        out["rows"] = self._store().read("versions", bd.VERSIONS)
        yield "b1"
        out["b2"] = bd.incremental_build(spark, cfg)
        out["reused"] = self._store().read("versions", bd.VERSIONS)
        yield "b2"
        out["b4"] = bd.apply_targets(spark, cfg, {"packages": ["V.7", "V.8"]}, remove=True)
        yield "b4"
        out["b6"] = bd.publish(spark, cfg, site, build_id=out["b1"]["build"])
        out["tracked"] = self._store().read("published", bd.PUBLISHED).groupBy("kind").count().collect()
        out["drift"] = bd.verify_published(spark, cfg, site).count()
        yield "b6"
        bd.clear_published(spark, cfg)
        out["b8"] = self._store().read("published", bd.PUBLISHED).count()
        out["untracked"] = bd.verify_published(spark, cfg, site).groupBy("drift_kind").count().collect()
        out["builds"] = self._store().builds().collect()
        yield "b8"

        def dies(step: str) -> None:
            if step == "moved":
                raise InterruptedError(step)

        kinds = lambda: [tuple(r) for r in Site(spark, site).rows().groupBy("kind").count().collect()]
        try:
            bd.publish(spark, cfg, site, force=True, on_step=dies)
        except InterruptedError:
            out["after_failure"] = [("failed", *r) for r in kinds()]
        bd.publish(spark, cfg, site, force=True)
        out["after_failure"] += [("published", *r) for r in kinds()]
        yield "failed"


@cache
def _jobs(spark: SparkSession, sf_dir: str) -> _Jobs:
    return _Jobs(spark, sf_dir)


@cache
def _pending(spark: SparkSession, sf_dir: str) -> dict:
    """What a build of the grown corpus would do; over a corpus of its own where that build has already run."""
    jobs = _jobs(spark, sf_dir)
    if "b1" in jobs.passed:
        jobs = _Jobs(spark, sf_dir)
    jobs.upto("grown")
    return bd.pending_diff(spark, jobs.cfg)


def job(name: str, step: str, sql: str):
    """Register a function of what the jobs have returned up to a step."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, _jobs(spark, sf_dir).upto(step))
        ORACLE[name] = duck(["frag_files"], sql)
        return fn

    return register


def _good(rows: str) -> str:
    """Records of the groups of a set of fragments that break no rule."""
    return f"(select * from ({record_sql(rows)}) where version_dir not in (select version_dir from ({rules_sql(rows)})))"


BEFORE, AFTER = "(select * from frag_files where conv_id % 10 <> 0 and turn <> 99)", "(select * from frag_files)"
COUNTS = f"""select (select count(*) from {_good(AFTER)} where conv_id % 10 = 0) added, (select count(*) from {_good(AFTER)} where conv_id % 10 = 2) updated, 0::bigint removed,
 (select count(*) from ({child_sql('frag_files')}) where version_dir in (select version_dir from {_good(AFTER)} where conv_id % 10 = 0)) revalidations"""


def _counts(spark: SparkSession, got: dict) -> DataFrame:
    names = ("added", "updated", "removed", "revalidations")
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


job("b3_full_rebuild", "b3", f"""select (select count(*) from {_good(BEFORE)}) added, 0::bigint updated, 0::bigint removed, (select count(*) from ({child_sql(BEFORE)}) where version_dir in (select version_dir from {_good(BEFORE)})) revalidations""")(lambda s, h: _counts(s, h["b3"]))
ORACLE["b5_pending_diff"] = duck(["frag_files"], COUNTS)
QUERIES["b5_pending_diff"] = lambda spark, sf_dir: _counts(spark, _pending(spark, sf_dir))
job("b1_incremental_build", "b1", f"select version_dir, package_id, package_version, sha256(record) content_sha, source_file_count from {_good(AFTER)}")(lambda s, h: h["rows"].select("version_dir", "package_id", "package_version", "content_sha", "source_file_count"))
job("b1_incremental_counts", "b1", COUNTS)(lambda s, h: _counts(s, h["b1"]))
job("b2_no_change", "b2", f"select 'staged_reused' status, 0::bigint changes, count(*) versions from {_good(AFTER)}")(
    lambda s, h: h["reused"].groupBy().agg(F.count(F.lit(1)).alias("versions")).select(F.lit(h["b2"]["status"]).alias("status"), F.lit(h["b2"]["added"] + h["b2"]["updated"] + h["b2"]["removed"]).cast("long").alias("changes"), "versions")
)
job("b4_remove_targets", "b4", f"select count(*) removed from {_good(AFTER)} where package_id in ('V.7', 'V.8')")(lambda s, h: s.createDataFrame([(h["b4"]["removed"],)], "removed long"))
job("b6_publish", "b6", f"select 'manifest' kind, count(*) files from {_good(AFTER)} union all select 'package', count(distinct package_id) from {_good(AFTER)} union all select 'catalog', 1")(lambda s, h: s.createDataFrame([tuple(r) for r in h["tracked"]], "kind string, files long"))
job("b6_publish_plan", "b6", f"select (select count(*) from {_good(AFTER)}) + (select count(distinct package_id) from {_good(AFTER)}) + 1 copied, 0::bigint drifted")(lambda s, h: s.createDataFrame([(h["b6"]["copy"], h["drift"])], "copied long, drifted long"))
_FILES = "(select count(*) from {0}) + (select count(distinct package_id) from {0}) + 1"
job("b8_clear_published", "b8", f"select 0::bigint tracked, 'extra' drift_kind, {_FILES.format(_good(AFTER))} files")(
    lambda s, h: s.createDataFrame([(h["b8"], *r) for r in h["untracked"]], "tracked long, drift_kind string, files long")
)
_LEFT = f"(select * from {_good(AFTER)} where package_id not in ('V.7', 'V.8'))"
_KINDS = "select '{0}' moment, 'manifest' kind, count(*) files from {1} union all select '{0}', 'package', count(distinct package_id) from {1} union all select '{0}', 'catalog', 1"
job("b6_publish_after_failure", "failed", f"{_KINDS.format('failed', _good(AFTER))} union all {_KINDS.format('published', _LEFT)}")(
    lambda s, h: s.createDataFrame(h["after_failure"], "moment string, kind string, files long")
)
job("s6_build_log", "b8", "select unnest([1, 2, 3, 4, 5, 6]) build_id, unnest(['staged', 'staged', 'staged_reused', 'staged', 'published', 'published']) status from (select 1 from frag_files limit 1)")(lambda s, h: s.createDataFrame([(r.build_id, r.status) for r in h["builds"]], "build_id int, status string"))
