"""Snapshot state: Parquet tables in buckets under one folder, made current by one numbered pointer file.

A table's rows are dealt to buckets by the hash of a key; a commit writes only the buckets that a run has touched into
the build's own folder, checks their keys, and then creates the next pointer by renaming a finished file.  A pointer
names the folder of every bucket, so readers see the old state or the new one, and older builds stay readable.

Writers are fenced.  A lock file with a token, renewed while its holder lives, refuses a second writer; one that has not
been renewed for ``lease`` seconds is taken over, and the build that left it is logged as failed.  Every pointer carries
the number after the last one that its writer has created or found when it began: whoever was taken over finds that
number used, and what it has written, into the folder of its own build, never becomes current.

A bucket may be changed by segments instead: a commit of ``deltas`` writes changed rows and the keys of rows that are gone,
and a read takes of every key what the latest segment says, else the base.  Segments of a bucket are merged once there
are more than ``SEGMENTS``, and with the base once they have grown to its size, so that what is written follows what
has changed, whatever the number of buckets.

The log of builds is what the pointers say of them, each of the build that has made it (and of one that it took over
from); the latest says how a build ended.  ``prune`` deletes pointers of old builds and then every folder that no
remaining pointer names, but for those that a living reader may still need.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalogspark.sources.files import filesystem
from catalogspark.sources.lease import Fenced, Lease, Mark, age, delete, read_text, write_text
from catalogspark.sources.scratch import together

KEYS = {"files": ["path"], "versions": ["version_dir"], "children": ["version_dir", "child_sha"], "packages": ["package_id"], "values": ["package_id", "attribute", "value"], "published": ["relpath"]}
BUCKET_BY = {"files": "version_dir", "versions": "package_id", "children": "version_dir", "packages": "package_id", "values": "package_id", "published": "relpath"}


EVENT = "struct<build_id: long, started: long, finished: long, status: string, error: string>"
STAGED = ("staged", "staged_reused", "published")

# the index by packages, kept up to date by segments: ids of values and packages never change
DIRECT = ("pfns", "productcodes", "upgradecodes", "norm_names", "norm_publishers")
KEYS |= {"index_packages": ["package_id"]} | {f"index_{n}2": ["value"] for n in ("tags", "commands")} | {f"index_{n}2_map": ["package", "id"] for n in ("tags", "commands")} | {f"index_{n}2": ["value", "package"] for n in DIRECT}
BUCKET_BY |= {"index_packages": "package_id"} | {f"index_{n}2": "value" for n in ("tags", "commands")} | {f"index_{n}2_map": "package" for n in ("tags", "commands")} | {f"index_{n}2": "package" for n in DIRECT}
#: Segments of one bucket that a read has to merge.
SEGMENTS = 8


def parts_of(held: str | list[str]) -> list[str]:
    """The base of a bucket ("" for none) and its segments, oldest first."""
    return [held] if isinstance(held, str) else held


class StateStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, lease: float = 86_400):
        self.spark, self.root, self.lease = spark, root.rstrip("/"), lease
        for folder in ("pointers", "readers"):
            fs, target = filesystem(spark, f"{self.root}/{folder}")
            fs.mkdirs(target)
        self.buckets = self.current().get("buckets", buckets)
        self._lock: Lease | None = None
        self._number = 0  # of the last pointer that this writer knows of
        self._event: dict = {}

    def numbers(self) -> list[int]:
        fs, target = filesystem(self.spark, f"{self.root}/pointers")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(target) if s.getPath().getName().isdigit())

    def pointer(self, number: int) -> dict:
        return json.loads(read_text(self.spark, self._pointer_path(number)))

    def _pointer_path(self, number: int) -> str:
        return f"{self.root}/pointers/{number:012d}"

    def current(self) -> dict:
        """The current pointer: build, status, tables, meta, and what it says of builds."""
        numbers = self.numbers()
        return self.pointer(numbers[-1]) if numbers else {"build": 0, "status": None, "tables": {}, "meta": {}, "events": []}

    def tables_of(self, build: int) -> dict:
        """The tables as the build left them."""
        for number in reversed(self.numbers()):
            pointer = self.pointer(number)
            if pointer["build"] == build:
                if pointer["status"] not in STAGED:
                    break
                return pointer["tables"]
        raise ValueError(f"build {build} was never staged")

    def holds(self, name: str) -> bool:
        """Whether the current snapshot has the table, be it empty."""
        return name in self.current()["tables"]

    def bucket(self, column: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, column: str) -> list[int]:
        """The buckets that hold these keys; at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(column)).distinct().collect())

    def _load(self, paths: list[str]) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def _latest(self, name: str, segments: list[str]) -> DataFrame:
        """Of every key in the segments what the latest one says, ``_gone`` rows included."""
        rows = self._load(segments)
        key = sorted({*KEYS[name], BUCKET_BY[name]})  # a key that has moved to another bucket is gone from its old one
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), "_seq").alias("r")).select("r.*")

    def _merged(self, name: str, parts: list[list[str]]) -> DataFrame:
        """The rows of some buckets: their bases, and what the segments say."""
        base, segments = [p[0] for p in parts if p[0]], [x for p in parts for x in p[1:]]
        if not segments:
            return self._load(base)
        latest = self._latest(name, segments)
        alive = latest.where("NOT _gone").drop("_gone", "_seq")
        if not base:
            return alive
        rows, key = self._load(base), sorted({*KEYS[name], BUCKET_BY[name]})
        changed = latest.select(*(F.col(k).alias(f"_{k}") for k in key))
        same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
        return rows.join(changed, same, "left_anti").unionByName(alive, allowMissingColumns=True)

    def read(self, name: str, schema: str | StructType, buckets: list[int] | None = None, tables: dict | None = None) -> DataFrame:
        """A table of the current snapshot with the wanted columns: those it does not have yet are null."""
        wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        held = (self.current()["tables"] if tables is None else tables).get(name, {})
        parts = [parts_of(p) for k, p in sorted(held.items()) if buckets is None or int(k) in buckets]
        if not parts:
            return self.spark.createDataFrame([], wanted)
        have = self._merged(name, parts)
        return have.select(*(F.col(f.name).cast(f.dataType) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))

    def _put(self, number: int, body: dict) -> None:
        """Create a pointer under its number, which nobody may have used."""
        body = body | {"number": number, "token": uuid.uuid4().hex}
        path = self._pointer_path(number)
        temp = f"{self.root}/pointers/.{body['token']}"
        write_text(self.spark, temp, json.dumps(body))
        fs, target = filesystem(self.spark, path)
        if fs.exists(target) or not fs.rename(filesystem(self.spark, temp)[1], target) or self.pointer(number)["token"] != body["token"]:
            delete(self.spark, temp)
            raise Fenced(f"{path} exists already: another writer has taken over")

    def _move(self, **changes) -> dict:
        """The next pointer: the current one with changes."""
        numbers = self.numbers()
        last = numbers[-1] if numbers else 0
        if self._lock and (last != self._number or not self._lock.held()):
            raise Fenced(f"{self.root}: another writer has taken over")
        body = self.current() | {"buckets": self.buckets, "events": []} | changes
        self._put(last + 1, body)
        self._number = last + 1
        return body

    @contextmanager
    def locked(self) -> Iterator[None]:
        """Hold the lock without a build: for work on the state itself."""
        lock = Lease(self.spark, f"{self.root}/lock", self.lease)
        lock.start()
        try:
            yield
        finally:
            lock.stop()

    def begin(self) -> int:
        """Take the lock and log a running build."""
        lock = Lease(self.spark, f"{self.root}/lock", self.lease)
        lock.start()
        try:
            numbers, now = self.numbers(), self.current()
            self._lock, self._number = lock, numbers[-1] if numbers else 0
            left = [e | {"status": "failed", "finished": int(time.time()), "error": "abandoned"} for e in now["events"] if e["status"] == "running"]
            self._event = {"build_id": now["build"] + 1, "started": int(time.time()), "finished": None, "status": "running", "error": None}
            self._move(build=now["build"] + 1, status="running", events=[*left, self._event])
        except BaseException:
            self._release()
            raise
        return self._event["build_id"]

    def _release(self) -> None:
        lock, self._lock = self._lock, None
        if lock:
            lock.stop()

    def close(self, status: str, error: str | None = None, **changes) -> None:
        """Log how the build ended, release the lock."""
        self._event = self._event | {"finished": int(time.time()), "status": status, "error": error}
        try:
            self._move(status=status, events=[self._event], **changes)
        finally:
            self._release()

    def fail(self, error: str) -> None:
        """Log the running build as failed, release the lock; a build that was taken over is logged already."""
        if self._lock:
            try:
                self.close("failed", error[:2000])
            except Fenced:
                pass

    @contextmanager
    def reading(self) -> Iterator[dict]:
        """The current pointer, whose folders ``prune`` leaves alone while the reader lives."""
        mark = Mark(self.spark, f"{self.root}/readers/{uuid.uuid4().hex}", self.lease, str((self.numbers() or [0])[-1]))
        mark.start()
        try:
            yield self.pointer(int(mark.text)) if mark.text != "0" else self.current()
        finally:
            mark.stop()

    def _written(self, rows: DataFrame, path: str) -> dict[str, str]:
        """Write rows by their bucket; the folders that there are now."""
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        fs, target = filesystem(self.spark, path)
        return {s.getPath().getName().partition("=")[2]: f"{path}/{s.getPath().getName()}" for s in fs.listStatus(target) if s.isDirectory()}

    def _check_key(self, name: str, paths: list[str]) -> None:
        if not (key := KEYS.get(name)) or not paths:
            return
        rows = self.spark.read.parquet(*paths)
        if not rows.groupBy(*key, *({"_gone"} & {*rows.columns})).count().where("count > 1").limit(1).isEmpty():
            raise ValueError(f"{name} repeats a key")

    def _add_segment(self, name: str, held: dict, changed: DataFrame, gone: DataFrame, root: str, build: int) -> None:
        """Write changed rows and keys of rows that are gone as a segment of each bucket that has any; merge where there are many."""
        by = BUCKET_BY[name]
        keys = gone.select(*sorted({*KEYS[name], by})).distinct().withColumn("_gone", F.lit(True))
        rows = changed.withColumn("_gone", F.lit(False)).unionByName(keys, allowMissingColumns=True)
        new = self._written(rows.withColumns({"_seq": F.lit(build).cast("long"), "bucket": self.bucket(by)}), f"{root}/{name}")
        self._check_key(name, list(new.values()))
        held |= {k: [*parts_of(held.get(k, "")), p] for k, p in new.items()}
        few, all_of = [], []
        for k in new:
            base, *segments = held[k]
            if base and sum(map(self._size, segments)) >= self._size(base) or not base and len(segments) > SEGMENTS:
                all_of.append(k)
            elif len(segments) > SEGMENTS:
                few.append(k)
        if few:
            rows = self._latest(name, [x for k in few for x in held[k][1:]]).withColumn("bucket", self.bucket(by))
            held |= {k: [held[k][0], p] for k, p in self._written(rows, f"{root}/{name}-segments").items()}
        if all_of:
            rows = self._merged(name, [held[k] for k in all_of]).withColumn("bucket", self.bucket(by))
            made = self._written(rows, f"{root}/{name}-merged")
            for k in all_of:  # a bucket may have become empty
                held.pop(k)
            held |= made

    def commit(self, tables: dict[str, DataFrame], status: str = "staged", touched: dict[str, list[int]] | None = None, deltas: dict[str, tuple[DataFrame, DataFrame]] | None = None, **meta) -> None:
        """Write the tables, or the touched buckets of them, check their keys, point to them.

        deltas: by table changed rows, and rows of which only the key and the column of the bucket count, that are gone.
        """
        if not self._lock:
            raise RuntimeError("a commit belongs to a build: begin() first")
        now, build = self.current(), self._event["build_id"]  # of this writer, whatever has become current meanwhile
        held = {n: dict(t) for n, t in now["tables"].items()}
        root = f"{self.root}/snapshots/{build:08d}"

        def replace(name: str, df: DataFrame) -> None:
            only, by = (touched or {}).get(name), BUCKET_BY.get(name)
            rows = df.withColumn("bucket", self.bucket(by) if by else F.lit(0))
            if only is not None:
                rows = rows.where(F.col("bucket").isin(only))
            new = self._written(rows, f"{root}/{name}")
            held[name] = {k: p for k, p in held.get(name, {}).items() if only is not None and int(k) not in only} | new
            self._check_key(name, list(new.values()))

        deltas = deltas or {}
        both = tables.keys() & deltas.keys()  # a table that is replaced and then changed
        steps = [partial(replace, n, df) for n, df in tables.items()]
        changes = {n: partial(self._add_segment, n, held.setdefault(n, {}), *rows, root, build) for n, rows in deltas.items() if n not in both}
        together(self.spark, steps + [*changes.values()])
        for name in both:
            self._add_segment(name, held[name], *deltas[name], root, build)
        self.close(status, tables=held, meta=now["meta"] | meta)

    def set_meta(self, **values) -> None:
        self._move(meta=self.current()["meta"] | values)

    def get_meta(self, key: str, default=None):
        return self.current()["meta"].get(key, default)

    def events(self) -> DataFrame:
        """number of the pointer, and what it says of builds."""
        if not self.numbers():
            return self.spark.createDataFrame([], f"number long, event {EVENT}")
        rows = self.spark.read.schema(f"number long, events array<{EVENT}>").json(f"{self.root}/pointers")
        return rows.select("number", F.explode("events").alias("event"))

    def builds(self) -> DataFrame:
        """The log: of every build what the latest pointer says."""
        last = self.events().groupBy("event.build_id").agg(F.max_by("event", "number").alias("event"))
        return last.select("event.build_id", "event.started", "event.finished", "event.status", "event.error")

    # -- deleting what no build needs ----------------------------------------------------------------------------------

    def living_readers(self) -> dict[str, int]:
        """Marks of readers that live, and the pointer that each reads; marks of dead ones are deleted."""
        fs, target = filesystem(self.spark, f"{self.root}/readers")
        out = {}
        for s in fs.listStatus(target):
            name = s.getPath().getName()
            path = f"{self.root}/readers/{name}"
            if name.startswith("."):
                continue
            if age(self.spark, path) > max(0, self.lease):
                delete(self.spark, path)
            else:
                out[name] = int(read_text(self.spark, path))
        return out

    def _folders(self, path: str) -> list[str]:
        fs, target = filesystem(self.spark, path)
        return sorted(f"{path}/{s.getPath().getName()}" for s in fs.listStatus(target) if s.isDirectory()) if fs.exists(target) else []

    def _size(self, path: str) -> int:
        fs, target = filesystem(self.spark, path)
        return fs.getContentSummary(target).getLength()

    def prune(self, old: DataFrame, dry_run: bool = False) -> dict:
        """Forget some builds (build_id) and delete every folder that nothing needs any more; returns counts and bytes.

        The current pointer and those that living readers hold stay, and with them all folders that they name; so do the
        pointers that tell how the other builds ended, which keep their folders too.  Pointers go first: if the job dies
        between, the next one finds folders without a pointer and deletes them.
        """
        with self.locked():
            read = self.living_readers()
            numbers = self.numbers()
            events = self.events()
            gone = old.select("build_id").distinct()
            told = events.select("number", "event.build_id").join(gone, "build_id", "left_anti").groupBy("build_id").agg(F.max("number").alias("number"))
            keep = {r["number"] for r in told.select("number").collect()} | set(read.values()) | set(numbers[-1:])
            keep &= set(numbers)
            published = self.current()["meta"].get("published") if numbers else None
            named, staying = set(), set()
            for number in sorted(keep):
                pointer = self.pointer(number)
                staying |= {pointer["build"], published}
                named |= {path for table in pointer["tables"].values() for held in table.values() for path in parts_of(held)}
            forgotten = {r["build_id"] for r in gone.collect()} - staying
            doomed = [f"{self.root}/changes/build_id={b}" for b in sorted(forgotten)]
            doomed += [f for f in self._folders(f"{self.root}/work") if f.rpartition("/")[2] not in read]
            for build in self._folders(f"{self.root}/snapshots"):
                number, parts = int(build.rpartition("/")[2]), []
                for table in self._folders(build):
                    buckets = self._folders(table)
                    free = [x for x in buckets if x not in named] if buckets else [table] if number not in staying else []
                    parts += [table] if free and len(free) == len(buckets) else free
                doomed += [build] if parts and set(parts) == set(self._folders(build)) else parts
            fs, _ = filesystem(self.spark, self.root)
            doomed = [x for x in doomed if fs.exists(filesystem(self.spark, x)[1])]
            out = {"builds": len(forgotten), "pointers": len(numbers) - len(keep), "folders": len(doomed), "bytes": sum(map(self._size, doomed))}
            if not dry_run:
                for number in numbers:
                    if number not in keep:
                        delete(self.spark, self._pointer_path(number))
                for path in doomed:
                    delete(self.spark, path)
            return out


def write_changes(changes: DataFrame, path: str, build_id: int) -> None:
    """Replace the log of one build and no other."""
    changes.withColumn("build_id", F.lit(build_id)).write.partitionBy("build_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_queue(queue: DataFrame, path: str, *order: str) -> None:
    queue.orderBy(*order).write.mode("overwrite").json(path)


def queue_count(spark: SparkSession, path: str) -> int:
    return spark.read.json(path, schema="version_dir string, child_sha string, reason string").count()


def write_records(records: DataFrame, path: str) -> None:
    """relpath, sha256, body of every record, as a table."""
    records.select("relpath", F.col("content_sha").alias("sha256"), F.col("record").alias("body")).write.mode("overwrite").parquet(path)
