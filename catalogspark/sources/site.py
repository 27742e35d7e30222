"""A published table in buckets that is changed without ever being half done.

``target/bucket=k`` holds the files of a bucket; the files that one publishing has written begin with its name.  A small
numbered pointer in ``target/_site`` gives the beginning of the names that count in each bucket, so its readers see the
old site or the new one.  New files are staged, then moved beside the old ones, then pointed to, and only then do the old
ones go; whatever a publishing that died has left is not pointed to and goes with the next one.  A plain read of the
folder agrees with the pointer but for the time between moving and dropping.

A folder without a pointer is a site of whatever files it holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.sources.files import filesystem
from catalogspark.sources.lease import Fenced, delete, read_text, write_text

SCHEMA = "relpath string, kind string, body string, bucket int"
#: How Spark names files: those of a folder that no pointer has told of yet.
PLAIN = "part-"


class Site:
    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")

    def _list(self, path: str) -> list[str]:
        fs, folder = filesystem(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def buckets(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self._list(self.target) if n.startswith("bucket="))

    def pointer(self) -> dict | None:
        """name, number, and ``begins``: the beginning of file names by bucket."""
        names = [n for n in self._list(f"{self.target}/_site") if n.isdigit()]
        return json.loads(read_text(self.spark, f"{self.target}/_site/{names[-1]}")) | {"number": int(names[-1])} if names else None

    def rows(self, begins: dict[str, str] | None = None) -> DataFrame:
        """relpath, kind, body, bucket of the site that a pointer tells of (the current one), or of all files without any."""
        if begins is None:
            now = self.pointer()
            begins = None if now is None else now["begins"]
        if not self.buckets():
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(self.target)
        if begins is None:
            return rows
        by: dict[str, list[int]] = {}
        for k, begin in begins.items():
            by.setdefault(begin, []).append(int(k))
        held = [F.col("bucket").isin(ks) & F.col("_metadata.file_name").startswith(begin) for begin, ks in by.items()]
        return rows.where(reduce(lambda x, y: x | y, held, F.lit(False)))

    def adopt(self) -> dict:
        """The current pointer; a folder without one gets a first one, to what it holds."""
        if now := self.pointer():
            return now
        self.point("adopted", {str(k): PLAIN for k in self.buckets()})
        return self.pointer()

    def add(self, rows: DataFrame, name: str, on_step: Callable[[str], None]) -> dict[str, str]:
        """Put files of the rows (with their bucket) beside those that are there; what to point to for their buckets."""
        staged = f"{self.target}/_staging/{name}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(staged)
        on_step("staged")
        begins = {}
        for folder in (n for n in self._list(staged) if n.startswith("bucket=")):
            fs, place = filesystem(self.spark, f"{self.target}/{folder}")
            fs.mkdirs(place)
            for file in (n for n in self._list(f"{staged}/{folder}") if n.startswith(PLAIN)):
                source, moved = (filesystem(self.spark, p)[1] for p in (f"{staged}/{folder}/{file}", f"{self.target}/{folder}/{name}-{file}"))
                if not fs.rename(source, moved):
                    raise OSError(f"{staged}/{folder}/{file} can't be moved")
                on_step("moved a file")
            begins[folder.partition("=")[2]] = f"{name}-"
        return begins

    def point(self, name: str, begins: dict[str, str], after: int | None = None) -> None:
        """Make these files the site; ``after``: the number of the pointer that must still be the current one."""
        now = self.pointer()
        number = now["number"] if now else 0
        if after not in (None, number):
            raise Fenced(f"{self.target}: another publishing has taken over")
        temp = f"{self.target}/_site/.{name}"
        write_text(self.spark, temp, json.dumps({"name": name, "begins": begins}), overwrite=True)
        fs, target = filesystem(self.spark, f"{self.target}/_site/{number + 1:012d}")
        if fs.exists(target) or not fs.rename(filesystem(self.spark, temp)[1], target):
            raise Fenced(f"{self.target}: another publishing has taken over")

    def sweep(self) -> int:
        """Drop files, staged tables and pointers that the current pointer doesn't tell of; how many files went."""
        now, gone = self.pointer(), 0
        if now is None:
            return 0
        for k in self.buckets():
            begin = now["begins"].get(str(k))
            for file in self._list(f"{self.target}/bucket={k}"):
                if begin is None or not file.lstrip(".").startswith(begin):
                    gone += not file.startswith(".")
                    delete(self.spark, f"{self.target}/bucket={k}/{file}")
            if begin is None:
                delete(self.spark, f"{self.target}/bucket={k}")
        delete(self.spark, f"{self.target}/_staging")
        for n in self._list(f"{self.target}/_site"):
            if not n.isdigit() or int(n) < now["number"]:
                delete(self.spark, f"{self.target}/_site/{n}")
        return gone
