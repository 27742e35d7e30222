"""File inventories: listing without bytes, and bytes of chosen files only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.normalize import parent


#: Tasks for each core that list paths.
LISTING_TASKS = 4
#: Tasks for each core that read files: each counts for a task's bytes as if it were large, so small ones would get a task, and
#: tables made of them a file, for every few.
READING_TASKS = 4


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path and the path, for the few calls that are about single files."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def corpus_root(spark: SparkSession, root: str) -> str:
    """``root/manifests`` if there is one, else ``root``."""
    root = root.rstrip("/")
    fs, target = filesystem(spark, f"{root}/manifests")
    return f"{root}/manifests" if fs.exists(target) else root


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While Spark lists paths: a few tasks for each core, where it would start one for every path (up to 10,000)."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was = spark.conf.get(key)
    spark.conf.set(key, str(max(1, min(int(was), LISTING_TASKS * spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    with few_listing_tasks(spark):
        return _few_tasks(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root))


def _few_tasks(files: DataFrame) -> DataFrame:
    return files.coalesce(READING_TASKS * files.sparkSession.sparkContext.defaultParallelism)


def _relative(root: str):
    bare = re.sub(r"^[a-z]+:", "", root).strip("/")
    return F.regexp_replace("path", rf"^([a-z]+:)?/*{re.escape(bare)}/", "")


def scan_files(spark: SparkSession, root: str, glob: str = "*.yaml") -> DataFrame:
    """path (below the root), version_dir, size, mtime of every file that has bytes and is not hidden; contents are not read."""
    root = corpus_root(spark, root)
    rows = _binary(spark, root, glob).select(_relative(root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return rows.select("path", parent(F.col("path")).alias("version_dir"), "size", "mtime")


def read_contents(spark: SparkSession, root: str, glob: str = "*.yaml") -> DataFrame:
    """path, content of every file.  A join with wanted paths comes after the bytes are read: ``read_chosen`` reads only those."""
    root = corpus_root(spark, root)
    return _binary(spark, root, glob).select(_relative(root).alias("path"), "content")


#: Paths that are read by one scan: their file states are on the driver while it runs.
BLOCK_PATHS = 50_000


def blocks_of_paths(paths: DataFrame, size: int) -> Iterator[list[str]]:
    """The distinct paths, fetched partition by partition, at most ``size`` of them at a time."""
    rows = paths.select("path").where("path IS NOT NULL").distinct().toLocalIterator()
    while block := [r[0] for r in islice(rows, size)]:
        yield block


def _open_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """The binaryFile scan over these files.  Their names go to the JVM as one text: as a list each would be a call of its own."""
    jvm, reader = spark.sparkContext._jvm, spark.read.format("binaryFile").option("recursiveFileLookup", "true")  # folders are no columns
    names = jvm.org.apache.hadoop.util.StringUtils.getStringCollection("\0".join(files), "\0")
    return reader._df(reader._jreader.load(jvm.PythonUtils.toSeq(names)))


def read_chosen(spark: SparkSession, root: str, paths: DataFrame, make: Callable[[DataFrame], DataFrame], out: str, block: int = BLOCK_PATHS) -> DataFrame | None:
    """What ``make`` turns (path, content) of the chosen files into, as a table at ``out``; None without any path.

    Only these files are listed and opened, whatever else lies in the corpus.  They are read a block of paths after
    another, each an ordinary scan over its own files, so that neither the driver nor a plan ever holds all of them.
    A path that is null is none; one that is no file fails the read.
    """
    root, schema = corpus_root(spark, root), None
    for chosen in blocks_of_paths(paths, block):
        files = [f"{root}/" + re.sub(r"([\\\[\]{}*?])", r"\\\1", path) for path in chosen]  # names are no patterns
        with few_listing_tasks(spark):
            opened = _open_files(spark, files)
        rows = make(_few_tasks(opened).select(_relative(root).alias("path"), "content"))
        rows.write.mode("append").parquet(out)
        schema = rows.schema
    return None if schema is None else spark.read.schema(schema).parquet(out)


def scan_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """relpath, package_id (second segment), sha256 of a staged tree."""
    rows = _binary(spark, root.rstrip("/"), glob).select(_relative(root.rstrip("/")).alias("relpath"), F.sha2("content", 256).alias("sha256"))
    return rows.withColumn("package_id", F.get(F.split("relpath", "/"), 1)).select("relpath", "package_id", "sha256")
