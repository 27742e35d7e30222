"""Listing and reading by tasks: folders are opened level by level, and what they hold goes to a written table, never to the driver."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from fnmatch import translate
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.normalize import parent
from catalogspark.sources.files import READING_TASKS, corpus_root, filesystem

ENTRY = "path string, folder boolean, size bigint, mtime timestamp"
ARROW = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC"))])
#: Entries that go to Spark at a time.
BATCH = 10_000
#: Tasks for each core that open the folders of a level.
FOLDER_TASKS = 2
#: Files, and bytes of files, that go to Spark at a time.
FILES, BYTES = 1_000, 8 << 20
#: File systems that Arrow opens as Hadoop does, whatever the session's settings.
ALIKE = ("file",)

#: (name, is a folder, bytes, time of the last change in microseconds) of what a folder holds.
Entries = Iterable[tuple[str, bool, int, int]]


def arrow_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of ``uri``, and its path there."""
    scheme, authority, path = re.fullmatch(r"([a-z0-9]+):(?://([^/]*))?(.*)", uri).groups()
    bucket = scheme in ("s3", "s3a", "gs", "gcs")
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority or ''}{'' if bucket else '/'}")
    return system, base.rstrip("/") + path.rstrip("/")


def opener(uri: str) -> Callable[[str], Entries]:
    """A function of a path below ``uri`` that lists this folder by Arrow's file systems; a folder that has gone is empty.

    Times are cut to milliseconds, as Spark's own listing has them.
    """
    system, top = arrow_system(uri)

    def entries(folder: str) -> Entries:
        for info in system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/") or "/", allow_not_found=True)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1_000_000 * 1000

    return entries


def hidden(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_files(spark: SparkSession, root: str, out: str, glob: str = "*.yaml", tasks: int | None = None, make: Callable[[str], Callable[[str], Entries]] = opener) -> DataFrame:
    """path (below the root), version_dir, size, mtime of every file, as ``scan_files`` gives them; the table lies at ``out``.

    Each level of folders is a job of ``tasks`` tasks (a few for each core, as each starts a Python function) that opens the
    folders of the level and writes what they hold; the folders among it are the next level.  The driver learns only whether there is one.  A
    folder is listed by one task, so the entries of a single folder must fit there.  Files without bytes and hidden names
    are left out, as Spark does.  A root without files gives no rows, one that does not exist is an error, and a folder
    that goes meanwhile counts as empty.  ``glob`` is about file names
    and knows ``*``, ``?`` and ``[..]``.  ``make`` gives the function that lists a folder, for file systems that Arrow lacks.
    """
    if "{" in glob:
        raise ValueError("alternatives in braces are not supported")
    root = corpus_root(spark, root)
    fs, target = filesystem(spark, root)
    if not fs.exists(target):
        raise FileNotFoundError(root)
    uri, wanted = str(fs.makeQualified(target).toString()), translate(glob)
    tasks = tasks or FOLDER_TASKS * spark.sparkContext.defaultParallelism

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, matches = make(uri), re.compile(wanted).match
        found = (
            (f"{folder}/{name}" if folder else name, is_folder, size, mtime)
            for batch in batches for folder in batch.column(0).to_pylist() for name, is_folder, size, mtime in entries(folder)
            if not hidden(name) and (is_folder or (size and matches(name)))
        )
        for rows in batched(found, BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        levels.append(f"{out}/level={len(levels)}")
        folders.mapInArrow(opened, ENTRY).write.parquet(levels[-1])
        below = spark.read.schema(ENTRY).parquet(levels[-1]).where("folder").select("path")
        if below.isEmpty():
            break
        folders = below.repartition(tasks, "path")  # a number of its own: a folder is few bytes and much to do
    rows = spark.read.schema(ENTRY).parquet(*levels).where("NOT folder")
    return rows.select("path", parent(rows["path"]).alias("version_dir"), "size", "mtime")


def tasks_can_open(spark: SparkSession, root: str) -> bool:
    fs, target = filesystem(spark, root)
    return fs.makeQualified(target).toUri().getScheme() in ALIKE


def read_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """path, content of the distinct paths below ``root``, opened by the tasks that they are dealt to; the driver learns none.

    As with Spark's own reading, a path that is null is none, one that is no file fails the read, and so does a file above
    ``spark.sql.sources.binaryFile.maxLength``.
    """
    root = corpus_root(spark, root)
    fs, target = filesystem(spark, root)
    uri = str(fs.makeQualified(target).toString())
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = arrow_system(uri)
        names, contents, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with system.open_input_file(f"{top}/{name}") as file:
                if file.size() > most:
                    raise ValueError(f"{name} has {file.size()} bytes, more than spark.sql.sources.binaryFile.maxLength")
                names.append(name)
                contents.append(file.read())
            held += len(contents[-1])
            if len(names) == FILES or held >= BYTES:
                yield batch()
                names, contents, held = [], [], 0
        if names:
            yield batch()

    # one shuffle deals and makes distinct; the number is fixed, as a path is few bytes and much to do
    dealt = paths.select("path").where("path IS NOT NULL").repartition(READING_TASKS * spark.sparkContext.defaultParallelism, "path").distinct()
    return dealt.mapInArrow(opened, "path string, content binary")


def write_files(rows: DataFrame, root: str) -> int:
    """Write every row (path below ``root``, content) as a file of its own, by tasks; returns how many.

    A file that is there already is replaced, so a task that is run again leaves the same files.
    """
    spark = rows.sparkSession
    target, path = filesystem(spark, root)
    uri = target.makeQualified(path).toString()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = arrow_system(uri)
        for batch in batches:
            made = set()
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                folder = f"{top}/{name}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder)
                    made.add(folder)
                with system.open_output_stream(f"{top}/{name}") as out:
                    out.write(content.encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("path", "content").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
