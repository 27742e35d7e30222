"""Merkle fixity audit of WARC replicas.

``write_archive`` lays pages out as WARC records in order of id, end to end in gzip files of about ``FILE_BYTES`` (cut by
ranges of ids, so a repeated id is spread over files), and ``read_archive`` reads the records of such files back with
their places and the sha256 of their bytes.  A record's place in the archive is the length of all files before it plus
its offset in its file.

Hash trees stand over ordered offset ranges: 64 KiB of places, and then always sixteen ranges under one node up to the
root, so no node ever has more than a few hundred children.  A replica's record takes the place that the expected
archive has for its record id (and copy of that id in the file); records that it doesn't know come behind the end.  An
audit compares the two roots and then, level by level from written tables of nodes, only the children of nodes that
differ, down to the records that are altered, missing or extra.

Defined results: a null url or html is empty in its record; a null page id is written as ``none`` and comes first; line
breaks in a url become blanks; rows that repeat an id have records of their own, in order of their md5, and equal rows
have equal records that count as copies; very long pages are records like others, read whole; an empty table makes an
empty archive and an empty audit; two equal replicas give an empty audit; a record whose head can't be read ends before
the next head and is extra; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.llm.common import delete_path, materialize, materialize_at, new_path

FILE_BYTES, DATE = 16 << 20, "2024-01-01T00:00:00Z"
RANGE_BITS, FAN_BITS = 16, 4
_END = "\r\n\r\n"
INDEX = "file long, nth long, offset long, length long, page_id long, record_id string, copy long, hash string"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """page_id, mark (md5 of url and html), record without its end."""
    url, html = (F.coalesce(pages[c].cast("string"), F.lit("")) for c in (url_col, html_col))
    plain = pages.select(pages[id_col].cast("long").alias("page_id"), F.regexp_replace(url, r"[\r\n]", " ").alias("u"), html.alias("h"), F.md5(F.concat_ws("\n", url, html).cast("binary")).alias("mark"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("mark"), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("u"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("h").cast("string"), F.lit(_END),
    )
    return plain.select("page_id", "mark", F.concat(head, F.col("h")).alias("record"))


def _write(rows: DataFrame, root: str, *order: str) -> None:
    """rows: file, record, ...  One WARC file for each ``file``, its records in the given order."""
    rows.sortWithinPartitions("file", *order).select("file", "record").write.partitionBy("file").option("lineSep", _END).option("compression", "gzip").text(root)


def write_archive(pages: DataFrame, root: str, file_bytes: int = FILE_BYTES, **columns) -> None:
    """All pages as WARC files below ``root``; pages are shuffled once, to the range that is their file."""
    rows = records(pages, **columns)
    size = rows.agg(F.sum(F.octet_length("record") + len(_END))).first()[0] or 0
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))  # equal rows may go to different files
    dealt = dealt.repartitionByRange(max(1, -(-size // file_bytes)), "page_id", "mark", "salt")
    _write(dealt.withColumn("file", F.spark_partition_id()), root, "page_id", "mark")


_HEAD = re.compile(rb"WARC-Record-ID: <([^>]*)>")
_LENGTH = re.compile(rb"Content-Length: (\d+)")


def parse(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(begin, end, record id) of every record; one whose length is wrong ends before the next head."""
    at, end = 0, _END.encode()
    while at < len(data):
        head = data.find(end, at)
        stop, name = -1, ""
        if head >= 0 and data.startswith(b"WARC/1.0\r\n", at):
            found, size = _HEAD.search(data, at, head), _LENGTH.search(data, at, head)
            name = found[1].decode("utf-8", "replace") if found else ""
            stop = head + 8 + int(size[1]) if size else -1
        if not (head < stop <= len(data) and data[stop - 4:stop] == end and (stop == len(data) or data.startswith(b"WARC/1.0\r\n", stop))):
            following = data.find(end + b"WARC/1.0\r\n", at)
            stop = following + 4 if following >= 0 else len(data)
        yield at, stop, name
        at = stop


def _read(with_record: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = int(re.search(r"/file=(\d+)/", path)[1])
                data = gzip.decompress(body.as_py())
                seen: Counter = Counter()
                rows, texts, held = [], [], 0
                for nth, (a, b, name) in enumerate(parse(data)):
                    number = re.match(r"urn:\w+:(\d+):", name)
                    rows.append((file, nth, a, b - a, int(number[1]) if number else None, name, seen[name], hashlib.sha256(data[a:b]).hexdigest()))
                    seen[name] += 1
                    if with_record:
                        texts.append(data[a:b - 4].decode("utf-8", "replace"))
                        held += b - a
                    if len(rows) >= 1024 or held >= 1 << 20:
                        yield _batch(rows, texts, with_record)
                        rows, texts, held = [], [], 0
                if rows:
                    yield _batch(rows, texts, with_record)

    return run


def _batch(rows: list[tuple], texts: list[str], with_record: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.string()]
    cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * with_record, names + ["record"] * with_record)


def read_archive(spark: SparkSession, root: str, with_record: bool = False) -> DataFrame:
    """file, nth, offset, length, page_id, record_id, copy, hash of every record (and the record without its end if asked for)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(root).select("path", "content")
    return files.mapInArrow(_read(with_record), INDEX + ", record string" * with_record)


def _starts(index: DataFrame) -> DataFrame:
    """file, start: one row a file."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return index.groupBy("file").agg(F.sum("length").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))


def leaves(expected: DataFrame, found: DataFrame) -> DataFrame:
    """replica (0 expected, 1 found), place, page_id, file, offset, length, hash of all records of two archives."""
    shown = ["page_id", "file", "offset", "length", "hash"]
    mine = expected.join(_starts(expected), "file").withColumn("place", F.col("start") + F.col("offset")).drop("start")
    size = expected.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size"))
    key = ["file", "record_id", "copy"]
    other = found.join(_starts(found), "file").join(mine.select(*key, F.col("place").alias("known")), key, "left").crossJoin(F.broadcast(size))  # one row
    place = F.coalesce("known", F.col("size") + F.col("start") + F.col("offset"))
    return mine.select(F.lit(0).alias("replica"), "place", *shown).unionByName(other.select(F.lit(1).alias("replica"), place.alias("place"), *shown))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Tables replica, node, hash of every level, from the ranges of 64 KiB to the root; each is written."""
    top = leaf.agg(F.max("place")).first()[0]
    if top is None:
        return []
    ordered = lambda at: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "hash"))), lambda x: x["hash"]), ""), 256).alias("hash")
    out = [materialize(leaf.groupBy("replica", F.shiftright("place", RANGE_BITS).alias("node")).agg(ordered("place")), "warc-nodes")]
    top >>= RANGE_BITS
    while top:
        out.append(materialize(out[-1].groupBy("replica", F.shiftright("node", FAN_BITS).alias("up")).agg(ordered("node")).withColumnRenamed("up", "node"), "warc-nodes"))
        top >>= FAN_BITS
    return out


def _differing(rows: DataFrame, by: str) -> DataFrame:
    a, b = (F.max(F.when(F.col("replica") == i, F.col("hash"))) for i in (0, 1))
    return rows.groupBy(by).agg(a.alias("expected"), b.alias("found"))


def audit(leaf: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The records that differ, and (level, nodes compared, nodes that differ) from the root down as far as it went."""
    nodes, report = tree(leaf), []
    wrong = None
    for level in range(len(nodes) - 1, -1, -1):
        rows = nodes[level]
        if wrong is not None:
            rows = rows.withColumn("up", F.shiftright("node", FAN_BITS)).join(wrong.select(F.col("node").alias("up")), "up", "left_semi")
        seen = materialize(_differing(rows, "node"), "warc-compared")
        wrong = seen.where("NOT expected <=> found")
        report.append((level, *seen.agg(F.count(F.lit(1)), F.count_if(~F.col("expected").eqNullSafe(F.col("found")))).first()))
        if not report[-1][2]:
            break  # nothing below equal roots is looked at
    bad = leaf.limit(0) if wrong is None else leaf.withColumn("up", F.shiftright("place", RANGE_BITS)).join(wrong.select(F.col("node").alias("up")), "up", "left_semi")
    shown = [F.min_by(c, "replica").alias(c) for c in ("page_id", "file", "offset", "length")]
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("altered")
    both = bad.groupBy("place").agg(F.max(F.when(F.col("replica") == 0, F.col("hash"))).alias("expected"), F.max(F.when(F.col("replica") == 1, F.col("hash"))).alias("found"), *shown)
    return both.where("NOT expected <=> found").select("page_id", "file", "offset", "place", "length", "expected", "found", status.alias("status")), report


def audit_archives(spark: SparkSession, expected: str, found: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Audit of the archive at ``found`` against the one at ``expected``."""
    indexes = [materialize_at(read_archive(spark, root), "warc-index") for root in (expected, found)]
    leaf = materialize(leaves(indexes[0][0], indexes[1][0]), "warc-leaves")
    for _, path in indexes:
        delete_path(spark, path)
    return audit(leaf)


def write_damaged(spark: SparkSession, root: str, to: str) -> None:
    """A replica with planted damage, chosen by the records' md5: of 64 records two lose their last character to a zero
    byte, one is lost and one is followed by a record that no one knows."""
    rows = read_archive(spark, root, with_record=True).select("file", "nth", "record")
    h, n = F.md5(F.col("record").cast("binary")), F.length("record")
    begins = lambda x, below: (F.substring(h, 1, 1) == x) & (F.substring(h, 2, 1) < below)
    broken = F.when(F.col("record").endswith(_END), F.col("record")).otherwise(F.concat(F.substring(F.col("record"), F.lit(1), n - 1), F.lit("\x00")))
    kept = F.when(begins("0", "8"), F.array(broken)).when(begins("2", "4"), F.array("record", F.replace("record", F.lit("<urn:page:"), F.lit("<urn:extra:")))).when(~begins("1", "4"), F.array("record"))
    _write(rows.select("file", "nth", F.posexplode(kept).alias("k", "record")), to, "nth", "k")


def audit_pages(pages: DataFrame) -> DataFrame:
    """Write all pages as an archive and a damaged replica of it, read both back and find the damage."""
    spark = pages.sparkSession
    root, copy = new_path(spark, "warc"), new_path(spark, "warc")
    write_archive(pages, root)
    write_damaged(spark, root, copy)
    out, _ = audit_archives(spark, root, copy)
    for path in (root, copy):
        delete_path(spark, path)
    return out.select("page_id", "place", "length", "expected", "found", "status")


SQL = rf"""
with page as (select page_id, md5(coalesce(url, '') || chr(10) || coalesce(html, '')) mark, regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g') u, coalesce(html, '') h from pages)
, rec as (
  select page_id, mark, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || ':' || mark || '>' || chr(13) || chr(10) || 'WARC-Date: {DATE}'
    || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h as record
  from page)
, own as (select *, md5(record) m, strlen(record) + 4 length, sum(strlen(record) + 4) over (order by page_id, mark rows unbounded preceding) - strlen(record) - 4 place from rec)
, kind as (select *, case when m[1] = '0' and m[2] < '8' then 'altered' when m[1] = '1' and m[2] < '4' then 'missing' when m[1] = '2' and m[2] < '4' then 'extra' else '' end status from own)
, two as (
  select page_id, mark, 0 k, status, place, case when status = 'altered' then left(record, length(record) - 1) || chr(0) else record end record from kind where status <> 'missing'
  union all select page_id, mark, 1, 'new', null, replace(record, '<urn:page:', '<urn:extra:') from kind where status = 'extra')
, copy as (select *, (select sum(length) from own) + sum(strlen(record) + 4) over (order by page_id, mark, k rows unbounded preceding) - strlen(record) - 4 own_place from two)
, sealed as (select *, sha256(record || chr(13) || chr(10) || chr(13) || chr(10)) hash from copy)
select x.page_id, x.place::bigint place, x.length::bigint length, sha256(x.record || chr(13) || chr(10) || chr(13) || chr(10)) expected, s.hash found, x.status
from kind x left join sealed s on s.place = x.place where x.status in ('altered', 'missing')
union all select page_id, own_place::bigint, (strlen(record) + 4)::bigint, null, hash, 'extra' from sealed where status = 'new'
"""
