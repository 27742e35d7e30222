import pytest
from pyspark.sql import functions as F

from catalogspark.llm import warc_fixity as wf
from tests.oracle import compare


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    ours, theirs = compare(spark, "op6_warc_fixity", f"/root/testdata/{sf}")
    assert ours == theirs and ours


def archive(spark, tmp_path, pages, name="a", **more):
    root = f"file://{tmp_path}/{name}"
    wf.write_archive(pages, root, **more)
    return root


def test_records_are_read_back(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "<p>é\r\n\r\nWARC/1.0 " + "x" * (i * 37 % 900)) for i in range(500)]
    rows += [(None, None, None), (None, "u\r\nv", ""), (4, "http://h/4", "again"), (4, "http://h/4", "again"), (900, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, mark int").repartition(3)
    root = archive(spark, tmp_path, pages, file_bytes=100_000)
    got = wf.read_archive(spark, root, with_record=True).orderBy("file", "nth").collect()
    assert len(got) == len(rows) and len({r.file for r in got}) > 5
    assert sorted(r.record.split("\r\n\r\n", 1)[1] for r in got) == sorted(h or "" for _, _, h in rows)
    ids = [-1 if r.page_id is None else r.page_id for r in got]
    assert ids == sorted(ids) and sorted(ids) == sorted(-1 if r[0] is None else r[0] for r in rows)
    ends = {}
    for r in got:
        assert r.offset == ends.get(r.file, 0) and r.length == len(r.record.encode()) + 4
        ends[r.file] = r.offset + r.length
    assert [r.copy for r in got if r.page_id == 4 and "again" in r.record] in ([0, 1], [0, 0])
    out, report = wf.audit_archives(spark, root, root)
    assert out.count() == 0 and len(report) == 1 and report[0][1:] == (1, 0)


def test_damage_is_found_by_descending(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>" + "x" * (i * 37 % 9000)) for i in range(2000)], "page_id long, url string, html string")
    root = archive(spark, tmp_path, pages, file_bytes=1_000_000)
    a = wf.read_archive(spark, root)
    b = a.where("page_id <> 77").withColumn("hash", F.when(F.col("page_id") == 1500, F.lit("bad")).otherwise(F.col("hash")))
    b = b.unionByName(a.where("page_id = 12").withColumns({"record_id": F.lit("other"), "offset": F.lit(10**8).cast("long")}))
    out, report = wf.audit(wf.leaves(a, b))
    assert {(r.status, r.page_id) for r in out.collect()} == {("missing", 77), ("altered", 1500), ("extra", 12)}
    level, compared, wrong = report[-1]
    assert level == 0 and wrong == 3 and compared <= 3 * 16 and report[0][1] == 1


def test_lost_lengths_and_heads():
    one = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:1:a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    short = one.replace(b": 3", b": 9")
    data = one + short + b"junk\r\n\r\n" + one
    assert [(a, b, n) for a, b, n in wf.parse(data)] == [(0, len(one), "urn:page:1:a"), (len(one), len(one) + len(short) + 8, "urn:page:1:a"), (len(data) - len(one), len(data), "urn:page:1:a")]
    assert b"".join(data[a:b] for a, b, _ in wf.parse(data[: len(one) + 20])) == data[: len(one) + 20]
    assert list(wf.parse(b"")) == []


def test_equal_rows_are_spread_and_empty_tables(spark, tmp_path):
    same = spark.range(9000).selectExpr("5L AS page_id", "'u' AS url", "repeat('z', 20) AS html").repartition(4)
    root = archive(spark, tmp_path, same, file_bytes=200_000)
    index = wf.read_archive(spark, root)
    sizes = [r["count"] for r in index.groupBy("file").count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 3 * 9000 / len(sizes) and len(sizes) > 5
    assert wf.audit(wf.leaves(index, index))[0].count() == 0
    missing = wf.audit(wf.leaves(index, index.where("nth <> 3")))[0].groupBy("status").count().collect()
    assert {r.status for r in missing} == {"missing"}
    assert wf.audit_pages(same.limit(0)).count() == 0
