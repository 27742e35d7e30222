
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from catalogspark.functions.version import reverse_key, version_key
from catalogspark.operators.rollup import latest_version, rank_versions

# relations that must hold, as (left, relation, right)
PAIRS = [
    ("1.0", "=", "1.0.0"), ("2.0.0.0", "=", "2"), ("1.0.0", ">", "1.0.0-preview.1"), ("1.0.0-preview.2", ">", "1.0.0-preview.1"), ("Version 1.2.0", "=", "1.2"), ("Latest", ">", "9.9.9"),
    ("Unknown", "<", "0.0.1"), ("18446744073709551616", ">", "18446744073709551615"), ("18446744073709551616", "<", "18446744073709551617"), ("3.16.2", ">", "3.15.2"),
    ("11.00.26100.1 (WinBuild.160101.0800)", ">", "2.2.2.1"), ("3.10", ">", "3.2"), ("1", ">", "1.0.0-beta"), ("latest.0", "=", "Latest"), ("< 1", "<", "1"), ("> 1", ">", "1"), ("1.0a", "<", "1.0"),
]


def compare(a: str, b: str) -> int:
    """The order written out on its own, for the test: parts padded with zeros."""

    def read(v):
        v = v.strip()
        approx = -1 if v.startswith("< ") else 1 if v.startswith("> ") else 0
        v = v[2:].strip() if approx else v
        m = re.match(r"[^0-9.]+(?=[0-9])", v)
        parts = []
        for p in (v[m.end():] if m else v).split("."):
            d, s = re.match(r"([0-9]*)(.*)", p.strip(), re.S).groups()
            n = int(d or 0)
            parts.append((min(n, 2**64 - 1), (1, len(d), d) if n >= 2**64 else (0, 0, ""), s == "", s.lower()))
        while parts and parts[-1][0] == 0 and parts[-1][2]:
            parts.pop()
        word = parts[0][3] if len(parts) == 1 and parts[0][0] == 0 else ""
        return {"latest": 1, "unknown": -1}.get(word, 0), parts, approx

    (ra, pa, aa), (rb, pb, ab) = read(a), read(b)
    zero = (0, (0, 0, ""), True, "")
    if ra != rb:
        return 1 if ra > rb else -1
    if not ra:
        for x, y in itertools.zip_longest(pa, pb, fillvalue=zero):
            if x != y:
                return 1 if x > y else -1
    return (aa > ab) - (aa < ab)


@pytest.mark.parametrize("a,rel,b", PAIRS)
def test_written_order(a, rel, b):
    assert compare(a, b) == {"=": 0, ">": 1, "<": -1}[rel]


def test_key_follows_order(spark):
    rnd = random.Random(7)
    piece = ["0", "00", "1", "2", "10", "beta", "0-beta", "1a", "1B", "latest", "unknown", "", "18446744073709551615", "18446744073709551616", "99999999999999999999999", " 3 ", "v1", "1\x01", "1\t2", "1\x00a", "\u20037\u00a0"]
    texts = sorted({p for x in PAIRS for p in (x[0], x[2])} | {rnd.choice(["", "", "< ", "> ", "v", "Version "]) + ".".join(rnd.choice(piece) for _ in range(rnd.randrange(1, 5))) for _ in range(220)})
    df = spark.createDataFrame([(t,) for t in texts], "v string").withColumn("k", version_key(F.col("v")))
    df.createOrReplaceTempView("keys_under_test")
    got = {(r.a, r.b): r.c for r in spark.sql("select x.v a, y.v b, case when x.k = y.k then 0 when x.k > y.k then 1 else -1 end c from keys_under_test x cross join keys_under_test y").collect()}
    wrong = [(a, b, c, compare(a, b)) for (a, b), c in got.items() if c != compare(a, b)]
    assert not wrong, wrong[:5]


def test_reverse_key_sorts_against_the_key(spark):
    rnd = random.Random(9)
    texts = sorted({".".join(rnd.choice(["0", "1", "10", "2-b", "0-a", "x", "latest", ""]) for _ in range(rnd.randrange(1, 5))) for _ in range(150)})
    df = spark.createDataFrame([(t,) for t in texts], "v string").withColumn("k", version_key(F.col("v"))).withColumn("r", reverse_key(F.col("k")))
    rows = df.collect()
    up, down = [r.k for r in sorted(rows, key=lambda r: r.k.encode())], [r.k for r in sorted(rows, key=lambda r: r.r)]
    assert up == down[::-1]


def test_index_order(spark):
    rows = [("p", "d1", "1.0.0", ""), ("p", "d2", "2.0.0", ""), ("p", "d3", "9.0.0", "beta"), ("p", "d4", "2.0", ""), ("q", "d5", "1", "x")]
    df = spark.createDataFrame(rows, "package_id string, version_dir string, package_version string, channel string")
    got = [r.version_dir for r in rank_versions(df).where("package_id = 'p'").orderBy("ordinal").collect()]
    assert got == ["d2", "d4", "d1", "d3"]
    assert {r.package_id: r.version_dir for r in latest_version(df).collect()} == {"p": "d2", "q": "d5"}

