"""Run a registered query and its SQL side by side."""

import glob
import math

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def compare(spark, name, sf=SF):
    """Rows of both, as sorted lists of reprs over columns in order of name."""
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {path.rsplit('/', 1)[1][:-8]} as select * from '{path}'")
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols, (sorted(names), cols)
    theirs = sorted(repr([_plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in res.fetchall())
    return ours, theirs
