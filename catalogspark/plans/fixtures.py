"""Views over the given tables that stand for a catalogue: one text for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "documents", "lineitem", "part", "customer", "pages", "events", "conversations")


def _words(engine: str) -> dict[str, str]:
    spark = engine == "spark"
    return {"S": "string" if spark else "varchar", "H": "sha2" if spark else "sha256", "E": ", 256)" if spark else ")", "L": "length"}


def _version(where: str, shift: int, old: bool) -> str:
    tail = " || case when o_orderkey % 7 = 0 then '|old' else '' end" if old else ""
    return f"""
select 'C.' || cast(o_custkey as {{S}}) package_id, 'c/' || cast(o_custkey as {{S}}) || '/' || cast(o_orderkey + {shift} as {{S}}) version_dir,
  cast(year(o_orderdate) as {{S}}) || '.' || cast(month(o_orderdate) as {{S}}) || '.' || cast(o_orderkey % 4 as {{S}}) package_version,
  case when o_orderkey % 10 = 0 then 'beta' else '' end channel,
  {{H}}(concat_ws('|', o_orderstatus, o_orderpriority, cast(cast(round(o_totalprice * 100) as bigint) as {{S}}){tail}){{E}} content_sha
from orders {where}"""


_FILE = """
select lang || '/' || source || '/' || cast(doc_id {shift} as {{S}}) path, lang || '/' || source version_dir, n_chars size, doc_id % 1000 mtime,
  {{H}}(text{tail}{{E}} raw_sha256 from documents {where}"""



def _fragments(folder: str, source: str) -> str:
    """A conversation as a group of fragments: turn 0 the version, 1 the installer, 2 the default locale, others locales; some break a rule."""
    item = lambda i: f"""'{{{{"Architecture":"x{'86' if i == 1 else '64'}","InstallerUrl":"u/' || cast(conv_id % 13 as {{S}}) || '"}}}}'"""
    return f"""
select {folder} version_dir, conv_id, turn, cast(turn as {{S}}) || '.yaml' file_name,
  case when turn = 0 then 'version' when turn = 1 then 'installer' when turn = 2 then 'defaultlocale' when conv_id % 29 = 3 and turn = 4 then 'mystery' else 'locale' end frag_type,
  'V.' || cast(conv_id % 40 as {{S}}) || case when conv_id % 23 = 4 and turn = 1 then 'x' else '' end id, '1.' || cast(conv_id % 7 as {{S}}) ver,
  case when conv_id % 31 = 5 and turn = 3 then null else '1.6.0' end mver, case when turn = 0 then case when conv_id % 19 = 6 then 'de-DE' else 'en-US' end end dl,
  case when turn = 2 then 'en-us' when turn > 2 then 'L' || cast(100 - turn as {{S}}) || '-' || role end pl, case when turn >= 2 then role || ' Inc' end pub,
  case when turn >= 2 then 'Name ' || cast(conv_id % 11 as {{S}}) || case when turn = 2 then ' x64' else '' end end name,
  case when turn = 2 then '["a","t' || cast(conv_id % 5 as {{S}}) || '"]' end tags, case when turn = 1 then 'exe' end itype, 1 + conv_id % 3 n_inst,
  case when turn = 1 and conv_id % 17 <> 7 then '[' || {item(0)} || case when conv_id % 3 > 0 then ',' || {item(1)} else '' end || case when conv_id % 3 > 1 then ',' || {item(2)} else '' end || ']' end inst
from {source}"""


VIEWS = {
    "ver_now": _version("", 0, False),
    "ver_prev": _version("where o_orderkey % 11 <> 0", 0, True) + " union all " + _version("where o_orderkey % 13 = 0", 10_000_000, False),
    "files_now": _FILE.format(shift="", tail="", where=""),
    "files_prev": _FILE.format(shift="", tail=" || case when doc_id % 5 = 0 then 'x' else '' end", where="where doc_id % 9 <> 0") + " union all " + _FILE.format(shift="+ 10000000", tail="", where="where doc_id % 17 = 0"),
    "child_now": """
select distinct 'o/' || cast(l_orderkey as {S}) version_dir, {H}(concat_ws('|', cast(l_partkey as {S}), cast(l_suppkey as {S}), cast(l_linenumber as {S})){E} child_sha from lineitem""",
    "child_prev": """
select distinct 'o/' || cast(l_orderkey as {S}) version_dir, {H}(concat_ws('|', cast(l_partkey as {S}), cast(l_suppkey as {S}), cast(l_linenumber as {S})) || case when l_partkey % 19 = 0 then 'x' else '' end{E} child_sha
from lineitem where l_orderkey % 7 <> 0 and not (l_orderkey % 5 = 0 and l_linenumber = 1)""",
    "child_lines": """
select 'o/' || cast(l_orderkey as {S}) owner, l_partkey, l_linenumber from lineitem""",
    "attrs": """
select distinct 'C.' || cast(o_custkey as {S}) package_id, 'c/' || cast(o_custkey as {S}) || '/' || cast(o_orderkey as {S}) version_dir, p_brand brand, p_type type, p_name name
from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey""",
    "attrs_prev": """
select distinct 'C.' || cast(o_custkey + case when o_orderkey % 8 = 3 then 1 else 0 end as {S}) package_id, 'c/' || cast(o_custkey as {S}) || '/' || cast(o_orderkey as {S}) version_dir,
  case when o_orderkey % 7 = 0 then p_brand || '|old' else p_brand end brand, p_type type, case when p_partkey % 9 = 2 then null else p_name end name
from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_orderkey % 11 <> 0""",
    "claims": """
select distinct package_id, 'P' || cast(l_partkey as {S}) value, version_dir, package_version, channel
from (""" + _version("", 0, False).replace("\nselect ", "select o_orderkey, ", 1) + """) v join lineitem on l_orderkey = o_orderkey""",
    "names": """
select p_partkey id, p_name || case p_partkey % 5 when 0 then ' (x64)' when 1 then ' en-US 32-bit' when 2 then ' X86_64 2.0' when 3 then ' [de-DE] 64 bit' else ' x86 x64' end display from part""",
    "titles": """
select doc_id id, text || case doc_id % 4 when 0 then ' (x64)' when 1 then ' Größe SARL' when 2 then ' Éditions 32-bit' else ' GmbH' end display from documents where text is not null""",
    "publishers": """
select c_custkey id, c_mktsegment || case c_custkey % 5 when 0 then ' Holdings LLC' when 1 then ', Inc.' when 2 then ' & Sons GmbH, Berlin' when 3 then '' else ' Co Ltd' end publisher from customer""",
    "paths": r"""
select distinct regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') path from pages""",
    "published": """
select lang || '/' || cast(doc_id as {S}) relpath, {H}(text{E} sha256 from documents where doc_id % 6 <> 0""",
    "actual": """
select lang || '/' || cast(doc_id as {S}) relpath, {H}(text || case when doc_id % 8 = 0 then 'x' else '' end{E} sha256 from documents where doc_id % 10 <> 0""",
    "builds": """
select cast(user_id as bigint) build_id, min(epoch_s) started, case when user_id % 4 = 0 then null else max(epoch_s) end finished,
  case user_id % 5 when 0 then 'published' when 1 then 'staged' when 2 then 'staged_reused' when 3 then 'failed' else 'running' end status
from (select user_id, cast({EPOCH} as bigint) epoch_s from events) e group by user_id""",
    "build_events": """
select cast(user_id as bigint) build_id, event_id seq, cast({EPOCH} as bigint) at_s, event_type status from events""",
    "frag": _fragments("'conv/' || cast(conv_id as {S}) || '/1.' || cast(conv_id % 7 as {S})", "conversations"),
    "frag_files": _fragments(
        "'p=' || cast(conv_id as {S}) || '/v=1.' || cast(conv_id % 7 as {S})", "(select conv_id, turn, role from conversations union all select conv_id, 99, 'user' from conversations where conv_id % 10 = 2 and turn = 0) c"
    ),
    "scalars": """
select event_id id, case event_id % 5 when 0 then '"' || event_type || '"' when 1 then cast(event_id as {S}) when 2 then 'true' when 3 then props else '["x"]' end json from events""",
}


#: Views of distinct rows, as the rows come: for operators that make them distinct in a shuffle of their own.
ROWS = {f"{name}_rows": VIEWS[name].replace("select distinct ", "select ", 1) for name in ("claims", "attrs", "attrs_prev")}
VIEWS |= ROWS


def view_sql(name: str, engine: str) -> str:
    words = _words(engine) | {"EPOCH": "unix_seconds(cast(ts as timestamp))" if engine == "spark" else "floor(epoch(ts))"}
    return VIEWS[name].format(**words)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = view_sql(name, "spark")
    for t in TABLES:
        if f" {t}" in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def duck(names: list[str], body: str) -> str:
    return "with " + ", ".join(f"{n} as ({view_sql(n, 'duckdb')})" for n in names) + " " + body
