"""Merkle fingerprints of documents, in column expressions only.

A document is a tree: sections of ``SECTION`` paragraphs, paragraphs (lines), leaves.  A paragraph is cut into leaves
after a stop, comma, colon, bar, a word that ends in d or t, or, in scripts without blanks, a stop or one of the most
frequent particles, so that an edit changes the leaves it touches and no others.  Every hash is a sha256: of a leaf's
text, of the hashes below for paragraph, section and root.  Equal roots mean equal texts; where roots differ, sections
and then the paragraphs of a differing section tell where.

The fingerprint is one string: the root in full, then the first 48 bits (8 characters of base64) of each section,
paragraph and leaf, divided by colons.  Two fingerprints are alike to the share of distinct leaves that they have in
common.

Defined results: a null text is empty; an empty text has one empty paragraph and no leaves; texts without leaves are
alike to 1 if equal, else 0; rows that repeat an id are all kept, and as a "next" document the one with the least
text stands for them; a null id comes after all others; other columns, whatever their names, are not read; an empty
table gives an empty result.  Texts, however long, are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION = 8
LEAF = r"(?s).*?(?:[.,;:!?|。、，；：！？的了是在のにはを]|[dt] )|.+"
RANGE_BYTES, MAX_RANGES = 2 << 20, 100_000
HOT_ROWS, SALTS = 20_000, 64


def _hashes(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add ``to``: the fingerprint of column ``text``."""
    leaves, paras, sections = f"_{to}_l", f"_{to}_p", f"_{to}_s"
    df = df.withColumn(leaves, F.transform(F.split(F.col(text), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x.cast("binary"), 256))))
    df = df.withColumn(paras, F.transform(leaves, lambda a: F.sha2(F.array_join(a, ""), 256)))
    df = df.withColumn(sections, F.transform(F.sequence(F.lit(0), F.floor((F.size(paras) - 1) / SECTION).cast("int")), lambda i: F.sha2(F.array_join(F.slice(F.col(paras), i * SECTION + 1, F.lit(SECTION)), ""), 256)))
    short = lambda a: F.array_join(F.transform(a, lambda x: F.base64(F.unhex(F.substring(x, 1, 12)))), "")
    whole = F.concat_ws(":", F.sha2(F.array_join(sections, ""), 256), short(F.col(sections)), short(F.col(paras)), short(F.flatten(leaves)))
    return df.withColumn(to, whole).drop(leaves, paras, sections)


def fingerprint(df: DataFrame, text_col: str, to: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text column; the text of a null is empty."""
    return _hashes(df.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))), "_text", to).drop("_text")


def _part(fp: Column, n: int, width: int = 8) -> Column:
    """The n-th list of a fingerprint (1: sections, 2: paragraphs, 3: leaves)."""
    return F.regexp_extract_all(F.split(fp, ":")[n], F.lit(f".{{{width}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: equal roots give 1; else the share of distinct leaves in common."""

    def share(x: Column, y: Column) -> Column:
        return F.when(F.size(x) + F.size(y) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))

    # a one-row transform binds the two leaf lists, so that each is cut out of its string once
    both = F.array(F.struct(_part(a, 3).alias("x"), _part(b, 3).alias("y")))
    return F.when(a == b, F.lit(1.0)).otherwise(F.get(F.transform(both, lambda p: share(p["x"], p["y"])), 0))


def first_difference(a: Column, b: Column) -> Column:
    """Number of the first paragraph that differs (null if none): through the first differing section only."""

    def differs(x: Column, y: Column, at: Column) -> Column:
        return ~F.get(x, at).eqNullSafe(F.get(y, at))

    sa, sb, pa, pb = _part(a, 1), _part(b, 1), _part(a, 2), _part(b, 2)
    section = F.filter(F.sequence(F.lit(0), F.greatest(F.size(sa), F.size(sb)) - 1), lambda i: differs(sa, sb, i))
    begin = F.get(section, 0) * SECTION
    inside = F.filter(F.sequence(begin, begin + SECTION - 1), lambda i: differs(pa, pb, i))
    return F.when(F.size(section) == 0, None).otherwise(F.get(inside, 0))


def with_next(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows: doc_id, key, text.  Adds ``fingerprint`` and ``nxt`` (text and fingerprint) of the next lower key, after the last the first.

    Of a key with more than ``hot_rows`` rows only the row that stands for it takes part in the ranges; what is next to
    it is then joined to all its rows, dealt to ``SALTS`` parts.
    """
    hot = [r["key"] for r in rows.groupBy("key").count().where(F.col("count") > hot_rows).select("key").collect()]  # one in hot_rows keys at most
    if not hot:
        return _ranged(rows)
    many = rows.where(F.col("key").isin(hot))
    heads = many.groupBy("key").agg(F.min(F.struct("text", "doc_id")).alias("r")).select("r.doc_id", "key", "r.text")
    done = _ranged(rows.where(~F.col("key").isin(hot)).unionByName(heads))
    after = done.where(F.col("key").isin(hot)).select("key", "nxt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = many.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(after, ["key", "_salt"])
    return done.where(~F.col("key").isin(hot)).unionByName(fingerprint(dealt.drop("_salt"), "text").select(*done.columns))


def _ranged(rows: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``with_next`` by ranges of keys.

    Rows are dealt to ranges of keys between quantiles (the only values that reach the driver), as many as give ranges
    of ``range_bytes`` of text, but MAX_RANGES at most; each range also gets a copy of the head of the range below it, so that one shuffle and a window inside ranges are enough.  Of
    rows that share a key the one with the least text is the next of others.
    """
    size = rows.agg(F.sum(F.octet_length("text")).alias("size"), F.max("key").alias("top")).first()
    if size["top"] is None:
        heads = [0]
    else:
        parts = min(MAX_RANGES, size["size"] // range_bytes + 2)
        marks = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("q")).first()
        heads = sorted({*marks["q"], size["top"]})
    bounds = F.split(F.lit(",".join(map(str, heads))), ",").cast("array<bigint>")
    halve = lambda s, _: F.when(F.get(bounds, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) >= F.col("key"), F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))).otherwise(
        F.struct(F.least(s["hi"], F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))
    )
    at = F.aggregate(F.sequence(F.lit(1), F.lit(len(heads).bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(len(heads) - 1).alias("hi")), halve, lambda s: s["lo"])
    placed = rows.withColumn("_at", at)
    above = F.pmod(F.col("_at") + 1, F.lit(len(heads)))
    own = F.struct(F.col("_at").alias("r"), F.lit(0).alias("copy"))
    dealt = placed.withColumn("_r", F.explode(F.when(F.get(bounds, F.col("_at")) == F.col("key"), F.array(own, F.struct(above.alias("r"), F.lit(1).alias("copy")))).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, F.col("_r.r").alias("_r"), F.col("_r.copy").alias("_copy"))
    order = Window.partitionBy("_r").orderBy("_copy", F.desc("key"), "text")
    first = (F.lag("key").over(order) != F.col("key")) | F.lag("key").over(order).isNull() | (F.lag("_copy").over(order) != F.col("_copy"))
    made = fingerprint(dealt.withColumn("_first", first), "text").withColumn("_given", F.when(F.col("_first"), F.struct("text", "fingerprint")))
    return made.withColumn("nxt", F.expr("lead(_given) IGNORE NULLS OVER (PARTITION BY _r ORDER BY _copy, key DESC, text)")).where("_copy = 0").drop("_r", "_copy", "_first", "_given")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each document, its text with the last half replaced from the next document, and how alike they are."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63))).alias("key"), text.alias("text"))
    joined = with_next(base, hot_rows).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int")), F.substring(F.col("nxt.text"), F.lit(1), F.col("_half")))
    made = fingerprint(joined.withColumn("edited", edited), "edited", "edited_fingerprint")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("nxt.fingerprint")).alias("near_next"),
        first_difference(F.col("fingerprint"), F.col("edited_fingerprint")).cast("long").alias("edited_paragraph"),
    )


def sql() -> str:
    """The same in DuckDB over ``documents`` (distinct ids)."""
    def tree(text: str, name: str) -> str:
        leaves = f"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}', 0), lambda x: sha256(x)))"
        return f"""
, {name}_l as (select *, {leaves} l from {name})
, {name}_p as (select *, list_transform(l, lambda a: sha256(array_to_string(a, ''))) p from {name}_l)
, {name}_s as (select *, list_transform(range(0, (len(p) - 1) // {SECTION} + 1), lambda i: sha256(array_to_string(p[i * {SECTION} + 1:i * {SECTION} + {SECTION}], ''))) s from {name}_p)
, {name}_f as (select doc_id, p, s, list_transform(flatten(l), lambda x: x[1:12]) c,
    concat(sha256(array_to_string(s, '')), ':', array_to_string(list_transform(s, lambda x: to_base64(unhex(x[1:12]))), ''), ':', array_to_string(list_transform(p, lambda x: to_base64(unhex(x[1:12]))), ''), ':', array_to_string(list_transform(flatten(l), lambda x: to_base64(unhex(x[1:12]))), '')) fp from {name}_s)"""

    def alike(a: str, b: str) -> str:
        return f"case when {a}.fp = {b}.fp then 1.0::double when len(list_distinct(list_concat({a}.c, {b}.c))) = 0 then 0.0::double else len(list_intersect(list_distinct({a}.c), list_distinct({b}.c)))::double / len(list_distinct(list_concat({a}.c, {b}.c))) end"

    return f"""
with own as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n from documents)
, linked as (select *, coalesce(lead(doc_id) over (order by doc_id desc), max(doc_id) over ()) nxt from own)
, edit as (select a.doc_id, a.n, a.nxt, left(a.t, a.n - a.n // 2) || left(b.t, a.n // 2) e from linked a join own b on a.nxt = b.doc_id)
{tree("t", "own")}{tree("e", "edit")}
select o.doc_id, e.n n_chars, sha256(e.e) edited_sha256, f.fp fingerprint, g.fp edited_fingerprint, {alike("f", "g")} near_edited, {alike("f", "h")} near_next,
  (list_filter(range(0, greatest(len(f.p), len(g.p))), lambda i: coalesce(f.p[i + 1], '') <> coalesce(g.p[i + 1], '')))[1] edited_paragraph
from own o join edit e using (doc_id) join own_f f using (doc_id) join edit_f g using (doc_id) join own_f h on h.doc_id = e.nxt"""
