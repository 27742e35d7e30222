"""Sharding by jump consistent hashing, in column expressions only.

The published algorithm: a linear congruential generator seeded with the key gives a falling chain of jumps, and the
last jump target below the shard count is the shard.  No ring table is kept; going from n to n+1 shards moves 1/(n+1)
of the keys, all of them into the new shard.

Defined results: a null key counts as key 0; a null text has size 16 and crc32 0 (that of no bytes); rows that repeat
a key all go to that key's shard and get slots of their own; very long texts are read whole; an empty table gives an
empty result; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Multiplier of the generator in the published algorithm (a fixed value).
MULTIPLIER = 2862933555777941757

_M32 = 0xFFFFFFFF
#: Slots that are dealt out in one array.
CHUNK = 10_000


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64 on two 32-bit halves held in bigints; no step exceeds 63 bits."""
    c_hi, c_lo = MULTIPLIER >> 32, MULTIPLIER & _M32
    low = lo * (c_lo & 0xFFFF) + 1  # below 2**49
    mid = lo * (c_lo >> 16) + F.shiftright(low, 16)  # below 2**49
    carry = F.shiftright(mid, 16)
    new_lo = F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(low.bitwiseAND(F.lit(0xFFFF)))

    def times(x: Column, c: int) -> Column:
        """x * c modulo 2**32 for 32-bit x and c."""
        upper = (x * (c >> 16)).bitwiseAND(F.lit(0xFFFF))
        return (x * (c & 0xFFFF) + F.shiftleft(upper, 16)).bitwiseAND(F.lit(_M32))

    new_hi = (carry + times(hi, c_lo) + times(lo, c_hi)).bitwiseAND(F.lit(_M32))
    return new_hi, new_lo


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a bigint key.

    A chain has about ln(shards) jumps.  All keys take a few times as many steps; only for a key whose chain isn't over
    by then the rest is worked out, in as many steps as always end it (the chain rises strictly).
    """
    if not 1 <= shards <= 2**20:
        raise ValueError("shards must be between 1 and 2**20")
    long = lambda x: F.lit(x).cast("long")
    key = F.coalesce(key.cast("long"), long(0))
    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(long(_M32)).alias("lo"), long(-1).alias("b"), long(0).alias("j"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(2**31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), jump.alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    times = lambda n: F.sequence(F.lit(1), F.lit(n))
    usual = F.aggregate(times(8 + 3 * math.ceil(math.log(shards + 1))), start, step)
    whole = lambda s: F.when(s["j"] >= shards, s["b"]).otherwise(F.aggregate(times(shards + 1), s, step, lambda x: x["b"]))
    return F.get(F.transform(F.array(usual), whole), 0).cast("int")  # a one-row transform binds the usual steps


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", parts: int = 64) -> DataFrame:
    """Every row with its shard, its gapless slot in the shard and its shard once one more is appended.

    Slots run over ``parts`` hashed parts of each shard in turn and by key inside a part, so that no task sorts a
    whole shard; the parts' sizes are ``shards * parts`` counts, the only thing that is broadcast.  Rows that agree in
    key, size and crc32 are counted before any shuffle and numbered as one, so repeated rows gather nowhere.
    """
    key, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = docs.select(
        key.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        crc.alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(key, crc), F.lit(parts)).cast("int").alias("part"),
    )
    groups = rows.groupBy("shard", "part", "doc_id", "text_crc32", "size", "grown_shard").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("nth", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), ["shard", "part"])
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("first")
    each = F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + CHUNK) - 1)).alias("k")
    spread = placed.select("*", first).select("*", each)
    return spread.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth") + F.col("k")).alias("slot"), "grown_shard")
