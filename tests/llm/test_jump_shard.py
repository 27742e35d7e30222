import zlib

from catalogspark.llm.jump_shard import jump_hash, shard_documents


def jump(key: int, shards: int) -> int:
    """The published loop, in plain integers."""
    key %= 2**64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_equals_published_loop(spark):
    keys = [0, 1, 2, 7, 10**6, 2**31, 2**40 + 3, 2**63 - 1, -1, -(2**63), None, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 3, 40, 41, 300, 20_000):
        got = df.select("k", jump_hash(df.k, n).alias("s")).collect()
        assert [r.s for r in got] == [jump(k or 0, n) for k in keys]


def test_documents(spark):
    text = ["a", None, "", "ä€", "a", "x" * 200_000]
    rows = [(i * 7, text[i % 6], i) for i in range(600)] + [(0, "a", 0), (0, "a", 0), (None, "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = shard_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.shard == jump(r.doc_id or 0, 40) and r.grown_shard == jump(r.doc_id or 0, 41)
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
    by_id = {k: t for k, t, _ in rows}
    for r in got:
        raw = (by_id[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shard_documents(docs.limit(0)).count() == 0


def test_long_chains(spark):
    """Keys whose chain is longer than the usual number of steps."""
    def jumps(key, shards):
        n, b, j = 0, -1, 0
        while j < shards:
            b, n = j, n + 1
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return n
    long = [k for k in range(60_000) if jumps(k, 3) > 2 and jumps(k, 40) > 10][:40]
    assert long
    df = spark.createDataFrame([(k,) for k in long], "k long")
    assert [r.s for r in df.select(jump_hash(df.k, 40).alias("s")).collect()] == [jump(k, 40) for k in long]
    whole = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
    for n in whole:
        assert [r.s for r in df.select(jump_hash(df.k, n).alias("s")).collect()] == [jump(k, n) for k in long]


def test_many_equal_rows(spark):
    docs = spark.range(45_000).selectExpr("if(id % 3 = 0, 5L, id) AS doc_id", "if(id % 3 = 0, 'same', cast(id AS string)) AS text").repartition(3)
    got = shard_documents(docs).collect()
    assert len(got) == 45_000 and sum(r.doc_id == 5 for r in got) == 15_001
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
