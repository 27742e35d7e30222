import random
import re

import numpy as np
import pytest

from catalogspark.llm import minhash
from catalogspark.llm.shingles import shingle_sets


def brute(rows: list[tuple], size: int = 5) -> dict[int, tuple]:
    sets = {}
    for d, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    index: dict[tuple, list[int]] = {}
    for d in ids:
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    seen = set()
    for held in index.values():
        for i, a in enumerate(held):
            for b in held[i + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(spark, rows, **more):
    docs = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, component_id long, n string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, **more).collect()}
    assert got == brute(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_of_edits_and_odd_texts(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 5, 8])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "ONE  two\n"), (205, "one two three"), (206, "ä" * 70_000), (207, " ".join(base * 200)), (208, rows[3][1])]
    check(spark, rows)
    check(spark, rows, block_bytes=4000)


def test_repeated_rows_and_null_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), None: (2, 1, True)} or got[1] == (2, 1, True) and got[2] == (2, 1, False)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signature_agrees_with_similarity():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]  # 1500 of 2500 are common
    sig = minhash.superminhash(np.concatenate([a, b]), np.array([0, 2000, 4000]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.05
    assert (sig != np.iinfo(np.uint64).max).all()


def test_every_register_is_one_permutation():
    h = np.array([12345], np.uint64)
    sig = minhash.superminhash(h, np.array([0, 1]), 64)[0]
    assert sorted(int(v) >> 48 for v in sig) == list(range(64))


def test_shingles_of_bytes():
    text = "One two\tTHREE  four\nfive sixé"
    raw = np.frombuffer(text.encode(), np.uint8)
    low = np.frombuffer("one two three four five sixé".encode(), np.uint8)
    x, _ = shingle_sets(raw, np.array([0, len(raw)]), 5)
    y, _ = shingle_sets(low, np.array([0, len(low)]), 5)
    assert len(x) == 2 and (x == y).all()


@pytest.mark.parametrize("n", [1, 3, 5])
def test_no_words_no_shingles(n):
    _, bounds = shingle_sets(np.frombuffer(b" \n" * n, np.uint8), np.array([0, n, 2 * n]), 5)
    assert list(bounds) == [0, 0, 0]


def test_many_documents_around_one_passage(spark):
    """A passage that is over half of each document: buckets are full of pairs that aren't alike, and of some that are."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(240):
        own = [word() for _ in range(rnd.choice([6, 12, 20, 30]))]
        rows.append((i, " ".join(passage + own)))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join([word(), *passage, *own[:-1]])))
    check(spark, rows)
    check(spark, rows, block_bytes=3000)
