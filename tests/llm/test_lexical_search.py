import math
import random
import re
from collections import Counter

import numpy as np

from catalogspark.llm import lexical_search as lx
from tests.oracle import compare


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    """Ranks by scoring every document for every item."""
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if score:
                scored.append((-score, i is not None, i or 0))
        out += [(item, k, i if known else None, -s) for k, (s, known, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


def test_given_tables_against_all_scores(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows_of(lx.rank(docs, items))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_query_equals_its_sql(spark):
    ours, theirs = compare(spark, "op13_lexical_search")
    assert ours == theirs and ours


def test_ties_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lx, "COLUMNS", 64)
    rnd = random.Random(2)
    word = lambda: rnd.choice(["alpha", "Beta", "gämma", "字", "d4", "x"]) + str(rnd.choice(["", 1, 2, 3]))
    docs = [(i, rnd.choice([" ", ", ", "'"]).join(word() for _ in range(rnd.randrange(1, 30)))) for i in range(300)]
    docs += [(i, "same text for all of Beta1") for i in range(1000, 1100)] + [(None, "same text for all of Beta1"), (1003, "same text for all of Beta1"), (5, None), (6, ""), (7, "..."), (8, "alpha " * 50_000), (None, "gämma")]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(9)] + [(1, "same same TEXT beta1"), (50, None), (51, ""), (52, "nowhere at all"), (None, "x x x"), (50, "字")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in docs], "doc_id long, text string, score int, rank double").repartition(5)
    ask = spark.createDataFrame([(*r, "t") for r in items], "item_id long, text string, terms string")
    want = brute(docs, items)
    assert rows_of(lx.rank(df, ask)) == want
    assert rows_of(lx.rank(df, ask, block_bytes=40)) == want  # many blocks of items
    assert lx.rank(df.limit(0), ask).count() == 0 and lx.rank(df, ask.limit(0)).count() == 0


def test_grid_holds_its_cells_and_maxima():
    rng = np.random.default_rng(4)
    for height, cells in ((1, 1), (3, 20), (6, 500), (7, 1)):
        at = rng.choice(4**height, cells, replace=False)
        row, column, impact = at >> height, at & (1 << height) - 1, rng.integers(1, 1000, cells)
        grid = lx.K2Treap.build(height, row, column, impact)
        full = np.zeros((1 << height, 1 << height), np.int64)
        full[row, column] = impact
        assert len(grid.most) == grid.bits.sum()

        def walk(cell, level, r, c, grid=grid, full=full, height=height):
            size = 1 << (height - level)
            part = full[r:r + size, c:c + size]
            if level:
                assert grid.most[grid.rank[cell] - 1] == part.max()
            if level == height:
                return
            for bit in range(2):
                place, there, most = (x[0] for x in grid.children(np.array([cell]), np.array([bit])))
                for k in range(2):
                    quarter = full[r + bit * size // 2:r + (bit + 1) * size // 2, c + k * size // 2:c + (k + 1) * size // 2]
                    assert there[k] == quarter.any() and most[k] == quarter.max()
                    if there[k]:
                        walk(int(place[k]), level + 1, r + bit * size // 2, c + k * size // 2)

        walk(-1, 0, 0, 0)


def test_bounds_save_work():
    """Of many documents with a term only those near the best are opened; a document that beats all is found last of all."""
    rng = np.random.default_rng(5)
    n = 4096
    impact = np.concatenate([rng.integers(1, 100, n - 1), [10_000]])
    grid = lx.K2Treap.build(12, np.zeros(n, np.int64), np.arange(n), impact)
    best = lx.Best(3, [])
    opened = lx.search(grid, list(range(n)), np.zeros(1, np.int64), np.ones(1, np.int64), best)
    want = sorted(((-s, i) for i, s in enumerate(impact.tolist())))[:3]
    assert sorted((-s, -i) for s, _, i, _ in best.held) == want and opened < n
    assert lx.search(grid, list(range(n)), np.zeros(1, np.int64), np.ones(1, np.int64), lx.Best(3, [(20_000, 0, 0, 0)] * 3)) == 0


def test_two_hashes_tell_words_apart():
    found = sorted({f"{a}{b}" for a in ("", "a", "ab", "字", "x9") for b in range(500)} | {"", "a"})[1:]
    for h in lx.hashes(found):
        assert len(np.unique(h)) == len(found)
    upper, lower = lx.hashes(["ABCé"]), lx.hashes(["abcé"])
    assert upper[0] == lower[0] and upper[1] == lower[1]
