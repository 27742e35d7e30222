import random
import re

import numpy as np

from catalogspark.llm import decontaminate as dc


def plain_sw(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_plain_loops():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(1, 18))] for _ in range(2))
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        score, begin, end = dc.smith_waterman(x, y)
        assert score == plain_sw(a, b)
        assert plain_sw(a, b[begin:end]) == score


def split(t):
    return [w.lower() for w in re.findall(r"[0-9A-Za-z'\u0080-\U0010ffff]+", t or "")]


def test_given_tables_against_all_alignments(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(docs, bench).collect()}
    number: dict[str, int] = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in split(t)], np.uint64)
    items = {r.item_id: code(r.text) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        w = code(r.text)
        for k, item in items.items():
            s = dc.smith_waterman(item, w)[0] / (2 * len(item))
            if s >= dc.THRESHOLD:
                want[r.doc_id, k] = s
    assert got == want and want


def test_edits_odd_rows_and_blocks(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("bcdfgaeiou") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(40)] + [(90, None), (91, ""), (92, "two Words"), (93, "UP low ünï")]
    rows = []
    for i in range(400):
        w = [word() for _ in range(200)]
        if i % 4 == 0:
            copy = items[i % 40][1].upper().split()
            for at in rnd.sample(range(30), 3):
                copy[at] = word()
            w[50:50] = copy[:12] + [word()] + copy[12:]
        rows.append((i, ", ".join(w)))
    rows += [(500, None), (501, ""), (502, "some two, words"), (503, "up LOW ünï"), (504, "x " * 100_000 + items[3][1]), (505, items[5][1]), (505, items[5][1]), (506, "(TWO, words.)"), (None, items[6][1])]
    docs = spark.createDataFrame([(*r, 1.0, 3) for r in rows], "doc_id long, text string, score double, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.item_id) for r in dc.contaminated(docs, bench).collect())
    want = sorted([(i, i % 40) for i in range(0, 400, 4)] + [(503, 93), (504, 3), (505, 5), (505, 5), (506, 92), (-1, 6)])
    assert got == want
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(want)
    assert dc.contaminated(docs.limit(0), bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0


def test_repeated_edited_copy_against_all_alignments(spark):
    rnd = random.Random(3)
    item = [f"item{i}" for i in range(30)]
    edited = [f"other{i}" if i in (3, 7, 11, 15, 19, 22) else w for i, w in enumerate(item)]
    assert sum(edited[i:i + 4] == item[i:i + 4] for i in range(27)) == 4
    number: dict[str, int] = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in split(t)], np.uint64)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for whole, copies in ((1, 5), (0, 6), (3, 100), (50, 1000)):
        body = [item] * whole + [edited] * copies + [item[:4], item[26:], ["none"]] * 20
        rows = [(i, " ".join([*(f"w{rnd.randrange(999)}" for _ in range(9)), *x, f"end{i}"])) for i, x in enumerate(body)]
        got = {r.doc_id: r.score for r in dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench).collect()}
        score = {i: dc.smith_waterman(code(" ".join(item)), code(t))[0] / 60 for i, t in rows}
        assert got == {i: s for i, s in score.items() if s >= dc.THRESHOLD}
        assert len(got) == whole + copies


def test_bound_of_matches():
    rnd = random.Random(6)
    for _ in range(300):
        a, b = (np.array([rnd.randrange(6) for _ in range(rnd.randrange(1, 15))], np.uint64) for _ in range(2))
        assert dc.smith_waterman(a, b)[0] <= 2 * dc.most_matches(a, b)


def test_each_row_is_judged_by_its_own_text(spark):
    leak = " ".join(f"item{i}" for i in range(12))
    rows = [(None, leak, 1), (None, "a clean text of no item", 2), (7, leak, 3), (7, "another clean text", 4), (7, None, 5), (8, "the", 6), (8, "the cat and the dog", 7), (9, "", 8)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, n long, t1 int, items int").repartition(2)
    bench = spark.createDataFrame([(1, leak), (1, leak), (2, "the"), (3, "the cat")], "item_id long, text string")
    assert {r.n for r in dc.drop_contaminated(docs, bench).collect()} == {2, 4, 5, 7, 8}
    assert sorted((r.doc_id or 0, r.item_id, r.score) for r in dc.contaminated(docs, bench).collect()) == [(0, 1, 1.0), (7, 1, 1.0), (8, 2, 1.0)]


def test_repeated_seeds_of_item_and_text(spark):
    item = ("tick tock " * 8 + "boom goes the clock ") * 3
    rows = [(1, "x y z " + item + " end"), (2, "tick tock " * 500), (3, "boom goes the clock " * 4)]
    number: dict[str, int] = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in split(t)], np.uint64)
    got = {r.doc_id: r.score for r in dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    score = {i: dc.smith_waterman(code(item), code(t))[0] / (2 * len(code(item))) for i, t in rows}
    assert got == {i: s for i, s in score.items() if s >= dc.THRESHOLD} and 1 in got


def test_recall_of_edited_copies_of_any_length(spark):
    """Copies with 10, 20 and 30 % of the words replaced that score enough are found, nine of ten at least at every length."""
    rnd = random.Random(12)
    number: dict[str, int] = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in split(t)], np.uint64)
    lengths, rows, want = (6, 8, 10, 12, 15, 20, 30, 60), [], {}
    items = {k: [f"w{k}x{i}" for i in range(k)] for k in lengths}
    for k in lengths:
        for rate in (0.1, 0.2, 0.3):
            for _ in range(60):
                copy = [w if rnd.random() >= rate else f"e{len(rows)}x{i}" for i, w in enumerate(items[k])]
                text = " ".join([*(f"f{rnd.randrange(999)}" for _ in range(20)), *copy, *(f"f{rnd.randrange(999)}" for _ in range(20))])
                if dc.smith_waterman(code(" ".join(items[k])), code(text))[0] / (2 * k) >= dc.THRESHOLD:
                    want[len(rows)] = (k, rate)
                rows.append((len(rows), text))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = {r.doc_id for r in dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench).collect()}
    assert found <= want.keys()
    for k in lengths:
        for rate in (0.1, 0.2, 0.3):
            of = [i for i, x in want.items() if x == (k, rate)]
            assert len(found.intersection(of)) >= 0.9 * len(of) > 0, (k, rate)
    every_fourth = [w if i % 4 else f"z{i}" for i, w in enumerate(items[30])]
    assert dc.contaminated(spark.createDataFrame([(1, " ".join(every_fourth))], "doc_id long, text string"), bench).count() == 1


def test_more_items_than_one_row_holds(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS", 4)
    items = [(i, f"the same words in all of them and then number {i} at the very end") for i in range(50)]
    docs = spark.createDataFrame([(1, items[7][1]), (2, "the same words in all of them"), (3, "nothing of it")], "doc_id long, text string")
    got = dc.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, i) for i in range(50)}  # 7 of 15 words are too few
    assert next(r.score for r in got if (r.doc_id, r.item_id) == (1, 7)) == 1.0
