import base64
import hashlib
import re

from pyspark.sql import functions as F

from catalogspark.llm import merkle_text as mt
from tests.oracle import compare


def test_equals_sql(spark):
    ours, theirs = compare(spark, "op4_merkle_fingerprint")
    assert ours == theirs and len(ours) == 1000


def fp(text):
    leaves = [[hashlib.sha256(x.encode()).hexdigest() for x in re.findall(mt.LEAF.replace("(?s)", ""), p, re.S)] for p in text.split("\n")]
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    paras = [sha(x) for x in leaves]
    sections = [sha(paras[i:i + mt.SECTION]) for i in range(0, len(paras), mt.SECTION)]
    short = lambda parts: "".join(base64.b64encode(bytes.fromhex(x[:12])).decode() for x in parts)
    return ":".join([sha(sections), short(sections), short(paras), short(x for a in leaves for x in a)])


def test_odd_rows(spark):
    rows = [(1, "One. Two and three\nfour"), (2, None), (3, ""), (5, "x"), (7, "ä€😀b"), (8, "a, b\n" * 40), (9, "w" * 100_000), (10, "日本語の文章は、長い。それを読む。"), (7, "ä€😀b"), (None, "last")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = mt.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    text = {k: t or "" for k, t in rows}
    order = sorted((k for k in text if k is not None), reverse=True) + [None]
    for r in got:
        t, nxt = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fp(t), fp(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        paras, changed = t.split("\n"), edited.split("\n")
        differ = [i for i in range(max(len(paras), len(changed))) if (paras[i:i + 1] != changed[i:i + 1])]
        assert r.edited_paragraph == (differ[0] if differ else None)
    assert mt.edited_fingerprints(docs.limit(0)).count() == 0
    one = mt.edited_fingerprints(docs.where("doc_id = 5")).first()
    assert one.near_edited == one.near_next == 1.0


def test_keys_with_many_rows(spark):
    rows = [(i % 9 if i % 3 else 4, f"text {i % 7} of {i}, and more\nline") for i in range(120)] + [(None, f"no id {i}") for i in range(30)] + [(20, "alone"), (21, "alone too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = [sorted(map(repr, mt.edited_fingerprints(docs, hot_rows=n).collect())) for n in (10**6, 12, 1)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(rows)


def test_edits_lower_likeness_less_than_other_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") > 400)
    r = mt.edited_fingerprints(docs).agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("share"), F.avg("near_edited").alias("edited")).first()
    assert r.share > 0.9 and r.edited > 0.2
