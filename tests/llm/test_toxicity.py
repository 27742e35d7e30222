import zlib

import numpy as np
import pytest

from catalogspark.llm import toxicity as tx


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    s = np.asarray(score)[order]
    _, inv, cnt = np.unique(s, return_inverse=True, return_counts=True)
    mean = np.cumsum(cnt) - (cnt - 1) / 2
    rank[order] = mean[inv]
    label = np.asarray(label)
    n1, n0 = label.sum(), (1 - label).sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("sf,least,found,wrong", [("sf0.001", 0.9, 0.5, 0.1), ("sf0.01", 0.9, 0.6, 0.03), ("sf0.1", 0.96, 0.85, 0.01)])
def test_held_out_accuracy(spark, sf, least, found, wrong):
    """Some of the labels are noise: toxic rows without any telling word."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    model = tx.fit(docs, labels)
    rows = tx.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    assert auc(s, y) > least and len({*s.round(6)}) > 10
    assert (s[y == 1] >= 0.5).mean() > found and (s[y == 0] >= 0.5).mean() < wrong
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.selectExpr("doc_id", "quality", "IF(crc32(cast(doc_id AS string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    a, b = tx.fit(docs, labels), tx.fit(docs, flipped)
    assert (a.keys == b.keys).all() and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_odd_rows(spark):
    rows = [(i, ("you idiot clown " if i % 4 == 0 else "a calm line about tea ") * (1 + i % 3)) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "x" * 300_000), (None, "idiot"), (4, rows[4][1])]
    docs = spark.createDataFrame([(*r, 9.0, "idiot") for r in rows], "doc_id long, text string, score double, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    got = [(r.doc_id, r.score, r.predicted) for r in tx.score(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in got)
    assert all(p == int(k % 4 == 0) for k, _, p in got if k is not None and k < 200)
    kept = tx.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {k for k, _, p in got if not p}
    assert tx.score(docs.limit(0), model).count() == 0
    none = tx.fit(docs, labels.where("toxic = 0"))
    assert tx.score(docs, none).where("predicted = 1").count() == 0


def test_risk_never_rewards_negative_part():
    rng = np.random.default_rng(0)
    pos = rng.random((50, 6)) < [0.9, 0.8, 0.5, 0.5, 0.5, 0.5]
    neg = rng.random((400, 6)) < [0.05, 0.1, 0.5, 0.5, 0.5, 0.5]
    more = rng.random((60, 6)) < [0.9, 0.8, 0.5, 0.5, 0.5, 0.5]
    w, b = tx.nn_pu(pos.astype(float), np.concatenate([neg, more]).astype(float), 60 / 460)
    assert ((more @ w + b) > 0).mean() > 0.6 and ((neg @ w + b) > 0).mean() < 0.05


def test_fit_reaches_the_least_risk():
    """Against the risk written out on its own: no step in any direction lowers it much."""
    rng = np.random.default_rng(2)
    pos = (rng.random((80, 3)) < [0.8, 0.3, 0.1]).astype(float)
    unl = (rng.random((500, 3)) < [0.15, 0.3, 0.3]).astype(float)
    prior, l2 = 0.1, 0.01

    def risk(theta):
        g = lambda x: x @ theta[:3] + theta[3]
        loss = lambda z: np.mean(np.log1p(np.exp(-z)))
        return prior * loss(g(pos)) + max(0, loss(-g(unl)) - prior * loss(-g(pos))) + l2 / 2 * (theta[:3] ** 2).sum()

    w, b = tx.nn_pu(pos, unl, prior, steps=3000, l2=l2)
    at = np.append(w, b)
    for _ in range(200):
        assert risk(at + rng.normal(0, 0.05, 4)) > risk(at) - 1e-4
    assert risk(at) < risk(np.zeros(4))
