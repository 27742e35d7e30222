"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts as they come, whatever their labels, are the unlabelled ones.  A linear
classifier over words and word beginnings minimises the class-prior-corrected risk

    prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

with numpy; while the second term is below zero its gradient is reversed, so the model cannot fit it away.  The prior
is the share of toxic rows among all labels that may be learned from.

Fitting uses at most ``positives`` + ``unlabelled`` labelled rows outside the held-out fold, those with the lowest hash
of their id (documented bounds; nothing else is sampled).  Their features are counted in Spark; the ``features`` with
the highest lower bound of their excess in positives are kept, however small the sample.  Only these rows' hits on them
(at most ``features`` small numbers a row) and the model reach the driver.  Every document is scored whole.

Defined results: a null or empty text has the score of a text without features; without any positive label to learn
from every score is 0; rows that repeat an id are scored each; a null id is in fold 0 of crc32('') and never used to
learn; label, language, source and id never are features; very long texts are learned from and scored whole; other
columns, whatever their names, are kept by ``drop_toxic`` and not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import delete_path, id_text, materialize_at, text_slices
from catalogspark.llm.shingles import U, mix, word_hashes, words

#: Bytes of a longer word that make a beginning, each a feature of its own: insults are often stems with many endings.
PREFIXES = (4, 5, 6, 7, 8, 10)
_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = False


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) for every word of the slice and for the beginnings of longer words."""
    starts, ends, first = words(data, offsets, _GAPS)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    whole = word_hashes(data, starts, ends)
    docs, hashes = [doc], [whole]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        docs.append(doc[long])
        hashes.append(mix(word_hashes(data, starts[long], starts[long] + n) ^ U(0x5DEECE66D)))
    return np.concatenate(docs), np.concatenate(hashes)


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


class Model:
    """keys: sorted feature hashes; weights: one each; bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature number) pairs."""
        doc, h = features_of(data, offsets)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        pair = np.unique(doc[hit] * max(1, len(self.keys)) + at[hit])
        return pair // max(1, len(self.keys)), pair % max(1, len(self.keys))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, f = self.present(data, offsets)
        g = self.bias + np.bincount(doc, self.weights[f] if len(f) else None, minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def excess(pos: Column, unl: Column, n_pos: int, n_unl: int) -> Column:
    """Lower bound (two standard errors) of the log of a feature's rate in positives over its rate in unlabelled texts."""
    rate = lambda c, n: (c + 0.5) / F.lit(n + 1.0)
    return F.log(rate(pos, n_pos) / rate(unl, n_unl)) - 2 * F.sqrt(1 / (pos + 0.5) - F.lit(1 / (n_pos + 1.0)) + 1 / (unl + 0.5) - F.lit(1 / (n_unl + 1.0)))


def nn_pu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, l2: float = 4e-5, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with the logistic loss; equal rows count once, with their number."""
    k = x_pos.shape[1]
    (x_pos, n_p), (x_unl, n_u) = (np.unique(x, axis=0, return_counts=True) if len(x) else (x, np.zeros(0)) for x in (x_pos, x_unl))
    w_pos, w_unl = n_p / max(1, n_p.sum()), n_u / max(1, n_u.sum())
    theta, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    along = lambda x, w: np.append(x.T @ w, w.sum())
    best, since = np.inf, 0
    for t in range(1, steps + 1):
        g_pos, g_unl = x_pos @ theta[:k] + theta[k], x_unl @ theta[:k] + theta[k]
        negative = w_unl @ np.logaddexp(0, g_unl) - prior * (w_pos @ np.logaddexp(0, g_pos))
        risk = prior * (w_pos @ np.logaddexp(0, -g_pos)) + max(0.0, negative) + l2 / 2 * (theta[:k] @ theta[:k])
        best, since = (risk, 0) if risk < best - tolerance else (best, since + 1)
        if since > 60:
            break
        d_neg = along(x_unl, w_unl * sigmoid(g_unl)) - prior * along(x_pos, w_pos * sigmoid(g_pos))
        d_pos = -prior * along(x_pos, w_pos * sigmoid(-g_pos))
        grad = d_pos + d_neg if negative >= 0 else -d_neg
        grad[:k] += l2 * theta[:k]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:k], float(theta[k])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, positive, unlabelled) to the distinct features of each text."""
    for batch in batches:
        for at, n, data, offsets in text_slices(batch, "text", 1 << 18):
            doc, h = features_of(data, offsets)
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
            doc, h = doc[new], h[new]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, n), batch.column(3).slice(at, n), lists], ["positive", "unlabelled", "features"])


def _hits(keys: np.ndarray):
    """Features to the numbers of those that are keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            h = col.flatten().to_numpy().view(U)
            row = np.repeat(np.arange(len(col)), col.value_lengths().to_numpy(zero_copy_only=False))
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            hit = keys[at] == h
            ends = np.searchsorted(row[hit], np.arange(len(col) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends), pa.array(at[hit].astype(np.int32)))], ["positive", "unlabelled", "at"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = 4000, unlabelled: int = 8000, features: int = 512) -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out fold."""
    spark, text = docs.sparkSession, id_text(docs, id_col, text_col)
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    toxic, total = known.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count(F.lit(1))).first()
    nothing = Model(np.zeros(0, U), np.zeros(0), -30.0)
    if not toxic:
        return nothing
    prior = min(0.9, max(0.001, toxic / total))
    ids = known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    take = lambda rows, n: rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # the risk wants unlabelled texts as they come, toxic ones among them at the prior's rate
    chosen = take(ids.where("toxic"), positives).withColumn("positive", F.lit(True)).join(take(ids, unlabelled).withColumn("unlabelled", F.lit(True)), "doc_id", "full_outer")
    chosen = chosen.select("doc_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("positive", "unlabelled")))  # at most positives + unlabelled rows
    sample, path = materialize_at(text.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "positive", "unlabelled").mapInArrow(_featurise, "positive boolean, unlabelled boolean, features array<long>"), "toxicity-sample")
    n_pos, n_unl = sample.agg(F.count_if("positive"), F.count_if("unlabelled")).first()
    counts = sample.select("positive", "unlabelled", F.explode("features").alias("h")).groupBy("h").agg(F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u"))
    ranked = counts.where("p > 1").select("h", excess(F.col("p"), F.col("u"), n_pos, n_unl).alias("e")).orderBy(F.desc("e"), "h").limit(features)
    keys = np.sort(np.array([r.h for r in ranked.collect()], np.int64).view(U))
    if not n_pos or not len(keys):
        delete_path(spark, path)
        return nothing
    rows = sample.mapInArrow(_hits(keys), "positive boolean, unlabelled boolean, at array<int>").collect()
    delete_path(spark, path)

    def matrix(kind: str) -> np.ndarray:
        mine = [r.at for r in rows if r[kind]]
        out = np.zeros((len(mine), len(keys)), np.float32)
        for i, at in enumerate(mine):
            out[i, at] = 1
        return out

    weights, bias = nn_pu(matrix("positive"), matrix("unlabelled"), prior)
    return Model(keys, weights, bias)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in text_slices(batch, "text"):
                keep = [batch.column(i).slice(at, n) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(model.score(data, offsets))], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = id_text(docs, id_col, text_col).mapInArrow(_score(model), "doc_id long, text string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with their own columns."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)  # so that no column of the input can be called score or text
    plain = plain.withColumnRenamed(names[docs.columns.index(text_col)], "text")
    schema = ", ".join(f"`{n}` {t}" for n, t in plain.dtypes)
    return plain.mapInArrow(_score(model), f"{schema}, score double").where("score < 0.5").drop("score").toDF(*docs.columns)
