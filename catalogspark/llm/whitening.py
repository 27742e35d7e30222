"""Whitening of embeddings: principal components by block Jacobi-Davidson with matrix-free products over the cluster.

Entries c become the whole numbers x = floor(64*c) + 1000000; n vectors have the sums S.  Their covariance V is never
formed: all that is asked of the cluster is V Q for a few columns Q, one pass over the vectors for each block of
columns.  A task works out sum((x-m) * ((x-m)'Q)) of its own vectors, and only its block of a row for each dimension is
added up over the tasks.  x - m is taken as (n*x - S)/n, whose numerator is an exact whole number, so that nothing is
lost to the large mean.

Jacobi-Davidson on the driver's side holds blocks of a column for each component, never anything of the vectors:

1. Rayleigh-Ritz in the search space gives Ritz pairs (e, u) and residuals r = V u - e u.  Leading pairs whose residual
   is at most 8*d*eps*e1 are locked, and the space is kept orthogonal to them.
2. For all other wanted pairs at once, the correction equations (I-UU')(V-e)(I-UU') t = -r, with U the locked and the
   wanted Ritz vectors, are solved roughly by inner MINRES: one pass for each inner step, whatever the number of pairs.
3. The corrections are made orthogonal and join the space; a space that has grown too large is restarted with its best
   Ritz vectors.

Locked pairs are checked by one more product at the end, together with the mean of their projections.

Defined results: a vector that is null, or holds nulls or entries that are not finite, is dropped, and so is one of
another length than the most frequent (the longest of equals): it lacks entries or has too many.  Null and repeated ids
are kept as they are, a row for each vector and component.  Components end at 32, at the number of dimensions, and where
an eigenvalue is nothing but rounding (d*eps*64 of the trace), as its component can't be scaled to one: equal vectors,
one vector or an empty table give no rows.  Of equal eigenvalues any unit vectors of their space may be returned.  An
entry or a deviation beyond 64 bits stops the job rather than wrap around.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import Scratch, materialize

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
EPS = float(np.finfo(np.float64).eps)
#: Columns beyond the wanted ones at the start; inner steps at most; dimensions of the space for each wanted pair.
GUARD, INNER, GROWTH = 8, 8, 3
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, b: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Columns of x with apply(x) near b, for a symmetric operator; each column by its own recurrence, all in the same products."""
    x, before, w0, w1 = (np.zeros_like(b) for _ in range(4))
    size = beta = np.linalg.norm(b, axis=0)
    v = b / np.where(beta > 0, beta, 1)
    eta, gamma0, gamma1 = beta.copy(), np.ones_like(beta), np.ones_like(beta)
    sigma0, sigma1 = np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        z = apply(v)
        alpha = (v * z).sum(axis=0)
        z = z - alpha * v - beta * before
        grown = np.linalg.norm(z, axis=0)
        delta = gamma1 * alpha - gamma0 * sigma1 * beta
        rho1 = np.hypot(delta, grown)
        going = (rho1 > 0) & (np.abs(eta) > goal * size)
        safe = np.where(rho1 > 0, rho1, 1)
        w = (v - sigma0 * beta * w0 - (sigma1 * alpha + gamma0 * gamma1 * beta) * w1) / safe
        x = x + np.where(going, delta / safe * eta, 0) * w
        eta = np.where(going, -grown / safe * eta, eta)
        if not (going & (np.abs(eta) > goal * size)).any():
            break
        gamma0, gamma1, sigma0, sigma1 = gamma1, delta / safe, sigma1, grown / safe
        before, v, w0, w1 = v, z / np.where(grown > 0, grown, 1), w1, w
        beta = grown
    return x


def orthogonal(new: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the new columns add to the spaces; columns that add nothing but rounding go."""
    kept: list[np.ndarray] = []
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for space in (*spaces, np.array(kept).T.reshape(len(column), len(kept))):
                column = column - space @ (space.T @ column)
        if np.linalg.norm(column) > 1e-8 * size:
            column = column / np.linalg.norm(column)
            for space in (*spaces, np.array(kept).T.reshape(len(column), len(kept))):
                column = column - space @ (space.T @ column)
            kept.append(column / np.linalg.norm(column))
    return np.array(kept).T.reshape(len(new), len(kept))


def jacobi_davidson(product: Product, d: int, wanted: int, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit vectors as columns) of the symmetric matrix behind ``product``: its largest ``wanted``."""
    wanted, most = min(wanted, d), min(d, GROWTH * wanted + GUARD)
    locked, held = np.zeros((d, 0)), np.zeros((d, 0))  # vectors, and the matrix times them
    values = np.zeros(0)
    q = orthogonal(np.random.default_rng(11).standard_normal((d, min(d, wanted + GUARD))))
    w = product(q)
    top = 0.0
    for turn in range(rounds):
        w = w - locked @ (locked.T @ w)
        h = q.T @ w
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        q, w = q @ y, w @ y
        top = max([top, *np.abs(theta)])
        size = np.linalg.norm(w - q * theta, axis=0)
        need = wanted - len(values)
        good = size <= 8 * d * EPS * top
        ready = int(np.argmin(good)) if not good.all() else len(good)
        if ready:  # locked in falling order only; one too many is looked at, so that none is missed
            take = min(ready, need)
            values = np.append(values, theta[:take])
            locked, held = np.hstack([locked, q[:, :take]]), np.hstack([held, w[:, :take]])
            q, w, theta, size = q[:, take:], w[:, take:], theta[take:], size[take:]
            need -= take
        if not need and (not len(theta) or theta[0] <= values.min() + 8 * d * EPS * top):
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if not need:  # a larger one has come up: the smallest locked pair goes back into the space
            back = int(values.argmin())
            q, w, theta = np.hstack([q, locked[:, [back]]]), np.hstack([w, held[:, [back]]]), np.append(theta, values[back])
            size = np.append(size, 0.0)
            keep = np.arange(len(values)) != back
            values, locked, held, need = values[keep], locked[:, keep], held[:, keep], 1
            order = np.argsort(-theta, kind="stable")
            q, w, theta, size = q[:, order], w[:, order], theta[order], size[order]
        if len(theta) + len(values) >= d:  # the space is everything: what is left is rounding of earlier sums
            w = product(q)
            continue
        if q.shape[1] > most - need:
            keep = min(q.shape[1], need + GUARD)
            q, w, theta = q[:, :keep], w[:, :keep], theta[:keep]
        count = min(need, q.shape[1])
        r, at = w[:, :count] - q[:, :count] * theta[:count], theta[:count]
        fixed = np.hstack([locked, q[:, :count]])

        def free(z: np.ndarray, fixed: np.ndarray = fixed) -> np.ndarray:
            return z - fixed @ (fixed.T @ z)

        def shifted(z: np.ndarray, free=free, at: np.ndarray = at) -> np.ndarray:
            z = free(z)
            return free(product(z) - z * at)

        t = orthogonal(minres(shifted, free(-r), INNER, 2.0 ** -(turn + 2)), locked, q)
        if not t.shape[1]:  # nothing new: the space goes on with a fresh direction
            t = orthogonal(np.random.default_rng(turn).standard_normal((d, 1)), locked, q)
        q, w = np.hstack([q, t]), np.hstack([w, product(t)])
    raise ArithmeticError(f"{len(values)} of {wanted} components after {rounds} rounds")


def _vectors(batch: pa.RecordBatch, column: int = 1) -> np.ndarray:
    col = batch.column(column)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            scaled = np.floor(SCALE * _vectors(batch).astype(np.float64))
            if np.abs(scaled).max(initial=0) >= 2.0**62:
                raise OverflowError("an entry is beyond 64-bit whole numbers")
            x = scaled.astype(np.int64) + SHIFT
            ends = np.arange(len(batch) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["vec_id", "x"])


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x: the vectors that remain, as whole numbers."""
    rows = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))) & (F.size("v") > 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (length["d"] if length else 0))
    return rows.mapInArrow(_whole_numbers, "vec_id long, x array<bigint>")


def summed(table: DataFrame, block: Callable[[np.ndarray], np.ndarray], width: int, kind: str = "double") -> np.ndarray:
    """The sum of block(x), ``width`` columns, over the vectors: every task adds up its own, Spark adds the rows of the tasks' blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                made = block(_vectors(batch, 0))
                total = made if total is None else total + made
        if total is not None:
            ends = np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))], ["j", "v"])

    parts = table.select("x").mapInArrow(run, f"j int, v array<{kind}>")
    rows = parts.groupBy("j").agg(*(F.sum(F.col("v")[c]).alias(f"c{c}") for c in range(width))).orderBy("j").collect()  # a row for each dimension
    return np.array([r[1:] for r in rows])


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n*x - S, exactly."""
    near = s // n
    off = x - near
    if len(off) and np.abs(off).max() > 2**62 // n:
        raise OverflowError("n*x - S is beyond 64 bits")
    return n * off - (s - n * near)


def _product_block(n: int, s: np.ndarray, q: np.ndarray):
    def block(x: np.ndarray) -> np.ndarray:
        z = _centred(x, n, s) / n
        p = z @ q
        return np.vstack([z.T @ p, p.sum(axis=0)]) / n

    return block


def _covariance_block(n: int, s: np.ndarray, basis: np.ndarray, mean: np.ndarray):
    def block(x: np.ndarray) -> np.ndarray:
        p = _centred(x, n, s) / n @ basis - mean
        return p.T @ p / n

    return block


def _moments(x: np.ndarray) -> np.ndarray:
    return np.array([x.sum(axis=0), np.full(x.shape[1], len(x), np.int64)]).T.reshape(x.shape[1], 2)


def _spread_block(n: int, s: np.ndarray):
    return lambda x: np.array([[((_centred(x, n, s) / n) ** 2).sum() / n]])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict:
    """n, sums, trace, values, basis (columns scaled to whiten), mean (of the projections, all rounding) and identity_error of ``whole_vectors``."""
    empty = {"n": 0, "sums": np.zeros(0, np.int64), "trace": 0.0, "values": np.zeros(0), "basis": np.zeros((0, 0)), "identity_error": 0.0}
    if vectors.isEmpty():
        return empty
    moments = summed(vectors, _moments, 2, "bigint").astype(np.int64)
    n, s = int(moments[0, 1]), np.ascontiguousarray(moments[:, 0])
    trace, d = float(summed(vectors, _spread_block(n, s), 1)[0, 0]), len(s)
    if trace == 0:
        return empty | {"n": n, "sums": s}
    values, u = jacobi_davidson(lambda q: summed(vectors, _product_block(n, s, q), q.shape[1])[:d], d, components)
    checked = summed(vectors, _product_block(n, s, u), u.shape[1])
    residual = np.linalg.norm(checked[:d] - u * values, axis=0).max()
    if residual > 16 * d * EPS * values[0]:
        raise ArithmeticError(f"residual {residual} of eigenvalue {values[0]}")
    kept = values > 64 * d * EPS * trace
    values, u, mean = values[kept], u[:, kept], checked[d, kept]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1, 1)
    basis = u / np.sqrt(values)
    covariance = summed(vectors, _covariance_block(n, s, basis, mean / np.sqrt(values)), len(values))
    return {"n": n, "sums": s, "trace": trace, "values": values, "basis": basis, "identity_error": float(np.abs(covariance - np.eye(len(values))).max())}


def _whiten(model: dict):
    n, s, k = model["n"], model["sums"], len(model["values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch) if k else 0, 2048):
                part = batch.slice(at, 2048)
                centred = _centred(_vectors(part), n, s)
                if (np.square(centred.astype(np.float64)).sum(axis=1) > 2.0**63 * 0.999).any():
                    raise OverflowError("a deviation is beyond 64 bits")
                rows = np.repeat(np.arange(len(part)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(rows), n, np.int64)), pa.array((centred * centred).sum(axis=1)[rows]),
                        pa.array((centred / n @ model["basis"]).ravel()), pa.array(np.tile(model["values"] / model["trace"], len(part))), pa.array(np.full(len(rows), model["identity_error"])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every remaining vector's whitened components, one row each, with the share that the component explains."""
    vectors = materialize(whole_vectors(embeddings, id_col, vector_col), "whole-vectors")
    return vectors.mapInArrow(_whiten(fit(vectors, components)), SCHEMA)


def whitened_vectors(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and the whitened vector as one array: what a nearest-neighbour index or a clustering reads."""
    scratch = Scratch(embeddings.sparkSession, "whole-vectors")
    vectors = scratch.table(whole_vectors(embeddings, id_col, vector_col), "vectors")
    model = fit(vectors, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                p = _centred(_vectors(batch), model["n"], model["sums"]) / max(1, model["n"]) @ model["basis"]
                ends = np.arange(len(batch) + 1, dtype=np.int32) * p.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel()))], ["vec_id", "vector"])

    return vectors.mapInArrow(run, "vec_id long, vector array<double>")
