"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

Per document the distinct shingles are drawn through correlated ranks: in round j an element takes the j-th entry of
its own random permutation of the registers and offers j + u there, so a register's minimum spreads over all
registers without replacement.  Rounds stop once every register of a document is below the round's number.

Steps, all exact after banding:

1. Documents with equal shingle sets form a class; only one row of each (its smallest id) goes on.
2. Classes that share a band of the signature form buckets.  Each bucket compares its members with its smallest one
   on their full sets; links found so far are grouped.
3. Of buckets with more than two members, still in several groups, every member outside the leader's group is compared
   with all members of other groups, again on full sets; of buckets with the same members one is enough.  Both sides
   are cut into blocks of ``block_bytes`` and each pair of blocks is a task of its own that holds one of them, so nothing
   is capped, no task holds an unbounded group, and where all but a few members are linked to the leader the work
   grows with the members and not with their square.
4. Links are grouped by union-find inside partitions, then by rounds of smallest-neighbour linking between them.

With 32 bands of 4 registers a pair at exactly 0.75 shares no band with probability 5e-6.

Defined results: a null, empty or blank text has no shingles, is linked with nothing and is kept; equal texts are one
class; of a group the smallest id is kept; rows that repeat an id are one document, with the links of all its
texts and the largest set size; a null id keeps its own class under id null and is never linked; very long texts are
read whole; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import Scratch, id_text, materialize, text_slices
from catalogspark.llm.shingles import U, mix, shingle_sets
from catalogspark.llm.unionfind import components

REGISTERS, ROWS = 128, 4
BLOCK_BYTES = 1 << 19


def superminhash(h: np.ndarray, bounds: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures of all documents of a slice: one row of m registers each; registers hold (round << 48) | rank bits."""
    n = len(bounds) - 1
    sig = np.full(n * m, np.iinfo(np.uint64).max, U)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    x = h.copy()
    where: list[np.ndarray] = []
    what: list[np.ndarray] = []
    table = None
    for j in range(m):
        if not len(x):
            break
        r = mix(x + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + ((r & U(0xFFFF)) * U(m - j) >> U(16)).astype(np.int64)
        if table is None and j >= 6:  # few elements are left: their permutations can be held in full
            table = np.tile(np.arange(m, dtype=np.int16), (len(x), 1))
            rows = np.arange(len(x))
            for at, put in zip(where, what, strict=True):
                table[rows, at] = put
        if table is None:
            own, other = np.full(len(x), j), k.copy()
            for at, put in zip(where, what, strict=True):
                other = np.where(at == k, put, other)
                own = np.where(at == j, put, own)
            where.append(k)
            what.append(own)
        else:
            rows = np.arange(len(x))
            other = table[rows, k].astype(np.int64)
            table[rows, k] = table[rows, j]
        np.minimum.at(sig, doc * m + other, U(j << 48) | (r >> U(16)))
        open_ = (sig.reshape(n, m).max(axis=1) >= U((j + 1) << 48))[doc]
        if not open_.all():
            x, doc = x[open_], doc[open_]
            where, what = [a[open_] for a in where], [a[open_] for a in what]
            table = None if table is None else table[open_]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` registers; the band's number is part of the key."""
    bands = sig.shape[1] // rows
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * U(0xD6E8FEB86659FD93) + parts[:, :, i])
    return key


def _sign(size: int, registers: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, n, data, offsets in text_slices(batch, "text"):
                h, bounds = shingle_sets(data, offsets, size)
                keys = band_keys(superminhash(h, bounds, registers), rows)
                raw = h.tobytes()
                digest = [xxhash.xxh3_128_digest(raw[8 * a:8 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                flat = pa.array(keys.view(np.int64).ravel())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(np.diff(bounds)), pa.array(digest, pa.binary()), bands], ["doc_id", "n", "digest", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, n, data, offsets in text_slices(batch, "text"):
                h, bounds = shingle_sets(data, offsets, size)
                raw = h.tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array([raw[8 * a:8 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["rep", "hashes"])

    return run


def similar(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _star(percent: int):
    """Rows (a, b, set of a, set of b): the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = []
            for i in range(len(a)):
                p, q = np.frombuffer(x[i].as_py(), U), np.frombuffer(y[i].as_py(), U)
                short, long = (p, q) if len(p) <= len(q) else (q, p)
                if 100 * len(short) < percent * len(long):
                    continue
                at = np.searchsorted(long, short)
                at[at == len(long)] = 0
                if similar(int((long[at] == short).sum()), len(p), len(q), percent):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], ["a", "b"])

    return run


class Probes:
    """Some sets that others are compared with; ``groups`` says what is known to be linked already."""

    def __init__(self, rows: list[tuple[int, int, bytes]], percent: int):
        self.percent = percent
        self.ids, self.group = [r[0] for r in rows], [r[1] for r in rows]
        sets = [np.frombuffer(r[2], U) for r in rows]
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, U)
        order = np.argsort(flat, kind="stable")
        self.value, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.size)[order]
        self.root: dict[int, int] = {}

    def find(self, g: int) -> int:
        while (up := self.root.get(g, g)) != g:
            g = up
        return g

    def links(self, rep: int, group: int, raw: bytes) -> list[tuple[int, int]]:
        """Links of a set to probes of other groups, as far as they join groups."""
        s = np.frombuffer(raw, U)
        lo, hi = np.searchsorted(self.value, s, "left"), np.searchsorted(self.value, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.ids))
        out = []
        for i in np.flatnonzero((common > 0) & (100 * common >= self.percent * (self.size + len(s) - common))).tolist():
            a, b = self.find(group), self.find(self.group[i])
            if a != b:
                self.root[a] = b
                out.append((rep, self.ids[i]))
        return out


def _rest(percent: int):
    """Rows (bucket, p, c, role, rep, group, set) sorted by the first four, probes (role 0) before the others; yields links that join groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, probes = None, [], None
        for batch in batches:
            out = []
            for *key, role, rep, group, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, held, probes = key, [], None
                if role == 0:
                    held.append((rep, group, raw))
                    continue
                probes = probes or Probes(held, percent)
                out += probes.links(rep, group, raw)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("set_b"))
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("set_a"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b").mapInArrow(_star(percent), "a long, b long")


def _open_links(grouped: DataFrame, sets: DataFrame, percent: int, block_bytes: int) -> DataFrame:
    """Links between members (bucket, rep, n, grp) of different groups of one bucket that comparing with its leader has left."""
    key = F.xxhash64("rep")
    known = grouped.groupBy("bucket").agg(F.min(F.struct("rep", "grp")).alias("lead"), F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count(F.lit(1)).alias("members"), F.bit_xor(key).alias("x"), F.sum(F.shiftright(key, 20)).alias("y"))
    alone = known.where("lo < hi AND members > 2").groupBy("members", "x", "y").agg(F.min(F.struct("bucket", "lead")).alias("k")).select("k.bucket", F.col("k.lead.grp").alias("main"))
    rows = grouped.join(alone, "bucket").withColumn("probe", F.col("grp") != F.col("main"))
    blocks = lambda n: F.ceil(F.coalesce(F.sum(n), F.lit(0)) * 8 / block_bytes).cast("int")
    counts = rows.groupBy("bucket").agg(blocks(F.when(F.col("probe"), F.col("n"))).alias("ps"), blocks(F.col("n")).alias("cs"))
    rows = rows.join(counts, "bucket")
    mine, every = lambda n: F.pmod(key, F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    probes = rows.where("probe").select("bucket", mine("ps").alias("p"), every("cs").alias("c"), F.lit(0).alias("role"), "rep", "grp")
    others = rows.select("bucket", every("ps").alias("p"), mine("cs").alias("c"), F.lit(1).alias("role"), "rep", "grp")
    parts = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = probes.unionByName(others).join(sets, "rep").select("bucket", "p", "c", "role", "rep", "grp", "hashes")
    return placed.repartition(parts, "bucket", "p", "c").sortWithinPartitions("bucket", "p", "c", "role").mapInArrow(_rest(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, registers: int = REGISTERS, rows: int = ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_rows (rows of that id)."""
    text, scratch = id_text(docs, id_col, text_col), Scratch(docs.sparkSession, "minhash")
    signed = materialize(text.mapInArrow(_sign(size, registers, rows), "doc_id long, n long, digest binary, bands array<long>"), "minhash-signed")
    solid = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = solid.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "bands")).alias("r")).select(F.col("r.doc_id").alias("rep"), "r.n", "r.bands")
    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = scratch.table(banded.join(shared.select("bucket", "leader"), "bucket"), "members")

    reps = members.select("rep").distinct()
    sets = scratch.table(text.join(reps, text["doc_id"] == reps["rep"], "left_semi").distinct().mapInArrow(_sets(size), "rep long, hashes binary"), "sets")
    star = members.where("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    first = scratch.table(_verified(star, sets, percent), "first")
    groups = components(first)
    grouped = members.join(groups, members["rep"] == groups["node"], "left").select("bucket", "rep", "n", F.coalesce("label", "rep").alias("grp"))
    second = scratch.table(_open_links(scratch.table(grouped, "grouped"), sets, percent, block_bytes), "second")
    final = groups if second.isEmpty() else components(first.unionByName(second))
    scratch.drop()

    heads = solid.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    labels = heads.join(final, heads["rep"] == final["node"], "left").select("digest", F.coalesce("label", "rep").alias("label"))
    tagged = signed.where("n > 0").select("doc_id", "n", "digest").join(labels, "digest", "left").select("doc_id", "n", "label")
    blank = signed.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("label"))  # equal, but linked with nothing
    return tagged.unionByName(blank).groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("label", "doc_id")).alias("component_id"), F.count(F.lit(1)).alias("n_rows")).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_rows"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Rows of the document with the smallest id of each group, with their own columns, whatever their names.

    Rows that share an id are one document and stay or go together; of those equal in id and text one stays.  Rows
    without an id all stay.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    marks = near_duplicates(docs, id_col, text_col, **more).where("doc_id IS NOT NULL AND (NOT kept OR n_rows > 1)").select(F.col("doc_id").alias("_id"), F.col("kept").alias("_kept"))
    rows = docs.toDF(*names)
    marked = rows.join(marks, rows[key].cast("long") == marks["_id"], "left")
    return marked.where("_kept IS NULL").unionByName(marked.where("_kept").dropDuplicates([key, text])).select(*names).toDF(*docs.columns)
