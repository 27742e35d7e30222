"""Line dedup by pairwise alignment.

1. From every line of a document the shortest run of adjacent lines with at least ``block_words`` words is hashed,
   once forwards and once backwards.  These runs cover every common block of two documents: the forward run from a
   block's first line lies in it, and so on up to the backward run from its last line.
2. A run held by several documents pairs each holder with the run's first holder.  So pairs grow with the lines, never
   with the square of a group; no run is left out for being frequent, and whatever a document shares with any earlier
   one it shares with a partner.
3. Each pair is aligned by patience diff on the hashes of all its lines: lines unique in both, their longest common
   increasing order, and the same again between them.  Runs of aligned lines, adjacent in both documents, with at least
   ``block_words`` words are deleted from the later document.
4. One alignment leaves passages in another order and passages that either document repeats.  What it left is matched
   by the hashes of runs: each run of the later document that the earlier one holds anywhere is deleted.

So a line of the later document is deleted exactly if it lies in a block of adjacent lines with at least
``block_words`` words that some earlier document holds, wherever and however often either holds it.  Repeats inside
one document alone are kept.

Documents are in order of id, then of the hash of the text.  Only hashes are joined and aligned; texts move once, when
the lines are taken out.  Runs and alignments go by 64 bits of hash a line; a line is deleted only if the earlier
document holds one that also agrees in 64 others.

Defined results: a null text stays null and has no lines; blank lines are lines without words, deleted only inside a
block; equal texts lose all blocks in every later copy; rows equal in id and text are one document (each row is
returned, with the same lines taken out); rows that share an id but not the text are documents in order of their
text's hash; a null id comes first; very long texts are aligned whole; an empty table gives an empty result.  Columns of
the input are returned as they are, whatever their names; one that is called like an added column is an error, and the
added ones can be renamed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import materialize
from catalogspark.llm.shingles import U, mix

BLOCK_WORDS = 25
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
        common = [(place[x], j) for j, x in enumerate(b[b0:b1], b0) if x in place]
        if not common:
            continue
        tails: list[int] = []
        last: list[int] = []
        back = [-1] * len(common)
        for n, (i, _) in enumerate(common):
            k = bisect_left(tails, i)
            back[n] = last[k - 1] if k else -1
            tails[k:k + 1], last[k:k + 1] = [i], [n]
        chain, n = [], last[-1]
        while n >= 0:
            chain.append(common[n])
            n = back[n]
        x, y = a0, b0
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        todo.append((x, a1, y, b1))
    return sorted(out)


def blocks(aligned: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Positions in the later document of the runs that have enough words."""
    out, run = [], []
    for pair in [*aligned, None]:
        if run and (pair is None or pair != (run[-1][0] + 1, run[-1][1] + 1)):
            if sum(words[j] for _, j in run) >= least:
                out += [j for _, j in run]
            run = []
        if pair is not None:
            run.append(pair)
    return out


def runs(h: np.ndarray, w: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the shortest runs of lines with ``least`` words, from each line forwards and backwards.

    ``first`` has the first line of each document, and one more entry at the end; a run stays inside its document.
    """
    n = len(h)
    total = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    line, size = np.arange(n), np.diff(first)
    begin, end = np.repeat(first[:-1], size), np.repeat(first[1:], size)
    last = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    ahead, behind = last <= end, (start >= begin) & (total[1:] >= least)
    b, e = np.concatenate([line[ahead], start[behind]]), np.concatenate([last[ahead], line[behind] + 1])
    power, inverse = (np.concatenate([np.ones(1, U), np.cumprod(np.full(n, U(x), U), dtype=U)]) for x in (_BASE, _BASE_INV))
    value = np.concatenate([np.zeros(1, U), np.cumsum(mix(h.astype(np.int64).view(U)) * power[:n], dtype=U)])
    return b, e, mix((value[e] - value[b]) * inverse[b] + (e - b).astype(U))


def rest(a: list[int], b: list[int], words: list[int], least: int, done: list[int]) -> list[int]:
    """Positions in the later document, besides ``done``, of runs that the earlier one holds anywhere."""
    count = dict(zip(b, words, strict=True))
    one = lambda x, w: runs(np.array(x, np.int64), np.array(w, np.int64), np.array([0, len(x)]), least)
    _, _, held = one(a, [count.get(x, least) for x in a])  # a line that b hasn't ends every run, and b has no such run
    begin, end, seed = one(b, words)
    found = np.isin(seed, held)
    depth = np.zeros(len(b) + 1, np.int64)
    np.add.at(depth, begin[found], 1)
    np.add.at(depth, end[found], -1)
    inside = np.cumsum(depth[:-1]) > 0
    inside[done] = False
    return np.flatnonzero(inside).tolist()


def _seeds(least: int):
    """(key, line hashes, words) to (key, hash) of each document's distinct runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = batch.column(1), batch.column(2)
            size = h.value_lengths().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(size)])
            b, _, seed = runs(h.flatten().to_numpy(), w.flatten().to_numpy(), first, least)
            doc = np.repeat(np.arange(len(size)), size)[b]
            order = np.lexsort((seed, doc))
            doc, seed = doc[order], seed[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[new])), pa.array(seed[new].view(np.int64))], ["k", "h"])

    return run


def _align(least: int):
    """(a's hashes, key of b, b's hashes, b's words, a's and b's other hashes) to (key of b, positions to delete)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cut = [], []
            for n, (a, b, w, x, y) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True)):
                gone = blocks(patience(a, b), w, least)
                if len(gone) < len(b):
                    gone += rest(a, b, w, least, gone)
                held = {*zip(a, x, strict=True)} if gone else ()
                gone = [j for j in gone if (b[j], y[j]) in held]
                if gone:
                    keep.append(n)
                    cut.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep, pa.int64())), pa.array(cut, pa.list_(pa.int32()))], ["b", "cut"])

    return run


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def remove_common_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, cut_as: str = "_cut", left_as: str = "_left") -> DataFrame:
    """All rows and columns of ``docs``; then the positions of lines taken out (null if none) and the text without them."""
    if {cut_as.lower(), left_as.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"a column of the input is called {cut_as} or {left_as}")
    names = [f"_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    key, text = F.coalesce(F.col(names[docs.columns.index(id_col)]).cast("long"), F.lit(-(2**63))), F.col(names[docs.columns.index(text_col)]).cast("string")
    k = F.struct(key.alias("d"), F.xxhash64(text).alias("t"))
    bare = F.transform(_lines(text), lambda x: F.trim(F.translate(x, "\t\r\f\u000b", "    ")))
    count = lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, " +")))
    held = materialize(
        rows.where(text.isNotNull()).select(k.alias("k"), bare.alias("x")).select("k", F.transform("x", lambda x: F.xxhash64(x)).alias("h"), F.transform("x", lambda x: F.xxhash64(F.lit(1), x)).alias("g"), F.transform("x", count).alias("w")).distinct(), "line-hashes"
    )

    run = held.select("k", "h", "w").mapInArrow(_seeds(block_words), "k struct<d: bigint, t: bigint>, h bigint")
    seed = run.groupBy("h").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("df")).where("df > 1").select("h", "first")
    pairs = run.join(seed, "h").where("first <> k").select(F.col("first").alias("a"), F.col("k").alias("b")).distinct()

    later = pairs.join(held.select(F.col("k").alias("b"), F.col("h").alias("bh"), "w", F.col("g").alias("bg")), "b")
    both = later.join(held.select(F.col("k").alias("a"), F.col("h").alias("ah"), F.col("g").alias("ag")), "a").select("ah", "b", "bh", "w", "ag", "bg")
    cuts = both.mapInArrow(_align(block_words), "b struct<d: bigint, t: bigint>, cut array<int>")
    merged = cuts.groupBy("b").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("_cut"))
    keyed = rows.withColumn("_d", key).withColumn("_t", F.xxhash64(text))
    joined = keyed.join(merged.select(F.col("b.d").alias("_d"), F.col("b.t").alias("_t"), "_cut"), ["_d", "_t"], "left")
    left = F.when(F.col("_cut").isNull(), text).otherwise(F.array_join(F.filter(_lines(text), lambda x, i: ~F.array_contains("_cut", i)), "\n"))
    return joined.select(*(F.col(n).alias(f"_{n}") for n in names), "_cut", left.alias("_left")).toDF(*docs.columns, cut_as, left_as)


def without_common_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars", **more) -> DataFrame:
    """``docs`` with the blocks taken out of their texts, and the number of characters of those that changed; a document
    that is left without a word goes.  Columns may have any names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: names[docs.columns.index(c)] for c in (id_col, text_col, n_chars_col)}
    out = remove_common_blocks(docs.toDF(*names), at[id_col], at[text_col], **more)
    out = out.where(F.col("_cut").isNull() | F.col("_left").rlike(r"\S"))
    size = F.when(F.col("_cut").isNull(), F.col(at[n_chars_col])).otherwise(F.char_length("_left").cast("long"))
    changed = {at[text_col]: F.col("_left"), at[n_chars_col]: size}
    return out.select(*(changed.get(c, F.col(c)).alias(c) for c in names)).toDF(*docs.columns)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without the deleted blocks, n_lines, removed_lines, removed (positions)."""
    out = remove_common_blocks(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_left").alias("text"), F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).alias("n_lines"), F.coalesce(F.size("_cut"), F.lit(0)).alias("removed_lines"), "_cut").withColumnRenamed("_cut", "removed")
