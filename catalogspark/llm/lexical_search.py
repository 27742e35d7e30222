"""Ranked lexical search: items against all documents, over K2-treaps of the term-document grid.

A grid has a row for each term, a column for each document, and in a cell the impact of the term in the document, the
share of the score that it adds.  A K2-treap is a quadtree over the grid that stores nothing for empty quarters: one
bit for each quarter of a cell that isn't empty, whether it holds impacts, and for each set bit the largest impact in
it.  Children are found by counting set bits, so there are no pointers.

1. One pass over the texts gives each document's number of terms and how often it holds those of the items (the terms
   of a block of items, a bounded list, go to every task).  Their sums are N, L and the documents of each term.
2. The table of these counts is read once more.  Each task builds the grids of its documents, ``COLUMNS`` of them at a
   time in ascending order of their ids, with rows in order of the terms' weights, so that neighbours have like maxima.
3. For an item the rows of its terms descend jointly: a node is a range of documents with the cell of each of its terms
   there, its bound the sum of the cells' maxima.  The nodes with the highest bounds are opened first, many at a time;
   a range goes once its bound can't reach the worst of the best documents so far, which go on from grid to grid.
4. A task returns the best documents of each item; the best of these are the result.

No document, cell or candidate is left out: the order of descent and the bounds only save work.  All scores are whole
numbers of 64 bits.

Defined results: null and empty texts, and those without terms, are no documents of N and are never found; an item that
is null or has no terms gives no rows; items and documents that repeat an id are each on their own; a null id comes
before all others among equal scores; texts and items are read whole; other columns, whatever their names, are not read;
empty tables give an empty result.  Terms are told apart by 128 bits of hash.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalogspark.llm.common import Scratch, id_text, materialize, text_slices
from catalogspark.llm.shingles import U, mix, word_hashes, words

TOP = 20
#: Documents of one grid; bytes of item text in one block of items; nodes opened at once.
COLUMNS, BLOCK_BYTES, OPENED = 8192, 1 << 20, 128
_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SECOND = np.random.default_rng(97).integers(1, 2**63, 256, dtype=U)
_SECOND[65:91] = _SECOND[97:123]
SCHEMA = "item_id long, rank int, doc_id long, score long"


def terms(text: str | None) -> Counter:
    """Terms of one text, A-Z lower-cased, and how often each occurs."""
    return Counter(_TERM.findall((text or "").translate(_LOWER)))


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another 64 bits of each word, by a polynomial over its bytes taken one place at a time."""
    out = np.zeros(len(starts), U)
    size = ends - starts
    left = np.arange(len(starts))
    at = 0
    while len(left := left[size[left] > at]):
        out[left] = out[left] * U(0x9FB21C651E98DF25) + _SECOND[data[starts[left] + at]]
        at += 1
    return mix(out + size.astype(U))


def hashes(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in found]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if raw else ends
    return word_hashes(data, starts, ends), second_hashes(data, starts, ends)


# -- the grid ----------------------------------------------------------------------------------------------------------


@dataclass
class K2Treap:
    """Cells of a grid of ``1 << height`` rows and columns.

    ``bits``: four for each cell that isn't empty, quarter by quarter (rows first, then columns), level by level.
    ``rank``: set bits up to and with each one.  ``most``: the largest impact behind each set bit, in their order.
    """

    height: int
    bits: np.ndarray
    rank: np.ndarray
    most: np.ndarray

    @classmethod
    def build(cls, height: int, row: np.ndarray, column: np.ndarray, impact: np.ndarray) -> K2Treap:
        """From cells that are all different, with impacts above 0."""
        code = np.zeros(len(row), np.int64)
        for k in range(height):
            code |= (column.astype(np.int64) >> k & 1) << (2 * k) | (row.astype(np.int64) >> k & 1) << (2 * k + 1)
        order = np.argsort(code, kind="stable")
        code, impact = code[order], impact[order]
        bits, most = [], []
        for level in range(height - 1, -1, -1):  # from the leaves up; the quarter is the last two bits of the code
            bits.append(code)
            most.append(impact)
            parent = code >> 2
            heads = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.zeros(0, np.int64)
            impact = np.maximum.reduceat(impact, heads) if len(heads) else impact
            code = parent[heads]
        rows = []
        for quarters in reversed(bits):
            parent = quarters >> 2
            ordinal = np.cumsum(np.concatenate([[0], parent[1:] != parent[:-1]])) if len(parent) else parent
            made = np.zeros(4 * (int(ordinal[-1]) + 1) if len(parent) else 0, bool)
            made[4 * ordinal + (quarters & 3)] = True
            rows.append(made)
        flat = np.concatenate(rows) if rows else np.zeros(0, bool)
        return cls(height, flat, np.cumsum(flat, dtype=np.int64), np.concatenate([np.zeros(0, np.int64), *reversed(most)]))

    def children(self, cell: np.ndarray, row_bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of cells (places of set bits, -1 for the whole grid) the two quarters with this row bit: places, whether there is anything, largest impact."""
        base = np.where(cell < 0, 0, 4 * self.rank[cell])[:, None] + 2 * row_bit[:, None] + np.arange(2)
        there = self.bits[base]
        return base, there, np.where(there, self.most[np.maximum(self.rank[base] - 1, 0)], 0)


@dataclass
class Best:
    """The best documents of an item so far: a heap with the worst at its top, as (score, -place of the id)."""

    size: int
    held: list[tuple]

    def add(self, score: int, order: tuple) -> None:
        entry = (score, *order)
        if len(self.held) < self.size:
            heapq.heappush(self.held, entry)
        elif entry > self.held[0]:
            heapq.heapreplace(self.held, entry)

    def floor(self) -> tuple | None:
        return self.held[0] if len(self.held) == self.size else None


def _order(doc_id: int | None) -> tuple[int, int]:
    """Larger for the earlier of equal scores: a null id is the first, then ascending ids."""
    return (1, 0) if doc_id is None else (0, -doc_id)


def search(grid: K2Treap, ids: list, row: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Descend the grid with an item's rows (each ``times`` times), keep its best documents; returns the nodes opened.

    ``ids``: of the columns, in the order that breaks ties.
    """
    if not len(row) or not len(grid.most):
        return 0
    height, opened = grid.height, 0
    # a node: bound, depth, first column; the cells of its terms are an array of (term, place) beside it
    nodes = [(-int((grid.most[: grid.rank[3]].max() * times).sum()), 0, 0, np.arange(len(row)), np.full(len(row), -1))]
    while nodes:
        batch = []
        floor = best.floor()
        while nodes and len(batch) < OPENED:
            node = heapq.heappop(nodes)
            if floor is not None and (-node[0], *_order(ids[node[2]])) <= floor:
                if -node[0] < floor[0]:
                    nodes.clear()  # no other bound is higher
                continue
            batch.append(node)
        if not batch:
            break
        opened += len(batch)
        size = [len(x[3]) for x in batch]
        level, column = np.array([x[1] for x in batch]), np.array([x[2] for x in batch])
        term, cell = np.concatenate([x[3] for x in batch]), np.concatenate([x[4] for x in batch])
        place, there, most = grid.children(cell, row[term] >> (height - 1 - np.repeat(level, size)) & 1)
        heads = np.concatenate([[0], np.cumsum(size)[:-1]])
        bounds = np.add.reduceat(most * times[term][:, None], heads, axis=0)
        floor = best.floor()
        deeper = level + 1 < height
        for c in range(2):
            wanted = bounds[:, c] >= (1 if floor is None else floor[0])
            kept = there[:, c] & np.repeat(wanted & deeper, size)
            ends = np.cumsum(np.add.reduceat(kept, heads, dtype=np.int64))
            terms_in, cells_in, ends = term[kept], place[kept, c], [0, *ends.tolist()]
            rows = np.flatnonzero(wanted)
            firsts = (column + (c << (height - 1 - level)))[rows].tolist()
            for k, bound, first in zip(rows.tolist(), bounds[rows, c].tolist(), firsts, strict=True):
                if not deeper[k]:
                    best.add(bound, (*_order(ids[first]), -first))
                elif floor is None or bound > floor[0] or (bound, *_order(ids[first])) > floor[:3]:
                    a, b = ends[k], ends[k + 1]
                    heapq.heappush(nodes, (-bound, batch[k][1] + 1, first, terms_in[a:b], cells_in[a:b]))
    return opened


# -- counts, statistics and the search over Spark ----------------------------------------------------------------------


@dataclass
class Block:
    """Items whose terms go to every task together: (number, item_id, its terms), and the terms in order of their first hash."""

    items: list[tuple[int, int | None, Counter]]
    terms: list[str]
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, int | None, Counter]]) -> Block:
        found = sorted({t for _, _, held in items for t in held})
        first, second = hashes(found)
        order = np.argsort(first, kind="stable")
        if len(np.unique(first)) < len(found):
            raise ArithmeticError("two terms of the items share a 64-bit hash")
        return cls(items, [found[k] for k in order], first[order], second[order])


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items, read one after another, in blocks of at most ``limit`` bytes of text (or one longer item)."""
    held, size = [], 0
    for number, row in enumerate(items.where("text IS NOT NULL").toLocalIterator()):
        more = len(row["text"].encode())
        if held and size + more > limit:
            yield Block.of(held)
            held, size = [], 0
        if found := terms(row["text"]):
            held.append((number, row["item_id"], found))
            size += more
    if held:
        yield Block.of(held)


def _counts(first: np.ndarray, second: np.ndarray):
    """(doc_id, text) to a row for each text with terms: its number of terms, and of the block's terms the places and how often it holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size, data, offsets in text_slices(batch, "text"):
                starts, ends, begin = words(data, offsets, _GAPS)
                h = word_hashes(data, starts, ends)
                place = np.minimum(np.searchsorted(first, h), len(first) - 1)
                hit = np.flatnonzero(first[place] == h)
                hit = hit[second[place[hit]] == second_hashes(data, starts[hit], ends[hit])]
                count = np.diff(begin)
                doc = np.repeat(np.arange(size), count)[hit]
                cell, times = np.unique(doc * len(first) + place[hit], return_counts=True)
                some = np.flatnonzero(count)
                cuts = np.searchsorted(cell, np.append(some, size) * len(first)).astype(np.int32)
                lists = (pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (cell % len(first), times))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size).take(pa.array(some)), pa.array(count[some].astype(np.int64)), *lists], ["doc_id", "n", "terms", "times"])

    return run


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    """Of terms that so many of the documents hold."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(k) + 1))) for k in held], np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while len(batch):
            take = size - sum(map(len, held))
            held.append(batch.slice(0, take))
            batch = batch.slice(take)
            if sum(map(len, held)) == size:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(x.flatten().to_numpy(zero_copy_only=False) for x in column.chunks)])


def grid_of(chunk: pa.Table, row_of: np.ndarray, weight: np.ndarray, documents: int, occurrences: int, row_bits: int) -> tuple[K2Treap, int, list]:
    """(grid, bits that its rows are shifted by, ids of its columns) of some documents' counts."""
    ids = chunk.column("doc_id").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
    column_of = np.empty(len(ids), np.int64)
    column_of[order] = np.arange(len(ids))
    size = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in chunk.column("terms").chunks])
    term, times = _flat(chunk.column("terms")).astype(np.int64), _flat(chunk.column("times")).astype(np.int64)
    m = np.array([75 + 25 * k * documents // occurrences for k in chunk.column("n").to_pylist()], np.int64)
    impact = weight[term] * (1_000_000_000 * times // (1000 * times + 12 * np.repeat(m, size)))
    column, some = np.repeat(column_of, size), impact > 0
    height = max(1, row_bits, (len(ids) - 1).bit_length())
    shift = height - row_bits
    return K2Treap.build(height, row_of[term[some]] << shift, column[some], impact[some]), shift, [ids[k] for k in order]


def _search(block: Block, weight: np.ndarray, documents: int, occurrences: int, top: int):
    place = {t: k for k, t in enumerate(block.terms)}
    row_of = np.empty(len(weight), np.int64)
    row_of[np.argsort(weight, kind="stable")] = np.arange(len(weight))
    row_bits = max(1, (len(weight) - 1).bit_length())
    asked = []
    for number, item_id, found in block.items:
        used = np.array([k for k in (place[t] for t in found) if weight[k] > 0], np.int64)
        asked.append((number, item_id, row_of[used], np.array([found[block.terms[k]] for k in used], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top, []) for _ in asked]
        for chunk in _chunks(batches, COLUMNS):
            grid, shift, ids = grid_of(chunk, row_of, weight, documents, occurrences, row_bits)
            for (_, _, rows, times), held in zip(asked, best, strict=True):
                search(grid, ids, rows << shift, times, held)
        out = [(number, item_id, None if first else -negative, score) for (number, item_id, _, _), held in zip(asked, best, strict=True) for score, first, negative, _ in held.held]
        columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["number", "item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0, equal scores by ascending id."""
    spark, texts, found = docs.sparkSession, id_text(docs, id_col, text_col), []
    for block in blocks(id_text(items, item_col, item_text_col).withColumnRenamed("doc_id", "item_id"), block_bytes):
        scratch = Scratch(spark, "term-counts")
        counts = scratch.table(texts.mapInArrow(_counts(block.first, block.second), "doc_id long, n long, terms array<int>, times array<int>"), "counts")
        total = counts.agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences")).first()
        held = np.zeros(len(block.terms), np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # no more rows than terms of the block
            held[r["term"]] = r["count"]
        if total["documents"]:
            weight = weights(total["documents"], held)
            best = counts.mapInArrow(_search(block, weight, total["documents"], total["occurrences"], top), "number long, item_id long, doc_id long, score long")
            order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
            ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            found.append(materialize(ranked.select("item_id", "rank", "doc_id", "score"), "ranked"))
        scratch.drop()
    out = spark.createDataFrame([], SCHEMA)
    for part in found:
        out = out.unionByName(part)
    return out


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as ws from documents where text is not null),
total as (select count(*) as documents, sum(len(ws))::bigint as occurrences from d where len(ws) > 0),
q as (select number, item_id, term, count(*) as times from (select row_number() over () as number, item_id, unnest({_WORDS}) as term from benchmark) group by all),
tf as (select rid, doc_id, n, term, count(*) as tf from (select rid, doc_id, len(ws) as n, unnest(ws) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::bigint as w from tf, total group by term),
impact as (select rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // occurrences))) as impact from tf join w using (term), total),
scored as (select number, item_id, rid, doc_id, sum(times * impact)::bigint as score from q join impact using (term) group by all)
select item_id, rank::integer as rank, doc_id, score from (
    select *, row_number() over (partition by number order by score desc, doc_id) as rank from scored where score > 0) where rank <= {TOP}
"""
