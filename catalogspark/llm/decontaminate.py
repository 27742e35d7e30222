"""Benchmark decontamination: n-gram seeds joined to test items, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits, apostrophes and all non-ASCII bytes, A-Z lower-cased.

1. Every run of 3 words of a test item is a seed, of an item of 4 to 9 words every run of 2: the shorter an item, the
   rarer a run of 3 that edits leave whole.  None is dropped, however many documents hold it: of an edited copy that is
   itself repeated only frequent seeds may be left.  An item of fewer than 4 words has its whole sequence as its only
   seed, and is found in texts that are nothing but this item: single words and pairs stand in any text.
2. The seeds' hashes set bits of a map of at most ``MAP_BITS`` bits, the only thing that is sent to every task.  One
   pass over the texts keeps the seeds whose bit is set, with their places; a join with the table of seeds says which
   are an item's.  Both sides of the join carry one of ``SALTS`` numbers, so that a seed held by a third of all texts is
   dealt to many tasks.  The items of one text go on in rows of about ``ITEMS`` items each, however many they are.
3. Texts that hold seeds meet their items' words, and the passage around the seeds' diagonals is aligned with the item
   word by word (match 2, mismatch -1, gap -1); the best local score over twice the item's words is the score, 1 for a
   whole copy.  A passage that has too few of the item's words to reach the threshold in any alignment isn't aligned,
   which changes no result.  A copy of which edits leave no 3 (2) adjacent words isn't found.

Texts are known by 128 bits of hash, so what is found depends on the text alone, never on its id.

Defined results: a null or empty text or item has no words and no hits; every row gives its own rows, whatever ids or
texts are repeated, null ids too; items that repeat an id give rows of their own, and an item given twice counts once;
a document may hold an item several times and gives one row, with its best passage (the first of equals); very long
texts are read whole; empty tables give an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import id_text, materialize, text_key, text_slices
from catalogspark.llm.shingles import U, mix, word_hashes, words

THRESHOLD = 0.5
#: Words of a seed of an item with at least so many words, and of shorter ones; below ``WHOLE`` the item itself.
SEED, FROM, SHORT_SEED, WHOLE = 3, 10, 2, 4
MAP_BITS, SALTS, ITEMS = 1 << 24, 32, 256
_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = False
_STEP = U(0xA24BAED4963EE407)
SCHEMA = "doc_id long, item_id long, score double, begin_word long, end_word long"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offsets, _GAPS)
    return word_hashes(data, starts, ends), first


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from every place (across documents too: callers keep to places inside one)."""
    if len(h) < n:
        return np.zeros(0, U)
    out = h[:len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _STEP + h[k:len(h) - n + 1 + k]
    return mix(out + U(n))


def seeds(h: np.ndarray, first: np.ndarray, sizes: tuple[int, ...], own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word's place in it, hash) of all seeds of a slice, in order; sizes: words of a run, negative for a whole text of so many.

    ``own``: those of test items, each by its own length.
    """
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    out = []
    for size in sizes:
        g = _grams(h, abs(size))
        if len(g):
            long = count[doc[:len(g)]]
            here = doc[:len(g)] == doc[abs(size) - 1:]
            if size < 0:
                here &= long == -size
                g = mix(g + U(WHOLE))  # never equal to that of a run inside a text
            elif own:
                here &= (long >= FROM) if size == SEED else (long >= WHOLE) & (long < FROM)
            place = np.flatnonzero(here)
            out.append((doc[place], place - first[doc[place]], g[place]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U)
    doc, place, g = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(doc, kind="stable")
    return doc[order], place[order], g[order]


ALL_SIZES = (SEED, SHORT_SEED, *range(-1, -WHOLE, -1))


def sizes_of(words: int) -> int:
    """The kind of seed of an item with so many words."""
    return -words if words < WHOLE else SHORT_SEED if words < FROM else SEED


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local score (match 2, mismatch -1, gap -1) and the passage's words [begin, end) that it covers."""
    width = len(passage)
    steps = np.arange(width + 1)
    h, begin = np.zeros(width + 1, np.int64), steps.copy()
    best, where = 0, (0, 0)
    for w in item:
        diagonal = h[:-1] + np.where(passage == w, 2, -1)
        now, start = np.zeros(width + 1, np.int64), steps.copy()
        better = diagonal > 0
        now[1:][better], start[1:][better] = diagonal[better], begin[:-1][better]
        up = h - 1 > now
        now[up], start[up] = h[up] - 1, begin[up]
        reach = now + steps  # a gap in the item: the best value to the left, less one for each step
        run = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == run, steps, 0))
        left = run - steps > now
        now[left], start[left] = (run - steps)[left], start[source[left]]
        h, begin = now, start
        top = int(now.argmax())
        if now[top] > best:
            best, where = int(now[top]), (int(start[top]), top)
    return float(best), *where


def most_matches(item: np.ndarray, passage: np.ndarray) -> int:
    """At least the matches of any alignment: each takes a word of its own on either side."""
    return int(min(np.isin(item, passage).sum(), np.isin(passage, item).sum()))


def windows(spans: list[tuple[int, int]], length: int, limit: int) -> list[tuple[int, int]]:
    """Passages around the diagonals (document word less item word) first to last of each span; overlapping ones are joined."""
    pad = length // 2 + 2
    around = sorted((max(0, lo - pad), min(limit, hi + length + pad)) for lo, hi in spans)
    out = [around[0]]
    for b, e in around[1:]:
        if b <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((b, e))
    return out


def best_passage(item: np.ndarray, text: np.ndarray, spans: list[tuple[int, int]], threshold: float) -> tuple[float, int, int]:
    best = (0.0, 0, 0)
    for b, e in windows(spans, len(item), len(text)):
        if most_matches(item, text[b:e]) / len(item) >= threshold:
            score, x, y = smith_waterman(item, text[b:e])
            if score / (2 * len(item)) > best[0]:
                best = (score / (2 * len(item)), b + x, b + y)
    return best


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) to the item's words, seeds and their kind."""
    for batch in batches:
        for at, size, data, offsets in text_slices(batch, "text"):
            h, first = _words(data, offsets)
            doc, _, g = seeds(h, first, ALL_SIZES, own=True)
            ends = np.searchsorted(doc, np.arange(size + 1)).astype(np.int32)
            raw = h.tobytes()
            words_of = [raw[8 * a:8 * b] for a, b in zip(first[:-1], first[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(g.view(np.int64)))
            kinds = pa.array([sizes_of(int(k)) for k in np.diff(first)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size), pa.array(words_of, pa.binary()), lists, kinds], ["item_id", "words", "seeds", "kind"])


def _candidates(bits: np.ndarray, sizes: tuple[int, ...]):
    """(t1, t2, text) to the seeds whose bit is set: (t1, t2, h, places), one row for each distinct seed of a text."""
    mask = U(8 * len(bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in text_slices(batch, "text"):
                h, first = _words(data, offsets)
                doc, place, g = seeds(h, first, sizes)
                bit = (g & mask).astype(np.int64)
                hit = (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                doc, place, g = doc[hit], place[hit], g[hit]
                order = np.lexsort((place, g, doc))
                doc, place, g = doc[order], place[order], g[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
                heads = np.flatnonzero(new)
                rows = pa.array(doc[heads] + at)
                places = pa.ListArray.from_arrays(pa.array(np.append(heads, len(doc)).astype(np.int32)), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(g[heads].view(np.int64)), places], ["t1", "t2", "h", "places"])

    return run


def _align(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, n, data, offsets in text_slices(batch, "text"):
                h, first = _words(data, offsets)
                for d in range(n):
                    text = h[first[d]:first[d + 1]]
                    for item in batch.column(4)[at + d].as_py():
                        spans = [(p - x["hi"], p - x["lo"]) for x in item["hits"] for p in x["places"]]
                        best = best_passage(np.frombuffer(item["words"], U), text, spans, threshold)
                        if best[0] >= threshold:
                            out.append((at + d, item["item_id"], *best))
            rows = pa.array([r[0] for r in out], pa.int64())
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            found = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), *found], ["doc_id", "t1", "t2", "item_id", "score", "begin_word", "end_word"])

    return run


def _bitmap(table: DataFrame, seed: str) -> np.ndarray:
    """Bytes of a map with a bit for every seed, 16 times as many bits as seeds but no more than MAP_BITS."""
    size = min(MAP_BITS, 1 << max(10, (16 * table.count()).bit_length()))
    bit = F.col(seed).bitwiseAND(F.lit(size - 1))
    cells = table.select(bit.cast("int").alias("bit")).groupBy(F.shiftright("bit", 3).alias("cell")).agg(F.expr("bit_or(shiftleft(1, bit & 7))").alias("byte"))
    packed = cells.groupBy(F.shiftright("cell", 8).alias("k")).agg(F.collect_list(F.struct("cell", "byte")).alias("c"))  # 256 bytes at most in each row
    out = np.zeros(size // 8, np.uint8)
    for r in packed.toLocalIterator():
        for cell, byte in r["c"]:
            out[cell] = byte
    return out


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, t1, t2 (key of the text), item_id, score, begin_word, end_word."""
    texts = id_text(docs, id_col, text_col).where("text IS NOT NULL").select("doc_id", *text_key("text"), "text")
    given = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].cast("string").alias("text")).where("text IS NOT NULL")
    items = materialize(given.mapInArrow(_item_rows, "item_id long, words binary, seeds array<long>, kind int").where("size(seeds) > 0").distinct().withColumn("item", F.xxhash64("item_id", "words")), "leak-items")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    # of a seed that an item repeats the first and last place are enough: the diagonals between them lie in one passage
    table = items.select("item", F.posexplode("seeds").alias("at", "h")).groupBy("item", "h").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    bits = _bitmap(table.select("h").distinct(), "h")
    sizes = tuple(sorted(r["kind"] for r in items.select("kind").distinct().collect()))  # five at most
    chunks = -(-max(1, items.count()) // ITEMS)
    held = texts.select("t1", "t2", "text").mapInArrow(_candidates(bits, sizes), "t1 long, t2 long, h long, places array<int>")
    held = held.groupBy("t1", "t2", "h").agg(F.first("places").alias("places")).withColumn("salt", F.pmod("t2", F.lit(SALTS)).cast("int"))
    hits = held.join(table.select("*", salts), ["h", "salt"]).groupBy("t1", "t2", "salt", "item").agg(F.collect_list(F.struct("places", "lo", "hi")).alias("hits"))
    words_of = items.select("item", "item_id", "words", salts)
    grouped = hits.join(words_of, ["item", "salt"]).groupBy("t1", "t2", F.pmod("item", F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("item_id", "words", "hits")).alias("items"))
    wanted = materialize(grouped.drop("chunk"), "leak-candidates")  # a plain table: the join below may then split the copies of one text
    schema = "doc_id long, t1 long, t2 long, item_id long, score double, begin_word long, end_word long"
    # the table grows with the texts: one way to join at every size
    return texts.join(wanted.hint("merge"), ["t1", "t2"]).select("doc_id", "t1", "t2", "text", "items").mapInArrow(_align(threshold), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """doc_id, item_id, score, begin_word, end_word: documents that hold a copy of an item, whole or edited."""
    return find(docs, benchmark, id_col, **more).drop("t1", "t2")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` whose own text holds no test item; ids play no part, other columns are returned as they are."""
    bad = find(docs, benchmark, id_col, text_col, **more).select("t1", "t2").distinct()
    names = [f"_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    keyed = rows.select("*", *text_key(names[docs.columns.index(text_col)]))
    return keyed.join(bad, ["t1", "t2"], "left_anti").select(*names).toDF(*docs.columns)
