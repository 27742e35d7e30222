"""Content-addressed store of token ids.

Layout of a store (a folder in any store that Spark writes):

* ``chunks``   hash (sha256 of the bytes), ids (little-endian integers of ``width`` bytes): each distinct chunk once;
* ``recipes``  in ascending doc_id order: doc_id, n_tokens, part, nth, offset (ids of the part before it), hashes of
  its chunks in order, root (Merkle root over these hashes);
* ``manifest`` part, block, root: Merkle nodes over each run of 256 recipes of a part;
* ``about``    one row: width, end_id, tokenizer (sha256 of its file).

A rolling hash over the last 16 ids cuts each document's id stream, so that an edit changes the chunks around it and
no others.  With the tokenizer whose normaliser and pre-tokenizer are named below (``WORD_WISE``) documents are encoded
word by word: white space is dropped and no token crosses it, nor the edge between letters and punctuation, so a word's
ids do not depend on its neighbours, and each distinct word of a slice is encoded once; words count as equal if a 64-bit
hash, the length and the first and last eight bytes are.  Any other tokenizer, and a slice that holds a token added to
the vocabulary (in whatever case), encodes whole texts.

Reading back recomputes every chunk's sha256, every document's root from its recipe and every manifest node; a
difference stops the job.  ``read_documents`` joins ids to documents; ``digests`` needs only each chunk's length and
crc32, which combine exactly to the crc32 of the document, so no ids are moved.

Defined results: a null or empty text is the end id alone; rows that repeat an id are documents of their own, next to
each other and in order of their root; a null id sorts first; an empty table makes an empty store; other columns,
whatever their names, are not read.  Texts, however long, are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.llm.common import delete_path, id_text, materialize_at, text_slices
from catalogspark.llm.shingles import U, _powers, mix, word_hashes

WINDOW, MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 16, 64, 256, 2048
#: Distinct words whose ids one Python worker keeps, and distinct chunk hashes it remembers having sent.
WORDS_KEPT, CHUNKS_KEPT = 1_200_000, 100_000
BLOCK = 256

_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_SHIFT = np.array([0, *(64 - 8 * n for n in range(1, 9))], U)
# Punctuation that ends a run of letters; a hyphen stays inside, so that compounds are words.
_STOP = np.zeros(256, bool)
_STOP[[*b"!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~"]] = True
# Second bytes of the letters of Latin-1 (after 0xC3): they compose with nothing that is ASCII, and lower to one letter.
_LATIN = np.zeros(256, bool)
_LATIN[128:192] = True
_LATIN[[0x97, 0xB7]] = False  # the signs of multiplication and division


# Settings of the tokenizer that may be taken word by word.
WORD_WISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


# Byte-level vocabularies write a byte as itself where it is printable in Latin-1, the others from 256 on in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_AS_TEXT = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


def plain_piece(word: str) -> str | None:
    """What the model sees of a word that is one run of letters: normaliser and pre-tokenizer leave one piece of it."""
    if word.isascii():
        return word.lower() if word.isalpha() else None
    low = word.lower() if "Σ" not in word else "".join([c.lower() for c in word])  # each letter for itself, a last sigma too
    if word.isalpha() and low.isalpha() and unicodedata.is_normalized("NFC", word):
        return low.encode().decode("latin-1").translate(_AS_TEXT)
    return None


class WordEncoder:
    """Ids of whole texts through a cache of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tool = Tokenizer.from_file(path)
        self.width = id_width(self.tool)
        settings = json.loads(self.tool.to_str())
        model = settings["model"]
        self.by_word = all(settings.get(k) == v for k, v in WORD_WISE.items()) and model["type"] == "BPE" and not model.get("dropout")
        self.by_word = self.by_word and not any(t["normalized"] for t in settings["added_tokens"])
        self.added = [t["content"].encode().lower() for t in settings["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        """No words: their hashes in order, their marks, where in ``flat`` their ids begin, and how many there are."""
        self.keys, self.marks = np.zeros(0, U), np.zeros(0, U)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, f"<u{self.width}")

    def encode_whole(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, by the tokenizer on whole texts."""
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ids = [[*e.ids, end_id] for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), f"<u{self.width}"), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])

    def _encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some words in any order, and where in them each word's begin and how many there are."""
        other = np.concatenate([[0], np.cumsum(~_LETTER[data])])
        letters = other[ends] == other[starts]
        here, there = np.flatnonzero(letters), np.flatnonzero(~letters)
        raw = data.tobytes()
        words = [raw[s:e].decode() for s, e in zip(starts[there].tolist(), ends[there].tolist(), strict=True)]
        pieces = [*map(plain_piece, words)]
        plain = [i for i, p in enumerate(pieces) if p is not None]
        rest = [i for i, p in enumerate(pieces) if p is None]
        ids, count, bpe = [], [], self.tool.model.tokenize
        for piece in chain(joined(data, starts[here], ends[here]).split(), (pieces[i] for i in plain)):
            tokens = bpe(piece)
            count.append(len(tokens))
            ids += [x.id for x in tokens]
        for e in self.tool.encode_batch_fast([words[i] for i in rest], add_special_tokens=False):
            count.append(len(e.ids))
            ids += e.ids
        order = np.concatenate([here, there[plain], there[rest]]).astype(np.int64)
        begin, size = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        size[order] = count
        begin[order] = np.cumsum(count) - count
        return np.array(ids, self.flat.dtype), begin, size

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice with the end id after each document, and where each document's ids begin."""
        if not self.by_word:
            return self.encode_whole(data, offsets, end_id)
        low = _FOLD[data]
        raw = low.tobytes()
        if any(token in raw for token in self.added):
            return self.encode_whole(data, offsets, end_id)
        starts, ends, first = _units(low, offsets)
        h = word_hashes(low, starts, ends)
        at, which = distinct(h)
        if not same_words(low, starts, ends, at, which):
            return self.encode_whole(data, offsets, end_id)
        if len(self.keys) + len(at) > WORDS_KEPT:
            self._forget()
        rank = np.argsort(h[at])
        at = at[rank]
        keys, marks = h[at], word_marks(low, starts[at], ends[at])
        near = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inner = near < len(self.keys)
        known[inner] = self.keys[near[inner]] == keys[inner]
        if (self.marks[near[known]] != marks[known]).any():
            return self.encode_whole(data, offsets, end_id)
        begin, size = np.empty(len(keys) + 1, np.int64), np.empty(len(keys) + 1, np.int64)
        begin[:-1][known], size[:-1][known] = self.begin[near[known]], self.size[near[known]]
        new = np.flatnonzero(~known)
        if len(new):
            flat, begins, size[new] = self._encoded(low, starts[at[new]], ends[at[new]])
            begin[new] = begins + len(self.flat)
            self.flat = np.concatenate([self.flat, flat])
            self.begin, self.size = np.insert(self.begin, near[new], begin[new]), np.insert(self.size, near[new], size[new])
            self.keys, self.marks = np.insert(self.keys, near[new], keys[new]), np.insert(self.marks, near[new], marks[new])
        flat = np.append(self.flat, np.array(end_id, self.flat.dtype))
        begin[-1], size[-1] = len(self.flat), 1
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        order = np.insert(place[which], first[1:], len(rank))
        length = size[order]
        out_at = np.concatenate([[0], np.cumsum(length)])
        take = np.arange(out_at[-1]) + np.repeat(begin[order] - out_at[:-1], length)
        return flat[take], out_at[first + np.arange(len(offsets))]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """Words of ASCII letters with a space after each."""
    size = ends - starts + 1
    out_at = np.cumsum(size)
    text = np.append(data, np.uint8(0))[np.arange(size.sum()) + np.repeat(starts - out_at + size, size)]
    text[out_at - 1] = 32
    return text.tobytes().decode("ascii")


def id_width(tool) -> int:
    return 2 if tool.get_vocab_size(with_added_tokens=True) <= 65536 else 4


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct hash stands first, in that order, and for every hash which of them it is."""
    coded = pa.array(h).dictionary_encode()
    which = coded.indices.to_numpy()
    at = np.zeros(len(coded.dictionary), np.int64)
    at[which[::-1]] = np.arange(len(h) - 1, -1, -1)
    return at, which


def word_marks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length and the first and last eight bytes of each word."""
    low = np.concatenate([np.zeros(8, np.uint8), _FOLD[data], np.zeros(8, np.uint8)])
    window = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    size = np.minimum(ends - starts, 8)
    return (window[starts + 8] & _MASK[size]) + (window[ends] >> _SHIFT[size]) * U(0x9E3779B97F4A7C15) + (ends - starts).astype(U)


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, which: np.ndarray) -> bool:
    """Whether every word has the length and the first and last eight bytes of the word that stands for its hash."""
    mark = word_marks(data, starts, ends)
    return bool((mark[at][which] == mark).all()) if len(mark) else True


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words cut at ASCII white space and between a letter of ASCII or Latin-1 and a stop, where no token can cross."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_BREAK[data]
    edge = np.zeros(n, bool)  # a new unit begins here although the byte before is inside one
    edge[1:] = _LETTER[data[:-1]]
    edge[2:] |= _LATIN[data[1:-1]] & (data[:-2] == 0xC3)
    edge[1:] &= _STOP[data[1:]]
    cut = offsets[(offsets > 0) & (offsets < n)]
    edge[cut] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    last[:-1] &= ~inside[1:] | edge[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def cuts(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all documents: content-defined, MIN_CHUNK to MAX_CHUNK long but for a document's last."""
    n = len(ids)
    power, inverse = _powers(n + 1)
    run = np.zeros(n + 1, U)
    np.cumsum(mix(ids.astype(U) + U(1)) * power[:n], dtype=U, out=run[1:])
    ends = np.arange(1, n + 1)
    begins = np.maximum(ends - WINDOW, 0)
    rolled = mix((run[ends] - run[begins]) * inverse[begins])
    hits = ends[(rolled & U(MEAN_CHUNK - 1)) == 0]
    out = []
    near = np.searchsorted(hits, bounds)
    for d in range(len(bounds) - 1):
        at, end = int(bounds[d]), int(bounds[d + 1])
        for hit in hits[near[d]:near[d + 1]].tolist():
            while hit - at > MAX_CHUNK:
                at += MAX_CHUNK
                out.append(at)
            if hit - at >= MIN_CHUNK and hit < end:
                at = hit
                out.append(at)
        while end - at > MAX_CHUNK:
            at += MAX_CHUNK
            out.append(at)
        out.append(end)
    return np.array(out, np.int64)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Binary tree over hashes; a node without a sibling moves up."""
    while len(leaves) > 1:
        leaves = [hashlib.sha256(b"\1" + leaves[i] + leaves[i + 1]).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else hashlib.sha256(b"").digest()


_ENCODERS: dict[str, WordEncoder] = {}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _ENCODERS.setdefault(path, None) or WordEncoder(path)
        _ENCODERS[path] = tool
        sent: set[bytes] = set()
        for batch in batches:
            for at, n, data, offsets in text_slices(batch, "text"):
                ids, bounds = tool.encode(data, offsets, end_id)
                ends = cuts(ids, bounds)
                begins = np.concatenate([[0], ends[:-1]])
                raw, w = ids.astype(f"<u{tool.width}").tobytes(), tool.width
                hashes, new = [], []
                for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
                    body = raw[w * b:w * e]
                    key = hashlib.sha256(body).digest()
                    hashes.append(key)
                    new.append(None if key in sent else body)
                    if len(sent) >= CHUNKS_KEPT:
                        sent.clear()
                    sent.add(key)
                per_doc = np.searchsorted(ends, bounds[1:]) + 1
                lists = np.concatenate([[0], per_doc]).astype(np.int32)
                roots = [merkle_root(hashes[a:b]) for a, b in zip(lists[:-1].tolist(), lists[1:].tolist(), strict=True)]
                offs = pa.array(lists)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n),
                        pa.array(np.diff(bounds)),
                        pa.array(roots, pa.binary()),
                        pa.ListArray.from_arrays(offs, pa.array(hashes, pa.binary())),
                        pa.ListArray.from_arrays(offs, pa.array(new, pa.binary())),
                    ],
                    ["doc_id", "n_tokens", "root", "hashes", "bodies"],
                )

    return run


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position and offset of each recipe in its part; a task holds one part, in order."""
    nth = offset = 0
    for batch in batches:
        n = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
        before = offset + np.concatenate([[0], np.cumsum(n)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(nth, nth + len(n))), pa.array(before[:-1].astype(np.int64))], [*batch.schema.names, "nth", "offset"])
        nth, offset = nth + len(n), int(before[-1])


def _manifest(recipes: DataFrame) -> DataFrame:
    block = F.floor(F.col("nth") / BLOCK).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("nth", "root")))
    return recipes.groupBy("part", block.alias("block")).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: F.hex(x["root"])), "").cast("binary"), 256).alias("node"))


def write_store(docs: DataFrame, root: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the store at ``root``."""
    spark = docs.sparkSession
    encoded, path = materialize_at(
        id_text(docs, id_col, text_col).mapInArrow(_encode(tokenizer_path, end_id), "doc_id long, n_tokens long, root binary, hashes array<binary>, bodies array<binary>"), "token-encoded"
    )
    pieces = encoded.select(F.explode(F.arrays_zip("hashes", "bodies")).alias("c")).select(F.col("c.hashes").alias("hash"), F.col("c.bodies").alias("ids")).where("ids IS NOT NULL")
    pieces.dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(f"{root}/chunks")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (
        encoded.select("doc_id", "n_tokens", "root", "hashes")
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "root")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_offsets, "doc_id long, n_tokens long, root binary, hashes array<binary>, part int, nth long, offset long")
        .write.option("compression", "zstd")
        .parquet(f"{root}/recipes")
    )
    _manifest(spark.read.parquet(f"{root}/recipes")).write.parquet(f"{root}/manifest")
    from tokenizers import Tokenizer

    with open(tokenizer_path, "rb") as f:
        mark = hashlib.file_digest(f, "sha256").hexdigest()
    about = spark.range(1).select(F.lit(id_width(Tokenizer.from_file(tokenizer_path))).alias("width"), F.lit(end_id).alias("end_id"), F.lit(mark).alias("tokenizer"))
    about.write.parquet(f"{root}/about")
    delete_path(spark, path)


def about(spark: SparkSession, root: str) -> dict:
    """width, end_id and tokenizer (sha256 of its file) of a store."""
    return spark.read.parquet(f"{root}/about").first().asDict()


def _check_chunks(width: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            count, crc = [], []
            for key, body in zip(keys, bodies, strict=True):
                if hashlib.sha256(body).digest() != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                wide = np.frombuffer(body, f"<u{width}").astype("<u4")
                count.append(len(wide))
                crc.append(zlib.crc32(wide.tobytes()))
            cols = [batch.column(0), pa.array(count, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [batch.column(1)] * keep_ids, ["hash", "n", "crc", "ids"][: len(cols) + keep_ids])

    return run


def _check_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Root of each recipe against its hashes; a row for each chunk of it."""
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for want, leaves, key in zip(col["root"].to_pylist(), col["hashes"].to_pylist(), col["doc_id"].to_pylist(), strict=True):
            if merkle_root(leaves) != want:
                raise ValueError(f"the recipe of document {key} is damaged")
        yield batch


def read_recipes(spark: SparkSession, root: str) -> DataFrame:
    """Recipes with their start in the whole stream, checked against their roots and the manifest."""
    recipes = spark.read.parquet(f"{root}/recipes")
    wrong = _manifest(recipes).join(spark.read.parquet(f"{root}/manifest").withColumnRenamed("node", "kept"), ["part", "block"], "full_outer").where("NOT node <=> kept").limit(1)
    if not wrong.isEmpty():
        raise ValueError("recipes differ from their manifest")
    totals = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    checked = recipes.mapInArrow(_check_recipes, recipes.schema)
    return checked.join(F.broadcast(before), "part").select("doc_id", (F.col("ahead") + F.col("offset")).alias("start"), "n_tokens", "part", "nth", "root", "hashes")


def _entries(recipes: DataFrame) -> DataFrame:
    return recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("hashes").alias("seq", "hash"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, ids (bytes, ``about``'s width each), put together again from the chunks."""
    chunks = spark.read.parquet(f"{root}/chunks").mapInArrow(_check_chunks(about(spark, root)["width"], True), "hash binary, n long, crc long, ids binary")
    joined = _entries(read_recipes(spark, root)).join(chunks, "hash", "left")
    body = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ids"))), lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return joined.groupBy("start").agg(F.first("doc_id").alias("doc_id"), body.alias("ids")).select("doc_id", "start", "ids")


#: The reflected polynomial of CRC-32 (a fixed value).
CRC_POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo the CRC's, bit-reflected, elementwise."""
    out = np.zeros_like(a)
    b = b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(CRC_POLYNOMIAL), b >> np.uint32(1))
    return out


def shift_crc(crc: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """What ``crc`` of a part adds to the crc32 of a whole that has ``behind`` more bytes after it."""
    square = np.array([1 << 23], np.uint32)  # x**8: one byte
    out, left = crc.astype(np.uint32), behind.astype(np.int64)
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _times(out[odd], np.broadcast_to(square, odd.shape))
        square, left = _times(square, square), left >> 1
    return out


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = shift_crc(batch.column(1).to_numpy(), 4 * batch.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(crc.astype(np.int64)), batch.column(5)], ["start", "doc_id", "n_tokens", "crc", "n"])


def digests(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    chunks = spark.read.parquet(f"{root}/chunks").mapInArrow(_check_chunks(about(spark, root)["width"], False), "hash binary, n long, crc long")
    ahead = Window.partitionBy("start").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = _entries(read_recipes(spark, root)).join(chunks, "hash", "left").select("start", "crc", (F.col("n_tokens") - F.sum("n").over(ahead)).alias("behind"), "doc_id", "n_tokens", "n")
    shifted = parts.mapInArrow(_shift, "start long, doc_id long, n_tokens long, crc long, n long")
    whole = shifted.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("found"))
    return whole.select("doc_id", "start", F.when(F.col("found") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document has lost chunks"))).alias("n_tokens"), "ids_crc32")
