"""SentencePiece encoding that keeps offsets: every piece knows its bytes in the original text.

The model's compiled character map (a double-array trie and a block of replacement strings) is read here.  A text is
normalised by longest prefix through that trie; each byte of the normalised text records the source byte it came
from.  The library then segments the text (it normalises for itself, too), and its pieces, laid end to end over the
normalised text, project every piece to a span of source bytes.  If the pieces' bytes are ever other than those of the
text as normalised here the job fails, so every id that is returned has been checked against the bytes that it covers.

Defined results: a null text is empty; an empty text has no pieces; special tokens' names in a text are ordinary text;
rows are independent, so repeated ids, nulls in other columns and clashing names change nothing; an empty table gives
an empty result.  Texts, however long, are encoded whole.  Of the byte pieces of one character the last one has its span
and the others an empty one at its beginning.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catalogspark.llm.common import id_text

SPACE = "▁".encode()


class CharMap:
    """The compiled character map: longest-prefix lookup of byte strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size:] if blob else b""
        heads = [c for c in range(256) if self.units and self._step(self._root(), c) is not None]
        self.scan = re.compile(b"[" + b"".join(b"\\x%02x" % c for c in heads) + b"]") if heads else None

    def _jump(self, unit: int) -> int:
        return (unit >> 10) << (8 if unit & 0x200 else 0)

    def _root(self) -> int:
        return self._jump(self.units[0])

    def _step(self, at: int, byte: int) -> tuple[int, bool] | None:
        at ^= byte
        if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
            return None
        return at ^ self._jump(self.units[at]), bool(self.units[at] >> 8 & 1)

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``start`` and its replacement."""
        at, best = self._root(), None
        for i in range(start, len(text)):
            went = self._step(at, text[i])
            if went is None:
                break
            at, leaf = went
            if leaf:
                best = i + 1 - start, self.units[at] & 0x7FFFFFFF
        if best is None:
            return None
        end = self.strings.index(b"\0", best[1])
        return best[0], self.strings[best[1]:end]

    def apply(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Replaced bytes, and for each the source byte where its replaced character starts."""
        source = np.frombuffer(text, np.uint8)
        if self.scan is None:
            return source, np.arange(len(text))
        parts, origin, done, at = [], [], 0, 0
        while found := self.scan.search(text, at):
            at = found.start()
            hit = self.longest(text, at)
            if hit is None:
                at += 1
                while at < len(text) and text[at] & 0xC0 == 0x80:
                    at += 1
                continue
            parts += [source[done:at], np.frombuffer(hit[1], np.uint8)]
            origin += [np.arange(done, at), np.full(len(hit[1]), at)]
            at = done = at + hit[0]
        parts.append(source[done:])
        origin.append(np.arange(done, len(text)))
        return np.concatenate(parts), np.concatenate(origin)


def _first_byte_of_character(text: bytes, origin: np.ndarray) -> np.ndarray:
    """Move every origin back to the first byte of its character."""
    if not len(origin):
        return origin
    source = np.frombuffer(text, np.uint8)
    starts = np.flatnonzero(source & 0xC0 != 0x80)
    return starts[np.searchsorted(starts, origin, "right") - 1]


class Codec:
    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        self.spec = proto.normalizer_spec
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharMap(self.spec.precompiled_charsmap)
        self.piece = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.encode() for p in proto.pieces]
        self.length = np.array([len(x) for x in self.piece], np.int64)
        self.unknown = self.lib.unk_id()
        self.text = [str(i) for i in range(len(proto.pieces))]

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, one longer, the source byte of each and where the last ends."""
        if not text:
            return b"", np.zeros(1, np.int64)
        out, origin = self.map.apply(text)
        origin = _first_byte_of_character(text, origin)
        begin, end = 0, len(text)
        if self.spec.remove_extra_whitespaces:
            blank = out == 32
            keep = ~blank | np.concatenate([[False], ~blank[:-1]])
            solid = np.flatnonzero(~blank)
            if not len(solid):
                return b"", np.full(1, end)
            if solid[-1] + 1 < len(out):
                end = int(origin[solid[-1] + 1])
            keep[solid[-1] + 1:] = False
            begin = int(origin[solid[0]])
            out, origin = out[keep], origin[keep]
        mark = SPACE if self.spec.escape_whitespaces else b" "
        if self.spec.escape_whitespaces:
            times = np.where(out == 32, 3, 1)
            origin = np.repeat(origin, times)
            body = out.tobytes().replace(b" ", SPACE)
        else:
            body = out.tobytes()
        if self.spec.remove_extra_whitespaces:  # the library also takes the mark itself off the end
            while body.endswith(mark):
                end, body, origin = int(origin[len(body) - len(mark)]), body[:-len(mark)], origin[:-len(mark)]
        if self.spec.add_dummy_prefix:
            pad = np.full(len(mark), end if self.suffix else begin)
            body, origin = (body + mark, np.concatenate([origin, pad])) if self.suffix else (mark + body, np.concatenate([pad, origin]))
        return body, np.append(origin, end)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end source byte of every piece."""
        body, origin = self.normalise(text)
        length = self.length[ids]
        if (ids == self.unknown).any():  # an unknown piece stands for the characters that no piece covers
            laid = [p.piece.encode() for p in self.lib.encode(text.decode(), return_type="proto").pieces]
            length = np.array([len(x) for x in laid], np.int64)
        else:
            laid = map(self.piece.__getitem__, ids.tolist())
        edge = np.concatenate([[0], np.cumsum(length)])
        if b"".join(laid) != body:
            raise ValueError(f"the pieces' {edge[-1]} bytes aren't the {len(body)} normalised ones")
        return origin[edge[:-1]], origin[edge[1:]]


_CODECS: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    if model_path not in _CODECS:
        _CODECS[model_path] = Codec(model_path)
    return _CODECS[model_path]


def _texts(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Row ranges of about ``limit`` characters."""
    held, size, first = [], 0, 0
    for i, t in enumerate(batch.column(1).to_pylist()):
        held.append(t or "")
        size += len(held[-1])
        if size >= limit:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _encode(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_path)
        for batch in batches:
            for first, texts in _texts(batch):
                ids = tool.lib.encode(texts, num_threads=1)
                flat = [np.array(x, np.int32) for x in ids]
                spans = [tool.spans(t.encode(), x) for t, x in zip(texts, flat, strict=True)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v).astype(np.int32))) for v in (flat, [s[0] for s in spans], [s[1] for s in spans])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *lists], ["doc_id", "ids", "begins", "ends"])

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends: the pieces of each whole text and their source byte spans."""
    return id_text(docs, id_col, text_col).mapInArrow(_encode(model_path), "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def _decode(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_path)
        for batch in batches:
            ids = [x or [] for x in batch.column(1).to_pylist()]
            texts = tool.lib.decode(ids, num_threads=1) if ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model_path), "doc_id long, text string")


def _digest(model_path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_path)
        name = tool.text
        for batch in batches:
            for first, texts in _texts(batch):
                ids = tool.lib.encode(texts, num_threads=1)
                back = tool.lib.decode(ids, num_threads=1)
                count, covered, sha, plain = [], [], [], []
                for t, x, y in zip(texts, ids, back, strict=True):
                    begins, ends = tool.spans(t.encode(), np.array(x, np.int32))
                    count.append(len(begins))
                    covered.append(int((ends - begins).sum()))
                    sha.append(hashlib.sha256(",".join([name[i] for i in x]).encode()).hexdigest())
                    plain.append(hashlib.sha256(y.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(count, pa.int64()), pa.array(covered, pa.int64()), pa.array(sha), pa.array(plain), *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], ["doc_id", "n_tokens", "covered_bytes", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return run


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode with spans, decode, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes, and ids if asked for.

    covered_bytes is the sum of the pieces' source spans.
    """
    schema = "doc_id long, n_tokens long, covered_bytes long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = id_text(docs, id_col, text_col).mapInArrow(_digest(model_path, with_ids), schema)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes", *["ids"] * with_ids)
