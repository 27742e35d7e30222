"""License scans: fuzzy search for short notices, by exact seeds and bounded-error matching.

A text's words (A-Z lower-cased; digits, letters and everything beyond ASCII) are joined by one blank; a notice is a
row of words as well, with the number of character edits that it may have.

1. Pigeonhole: a notice with at most e edits is cut into e+1 pieces, of which any copy holds at least one unchanged.
   One Aho-Corasick automaton over the pieces of all notices finds them in the joined words of many texts at once.
2. Around every piece a window is opened that holds any copy with this piece, and the words that such a copy may begin
   with are noted; overlapping windows of one notice are joined.
3. From each of these words the ``regex`` library matches the notice with at most e insertions, deletions and
   substitutions, as few as can be, up to the end of a word.  The best match of a window is taken, and what lies before
   and behind it is matched again until nothing is left.  A match gives its words, its bytes in the text as it stands,
   and its edits.

Notices of no edits are found and verified in the same way, with themselves as the only piece; of these the overlapping
places are all reported, as no edit can make one place out of two.

Defined results: null and empty texts have no words and no matches; every row is scanned by itself, so repeated rows,
null and repeated ids, and other columns, whatever their names, change nothing; texts are read whole, however long; an
empty table gives an empty result; of matches that overlap within one notice the one with fewer edits, then the first,
is reported; no notices at all give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import id_text, text_slices
from catalogspark.llm.shingles import words

_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The phrases and labels that a base place is made of.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Usual short notices of public licenses, as words, and the label that each stands for.
SHORT_NOTICES = (
    ("gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("creative commons attribution", "cc-by"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("bsd 3 clause license", "bsd"),
    ("bsd 2 clause license", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("boost software license", "boost"),
)
MATCH = "struct<notice int, label string, first_word long, last_word long, begin long, end long, edits int>"


def allowed_edits(notice: str) -> int:
    """One edit for every ten characters of a short notice, fewer of a long one: its pieces stay rare."""
    return min(len(notice) // 10, 2 + len(notice) // 30)


@dataclass(frozen=True)
class Notice:
    """``text`` is words joined by blanks."""

    text: str
    label: str
    edits: int

    @cached_property
    def pattern(self) -> regex.Pattern:
        return regex.compile(rf"(?b)(?:{regex.escape(self.text)}){{e<={self.edits}}}(?![^ ])")

    def pieces(self) -> list[tuple[int, str]]:
        """(place, piece): e+1 pieces of about the same length; at most as many as there are characters."""
        n = self.edits + 1
        ends = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def notices(base=BASE, short=SHORT_NOTICES) -> list[Notice]:
    """The base phrases without edits, then the short notices with theirs."""
    return [Notice(t, label, 0) for t, label in base] + [Notice(t, label, allowed_edits(t)) for t, label in short]


def automaton(wanted: list[Notice]) -> ahocorasick.Automaton:
    """Values are (length of the piece, [(notice, place in it)]); pieces are bytes read as Latin-1."""
    found: dict[str, list[tuple[int, int]]] = {}
    for k, notice in enumerate(wanted):
        if len(notice.text) <= notice.edits:
            raise ValueError(f"{notice.text!r} may lose all its characters")
        for at, piece in notice.pieces():
            # an edit may be as long as four bytes; a place counts in bytes
            found.setdefault(piece.encode().decode("latin-1"), []).append((k, len(notice.text[:at].encode())))
    made = ahocorasick.Automaton()
    for piece, held in found.items():
        made.add_word(piece, (len(piece), held))
    if found:
        made.make_automaton()
    return made


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, at, starts, ends, first): the words of a slice lower-cased and joined by blanks, documents by line feeds.

    Word w stands at ``at[w]`` of the bytes and from ``starts[w]`` to ``ends[w]`` of the slice; ``first`` as in ``words``.
    """
    starts, ends, first = words(data, offsets, _GAPS)
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    if len(starts):
        out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _LOWER[data[~_GAPS[data]]]
        last = first[1:][np.diff(first) > 0] - 1
        out[at[last] + size[last]] = 10
    return out.tobytes(), at, starts, ends, first


Window = tuple[int, int, set[int]]


def windows(joined: bytes, hits: list[int], slack: int, length: int, low: int, high: int) -> list[Window]:
    """(begin, end, places where a copy may begin) around the hits in the document [low, high), in whole words, overlapping ones joined."""
    out: list[Window] = []
    for hit in sorted(set(hits)):
        first, last = max(low, hit - slack), min(high, hit + length + slack)
        begin = max(low, joined.rfind(b" ", low, first + 1) + 1)
        blank = joined.find(b" ", max(begin, last - 1), high)
        end = high if blank < 0 else blank
        starts, at = set(), begin
        while 0 <= at <= hit + slack and at < end:
            if at >= first:
                starts.add(at)
            blank = joined.find(b" ", at, end)
            at = blank + 1 if blank >= 0 else -1
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end), out[-1][2] | starts
        else:
            out.append((begin, end, starts))
    return out


def matches(notice: Notice, text: str, starts: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, edits) of matches that begin at one of the places: the best ones that don't overlap; all of a notice without edits."""

    def found(low: int, high: int) -> list[tuple[int, int, int]]:
        """(edits, begin, end)"""
        tried = (notice.pattern.match(text, at, high) for at in starts if low <= at < high)
        return [(sum(m.fuzzy_counts), *m.span()) for m in tried if m]

    if not notice.edits:
        return [(b, e, 0) for _, b, e in found(0, len(text))]
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(text))]
    while todo:
        low, high = todo.pop()
        if held := found(low, high):
            edits, b, e = min(held)
            out.append((b, e, edits))
            todo += [(low, b - 1), (e + 1, high)]
    return sorted(out)


def scan_slice(wanted: list[Notice], machine: ahocorasick.Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple]]]:
    """Words of each document, and its matches: (notice, label, first_word, last_word, begin, end, edits), begin and end in bytes."""
    joined, at, starts, ends, first = joined_words(data, offsets)
    n = len(offsets) - 1
    found: list[list[tuple]] = [[] for _ in range(n)]
    hits: dict[tuple[int, int], list[int]] = {}
    bounds = np.append(at, len(joined))[first]  # where each document's words begin in the joined bytes
    if len(machine):
        for last, (size, held) in machine.iter(joined.decode("latin-1")):
            place = last + 1 - size
            doc = int(np.searchsorted(bounds, place, side="right")) - 1
            for k, inside in held:
                hits.setdefault((doc, k), []).append(place - inside)
    for (doc, k), places in sorted(hits.items()):
        notice, low, high = wanted[k], int(bounds[doc]), int(bounds[doc + 1]) - 1
        slack = 4 * notice.edits
        for b, e, begins in windows(joined, places, slack, len(notice.text.encode()), low, high):
            text = joined[b:e].decode(errors="surrogateescape")
            inside = sorted(len(joined[b:x].decode(errors="surrogateescape")) for x in begins)
            for x, y, edits in matches(notice, text, inside):
                begin = b + len(text[:x].encode(errors="surrogateescape"))
                w = int(np.searchsorted(at, begin, side="right")) - 1
                v = int(np.searchsorted(at, begin + len(text[x:y].encode(errors="surrogateescape")), side="left")) - 1
                found[doc].append((k, notice.label, w - int(first[doc]), v - int(first[doc]), int(starts[w] - offsets[doc]), int(ends[v] - offsets[doc]), edits))
    return np.diff(first), [sorted(set(rows)) for rows in found]


def _scan(wanted: list[Notice]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(wanted)
        for batch in batches:
            for row, size, data, offsets in text_slices(batch, "text"):
                count, found = scan_slice(wanted, machine, data, offsets)
                flat = [x for rows in found for x in rows]
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                names = ["notice", "label", "first_word", "last_word", "begin", "end", "edits"]
                columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate(kinds)]
                ends = np.concatenate([[0], np.cumsum([len(rows) for rows in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, size), pa.array(count.astype(np.int64)), lists], ["doc_id", "n_words", "matches"])

    return run


def scan(docs: DataFrame, wanted: list[Notice] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, matches of every row: notice (its number), label, first and last word, bytes [begin, end) of the text, edits."""
    wanted = notices() if wanted is None else wanted
    return id_text(docs, id_col, text_col).mapInArrow(_scan(wanted), f"doc_id long, n_words long, matches array<{MATCH}>")


def license_spans(docs: DataFrame, wanted: list[Notice] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label, begin, end, edits: a row for each match, in bytes of the text."""
    return scan(docs, wanted, id_col, text_col).select("doc_id", F.inline("matches")).select("doc_id", "label", "begin", "end", "edits")


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts and places of the base phrases, labels of these and of all matches.

    ``score`` is 1 less the share of edits in the characters of the best matched notice, 0 without a match.
    """
    wanted = notices()
    rows = scan(docs, wanted, id_col, text_col)
    base = F.filter("matches", lambda m: m["notice"] < len(BASE))
    labels = lambda held: F.array_join(F.array_sort(F.array_distinct(F.transform(held, lambda m: m["label"]))), ",")
    lengths = F.array(*(F.lit(len(x.text)) for x in wanted))
    likeness = F.transform("matches", lambda m: 1 - m["edits"] / F.get(lengths, m["notice"]))
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first_word"])).alias("first_word"), F.array_max(F.transform(base, lambda m: m["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
    )
