import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from catalogspark.llm import token_store as ts
from catalogspark.llm.common import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "a", "It's they're WE'LL don't'", "x.y,z!?...", "ÀÉ é ́ a ́", "ΑΣ ΟΔΟΣ.", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "日本語 テキスト。", "tab\tnew\nline\r\n\v\f x", "a b c　d", "İstanbul ǅ ß", "5 55 5.5,5", "😀😀 :)", "word" * 5000, "q " * 40_000, "a.b.c;d:e a'.s 's 't.", "x\u0000y"]


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "n", 3) for r in rows], "doc_id long, text string, n string, start int").repartition(3)
    root = new_path(spark, "store")
    ts.write_store(docs, root, PATH)
    return root


def want(rows):
    tool = Tokenizer.from_file(PATH)
    at, out = 0, []
    for d, t in sorted(rows):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    root = run(spark, rows)
    full = want(rows)
    got = sorted(map(tuple, ts.digests(spark, root).collect()))
    assert got == [x[:4] for x in full]
    back = {r.doc_id: (r.start, np.frombuffer(r.ids, "<u2").tolist()) for r in ts.read_documents(spark, root).collect()}
    assert back == {x[0]: (x[1], x[4]) for x in full}
    chunks = spark.read.parquet(f"{root}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count() < spark.read.parquet(f"{root}/recipes").selectExpr("sum(size(hashes))").first()[0]


def test_odd_texts(spark):
    rows = [*enumerate(ODD)]
    assert sorted(map(tuple, ts.digests(spark, run(spark, rows)).collect())) == [x[:4] for x in want(rows)]


def test_repeats_nulls_and_no_rows(spark):
    rows = [(5, "same text"), (5, "same text"), (5, "other"), (None, "no id"), (1, None)]
    got = ts.digests(spark, run(spark, rows)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 5, 5, 5]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert ts.digests(spark, run(spark, [(1, "x")][:0])).count() == 0


def test_damage_is_found(spark):
    root = run(spark, [(i, f"text number {i} " * 50) for i in range(20)])
    bad = spark.read.parquet(f"{root}/chunks").selectExpr("hash", "unhex(concat('0000', substr(hex(ids), 5))) AS ids")
    bad.write.parquet(f"{root}/x")
    ts.delete_path(spark, f"{root}/chunks")
    spark.read.parquet(f"{root}/x").write.parquet(f"{root}/chunks")
    with pytest.raises(Exception, match="damaged"):
        ts.digests(spark, root).collect()


def test_edit_moves_few_chunks():
    rnd = random.Random(1)
    ids = np.array([rnd.randrange(49000) for _ in range(60_000)], np.uint16)
    edited = np.concatenate([ids[:30_000], np.array([7, 8, 9], np.uint16), ids[30_000:]])
    parts = []
    for x in (ids, edited):
        ends = ts.cuts(x, np.array([0, len(x)]))
        assert ends[-1] == len(x) and np.diff(np.concatenate([[0], ends])).max() <= ts.MAX_CHUNK
        parts.append({x[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)})
    assert len(parts[1] - parts[0]) <= 3


def test_crc_combines():
    a, b, c = b"abcd" * 5, b"", b"xyz0" * 1000
    total = np.array([zlib.crc32(a), zlib.crc32(b), zlib.crc32(c)], np.int64)
    got = ts.shift_crc(total, np.array([len(b) + len(c), len(c), 0]))
    assert int(np.bitwise_xor.reduce(got)) == zlib.crc32(a + b + c)


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    """The same model without its normaliser, and one with more ids than two bytes hold."""
    plain = Tokenizer.from_file(PATH)
    state = json.loads(plain.to_str()) | {"normalizer": None}
    (tmp_path / "plain.json").write_text(json.dumps(state))
    rows = [(i, t) for i, t in enumerate(ODD)]
    for path in (str(tmp_path / "plain.json"), public_tokenizers.path("byte_bpe_50k.json")):
        tool, root = Tokenizer.from_file(path), new_path(spark, "store")
        ts.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), root, path)
        back = {r.doc_id: np.frombuffer(r.ids, f"<u{ts.about(spark, root)['width']}").tolist() for r in ts.read_documents(spark, root).collect()}
        assert back == {i: [*tool.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    assert ts.WordEncoder(PATH).by_word and not ts.WordEncoder(path).by_word
    assert ts.about(spark, root) == {"width": 2, "end_id": 2, "tokenizer": hashlib.sha256(open(path, "rb").read()).hexdigest()}


def test_words_are_compared():
    data = np.frombuffer(b"alpha Beta alpha beta a b gamma-delta-epsilon-zeta gamma-delta-epsilon-zetb", np.uint8)
    starts, ends, _ = ts._units(data, np.array([0, len(data)]))
    h = ts.word_hashes(data, starts, ends)
    _, at, which = np.unique(h, return_index=True, return_inverse=True)
    assert ts.same_words(data, starts, ends, at, which) and len(at) == 6
    for x, y in ((0, 1), (4, 5), (0, 4), (6, 7)):  # as if these two had one hash
        same = which.copy()
        same[x] = which[y]
        assert not ts.same_words(data, starts, ends, at, same)


def test_added_tokens_in_other_case(spark):
    """They are no such tokens, and words of other case next to them are not equal to them."""
    rows = [(1, "x <|ENDOFTEXT|> y <|endoftext|> Z"), (2, "<|EndOfText|>"), (3, "plain Words, words")]
    assert sorted(map(tuple, ts.digests(spark, run(spark, rows)).collect())) == [x[:4] for x in want(rows)]


def test_edges_of_letters():
    """Letters and the punctuation behind them are words of their own; mixed texts give the library's ids."""
    text = "esí, die&&& die Die*** esí"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = ts._units(data, np.array([0, len(data)]))
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["esí", ",", "die", "&&&", "die", "Die", "***", "esí"]
    tool, enc, rnd = Tokenizer.from_file(PATH), ts.WordEncoder(PATH), random.Random(5)
    signs = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", *"abSTdr059 \n", "é", "É", "×", "÷", "ß", "İ", "\u0301", "\u0338", "ÿ", "Σ", "ς", "'s", "'LL", "…", "日", "\u00a0", "\u00aa", "K"]
    for _ in range(30):
        texts = ["".join(rnd.choices(signs, k=rnd.randrange(60))) for _ in range(80)]
        raw = [t.encode() for t in texts]
        ids, bounds = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 2)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*tool.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_words_are_forgotten(monkeypatch):
    """A cache that fills up again and again changes no ids."""
    monkeypatch.setattr(ts, "WORDS_KEPT", 50)
    tool, enc = Tokenizer.from_file(PATH), ts.WordEncoder(PATH)
    for k in range(20):
        raw = " ".join(f"word{'abcdefghij'[i % 10]}{'xyz'[k % 3]}" for i in range(k, k + 30)).encode()
        ids, _ = enc.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 2)
        assert ids.tolist() == [*tool.encode(raw.decode(), add_special_tokens=False).ids, 2] and len(enc.keys) <= 50
