import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from catalogspark.llm import sentencepiece_codec as sc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a ", "  two  spaces ", "line\nbreak\ttab", "ä€ü", "日本語 テキスト", "<s> </s> <unk> <0x0A>", "▁mark▁", "é", "🙂🙂 x", "﻿b", "word " * 3000, "x" * 20000, "a\u0000b", "1 2 33 ½ ﬁ"]


def test_equals_library(spark):
    docs = spark.createDataFrame([*enumerate(ODD), (900, None)], "doc_id long, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in sc.round_trip(docs, MODEL).collect()}
    for i, t in [*enumerate(ODD), (900, "")]:
        ids = sp.encode(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sc.round_trip(docs.limit(0), MODEL).count() == 0


def test_spans_and_decode(spark):
    docs = spark.createDataFrame([*enumerate(ODD)], "doc_id long, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    enc = sc.encode(docs, MODEL)
    for r in enc.collect():
        t = ODD[r.doc_id]
        assert r.ids == sp.encode(t)
        want = [(p.begin, p.end) for p in sp.encode(t, return_type="proto").pieces]
        solid = [i for i, p in enumerate(r.ids) if not sp.is_byte(p)]  # the library gives a character's bytes to its last byte piece
        assert [(r.begins[i], r.ends[i]) for i in solid] == [want[i] for i in solid]
    back = {r.doc_id: r.text for r in sc.decode(enc, MODEL).collect()}
    assert all(back[i] == sp.decode(sp.encode(t)) for i, t in enumerate(ODD))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_character_map_follows_the_library(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb

    for extra in (False, True):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=extra)
        proto = pb.ModelProto()
        proto.ParseFromString(lib.serialized_model_proto())
        tool = sc.Codec.__new__(sc.Codec)
        tool.spec, tool.suffix, tool.map = proto.normalizer_spec, False, sc.CharMap(proto.normalizer_spec.precompiled_charsmap)
        for t in [*ODD, "Ⅳ ﬃ ｶﾞ ①  ＡＢＣ　x", "a　　b", "Å Ǻ 각"]:
            want, at = lib.normalize(t, with_offsets=True)
            body, origin = tool.normalise(t.encode())
            assert body.decode() == want, (rule, extra, t)
            raw = t.encode()
            chars = np.flatnonzero(np.frombuffer(body, np.uint8) & 0xC0 != 0x80) if body else []
            assert [len(raw[:origin[i]].decode()) for i in chars] == list(at)[:len(chars)], (rule, extra, t)


def test_every_piece_covers_its_bytes():
    tool = sc.codec(MODEL)
    for t in ODD:
        ids = np.array(tool.lib.encode(t), np.int32)
        begins, ends = tool.spans(t.encode(), ids)
        assert (begins[1:] >= ends[:-1]).all() and (ends >= begins).all()
    ids = np.array(tool.lib.encode("some words of text"), np.int32)
    with pytest.raises(ValueError, match="normalised"):
        tool.spans(b"some words of test", ids)
    # the byte pieces of one character: the last has its span
    ids = np.array(tool.lib.encode("a\U00013000b"), np.int32)
    spans = [(b, e) for i, b, e in zip(ids.tolist(), *tool.spans("a\U00013000b".encode(), ids), strict=True) if tool.lib.is_byte(i)]
    assert spans == [(1, 1), (1, 1), (1, 1), (1, 5)]
