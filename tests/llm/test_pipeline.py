import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from catalogspark.llm import decontaminate, toxicity
from tests.llm.test_line_dedup import brute as cut_lines
from tests.llm.test_minhash import brute as near_groups

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    want = {k: t for k, t in first.items() if k not in bad}

    gone = cut_lines([*want.items()])
    cut = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())) for k, t in want.items()}
    want = {k: t for k, t in cut.items() if not gone.get(k) or t.strip()}
    groups = near_groups([*want.items()])
    want = {k: t for k, t in want.items() if groups[k][1] == k}
    frame = spark.createDataFrame([*want.items()], "doc_id long, text string")
    leaks = {r.doc_id for r in decontaminate.contaminated(frame, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = {k: t for k, t in want.items() if k not in leaks}

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys() and bad and leaks and len(want) > 500
    for k, t in want.items():
        ids = sp.encode(t)
        assert got[k].ids == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, "a plain text of some words", "en", "s", 26), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id here", "en", "s", 10), (5, "a plain text of some words", "en", "s", 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.where(F.col("doc_id").isNull()).count() == 1 and out.where("doc_id in (1, 2, 3)").count() == 3
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF).collect()} == {1, 2, 3, None}


def test_stages_with_repeats_ties_long_texts_and_clashing_names(spark):
    """Rows are told apart by ``tag``; the extra columns have names that the operators use themselves."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    long = "tea " * 150_000 + "pot"
    block = " ".join(f"w{i}" for i in range(30))
    rows = [(7, "a clean text of words", 1), (7, "a clean text of words", 2), (7, "quite another text under the same id", 3), (None, "no id", 4), (None, "no id", 5), (8, None, 6), (8, "", 7), (9, long, 8), (10, long, 9)]
    rows += [(20, bench, 10), (20, "clean, whatever its id", 11), (None, bench, 12), (30, f"head\n{block}\ntail", 13), (31, f"other\n{block}\nend", 14), (32, block, 15)]
    extra = ["score", "_cut", "_left", "t1", "t2", "_kept", "label", "c0"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), tag, *range(len(extra))) for k, t, tag in rows], f"doc_id long, text string, lang string, source string, n_chars long, tag int, {', '.join(f'{c} int' for c in extra)}").repartition(3)
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema == docs.schema
        got[name] = {r.tag: r for r in out.collect()}
        assert all(tuple(r[c] for c in extra) == tuple(range(len(extra))) for r in got[name].values())
    everything = {r[2] for r in rows}
    assert got["toxicity"].keys() == everything
    assert got["line dedup"].keys() == everything - {9, 10, 15}  # nothing but a block of an earlier document; no id is the first
    assert (got["line dedup"][14].text, got["line dedup"][14].n_chars) == ("other\nend", 9)
    near = got["MinHash near-dedup"].keys()
    assert near - {1, 2} == everything - {1, 2, 9, 14, 15} and len(near & {1, 2}) == 1
    assert got["benchmark decontamination"].keys() == everything - {10, 12}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(rows) and last.where("n_tokens = 0").count() == 2
