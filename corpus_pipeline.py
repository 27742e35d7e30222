"""A training corpus from raw documents: five stages, each one operator of ``catalogspark.llm``.

Every stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns of ``documents``; the
last returns the encoded documents.  Between stages the documents are a written table; the one before is deleted, and so
is every table that the stage's operators have written.

In every stage rows are judged whole: very long texts are read to their end, columns may have any names beside those of
``documents``, ties are broken by the smaller id, and an empty table gives an empty one.  What a stage does with null
and empty texts, null ids and repeated rows is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catalogspark.llm import decontaminate, line_dedup, minhash, sentencepiece_codec, toxicity
from catalogspark.llm.common import delete_path, materialize_at, written_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Each row is scored by its text alone, so equal rows stay or go together; null and empty texts have the score of a
    text without features; an id may be null or repeated.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def cut_repeated_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks that an earlier document holds are cut out, ``n_chars`` follows; a document of nothing but such blocks goes.

    Null and empty texts stay as they are; a null id comes before all others; rows equal in id and text are one document
    and are cut alike; rows that share only the id are documents in order of their text's hash.
    """
    return line_dedup.without_common_blocks(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Null, empty and blank texts are alike to nothing and stay, and so do rows without an id; rows that share an id are
    one document, and of those equal in id and text one stays.
    """
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go.

    Each row is judged by its own text, whatever rows share its id; null and empty texts and null ids stay.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and decoded text.

    A row for each row: a null text counts as empty and has no ids; ids may be null or repeated.
    """
    return sentencepiece_codec.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_blocks),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: Learning, alignment and encoding are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with written_tables() as made:
            docs, path = materialize_at(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        for table in made:  # what the stage's operators have written, and the stage before
            if table != path:
                delete_path(spark, table)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
