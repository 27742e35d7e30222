"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catalogspark.llm import decontaminate, html_extract, jump_shard, lexical_search, license_scan, line_dedup, merkle_text, minhash, sentencepiece_codec, token_store, toxicity, warc_fixity, whitening
from catalogspark.llm.common import new_path


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "token-store")
    token_store.write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), root, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.digests(spark, root)


def op2_jump_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shard.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_text.edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model)


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.audit_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_jump_shard": op2_jump_shard,
        "op3_line_dedup": op3_line_dedup,
        "op4_merkle_fingerprint": op4_merkle_fingerprint,
        "op5_toxicity": op5_toxicity,
        "op6_warc_fixity": op6_warc_fixity,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_superminhash": op8_superminhash,
        "op9_decontaminate": op9_decontaminate,
        "op10_html_extract": op10_html_extract,
        "op11_whitening": op11_whitening,
        "op12_license_scan": op12_license_scan,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_merkle_fingerprint": merkle_text.sql(),
        "op6_warc_fixity": warc_fixity.SQL,
        "op13_lexical_search": lexical_search.SQL,
    }
