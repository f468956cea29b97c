"""The registered queries of this subpackage: name -> function of (spark, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_examples
from .hmm import score_documents
from .jaccard import similar_groups
from .langid import identify
from .licences import scan_licences
from .media import text_media
from .merkle import merkle_proofs
from .mixing import mix_sources
from .pii import find_personal_data
from .quality import quality_rules
from .spm import encode_documents
from .trie import conversation_trie
from .urls import judge_urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


def vocabulary() -> str:
    """Path of the merge-type vocabulary that executors have installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_documents(spark, sf_dir), vocabulary())


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(_documents(spark, sf_dir))


def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(_documents(spark, sf_dir))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score")


def op10_url_filter_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by its earlier name."""
    return op10_url_filter(spark, sf_dir)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_proofs(_documents(spark, sf_dir))


def op13_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_examples(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_mix_sources, op3_personal_data, op4_quality_rules, op5_sentencepiece, op6_ngram_jaccard_join, op7_hmm_scores, op8_language_id, op9_media_columns, op10_url_filter, op10_url_filter_whole, op11_conversation_trie, op12_merkle_manifest, op13_chat_examples)}
