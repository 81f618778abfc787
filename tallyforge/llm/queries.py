"""The queries opN_<name>: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, language_id, packing, resampling, secret_scan, simhash_dedup, spotsigs, suffix_dedup, token_shards, topk_search, toxicity, url_filter, vocabularies
from .common import learned_fold, table, work_dir

#: The rules of the URL query: (host and path, verdict).
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(learned_fold(F.col("doc_id"))))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (~learned_fold(F.col("doc_id"))).alias("held_out"), "toxicity.score", "toxicity.predicted", F.size("toxicity.passages").alias("n_passages"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared_with_edits(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(learned_fold(F.col("doc_id"))))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~learned_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = vocabularies.ByteLevelBpe.read(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages: the quality label of the document with the page's id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_filter.filter_urls(pages, pages.join(labels, "page_id").select("url", "good"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = vocabularies.WordBpe.read(public_tokenizers.path("word_bpe_49k.json"))
    path = f"{work_dir(spark)}/shards"
    token_shards.write_shards(table(spark, sf_dir, "documents"), vocabulary, 2, path, vocabulary_size=49_408)
    return token_shards.read_documents(spark, path)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.ranked(table(spark, sf_dir, "documents"), least=100, keep=2000)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"), seed=7, percent=25)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_toxicity": op2_toxicity,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_spot_signatures": op4_spot_signatures,
        "op5_language_id": op5_language_id,
        "op6_packing": op6_packing,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_url_filter": op9_url_filter,
        "op10_token_shards": op10_token_shards,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_secret_scan": op13_secret_scan,
    }
