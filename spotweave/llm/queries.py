"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm.decontaminate import decontaminate, hit_count
from spotweave.llm.embedding_dedup import embedding_components
from spotweave.llm.jaccard_join import jaccard_components
from spotweave.llm.labelled import held_out
from spotweave.llm.language_id import fit_language, identify_language
from spotweave.llm.line_dedup import html_text, line_dedup, url_host
from spotweave.llm.mixing import mix_sources
from spotweave.llm.quality import fit_quality, score_quality
from spotweave.llm.secrets import scan_secrets
from spotweave.llm.store import read
from spotweave.llm.suffix_dedup import repeated_spans
from spotweave.llm.toxicity import fit_toxicity, score_toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"), html_text(F.col("html")).alias("text"))
    return line_dedup(pages, "text", "host", ratio=0.1, min_pages=5)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = hit_count()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "links")


def _verdict(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _verdict(score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")), keep=["doc_id"]), 0.7)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _verdict(score_toxicity(docs, fit_toxicity(docs, read(spark, sf_dir, "labels")), keep=["doc_id"]), 0.3)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify_language(docs, fit_language(docs), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read(spark, sf_dir, "embeddings"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", F.array_join("spans", ",").alias("spans"), (F.col("n_repeated") > 0).alias("repeated"))


QUERIES = {"op1_line_dedup": op1_line_dedup, "op2_mix_sources": op2_mix_sources, "op3_ngram_jaccard_join": op3_ngram_jaccard_join, "op4_decontaminate": op4_decontaminate, "op5_language_id": op5_language_id, "op6_secret_scan": op6_secret_scan, "op7_quality_classifier": op7_quality_classifier, "op8_suffix_array_dedup": op8_suffix_array_dedup, "op9_toxicity": op9_toxicity, "op10_embedding_dedup": op10_embedding_dedup}
