"""The dealt operators as queries over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.paragraphs import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from leafgrid.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.private import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.lattice import lattice_links

    return lattice_links(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.language import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.ngram_join import ngram_jaccard

    return ngram_jaccard(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.article import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.manifest import proofs

    return proofs(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.owners import owners

    return owners(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafgrid.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_best_fit_packing,
        op3_pii,
        op4_toxicity,
        op5_embedding_near_dedup,
        op6_mixing,
        op7_exact_top_k,
        op8_language_id,
        op9_ngram_jaccard_join,
        op10_html_extraction,
        op11_merkle_manifest,
        op12_exact_dedup,
        op13_centroid_clustering,
    )
}
