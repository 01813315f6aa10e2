"""The registered queries of this subpackage, and the SQL to hold them against where SQL can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, archives, chat_tree, decontamination, language_id, periodic_runs, pii, piece_dropout, quality, simhash, token_counts, url_filters, vector_graph
from .common import secret_key, table
from .sql import ORACLES


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, url_filters.labelled_pages(pages, table(spark, sf_dir, "labels"))).drop("confidence")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op8_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    return chat_tree.digests(given.unionByName(marks))


def op9_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


def op10_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_dropout.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages")).drop("intact")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), a, b, alignment.digest).withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_token_counts, op3_pii_surrogates, op4_language_id, op5_simhash_near_dedup, op6_quality_classifier,
        op7_decontamination, op8_chat_tree, op9_embedding_graph, op10_piece_dropout,
        op11_periodic_runs, op12_warc, op13_alignment,
    )
}

__all__ = ["ORACLES", "QUERIES"]
