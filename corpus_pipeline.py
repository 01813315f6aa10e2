"""The corpus pipeline: documents through five stages, each written and read again before the next."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melodex.llm import decontamination, language_id, pii, piece_dropout, simhash
from melodex.llm.common import secret_key, spread_join, table, written

#: Least score of a predicted language; documents below it, and those without a letter, are rejected.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go (null texts, texts without a letter, scores below LEAST_SCORE); the others
    stay as they are, also with a null id; repeated rows are judged alike. All go where no labelled text is there to learn from."""
    told = language_id.identify(docs, carry=True)
    return told.where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of SimHash near-duplicates stays: the first by doc_id, nulls last, then by text.

    Null and empty texts have fingerprint zero and form one group; repeated rows and equal ids are told apart by rows.
    """
    rows = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    members = written(simhash.near_duplicates(rows.select("doc.doc_id", "doc.text", "row"), carry=("row",)).select("doc_id", "row", "component"))
    ids = members.groupBy("component", "doc_id").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("first"), F.sum("n").alias("members"))
    first = written(first.select("component", "first.*", "members"))
    kept = first.where("n = 1").select("row")
    tied = first.where("n > 1")
    if tied.limit(1).count():
        # A large group is dealt over tasks.
        of = tied.select("component", F.col("members").alias("n"), F.col("doc_id").alias("least"))
        alike = spread_join(members, of, "component", members.count(), "row").where(F.col("doc_id").eqNullSafe(F.col("least"))).select("component", "row")
        texts = rows.select("row", "doc.text").join(alike.hint("merge"), "row")
        kept = kept.unionByName(texts.groupBy("component").agg(F.min(F.struct("text", "row")).alias("least")).select("least.row"))
    return rows.join(written(kept).hint("merge"), "row", "left_semi").select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none and stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True).where("not contaminated").select("doc.*")


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates; all rows stay, null texts null."""
    return pii.pseudonymise(docs, secret_key(spark)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and lossless of each document's text; null and empty texts have no ids."""
    import public_tokenizers

    return piece_dropout.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", replace_pii),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
