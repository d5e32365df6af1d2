"""A corpus pipeline over ``documents``: quality rules, near-duplicate removal,
secret masking and packing into training sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of
``documents``, whatever further ones there are and however they are named.

Null and empty texts have no words, so the quality rules reject them; a stage that
meets one keeps it (they have no copies, no secrets, and pack as the end id alone).
Null doc_ids stay through all stages. Rows that repeat in all columns become one in
the n-gram join; rows of one doc_id with different texts are judged each by its own
text. Of equally good copies the smallest doc_id stays. Texts are read whole, of any
length. An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlake.llm import common, jaccard, packing, quality, secrets, tokens

#: Near duplicates, secrets and packing aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    masked = secrets.without_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed into sequences."""
    return packing.pack_documents(docs, tokens.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others' results lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
