"""A training corpus from raw documents: quality, near-duplicates, secrets, mix, pieces.

Each stage works on all that its predecessor kept.  The first four return the columns of documents, the last the ids of
each text's pieces.  A stage's rows are written as Parquet before the next one reads them, so that a lost executor costs
no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadriver.llm import mixing, neardup, pieces, quality, secrets
from quadriver.llm.common import remove, stored, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars again tells the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, texts at similarity 0.8 or more, the document of the smallest id stays."""
    # at 0.8 it takes 12 trees to miss no more pairs than 10 do at 0.85
    return neardup.drop_near_duplicates(docs, percent=80, trees=12)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay."""
    return _counted(docs.withColumn("text", secrets.redact(F.col("text"))))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; the last of a source ends at the exact word."""
    return _counted(mixing.mixed_rows(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each text."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
    ("SentencePiece", sentencepiece),
]

#: Hashes, tokenizer and pieces are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
