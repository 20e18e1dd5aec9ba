"""A training corpus from raw documents: what is toxic, repeated or part of a benchmark goes; the rest is encoded.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and is written as Parquet under
``spark.checkpoint.dir`` before the next one begins, so a lost executor repeats one stage's tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeweave.llm import bpe, decontamination, exact_dedup, minhash_dedup, toxicity
from gaugeweave.llm.queries import public_file
from gaugeweave.llm.tables import table
from gaugeweave.session import scratch_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models reject go; the models learn from labelled documents outside the held-out fifth."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest original stays, then the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles stays."""
    return minhash_dedup.drop_near_duplicates(docs, words=5, percent=80)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exact or edited, go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its tokens; ``decoded_equal`` says whether decoding gives the text back."""
    coded = bpe.encode(docs, public_file("byte_bpe_50k.json"), decoded=True)
    return coded.selectExpr(*[f"`{c}`" for c in docs.columns if c not in ("token_ids", "n_tokens", "decoded", "decoded_equal")],
                            "token_ids", "n_tokens", "decoded = coalesce(text, '') AS decoded_equal")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_exact_copies),
    ("minhash_dedup", without_near_copies),
    ("decontamination", without_test_items),
    ("bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
