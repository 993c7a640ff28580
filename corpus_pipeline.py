"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, piece encoding.

Each stage takes (spark, docs, dataset folder), works on all rows that its predecessor kept and returns the columns of
``documents``; the last one adds the pieces. ``run`` writes each stage's result as Parquet and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import decontamination, jaccard_join, piece_sampling, pii, toxicity
from wavemill.llm.common import load, saved

#: The key of the pseudonyms; real runs bring their own.
PII_KEY = b"wavemill pipeline key"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.5 or more) go."""
    scored = toxicity.toxicity(docs, load(spark, sf_dir, "labels"))
    return scored.where(F.col("toxic_score") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return jaccard_join.one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    return decontamination.without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by pseudonyms of the same format."""
    return pii.pseudonymise(docs, PII_KEY).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with one sampled segmentation each."""
    return piece_sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("pieces", encode_pieces),
]

#: A trained classifier and sampled segmentations have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
