"""A training corpus from ``documents``: language, toxicity, near duplicates,
benchmark leaks, then packing.

``run`` writes each stage's rows to the shared folder and reads them back as the
next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import discard, settle, table
from tidemark.llm.stages import decontamination, language, near_duplicates, packing, toxicity

STAGES = [
    ("language_id", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Classifiers and latent search have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = settle(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
