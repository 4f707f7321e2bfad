"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns rows.

All but the last return the columns of ``docs``, whatever they are called.  A row is
known by its doc_id together with its text, so another text under the same id, or a
text without an id, is decided on by itself.  Null, blank and letterless texts go with
the language stage; of rows that agree in id and text the near-duplicate stage keeps
one; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, drop_ids, fold, fresh, join_ids, settle, table
from .decontam import contaminated
from .jaccard import jaccard_groups
from .langid import UND, identify
from .packing import pack
from .queries import tokenizer_paths
from .toxicity import score_toxicity

#: Documents whose best language has less probability than this are rejected.
LEAST_LANGUAGE = 0.3


def key_of(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(doc_id, text_hash)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Adds a row key under a name that is free."""
    name = fresh(docs, "_key")
    return docs.withColumn(name, key_of(F.col("doc_id"), F.xxhash64("text"))), name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter or without a likely language."""
    bound_batches(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang")
    out = identify(rows, fold(F.col("doc_id"), 4) != 2)
    return out.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts that the classifier calls toxic."""
    bound_batches(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    out = score_toxicity(rows, table(spark, sf_dir, "labels"), lambda c: fold(c, 5) != 0)
    return out.where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more)
    the text with the smallest id stays, once; nulls come last, and of several texts
    under the smallest id the one with the least hash stays."""
    bound_batches(spark)
    groups = jaccard_groups(docs, words=5, num=4, den=5).where("group IS NOT NULL")
    groups = settle(groups.select("group", "id", "h", key_of(F.col("id"), F.col("h")).alias("key")), "groups")
    stays = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("s")).select("group", key_of(F.col("s.id"), F.col("s.h")).alias("first"))
    told = groups.join(stays, "group")
    docs_keyed, key = keyed(docs)
    gone = settle(told.where("key <> first").select(F.col("key").alias(key)).distinct(), "gone")
    out = drop_ids(docs_keyed, gone, key)
    twice = settle(told.where("key = first").groupBy(F.col("key").alias(key)).count().where("count > 1").select(key), "twice")
    if twice.limit(1).count():
        row = F.struct(*docs.columns)
        one = join_ids(out, twice, key).groupBy(key).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row"))
        out = drop_ids(out, twice, key).select(*docs.columns).unionByName(one.select("row.*"))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts that hold a benchmark item."""
    bound_batches(spark)
    docs_keyed, key = keyed(docs)
    leaks = contaminated(docs_keyed.select(key, "text"), table(spark, sf_dir, "benchmark"), id_col=key)
    return drop_ids(docs_keyed, settle(leaks.select(key).distinct(), "leaks"), key).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training."""
    bound_batches(spark)
    return pack(docs, **tokenizer_paths())
