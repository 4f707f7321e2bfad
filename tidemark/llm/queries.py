"""Queries of the training-data operators over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_paths(name: str = "byte_bpe_50k") -> dict:
    """Places of a public byte-level vocabulary in both of its forms."""
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path(f"{name}.json"), "ranks_path": public_tokenizers.path(f"{name}.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max(F.struct("lcs_share", "cosine", "item_id", "lcs", "answer_share")).alias("b")
    out = out.groupBy("doc_id").agg(best, F.sort_array(F.collect_set("item_id")).alias("item_ids"))  # at most all items
    return out.select("doc_id", F.lit(True).alias("contaminated"), "b.item_id", "item_ids", "b.cosine", "b.lcs", "b.lcs_share", "b.answer_share")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_paths()["tokenizer_path"])


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = fold(F.col("doc_id"), 4)
    out = identify(docs, rest != 2)
    return out.select("doc_id", (rest == 2).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), **tokenizer_paths())


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlgraph import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, table(spark, sf_dir, "labels"), lambda c: fold(c, 5) != 0)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), shards=40).drop("group_key")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_table

    out = media_table(table(spark, sf_dir, "documents"), keep_shards=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
JACCARD = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
t AS (SELECT doc_id, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 90 * (len(a.sh) + len(b.sh) - n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.doc)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM s JOIN (SELECT doc, min(label) AS component_id FROM r GROUP BY 1) ON doc = s.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The join can be said in SQL; models, tokenizers and media can't."""
    return {"op8_jaccard_join": JACCARD}
