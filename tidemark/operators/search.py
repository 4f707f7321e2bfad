"""Retrieval: BM25, vectors, token budgets and their combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import terms


def term_stats(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """corpus (scope, item_id, text) -> tf rows (scope, item_id, term, tf, dl) and
    scope rows (scope, n, avg_len)."""
    rows = corpus.select("scope", "item_id", terms(F.col("text")).alias("terms"))
    tf = rows.select("scope", "item_id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("scope", "item_id", "dl", "term").agg(F.count("*").alias("tf"))
    scope = rows.groupBy("scope").agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avg_len"))
    return tf, scope.withColumn("avg_len", F.when(F.col("avg_len") == 0, 1.0).otherwise(F.col("avg_len")))


def bm25(corpus: DataFrame, queries: DataFrame, *, top_k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, scope, rank, item_id, score) of every query in its scope.

    Only terms that occur in a query are kept before the corpus is aggregated; the
    statistics are computed once for all queries.
    """
    asked = queries.select("query_id", "scope", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    rows = corpus.select("scope", "item_id", terms(F.col("text")).alias("terms")).withColumn("dl", F.size("terms"))
    scope = rows.groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avg_len"))
    scope = scope.withColumn("avg_len", F.when(F.col("avg_len") == 0, 1.0).otherwise(F.col("avg_len")))
    used = asked.select("scope", "term").distinct()
    tf = rows.select("scope", "item_id", "dl", F.explode("terms").alias("term")).join(used, ["scope", "term"], "left_semi").groupBy("scope", "item_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("scope", "term").agg(F.count("*").alias("df"))
    idf = df.join(scope, "scope").select("scope", "term", "avg_len", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_len")))
    scored = asked.join(tf.join(idf, ["scope", "term"]), ["scope", "term"]).groupBy("query_id", "scope", "item_id").agg(F.sum(weight).alias("raw"))
    order = W.partitionBy("query_id", "scope").orderBy(F.round("raw", 9).desc(), "item_id")
    ranked = scored.where("raw > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "scope", "rank", "item_id", F.bround("raw", 4).alias("score"))


def within_budget(evidence: DataFrame, budget: int) -> DataFrame:
    """The longest prefix by rank whose tokens fit; whole items, no skipping."""
    w = W.partitionBy("query_id", "scope").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return evidence.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


#: Floats of the queries that one task holds at a time, and scores that it computes at
#: once.
QUERY_FLOATS, SCORES = 1 << 22, 1 << 20


def vector_topk(vectors: DataFrame, queries: DataFrame, *, top_k: int = 10, query_floats: int = QUERY_FLOATS, scores: int = SCORES) -> DataFrame:
    """Exact cosine top-k of (query_id, embedding) over (vec_id, embedding).

    A stated query set meets all vectors in blocks: queries are dealt by hash into as
    many blocks as keep one within ``query_floats``, and each block is sent once.  A task
    takes its vectors and the block's queries in tiles of at most ``scores`` products and
    keeps the best k of each query so far, so k rows per query and task are shuffled.
    Zero vectors have no cosine and are left out.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    size = queries.agg(F.coalesce(F.sum(F.size("embedding") + 2 * top_k), F.lit(0))).first()[0]  # a query and its best
    blocks = max(1, -(-size // query_floats))
    floats = lambda column: column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    out = None
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").toArrow()  # a bounded block
        ids = rows.column("query_id").to_numpy()
        q = floats(rows.column("embedding").combine_chunks()) if len(ids) else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def run(batches):
            ids, q = sent.value
            wide = min(4096, scores)
            tall = max(1, scores // wide)
            best, names = np.full((len(ids), top_k), -2.0), np.zeros((len(ids), top_k), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, wide):
                    v = batch.column("embedding").slice(at, wide)
                    v, name = floats(v), batch.column("vec_id").slice(at, wide).to_numpy()
                    norm = np.linalg.norm(v, axis=1)
                    v = (v / np.maximum(norm, 1e-300)[:, None]).T
                    for top in range(0, len(ids), tall):
                        part = slice(top, top + tall)
                        score = np.round(q[part] @ v, 6)
                        score[(ids[part, None] == name[None, :]) | (norm == 0)[None, :]] = -2
                        # what is no worse than the k-th so far, some of it by name
                        near = (score >= best[part, -1:]) & (score > -2)
                        for i in np.flatnonzero(near.any(axis=1)):
                            s = np.concatenate([best[top + i], score[i, near[i]]])
                            n = np.concatenate([names[top + i], name[near[i]]])
                            order = np.lexsort((n, -s))[:top_k]
                            best[top + i], names[top + i] = s[order], n[order]
            at, k = np.nonzero(best > -2)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(names[at, k]), pa.array(best[at, k])], ["query_id", "vec_id", "score"])

        found = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def _left(facts: DataFrame, budget: int) -> DataFrame:
    used = facts.groupBy("query_id", "scope").agg(F.max("rank").alias("_n"), F.sum("tokens").alias("_used"))
    return used.select("query_id", "scope", "_n", F.greatest(F.lit(budget) - F.col("_used"), F.lit(0)).alias("_left"))


def _fill(facts: DataFrame, turns: DataFrame, budget: int) -> DataFrame:
    """Facts that fit the budget, then turns within what it leaves, ranked on."""
    facts = within_budget(facts, budget).drop("used")
    rest = turns.join(_left(facts, budget), ["query_id", "scope"], "left")
    upto = W.partitionBy("query_id", "scope").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rest = rest.withColumn("_sum", F.sum("tokens").over(upto)).where(F.col("_sum") <= F.coalesce("_left", F.lit(budget)))
    rest = rest.withColumn("rank", (F.col("rank") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n", "_left", "_sum")
    return facts.withColumn("rank", F.col("rank").cast("int")).unionByName(rest)


def augment(facts: DataFrame, turns: DataFrame, refused: DataFrame, budget: int) -> DataFrame:
    """Facts first, then turns in the rest of the token budget; (query_id, scope) pairs in
    ``refused``, whose fact was deleted, get facts alone.  Rows carry query_id, scope,
    rank, item_id and tokens."""
    open_turns = turns.join(refused.select("query_id", "scope").distinct(), ["query_id", "scope"], "left_anti")
    return _fill(facts, open_turns, budget)


def fallback(facts: DataFrame, turns: DataFrame, refused: DataFrame, budget: int) -> DataFrame:
    """As ``augment``, but turns only where no fact is found."""
    fits = within_budget(facts, budget)
    return augment(facts, turns.join(fits.select("query_id", "scope").distinct(), ["query_id", "scope"], "left_anti"), refused, budget)


def history_of(events: DataFrame) -> DataFrame:
    """All events of each user in their order: (user_id, rank, event_id)."""
    order = W.partitionBy("user_id").orderBy("session_id", "position")
    return events.select("user_id", F.row_number().over(order).alias("rank"), "event_id")
