"""Aggregations over run logs: accuracy, latency, noise, bootstrap, costs."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERDICTS = ["correct", "polluted", "wrong", "missed", "false_abstention", "leaked", "no_abstention"]
# Price per million tokens (input, output) by model prefix.
ERRORS = ["stale", "future", "contaminated", "resurrected", "forbidden"]
PRICES = [("gpt-4.1-mini", 0.40, 1.60), ("gpt-4o-2024-08-06", 2.50, 10.00), ("gpt-4.1-2025-04-14", 2.00, 8.00)]


def run_log(events: DataFrame) -> DataFrame:
    """Events as probe rows of a run log: seed, system, checkpoint, verdict, ms."""
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("int")
    return events.select(
        F.col("event_id").alias("probe_id"),
        (F.col("user_id") % 5).cast("int").alias("seed"),
        F.col("event_type").alias("system"),
        (F.col("event_id") % 4 + 1).cast("int").alias("checkpoint"),
        F.get(F.array(*map(F.lit, VERDICTS)), k % 7).alias("verdict"),
        F.col("value").alias("ms"),
        (k * 10).cast("long").alias("tokens"),
        F.get(F.array(*map(F.lit, VERDICTS)), (k * 3 + 1) % 7).alias("answer_verdict"),
        F.when((k % 7).isin(1, 2, 5), F.array_distinct(F.array(F.get(F.array(*map(F.lit, ERRORS)), k % 5), F.get(F.array(*map(F.lit, ERRORS)), k % 3)))).otherwise(F.array().cast("array<string>")).alias("error_types"),
        F.when(k % 10 < 7, (k * 3.0) / 1e6).alias("usd"),
        F.when(k % 4 != 0, F.col("value") * 2).alias("ingest_ms"),
    )


def accuracy(log: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds of the accuracy in percent."""
    seeds = log.groupBy("system", "seed").agg((100.0 * F.count_if(F.col("verdict") == "correct") / F.count("*")).alias("pct"))
    return seeds.groupBy("system").agg(F.count("*").alias("seeds"), F.round(F.avg("pct"), 6).alias("mean_pct"), F.round(F.coalesce(F.stddev_samp("pct"), F.lit(0.0)), 6).alias("sd_pct"))


def latency(log: DataFrame) -> DataFrame:
    return log.groupBy("system").agg(F.round(F.median("ms"), 6).alias("median_ms"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.max("ms").alias("max_ms"))


def per_checkpoint(log: DataFrame) -> DataFrame:
    """Means of per-seed means, in numeric order of checkpoints; a metric that a seed
    lacks is left out of its checkpoint."""
    bad = lambda t: F.avg(F.array_contains("error_types", t).cast("int"))
    seeds = log.groupBy("system", "checkpoint", "seed").agg((1.0 * F.count_if(F.col("verdict") == "correct") / F.count("*")).alias("acc"), F.avg("ms").alias("ms"), F.avg("tokens").alias("tokens"), bad("stale").alias("stale"), F.avg((F.size("error_types") > 0).cast("int")).alias("forbidden"), F.avg("ingest_ms").alias("ingest_ms"))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.round(F.avg(c), 6)).alias(c)
    return seeds.groupBy("system", "checkpoint").agg(*map(whole, ("acc", "ms", "tokens", "stale", "forbidden", "ingest_ms")))


def verdict_pivot(log: DataFrame) -> DataFrame:
    counts = (F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS)
    return log.groupBy("system", "seed").agg(F.count("*").alias("probes"), *counts)


def noise(log: DataFrame, unit: str) -> DataFrame:
    """Repeats of a unit: how many have more than one verdict, and the mean over seeds
    of the deviation of the number right per repeat (the unit's rows in their order)."""
    per = log.groupBy("system", unit).agg(F.countDistinct("verdict").alias("kinds"), F.count("*").alias("repeats"))
    flips = per.groupBy("system").agg(F.count("*").alias("units"), F.count_if(F.col("kinds") > 1).alias("flips"))
    place = F.row_number().over(W.partitionBy("system", "seed", unit).orderBy("probe_id"))
    right = log.withColumn("_r", place).groupBy("system", "seed", "_r").agg(F.count_if(F.col("verdict") == "correct").alias("_c"))
    sd = right.groupBy("system", "seed").agg(F.coalesce(F.stddev_samp("_c"), F.lit(0.0)).alias("_sd")).groupBy("system").agg(F.round(F.avg("_sd"), 6).alias("mean_sd"))
    return flips.join(sd, "system")


def stratified_sample(rows: DataFrame, stratum: str, key: str, per: int) -> DataFrame:
    """The ``per`` rows of each stratum with the smallest arithmetic hash."""
    h = (F.col(key) * 7919 + 104729) % 1000003
    w = W.partitionBy(stratum).orderBy(h, key)
    return rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per)


#: Distinct values that a task draws from at a time, replicates that it draws for, and
#: draws that it makes at once; tasks that share the replicates.
RANGES, REPLICATES, DRAWS, TASKS = 1 << 18, 20, 1 << 16, 128
#: The modulus of the positions' hash.
PRIME = 2147483647


def bootstrap(rows: DataFrame, group: str, value: str, *, replicates: int = 2000, low: float = 0.025, ranges: int = RANGES) -> DataFrame:
    """Percentile interval of a group mean over resamples of its rows.

    Rows are only counted by value, and laid out in order of value, nulls last; draw d of
    replicate r falls on an arithmetic-hash position, the same on any engine, and takes
    the value whose range holds it, where a null counts for nothing.  Tasks get the
    ranges, at most ``ranges`` at a time, and some replicates; they make the draws in
    numpy and return a sum and a count for each, so no draw is ever a row.
    """
    kept = rows.where(F.col(group).isNotNull())
    counts = kept.groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    order = W.partitionBy(group).orderBy(F.col("_v").asc_nulls_last())
    upto = F.sum("_k").over(order.rowsBetween(W.unboundedPreceding, 0))
    laid = counts.select(group, "_v", "_k", upto.alias("_to"), F.sum("_k").over(W.partitionBy(group)).alias("_n"), F.floor((F.row_number().over(order) - 1) / ranges).alias("_block"))
    blocks = laid.groupBy(group, "_n", "_block").agg(F.min(F.col("_to") - F.col("_k")).alias("_from"), F.array_sort(F.collect_list(F.struct("_to", "_v"))).alias("_held"))
    work = blocks.select(group, "_n", "_from", F.col("_held._to").alias("_tos"), F.col("_held._v").alias("_vs"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(REPLICATES))).alias("_rep"), "_block").repartition(TASKS, group, "_rep", "_block")
    sums = work.mapInArrow(partial(_draw, group, replicates), T.StructType([T.StructField(group, rows.schema[group].dataType), *_DRAWN]))
    n = F.sum("_k")
    means = sums.groupBy(group, "_rep").agg(F.when(n > 0, F.sum("_s") / F.when(n > 0, n)).alias("_m"))
    ranked = means.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(F.col("_m").asc_nulls_last(), "_rep")) - 1)
    first, last = int(replicates * low), replicates - 1 - int(replicates * low)
    return ranked.groupBy(group).agg(F.round(F.max(F.when(F.col("_rn") == first, F.col("_m"))), 6).alias("low"), F.round(F.max(F.when(F.col("_rn") == last, F.col("_m"))), 6).alias("high"))


_DRAWN = [T.StructField("_rep", T.IntegerType()), T.StructField("_s", T.DoubleType()), T.StructField("_k", T.LongType())]


def _draw(group, replicates, batches):
    """Sum and count of what each replicate of a row draws from its ranges."""
    import pyarrow as pa

    for batch in batches:
        reps = [np.arange(r, min(r + REPLICATES, replicates)) for r in batch.column("_rep").to_pylist()]
        out = []
        for i, mine in enumerate(reps):
            n, start, tos, vs = (batch.column(c)[i] for c in ("_n", "_from", "_tos", "_vs"))
            valid = vs.values.is_valid().to_numpy(zero_copy_only=False)
            values = np.where(valid, vs.values.to_numpy(zero_copy_only=False), 0.0)
            hits = _hits(n.as_py(), start.as_py(), tos.values.to_numpy(), mine) * valid
            with np.errstate(invalid="ignore"):
                out.append((np.where(hits > 0, hits * values, 0.0).sum(axis=1) if len(values) <= 16 else np.array([(h[h > 0] * values[h > 0]).sum() for h in hits]), hits.sum(axis=1)))
        at = np.repeat(np.arange(len(reps)), [len(r) for r in reps])
        names = batch.column(group).take(pa.array(at))
        if len(at):
            yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(reps).astype(np.int32)), pa.array(np.concatenate([s for s, _ in out])), pa.array(np.concatenate([k for _, k in out]))], [group, *(f.name for f in _DRAWN)])


def _hits(n: int, start: int, tos: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """How many of the ``n`` draws of each replicate fall into each range: from ``start``
    to tos[0], from there to tos[1], and so on."""
    out = np.zeros((len(reps), len(tos)), np.int64)
    shifts = ((reps.astype(np.int64) * 69621 + 12345) % PRIME).astype(np.uint32)
    for d in range(0, n, DRAWS):
        base = (np.arange(d, min(d + DRAWS, n), dtype=np.int64) * 48271 % PRIME).astype(np.uint32)
        for k, shift in enumerate(shifts):
            at = (base + shift) % np.uint32(PRIME)  # under 2 ** 32
            if n < PRIME:
                at %= np.uint32(n)
            if len(tos) <= 16:
                out[k] += np.diff([np.count_nonzero(at < e) for e in (start, *tos)])
            else:
                held = np.searchsorted(tos, at[(at >= start) & (at < tos[-1])], side="right")
                out[k] += np.bincount(held, minlength=len(tos))
    return out


def price_calls(calls: DataFrame, prices: list[tuple[str, float, float]] = PRICES) -> DataFrame:
    """Dollar cost of (call_id, model, tokens_in, tokens_out) by the longest price
    prefix, row by row; a model without a price has null cost and ``priced`` false."""
    best = F.lit(None).cast("struct<i:double,o:double>")
    for prefix, price_in, price_out in sorted(prices, key=lambda p: len(p[0])):
        best = F.when(F.col("model").startswith(prefix), F.struct(F.lit(price_in).alias("i"), F.lit(price_out).alias("o"))).otherwise(best)
    rows = calls.withColumn("_p", best)
    cost = (F.col("tokens_in") * F.col("_p.i") + F.col("tokens_out") * F.col("_p.o")) / 1e6
    return rows.select("call_id", "model", F.round(cost, 9).alias("usd"), F.col("_p").isNotNull().alias("priced"))


def cache_split(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests marked as cache hits by content address."""
    known = cache.select("digest").distinct().withColumn("hit", F.lit(True))
    return requests.join(known, "digest", "left").na.fill(False, ["hit"])
