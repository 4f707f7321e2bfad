"""Reports over run logs: pairs of runs, audits, categories, phases, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evidence import numbered
from .metrics import ERRORS, VERDICTS, bootstrap


def paired_interval(rows: DataFrame, group: str, a: str, b: str, *, replicates: int = 2000) -> DataFrame:
    """Difference a - b in points on the same rows with its percentile interval."""
    d = rows.withColumn("_d", 100.0 * (F.col(a) - F.col(b)))
    ends = bootstrap(d, group, "_d", replicates=replicates)
    return d.groupBy(group).agg(F.count("*").alias("pairs"), F.round(F.avg("_d"), 6).alias("diff")).join(ends, group)


def agreement(rows: DataFrame, group: str, judge: str, human: str) -> DataFrame:
    """Agreement and Cohen's kappa of two 0/1 marks; kappa is null where chance
    agreement is certain."""
    j, h, n = F.col(judge), F.col(human), F.count("*")
    counts = rows.groupBy(group).agg(n.alias("items"), F.sum(j).alias("_j"), F.sum(h).alias("_h"), F.count_if(j == h).alias("same"), F.count_if((j == 1) & (h == 0)).alias("yes_no"), F.count_if((j == 0) & (h == 1)).alias("no_yes"))
    pj, ph, po = F.col("_j") / F.col("items"), F.col("_h") / F.col("items"), F.col("same") / F.col("items")
    pe = pj * ph + (1 - pj) * (1 - ph)
    kappa = F.when(pe < 1, (po - pe) / (1 - pe))
    return counts.select(group, "items", F.round(po, 6).alias("agreement"), F.round(kappa, 6).alias("kappa"), "yes_no", "no_yes")


def by_category(rows: DataFrame, category: str, mark: str) -> DataFrame:
    """Counts and accuracy per category and, as ``all``, overall; one rollup."""
    g = rows.rollup(category).agg(F.grouping(category).alias("_g"), F.count("*").alias("items"), F.round(100 * F.avg(mark), 6).alias("pct"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(category)).alias(category), "items", "pct")


def write_read(log: DataFrame, group: str, usd: str) -> DataFrame:
    """Cost of writing (``phase`` write) against reading (anything else)."""
    parts = (F.round(F.coalesce(F.sum(F.when(c, F.col(usd))), F.lit(0.0)), 6).alias(n) for n, c in (("write_usd", F.col("phase") == "write"), ("read_usd", F.col("phase") != "write")))
    return log.groupBy(group).agg(*parts, F.count_if(F.col("phase") == "write").alias("writes"))


def identity(a: DataFrame, b: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row: how many keys of two runs agree on all columns, differ, or occur in
    one run only."""
    left = a.select(key, F.struct(*columns).alias("_a"))
    both = left.join(b.select(key, F.struct(*columns).alias("_b")), key, "full")
    x, y = F.col("_a"), F.col("_b")
    return both.agg(F.count_if(x.isNotNull() & x.eqNullSafe(y)).alias("same"), F.count_if(x.isNotNull() & y.isNotNull() & ~x.eqNullSafe(y)).alias("changed"), F.count_if(y.isNull()).alias("only_first"), F.count_if(x.isNull()).alias("only_second"))


def without(log: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Accuracy per system over all rows and over those whose key is not in ``seen``."""
    marked = log.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    hit, fresh = F.col("verdict") == "correct", F.col("_seen").isNull()
    return marked.groupBy("system").agg(F.count_if(~fresh).alias("excluded"), F.round(100.0 * F.count_if(hit) / F.count("*"), 6).alias("pct_all"), F.round(100.0 * F.count_if(hit & fresh) / F.count_if(fresh), 6).alias("pct_rest"))


def fraction_checkpoints(events: DataFrame, fractions: list[float], *, order: str = "event_id", at: str = "ts") -> DataFrame:
    """The event at each fraction of the stream: (name, fraction, at); positions are
    rounded half to even."""
    n = events.agg(F.count("*").alias("_n"))
    marks = n.select("_n", F.posexplode(F.array(*map(F.lit, fractions))).alias("i", "f"))
    marks = marks.select("_n", F.concat(F.lit("c"), (F.col("i") + 1).cast("string")).alias("name"), F.greatest(F.lit(1), F.bround(F.col("f") * F.col("_n"))).cast("long").alias("no"))
    rows = numbered(events.select(order, F.col(at).alias("at")), order)
    return rows.join(F.broadcast(marks), "no").select("name", F.bround(F.col("no") / F.col("_n"), 4).alias("fraction"), "at")  # one row a fraction


def run_summary(log: DataFrame, budget: int) -> DataFrame:
    """A row per run (system, seed): probes by verdict, probes with each type of error
    (counted once a probe), tokens, probes over the budget, cost and mean latency."""
    verdicts = (F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS)
    errors = (F.count_if(F.array_contains("error_types", t)).alias(t) for t in ERRORS)
    over = F.count_if(F.col("tokens") > budget).alias("budget_violations")
    return log.groupBy("system", "seed").agg(F.count("*").alias("probes"), *verdicts, *errors, F.sum("tokens").alias("injected_tokens"), over, F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("cost_usd"), F.round(F.avg("ms"), 6).alias("mean_ms"))


def system_table(log: DataFrame, seeds: list[int] | None = None) -> DataFrame:
    """A row per system over some seeds (all): answers and evidence right in percent with
    the deviation over seeds, wrong answers, errors by type, leaks, tokens, cost."""
    log = log if seeds is None else log.where(F.col("seed").isin(seeds))
    pct = lambda c: 100.0 * F.count_if(F.col(c) == "correct") / F.count("*")
    per = log.groupBy("system", "seed").agg(
        pct("answer_verdict").alias("_a"), pct("verdict").alias("_e"), F.count("*").alias("_n"), F.sum("tokens").alias("_t"), F.sum("usd").alias("_u"),
        F.count_if(F.col("answer_verdict").isin("wrong", "polluted", "leaked")).alias("_w"), F.count_if(F.col("answer_verdict") == "leaked").alias("_la"), F.count_if(F.col("verdict") == "leaked").alias("_le"),
        *(F.count_if(F.array_contains("error_types", t)).alias(f"_{t}") for t in ERRORS[:3]),
    )
    sd = lambda c: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6)
    return per.groupBy("system").agg(
        F.round(F.avg("_a"), 6).alias("answer_pct"), sd("_a").alias("answer_sd"), F.round(F.avg("_e"), 6).alias("evidence_pct"), sd("_e").alias("evidence_sd"), F.sum("_w").alias("wrong_answers"),
        *(F.sum(f"_{t}").alias(t) for t in ERRORS[:3]), F.sum("_la").alias("leaked_answers"), F.sum("_le").alias("leaked_evidence"),
        F.round(F.sum("_t") / F.sum("_n"), 6).alias("mean_tokens"), F.round(F.coalesce(F.sum("_u"), F.lit(0.0)), 6).alias("cost_usd"),
    )


def efficiency(log: DataFrame, stats: DataFrame) -> DataFrame:
    """A row per system: median times of writing and reading, priced calls per write,
    cost per seed and per question, and the size of the store at the end (KiB)."""
    rows = log.groupBy("system").agg(F.round(F.median("ingest_ms"), 6).alias("ingest_ms"), F.round(F.median("ms"), 6).alias("retrieve_ms"), F.round(F.count("usd") / F.count("ingest_ms"), 6).alias("calls_per_write"), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)) / F.countDistinct("seed"), 6).alias("usd_per_seed"), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)) / F.count("*"), 9).alias("usd_per_question"))
    last = stats.groupBy("system").agg(F.round(F.max_by("bytes", "checkpoint") / 1024, 6).alias("final_kib"))
    return rows.join(last, "system")


def write_read_legacy(log: DataFrame, group: str) -> DataFrame:
    """Cost of writing against reading where old logs have only a total: rows carry
    write_usd and read_usd, or total_usd and the share that was reading."""
    write = F.coalesce("write_usd", F.col("total_usd") * (1 - F.col("read_share")))
    read = F.coalesce("read_usd", F.col("total_usd") * F.col("read_share"))
    return log.groupBy(group).agg(F.round(F.sum(write), 6).alias("write_usd"), F.round(F.sum(read), 6).alias("read_usd"), F.count_if(F.col("write_usd").isNull()).alias("legacy"))


def counters(events: DataFrame) -> DataFrame:
    """Events and users by kind and, as ``all``, overall."""
    g = events.groupingSets([["kind"], []], "kind").agg(F.grouping("kind").alias("_g"), F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.countDistinct("user_id", "session_id").alias("sessions"))
    return g.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("kind")).alias("kind"), "events", "users", "sessions")


def recount(evidence: DataFrame, budget: int, top_k: int) -> DataFrame:
    """Queries whose evidence breaks a promise by a recount of its tokens: over the
    budget, cut short though the next item fits, or fewer than ``top_k`` items though
    more were ranked.  Rows: query_id, scope, rank, tokens, kept."""
    upto = W.partitionBy("query_id", "scope").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = evidence.withColumn("_sum", F.sum("tokens").over(upto))
    per = rows.groupBy("query_id", "scope").agg(F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("used"), F.count_if("kept").alias("items"), F.count("*").alias("ranked"), F.count_if(~F.col("kept") & (F.col("_sum") <= budget) & (F.col("rank") <= top_k)).alias("_fits"))
    problem = F.when(F.col("used") > budget, "over budget").when(F.col("_fits") > 0, "truncated").when((F.col("items") < F.least("ranked", F.lit(top_k))), "short")
    return per.select("query_id", "scope", "used", "items", problem.alias("problem"))


def token_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Tokens of run ``a`` less those of ``b`` on the same questions."""
    both = a.select(key, F.col("tokens").alias("_a")).join(b.select(key, F.col("tokens").alias("_b")), key)
    return both.agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("_a") - F.col("_b")), 6).alias("mean_more"), F.sum(F.col("_a") - F.col("_b")).alias("more"))


def without_errors(rows: DataFrame) -> DataFrame:
    """Rows of runs that did not break off."""
    return rows.where("error IS NULL")
