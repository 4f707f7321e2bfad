"""Ground truth from a change log, and verdicts on retrieved evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mutations_of(outcomes: DataFrame) -> DataFrame:
    """Claim outcomes as a change log."""
    kind = F.when(F.col("outcome") == "supersede", "update").when(F.col("outcome") == "dispute", "contradict").otherwise(F.col("outcome"))
    return outcomes.where("outcome <> 'hold'").select("user_id", "slot", "seq", kind.alias("kind"), "value")


def expected(mutations: DataFrame, probes: DataFrame) -> DataFrame:
    """Truth and forbidden values of probes (probe_id, user_id, slot, asked, target).

    Only changes up to ``asked`` are known; those up to the last delete are erased;
    the truth is the last value set up to ``target`` after it.
    """
    m = mutations.select("user_id", "slot", "seq", "kind", "value")
    seen = probes.join(m, ["user_id", "slot"]).where(F.col("seq") <= F.col("asked"))
    cut = seen.groupBy("probe_id").agg(F.coalesce(F.max(F.when(F.col("kind") == "delete", F.col("seq"))), F.lit(-1)).alias("cut"))
    seen = seen.join(cut, "probe_id")
    sets = F.col("kind").isin("introduce", "update")
    visible = F.col("seq") > F.col("cut")
    agg = seen.groupBy("probe_id").agg(
        F.max_by(F.when(visible & sets & (F.col("seq") <= F.col("target")), F.col("value")), F.when(visible & sets & (F.col("seq") <= F.col("target")), F.col("seq"))).alias("truth"),
        F.collect_set(F.when(~visible | sets | (F.col("kind") == "contradict"), F.col("value"))).alias("_all"),
    )
    out = probes.select("probe_id").join(agg, "probe_id", "left")
    rest = F.array_sort(F.filter(F.coalesce("_all", F.array().cast("array<string>")), lambda v: F.col("truth").isNull() | (v != F.col("truth"))))
    return out.select("probe_id", F.when(F.col("truth").isNull(), "abstain").otherwise("value").alias("kind"), "truth", F.array_join(rest, ",").alias("forbidden"))


def explain(mutations: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, value, reason): why a value would be wrong."""
    seen = probes.join(mutations, ["user_id", "slot"]).where(F.col("seq") <= F.col("asked"))
    cut = seen.groupBy("probe_id").agg(F.coalesce(F.max(F.when(F.col("kind") == "delete", F.col("seq"))), F.lit(-1)).alias("cut"))
    seen = seen.join(cut, "probe_id").where("value IS NOT NULL")
    reason = (
        F.when(F.col("seq") <= F.col("cut"), "resurrected")
        .when(F.col("kind") == "contradict", "contaminated")
        .when(F.col("kind").isin("introduce", "update"), F.when(F.col("seq") > F.col("target"), "future").otherwise("stale"))
    )
    return seen.select("probe_id", "value", reason.alias("reason")).where("reason IS NOT NULL").distinct()


def verdict(kind, hit, bad, abstained):
    """correct, polluted, wrong, missed, false_abstention, leaked or no_abstention;
    a leak outranks the abstain flag."""
    return (
        F.when((kind == "abstain") & bad, "leaked")
        .when(kind == "abstain", F.when(abstained, "correct").otherwise("no_abstention"))
        .when(abstained, "false_abstention")
        .when(hit, F.when(bad, "polluted").otherwise("correct"))
        .otherwise(F.when(bad, "wrong").otherwise("missed"))
    )
