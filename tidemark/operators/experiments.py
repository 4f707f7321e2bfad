"""Experiments over timelines: several systems, restarts, extractors that change, and
instances that may fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import replay, report

System = Callable[[dict[str, DataFrame]], tuple[DataFrame, DataFrame]]
SYSTEMS: dict[str, System] = {
    "fact_store": replay.store_evidence,
    "ranked_turns": replay.bm25_evidence,
    "full_replay": replay.full_replay,
    "no_memory": replay.no_memory,
    "hybrid_fallback": lambda tl: replay.hybrid_evidence(tl, "fallback", least_trust=2),
    "hybrid_augment": lambda tl: replay.hybrid_evidence(tl, "augment", least_trust=2),
}


def sweep(tl: dict[str, DataFrame], systems: dict[str, System] = SYSTEMS, repeats: int = 1) -> DataFrame:
    """Scores of every system on every workload in ``tl`` (a seed each), by repeat."""
    out = None
    for name, system in systems.items():
        for repeat in range(repeats):
            scored = replay.score(tl, *system(tl)).withColumns({"system": F.lit(name), "repeat": F.lit(repeat)})
            out = scored if out is None else out.unionByName(scored)
    return out


def accuracy_by_seed(scores: DataFrame) -> DataFrame:
    """Percent right per system and workload, and its mean and deviation per system."""
    per = scores.groupBy("system", "workload_id", "repeat").agg((100.0 * F.count_if(F.col("verdict") == "correct") / F.count("*")).alias("pct"))
    return per.groupBy("system").agg(F.countDistinct("workload_id").alias("seeds"), F.round(F.avg("pct"), 6).alias("mean_pct"), F.round(F.coalesce(F.stddev_samp("pct"), F.lit(0.0)), 6).alias("sd_pct"))


def flips(scores: DataFrame) -> DataFrame:
    """Probes per system whose repeats have more than one verdict."""
    per = scores.groupBy("system", "workload_id", "probe_id").agg(F.countDistinct("verdict").alias("kinds"))
    return per.groupBy("system").agg(F.count("*").alias("probes"), F.count_if(F.col("kinds") > 1).alias("flips"))


def same_answers(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], tl: dict[str, DataFrame]) -> DataFrame:
    """How many probes of two runs (evidence, said) agree in verdict and in all evidence."""
    def rows(run):
        lines = run[0].groupBy("workload_id", "probe_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("lines"))
        scored = replay.score(tl, *run).join(lines, ["workload_id", "probe_id"], "left")
        return scored.select(F.concat_ws("|", "workload_id", "probe_id").alias("probe"), "verdict", "lines")

    return report.identity(rows(a), rows(b), "probe", "verdict", "lines")


def half_checkpoint(tl: dict[str, DataFrame]) -> DataFrame:
    """The checkpoint after which half of a workload's checkpoints remain."""
    w = W.partitionBy("workload_id")
    rows = tl["checkpoints"].select("workload_id", "name", "at", F.row_number().over(w.orderBy("at")).alias("_k"), F.count("*").over(w).alias("_n"))
    return rows.where("_k = floor(_n / 2)").select("workload_id", "name", "at")


def upgraded(tl: dict[str, DataFrame], before: DataFrame, after: DataFrame) -> DataFrame:
    """Claims of a run whose extractor changed half way: those of events up to the half
    checkpoint by the one, later ones by the other.  Both carry workload_id and ts."""
    half = half_checkpoint(tl).select("workload_id", F.col("at").alias("_half"))
    old = before.join(half, "workload_id").where("ts <= _half")
    new = after.join(half, "workload_id").where("ts > _half")
    return old.unionByName(new).drop("_half")


def each_instance(instances: DataFrame, run: Callable[[dict], dict], schema: str) -> DataFrame:
    """``run`` on every row by itself; a row that raises gives its ``error`` and nulls.
    schema: of what ``run`` returns; its key fields must include question_id."""
    names = [c.split()[0] for c in schema.split(", ")]

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    rows.append({**run(row), "error": None})
                except Exception as e:  # noqa: BLE001  the error is the result
                    rows.append({"question_id": row["question_id"], "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[*names, "error"]).astype(object).where(lambda x: x.notna(), None)

    return instances.mapInPandas(apply, f"{schema}, error string")


def instance_report(rows: DataFrame) -> DataFrame:
    """Accuracy by category and overall of the rows that ran, with how many did not."""
    done = report.without_errors(rows)
    lost = rows.where("error IS NOT NULL").agg(F.count("*").alias("errors"))
    return report.by_category(done, "category", "correct").join(F.broadcast(lost), F.lit(True))  # one row
