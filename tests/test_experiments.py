import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiments, replay
from tidemark.sources import tables

from .timelines import W, document


@pytest.fixture(scope="module")
def tl(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tl") / "example.json"
    path.write_text(json.dumps(document()))
    return {k: v.cache() for k, v in tables.read_timelines(spark, str(path)).items()}


def test_sweep(tl):
    systems = {k: experiments.SYSTEMS[k] for k in ("no_memory", "full_replay")}
    scores = experiments.sweep(tl, systems, repeats=2).persist()
    assert {(r.system, r.probes, r.flips) for r in experiments.flips(scores).collect()} == {("no_memory", 8, 0), ("full_replay", 8, 0)}
    got = {r.system: (r.seeds, r.mean_pct, r.sd_pct) for r in experiments.accuracy_by_seed(scores).collect()}
    assert got["no_memory"] == (1, 0.0, 0.0) and got["full_replay"][1] > 0


def test_a_restart_changes_nothing(spark, tl, tmp_path):
    """The claims written at a checkpoint and read back give the same answers."""
    before = replay.bm25_evidence(tl)
    tables.snapshot({"evidence": before[0], "said": before[1]}, str(tmp_path / "s"))
    back = tables.restore(spark, str(tmp_path / "s"))
    row = experiments.same_answers(before, (back["evidence"], back["said"]), tl).first()
    assert tuple(row) == (8, 0, 0, 0)
    row = experiments.same_answers(before, replay.no_memory(tl), tl).first()
    assert (row.only_first, row.only_second) == (0, 0) and row.changed == 8


def test_an_extractor_that_changes(tl):
    assert [r.name for r in experiments.half_checkpoint(tl).collect()] == ["c1"]
    events = tl["events"].select("workload_id", F.col("timestamp").alias("ts"), "event_id")
    got = experiments.upgraded(tl, events.withColumn("by", F.lit("old")), events.withColumn("by", F.lit("new")))
    assert {(r.event_id, r.by) for r in got.collect()} == {(f"e{i:02d}", "old" if i <= 7 else "new") for i in range(1, 13)}
    assert W


def test_instances_that_fail(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 0), ("c", "y", -1)], "question_id string, category string, n int")

    def run(row):
        if row["n"] < 0:
            raise ValueError("no answer")
        return {"question_id": row["question_id"], "category": row["category"], "correct": int(row["n"])}

    out = experiments.each_instance(rows, run, "question_id string, category string, correct int").persist()
    assert {(r.question_id, r.error) for r in out.collect()} == {("a", None), ("b", None), ("c", "ValueError: no answer")}
    got = {(r.category, r["items"], r.pct, r.errors) for r in experiments.instance_report(out).collect()}
    assert got == {("x", 2, 50.0, 1), ("all", 2, 50.0, 1)}


def test_run_logs_are_named_by_their_files(spark, tmp_path):
    for seed, name in ((0, "rules"), (3, "rules__nosrc")):
        folder = tmp_path / f"synthetic-small-s{seed}"
        folder.mkdir()
        (folder / f"{name}.json").write_text(json.dumps({"workload_id": f"w{seed}"}))
    got = {(r.workload_id, r.seed, r.system, r.suffix) for r in tables.read_run_logs(spark, str(tmp_path), "workload_id string").collect()}
    assert got == {("w0", 0, "rules", ""), ("w3", 3, "rules", "nosrc")}
