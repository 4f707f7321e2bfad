"""The example timeline through the systems, against known evidence and verdicts."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import replay, stream
from tidemark.sources import tables

from .timelines import U, W, document


@pytest.fixture(scope="module")
def tl(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tl") / "example.json"
    path.write_text(json.dumps(document()))
    return {k: v.cache() for k, v in tables.read_timelines(spark, str(path)).items()}


def verdicts(tl, evidence, said):
    return {r.probe_id: r for r in replay.score(tl, evidence, said).collect()}


def test_fact_store(tl):
    evidence, said = replay.store_evidence(tl)
    got = {r.probe_id: (r.content, r.memory_id, r.source_event_ids) for r in evidence.collect()}
    assert got == {
        "p01": ("database: PostgreSQL 14 (since 2026-01-05; source: user_message)", "L000001", ["e01", "e07"]),
        "p02": ("deploy branch: main (since 2026-01-05; source: user_message)", "L000003", ["e03"]),
        "p03": ("database: PostgreSQL 16 (since 2026-02-15; source: tool_result)", "L000006", ["e08"]),
        "p04": ("test command: make test (since 2026-02-15; source: user_message)", "L000007", ["e09"]),
        "p05": ("database: PostgreSQL 14 (since 2026-01-05 until 2026-02-15; source: user_message)", "L000001", ["e01", "e07"]),
        "p07": ("deploy branch: main (since 2026-01-05; source: user_message)", "L000003", ["e03"]),
    }
    scored = verdicts(tl, evidence, said)
    assert {r.verdict for r in scored.values()} == {"correct"}
    assert scored["p06"].abstain_reason == "deleted at the user's request" and scored["p08"].abstain_reason == "no known slot matches"
    assert scored["p01"].matched == "PostgreSQL 14"


def test_fact_store_without_sources(tl):
    scored = verdicts(tl, *replay.store_evidence(tl, with_sources=False))
    assert {r.verdict for r in scored.values()} == {"correct"}


def test_a_small_budget_leaves_nothing(tl):
    evidence, said = replay.store_evidence(tl, budget=10)
    assert evidence.count() == 0 and {r.abstained for r in said.collect()} == {True}


RANKED = {
    "p01": [("e01", 2.8001), ("e07", 1.0518)],
    "p02": [("e03", 3.4267), ("e05", 0.9705)],
    "p03": [("e01", 2.4837), ("e08", 1.9656), ("e07", 0.9839)],
    "p04": [("e09", 3.3475), ("e02", 1.5495)],
    "p05": [("e01", 2.8457), ("e08", 2.2501), ("e07", 1.1504)],
    "p06": [("e10", 4.2256)],
    "p07": [("e03", 4.5009), ("e05", 1.3547)],
    "p08": [("e01", 2.8457), ("e08", 2.2501), ("e07", 1.1504)],
}


def test_ranked_turns(tl):
    evidence, said = replay.bm25_evidence(tl)
    got = {}
    for r in evidence.orderBy("probe_id", "rank").collect():
        got.setdefault(r.probe_id, []).append((r.memory_id, r.score))
    assert got == RANKED
    scored = verdicts(tl, evidence, said)
    assert {k: r.verdict for k, r in scored.items()} == {"p01": "correct", "p02": "polluted", "p03": "polluted", "p04": "polluted", "p05": "polluted", "p06": "no_abstention", "p07": "polluted", "p08": "no_abstention"}
    hit = scored["p03"].forbidden_hits[0]
    assert (hit.value, hit.error_types, hit.source_event_ids) == ("PostgreSQL 14", ["stale"], ["e01", "e07"])
    assert scored["p05"].forbidden_hits[0].error_types == ["future"] and scored["p02"].forbidden_hits[0].error_types == ["contaminated"]


def test_ranked_turns_without_sources_leak(tl):
    evidence, said = replay.bm25_evidence(tl, with_sources=False)
    got = [(r.memory_id, r.score) for r in evidence.where("probe_id = 'p06'").orderBy("rank").collect()]
    assert got == [("e10", 3.8642), ("e06", 2.3799)]
    row = verdicts(tl, evidence, said)["p06"]
    assert row.verdict == "leaked" and row.forbidden_hits[0].error_types == ["resurrected"] and row.forbidden_hits[0].source_event_ids == ["e06"]


def test_no_memory_and_full_replay(tl):
    scored = verdicts(tl, *replay.no_memory(tl))
    assert {k: r.verdict for k, r in scored.items()} == {f"p0{i}": "no_abstention" if i in (6, 8) else "missed" for i in range(1, 9)}
    evidence, _ = replay.full_replay(tl)
    assert [r.memory_id for r in evidence.where("probe_id = 'p01'").orderBy("rank").collect()] == [f"e0{i}" for i in range(1, 8)]
    assert "e06" not in [r.memory_id for r in evidence.where("probe_id = 'p06'").collect()]


def test_answers_are_scored_like_evidence(spark, tl):
    rows = [(W, "p01", "It is on PG 14.", False), (W, "p02", "master", False), (W, "p03", None, True), (W, "p06", "staging-7.internal", True), (W, "p08", "", True)]
    scored = {r.probe_id: (r.verdict, r.matched) for r in replay.score_answers(tl, spark.createDataFrame(rows, "workload_id string, probe_id string, answer string, abstained boolean")).collect()}
    assert scored == {"p01": ("correct", "PG 14"), "p02": ("wrong", None), "p03": ("false_abstention", None), "p06": ("leaked", None), "p08": ("correct", None)}


def test_foreign_values(spark, tl):
    facts = tl["facts"].unionByName(tl["facts"].limit(1).selectExpr("workload_id", "99 AS seq", "'g' AS fact_id", "'u2' AS user_id", "entity", "attribute", "category", "description"))
    changes = tl["mutations"].unionByName(tl["mutations"].where("mutation_id IN ('m01', 'm02')").selectExpr("workload_id", "seq + 50 AS seq", "concat(mutation_id, 'x') AS mutation_id", "'g' AS fact_id", "kind", "at", "if(mutation_id = 'm01', 'the branch', value) AS value", "source", "carrier_event_ids"))
    two = {**tl, "facts": facts, "mutations": changes}
    assert {(r.user_id, r.value) for r in replay.foreign(two).where(f"user_id = '{U}'").collect()} == {(U, "the branch")}


def test_summary(tl):
    evidence, said = replay.bm25_evidence(tl)
    row = replay.summary(replay.score(tl, evidence, said), evidence).first()
    assert (row.probes, row.correct, row.polluted, row.no_abstention, row.stale, row.future, row.contaminated, row.budget_violations) == (8, 1, 5, 2, 2, 1, 2, 0)


def test_operations_in_order(tl):
    events = tl["events"].select("seq", "event_id", "user_id", "session_id", tl["events"].timestamp.alias("ts"))
    asks = replay.requests(tl)
    asks = asks.withColumn("trigger", F.element_at(F.split("trigger", replay.SEP), -1))
    log = stream.op_log(events, asks, tl["checkpoints"]).orderBy("pos", "no").collect()
    assert [(r.op, r.ref.split("\x1f")[-1], r.event_ids if r.op == "ingest" else None) for r in log] == [
        ("ingest", "s1", ["e01", "e02", "e03", "e04"]), ("ingest", "s2", ["e05", "e06", "e07"]), ("ask", "c1", None),
        ("ingest", "s3", ["e08", "e09"]), ("ask", "c2", None), ("ingest", "s4", ["e10"]), ("delete", "m09", None),
        ("ingest", "s4", ["e11"]), ("ingest", "s5", ["e12"]), ("ask", "c3", None),
    ]


@pytest.mark.parametrize("with_sources", [True, False])
def test_hybrid_fallback(tl, with_sources):
    evidence, said = replay.hybrid_evidence(tl, "fallback", with_sources=with_sources)
    rows = {}
    for r in evidence.orderBy("probe_id", "rank").collect():
        rows.setdefault(r.probe_id, []).append(r.memory_id)
    assert {k: v for k, v in rows.items() if k != "p08"} == {"p01": ["L000001"], "p02": ["L000003"], "p03": ["L000006"], "p04": ["L000007"], "p05": ["L000001"], "p07": ["L000003"]}
    assert rows["p08"][0] == "e01"
    scored = verdicts(tl, evidence, said)
    assert scored["p06"].verdict == "correct" and scored["p06"].abstain_reason == "deleted at the user's request"


def test_hybrid_augment_scrubs_what_was_erased(tl):
    evidence, said = replay.hybrid_evidence(tl, "augment", with_sources=False)
    rows = {}
    for r in evidence.orderBy("probe_id", "rank").collect():
        rows.setdefault(r.probe_id, []).append(r.memory_id)
    assert rows["p03"][0] == "L000006" and rows["p03"][1:] == ["e01", "e08", "e07"] and "p06" not in rows
    gone = {r.event_id for r in replay.scrubbed_turns(tl, replay.claim_stream(tl, False).persist(), False).collect()}
    assert "e06" in gone and "e01" not in gone
    tight, _ = replay.hybrid_evidence(tl, "augment", budget=20, with_sources=False)
    assert {r.memory_id for r in tight.where("probe_id = 'p03'").collect()} == {"L000006"}
    with pytest.raises(ValueError):
        replay.hybrid_evidence(tl, "neither")
