from tidemark.operators import replay, timeline
from tidemark.workloads import generate as G


def test_generated_timelines_are_consistent(spark):
    tl = G.generate(spark, G.Preset("tiny", users=2, sessions=8, checkpoints=(0.5, 1.0)), [0, 7])
    tl = {k: v.persist() for k, v in tl.items()}
    assert [r.error for r in timeline.consistency_errors(tl).collect()] == []
    assert [r.error for r in G.hygiene_errors(tl).collect()] == []
    counts = {r.workload_id: r["count"] for r in tl["probes"].groupBy("workload_id").count().collect()}
    assert len(counts) == 2 and min(counts.values()) > 8
    assert {r.kind for r in tl["mutations"].select("kind").collect()} == {"introduce", "update", "restate", "contradict", "delete"}
    again = G.generate(spark, G.Preset("tiny", users=2, sessions=8, checkpoints=(0.5, 1.0)), [7])
    for name in ("events", "probes"):
        mine = tl[name].where("workload_id = 'synthetic-tiny-s7'")
        assert sorted(map(str, again[name].collect())) == sorted(map(str, mine.collect())), name
    said = replay.score(tl, *replay.full_replay(tl)).groupBy("verdict").count().collect()
    assert {r.verdict for r in said} <= {"correct", "polluted", "no_abstention", "leaked", "missed", "wrong"}


def test_presets():
    assert G.PRESETS["long"].checkpoints[-1] == 1.0 and len(G.PRESETS["long"].checkpoints) == 8
    assert (G.PRESETS["medium"].users, G.PRESETS["small"].sessions) == (8, 16)
