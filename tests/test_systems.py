import pytest

from tidemark import systems as S

from .timelines import EVENTS, U, ts

EVENT = "event_id string, user_id string, session_id string, timestamp timestamp, kind string, content string"
QUERY = "query_id string, user_id string, text string, asked_at timestamp, as_of timestamp"
REQUEST = "request_id string, user_id string, requested_at timestamp, description string, sources array<string>"


def events(spark, ids):
    return spark.createDataFrame([(i, U, s, t, k, c) for i, s, t, k, c in EVENTS if i in ids], EVENT)


def ask(store, text, at):
    q = store.spark.createDataFrame([("q", U, text, at, None)], QUERY)
    found, said = store.retrieve(q)
    return [r.content for r in found.orderBy("rank").collect()], said.first().abstain_reason


def test_a_store_through_its_life(spark, tmp_path):
    store = S.Store(spark, str(tmp_path / "a"))
    assert store.ingest(events(spark, ["e01", "e02", "e06"])) == {"added": 3, "rejected": 0}
    assert store.ingest(events(spark, ["e06", "e08"])) == {"added": 1, "rejected": 0}
    assert ask(store, "Which database?", ts(3, 1)) == (["database: PostgreSQL 16 (since 2026-02-15; source: tool_result)"], None)
    assert ask(store, "Which database?", ts(2, 1)) == (["database: PostgreSQL 14 (since 2026-01-05; source: user_message)"], None)
    store.snapshot(str(tmp_path / "s"))
    store.delete(spark.createDataFrame([("r1", U, ts(3, 2), "please forget the staging hostname", [])], REQUEST))
    assert ask(store, "the staging host?", ts(3, 3)) == ([], "deleted at the user's request")
    assert ask(store, "the staging host?", ts(3, 1))[0]
    assert store.ingest(events(spark, ["e06"])) == {"added": 0, "rejected": 1}
    row = store.stats().first()
    assert (row.items, row.active, row.tombstones) == (3, 2, 1)
    assert {(r.content, r.status) for r in store.export_items(U).collect()} == {("database: PostgreSQL 14", "superseded"), ("database: PostgreSQL 16", "active"), ("test_command: pytest -x", "active")}
    other = S.Store(spark, str(tmp_path / "b"))
    other.restore(str(tmp_path / "s"))
    assert ask(other, "the staging host?", ts(3, 3))[0]  # as it was before the delete
    other.reset()
    assert ask(other, "the staging host?", ts(3, 3))[0] == []


def test_what_systems_lack(spark, tmp_path):
    none = S.Store(spark, str(tmp_path / "n"), "no_memory")
    with pytest.raises(S.NotSupported):
        none.delete(spark.createDataFrame([], REQUEST))
    with pytest.raises(S.NotSupported):
        S.Store(spark, str(tmp_path / "t"), "ranked_turns").export_items(U)
    table = {r.system: r for r in S.capability_table(spark).collect()}
    assert not table["no_memory"].persistence and table["fact_store"].temporal_query and not table["ranked_turns"].abstention
    assert S.REGISTRY["hybrid_augment"].config()["mode"] == "augment"
