import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import facts, scoring
from tidemark.sources import tables
from tidemark.streaming.facts import step, stream_outcomes

START = datetime(2026, 1, 1)
CLAIM = "seq bigint, ts timestamp_ntz, user_id bigint, slot string, is_delete boolean, value string, trust int"


def random_claims(seed, n=400):
    rng = random.Random(seed)
    return [(i, START + timedelta(minutes=i), rng.randrange(3), rng.choice("ab"), gone := rng.random() < 0.08, None if gone else rng.choice("xyz"), rng.choice([1, 1, 2, 3])) for i in range(n)]


class Row:
    def __init__(self, row):
        self.seq, _, self.user_id, self.slot, self.is_delete, self.value, self.trust = row


def fold(rows, theta):
    state, out = {}, {}
    for row in map(Row, rows):
        key = row.user_id, row.slot
        outcome, *state[key] = step(*state.get(key, (None, 0)), row, theta)
        out[row.seq] = outcome
    return out


@pytest.mark.parametrize("theta", [1, 2, 3])
def test_windows_equal_the_fold(spark, theta):
    rows = random_claims(theta)
    got = {r.seq: r.outcome for r in facts.outcomes(spark.createDataFrame(rows, CLAIM), theta).collect()}
    assert got == fold(rows, theta)


def test_stream_equals_batch_across_restart(spark, tmp_path):
    """Each pass restarts from the checkpoint; late rows are applied late, a row that
    comes again and a blocked one not at all."""
    rows = random_claims(9, 120)
    df = spark.createDataFrame(rows, CLAIM).withColumn("ts", F.col("ts").cast("timestamp"))
    schema, src, out = df.schema, str(tmp_path / "in"), str(tmp_path / "out")
    blocked = spark.createDataFrame([(rows[7][2], 7)], "user_id bigint, seq bigint")
    for part in ("seq < 40 OR seq BETWEEN 60 AND 80", "seq BETWEEN 40 AND 65", "seq > 80 OR seq < 5"):
        df.where(part).coalesce(1).write.mode("append").parquet(src)
        q = stream_outcomes(spark.readStream.schema(schema).parquet(src), blocked=blocked).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination(120)
    got = [(r.seq, r.outcome) for r in spark.read.parquet(out).collect()]
    arrived = [r for r in [*rows[:40], *rows[60:81], *rows[40:60], *rows[81:]] if r[0] != 7]
    assert len(got) == len(set(got)) and dict(got) == fold(arrived, 2)


def test_history_intervals_are_half_open(spark):
    rows = [(0, START, 1, "db", False, "14", 3), (1, START + timedelta(days=2), 1, "db", False, "14", 3), (2, START + timedelta(days=9), 1, "db", False, "16", 3)]
    c = spark.createDataFrame(rows, CLAIM)
    asked = [(1, "db", START - timedelta(1)), (1, "db", START), (1, "db", START + timedelta(9))]
    q = spark.createDataFrame([(*x, START + timedelta(30)) for x in asked], "user_id bigint, slot string, as_of timestamp_ntz, asked_at timestamp_ntz")
    got = {r.as_of: (r.value, r.valid_to) for r in facts.as_of(c, q).collect()}
    assert got[START - timedelta(1)] == (None, None) and got[START] == ("14", START + timedelta(9)) and got[START + timedelta(9)] == ("16", None)


ASKED = "user_id bigint, slot string, as_of timestamp_ntz, asked_at timestamp_ntz"


def day(n):
    return START + timedelta(n)


def test_held_claims(spark):
    """An equal held claim confirms and gives its event and label; others end as disputes."""
    rows = [
        (0, day(0), 1, "a", False, "old label", "x", 1), (1, day(1), 1, "a", False, "new", "x", 3),
        (2, day(2), 1, "b", False, "b", "x", 1), (3, day(3), 1, "b", False, "b", "x", 1), (4, day(4), 1, "b", False, "b", "y", 3),
        (5, day(5), 1, "c", False, "c", "p", 1), (6, day(6), 1, "c", False, "c", "q", 1),
    ]
    c = spark.createDataFrame(rows, "seq bigint, ts timestamp_ntz, user_id bigint, slot string, is_delete boolean, label string, value string, trust int")
    got = {r.slot: (r.label, r.value, r.sources, r.n_sources) for r in facts.history(c).collect()}
    assert got == {"a": ("old label", "x", "0,1", 2), "b": ("b", "y", "4", 1)}
    assert {r.seq: r.state for r in facts.held_claims(c).collect()} == {0: "confirmed", 2: "disputed", 3: "disputed", 5: "disputed", 6: "pending"}
    assert {r.seq for r in facts.disputes(c).collect()} == {2, 3, 5}


def test_answers_depend_on_when_they_are_asked(spark):
    rows = [(0, day(1), 1, "a", False, "x", 1), (1, day(2), 1, "a", False, "y", 3), (2, day(4), 1, "a", True, None, 3), (3, day(6), 1, "a", False, "z", 1)]
    c = spark.createDataFrame(rows, CLAIM)
    want = {0: "no known slot", 1: "unconfirmed", 2: "answered", 3: "answered", 4: "deleted", 5: "deleted", 7: "deleted"}
    q = spark.createDataFrame([(1, "a", day(n), day(n)) for n in want], ASKED)
    assert {r.asked_at: r.reason for r in facts.abstain_reasons(c, q).collect()} == {day(n): w for n, w in want.items()}
    before = spark.createDataFrame([(1, "a", day(1), day(3)), (1, "a", day(2), day(5))], ASKED)
    assert {r.asked_at: r.reason for r in facts.abstain_reasons(c, before).collect()} == {day(3): "no value at date", day(5): "deleted"}


def test_open_values_by_bucket_equal_a_fold(spark):
    rows = random_claims(5, 300)
    c = spark.createDataFrame(rows, CLAIM)
    got = {(r.bucket, r.slot): (r.open, r.trust) for r in facts.open_at(c, F.floor(F.col("seq") / 40)).collect()}
    state, want = {}, {}
    for i, row in enumerate(map(Row, rows)):
        key = row.user_id, row.slot
        state[key] = step(*state.get(key, (None, 0)), row, 2)[1:]
        if i % 40 == 39 or i == len(rows) - 1:
            for slot in "ab":
                held = [t for (_, s), (v, t) in state.items() if s == slot and v is not None]
                if held:
                    want[i // 40, slot] = (len(held), sum(held))
    assert got == want


def test_delete_hides_history(spark):
    rows = [(0, START, 1, "host", False, "s7", 3), (1, START + timedelta(1), 1, "host", True, None, 3)]
    m = scoring.mutations_of(facts.outcomes(spark.createDataFrame(rows, CLAIM)))
    p = spark.createDataFrame([("p", 1, "host", 5, 0)], "probe_id string, user_id bigint, slot string, asked bigint, target bigint")
    r = scoring.expected(m, p).first()
    assert (r.kind, r.truth, r.forbidden) == ("abstain", None, "s7")
    assert [tuple(x) for x in scoring.explain(m, p).collect()] == [("p", "s7", "resurrected")]


@pytest.mark.parametrize("text,phrase,want", [("on Main st", "main", True), ("maintain", "main", False), ("make   test.", "make test", True), ("ÜBER alles", "über", True), ("a", "  ", False), ("x.y", "x.y", True), ("xay", "x.y", False)])
def test_mentions(spark, text, phrase, want):
    df = spark.createDataFrame([(text, phrase)], "t string, p string")
    assert df.select(X.mentions(F.col("t"), F.col("p"))).first()[0] is want


def test_slot_key(spark):
    df = spark.createDataFrame([('The "Nightingale"', "deploy branch-name")], "e string, a string")
    assert df.select(X.slot_key(F.col("e"), F.col("a"))).first()[0] == "the-nightingale/deploy_branch_name"


def test_chat_reader(spark, tmp_path):
    doc = '[{"question_id":"q1_abs","question_type":"t","question":"?","answer":"a","question_date":"2023/05/30 (Tue) 10:00","haystack_dates":["2023/05/20 (Sat) 02:21"],"haystack_session_ids":["s1"],"haystack_sessions":[[{"role":"user","content":"hi"},{"role":"user","content":" "},{"role":"tool","content":"x"},{"role":"assistant","content":"yes"}]]}]'
    (tmp_path / "chat.json").write_text(doc)
    instances, events = tables.read_chats(spark, str(tmp_path / "chat.json"))
    assert instances.first().category == "abstention"
    got = [(r.event_id, r.ts.second, r.kind) for r in events.orderBy("j").collect()]
    assert got == [("s1#0", 0, "user_message"), ("s1#3", 3, "assistant_message")]


def test_snapshots_are_whole_or_none(spark, tmp_path):
    h = facts.history(spark.createDataFrame(random_claims(2, 60), CLAIM))
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        tables.restore(spark, path)
    assert tables.snapshot({"entries": h}, path) == 1
    assert tables.snapshot({"entries": h.limit(3)}, path) == 2
    h.limit(1).write.parquet(f"{path}/version=3/entries")  # broke off before its manifest
    assert tables.restore(spark, path)["entries"].count() == 3
    back = tables.restore(spark, path, 1)["entries"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, h.collect()), key=str)
