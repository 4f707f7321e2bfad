from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import deletes
from tidemark.sources import tables

START = datetime(2026, 1, 1)
CLAIM = "seq bigint, ts timestamp, user_id string, slot string, is_delete boolean, value string, trust int"
REQUEST = "request_id string, user_id string, requested_at timestamp, sources array<string>, description string"
TURN = "event_id string, user_id string, ts timestamp, kind string, content string"


def day(n):
    return START + timedelta(n)


def claims(spark):
    rows = [(0, 0, "u", "staging/host"), (1, 1, "u", "app/database"), (2, 2, "u", "staging/host"), (3, 6, "u", "staging/host"), (4, 1, "v", "staging/host")]
    return spark.createDataFrame([(s, day(d), u, slot, False, f"value-{s}", 3) for s, d, u, slot in rows], CLAIM)


def test_slots_by_sources_then_by_description(spark):
    c = claims(spark)
    rows = [
        ("r1", "u", day(4), ["2"], "forget it"),  # cited and there
        ("r2", "u", day(5), ["0"], "forget the app database"),  # cited, but gone with r1: the text counts
        ("r3", "u", day(7), [], "drop the staging host please"),  # what came after r1
        ("r4", "v", day(8), ["0"], "nothing named"),  # another user's event
    ]
    requests = spark.createDataFrame(rows, REQUEST)
    routes = deletes.routed(requests, c).where(F.contains("slot", F.lit("/")))
    got = deletes.deleted_slots(c, requests, routes)
    assert {(r.request_id, r.slot) for r in got.collect()} == {("r1", "staging/host"), ("r2", "app/database"), ("r3", "staging/host")}
    erased = deletes.erased_claims(c, got)
    assert {(r.seq, r.request_id) for r in erased.collect()} == {(0, "r1"), (2, "r1"), (1, "r2"), (3, "r3")}
    assert {(r.request_id, r.slots, r.erased) for r in deletes.delete_report(got, erased).collect()} == {("r1", 1, 2), ("r2", 1, 1), ("r3", 1, 1)}
    assert {(r.user_id, r.event_id) for r in deletes.blocked_sources(requests, erased).collect()} == {("u", str(i)) for i in range(4)} | {("v", "0")}


def test_turns_that_give_erased_facts_away(spark):
    turns = spark.createDataFrame(
        [
            ("t1", "u", day(1), "user_message", "The host is value-0 now."),
            ("t2", "u", day(9), "user_message", "Value-0 again, after the request."),
            ("t3", "u", day(2), "user_message", "What's the staging hostname?"),
            ("t4", "u", day(9), "user_message", "What's the staging hostname?"),
            ("t5", "u", day(3), "assistant_message", "I'll look at staging."),
            ("t6", "u", day(3), "user_message", "I'll look at staging."),
            ("t7", "v", day(1), "user_message", "value-0 is theirs"),
            ("t8", "u", day(3), "tool_call", "open app.log"),
            ("t9", "u", day(3), "tool_call", "open my-app"),
        ],
        TURN,
    )
    c = claims(spark)
    requests = spark.createDataFrame([("r", "u", day(4), ["0"], "also what you know of app")], REQUEST)
    deleted = spark.createDataFrame([("u", "r", day(4), "staging/host")], "user_id string, request_id string, requested_at timestamp, slot string")
    erased = spark.createDataFrame([("u", 0, "staging/host", "value-0", "r")], "user_id string, seq bigint, slot string, value string, request_id string")
    ids = lambda df: {r.event_id for r in df.collect()}
    assert ids(deletes.turns_with_values(turns, erased)) == {"t1", "t2"}
    assert ids(deletes.turns_with_slots(turns, deleted)) == {"t3"}
    assert ids(deletes.turns_with_entities(turns, requests, deleted, c)) == {"t5", "t8"}
    gone = deletes.scrubbed(turns, requests, deleted, erased, c)
    assert ids(deletes.delete_turns(turns, gone)) == {"t4", "t6", "t7", "t9"}
    other = spark.createDataFrame([("v", "t1")], "user_id string, event_id string")
    assert deletes.delete_turns(turns, other).count() == 9


def test_memories_by_provenance(spark):
    memories = spark.createDataFrame([("m1", ["a", "b"]), ("m2", ["c"]), ("m3", [])], "memory_id string, event_ids array<string>")
    requests = spark.createDataFrame([("r", "u", day(1), ["b", "x"], "")], REQUEST)
    assert {r.memory_id for r in deletes.by_provenance(memories, requests).collect()} == {"m2", "m3"}
    row = deletes.unsupported(requests, "notes").first()
    assert (row.op, row.ref, row.error) == ("delete", "r", "unsupported: notes cannot delete")


def test_responses_are_addressed_by_content(spark):
    schema = "id int, request struct<prompt:string,model:string>"
    requests = spark.createDataFrame([(1, ("a", "m")), (2, ("b", "m")), (3, ("a", "m")), (4, ("no", "m"))], schema)
    empty = spark.createDataFrame([], "digest string, response string, usage int")

    def call(misses):
        return misses.select("digest", F.upper("request.prompt").alias("response"), F.lit(7).alias("usage"), (F.col("request.prompt") == "no").alias("refused"))

    answers, stored = tables.cached_responses(requests, empty, call)
    assert {(r.id, r.response, r.hit) for r in answers.collect()} == {(1, "A", False), (2, "B", False), (3, "A", False), (4, "NO", False)}
    assert stored.count() == 2
    swapped = requests.select("id", F.struct("request.model", "request.prompt").alias("request"))  # the order of fields is no matter
    answers, more = tables.cached_responses(swapped, stored, call)
    assert {(r.id, r.hit) for r in answers.collect()} == {(1, True), (2, True), (3, True), (4, False)} and more.count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, None), ("b", 2.0, "x")], "name string, v double, note string")
    tables.write_latex(rows, str(tmp_path / "t"), "name", "v", "note")
    assert {r.value for r in spark.read.text(str(tmp_path / "t")).collect()} == {r"a & 1.5 & -- \\", r"b & 2.0 & x \\"}
    tables.write_plot_data(rows.select("name", "v"), str(tmp_path / "p"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "p")).collect()) == ["a 1.5", "b 2.0", "name v"]
    tables.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    log = spark.createDataFrame([("w", "s", "m", 1)], "workload_id string, system string, mode string, n int")
    tables.write_runs(log, str(tmp_path / "r"))
    tables.write_runs(log, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    tables.write_ids(spark.createDataFrame([(1, "b"), (0, "a")], "pos int, id string"), str(tmp_path / "i"))
    assert tables.read_ids(spark, str(tmp_path / "i")) == ["a", "b"]
    made = []
    for _ in range(2):
        df = tables.cached_workload(spark, str(tmp_path / "w"), lambda: made.append(1) or rows)
    assert df.count() == 2 and made == [1]
    assert "spark.app.name" not in tables.options(spark)
