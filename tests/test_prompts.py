from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import prompts as P


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_texts(spark):
    DAY = F.lit(datetime(2026, 3, 5, 9, 7))
    cases = [
        (P.fill(F.lit("{svc} runs {v} on {short}"), {"svc": F.lit("pay-service"), "v": F.lit("$1 {x}"), "short": P.short_name(F.lit("pay-service"))}), "pay-service runs $1 {x} on pay"),
        (P.long_date(DAY), "March 5, 2026"),
        (P.redated(F.lit("a. Today's date is 2024-01-02. b"), F.lit("2026-03-05")), "a. Today's date is 2026-03-05. b"),
        (P.spliced(F.lit("x\n# A\nold\n# B\nend"), "# A", "# B", F.lit("# A\nnew $1 \\d\n")), "x\n# A\nnew $1 \\d\n# B\nend"),
        (P.spliced(F.lit("nothing"), "# A", "# B", F.lit("z")), "nothing"),
        (P.percent(F.lit(1), F.lit(4)), 25.0),
        (P.percent(F.lit(0), F.lit(0)), 0.0),
        (P.mean_sd(F.lit(71.04), F.lit(None).cast("double")), "71.0 ± 0.0"),
        (P.kib(F.lit(1536)), "1.5"),
        (P.verdict_cell(F.lit("wrong"), F.array(F.lit("stale"), F.lit("future"), F.lit("stale"))), "wrong (future,stale)"),
        (P.verdict_cell(F.lit("correct"), F.array().cast("array<string>")), "correct"),
        (P.aliases(F.lit("PostgreSQL 14")), ["Postgres 14", "PG 14"]),
        (P.aliases(F.lit("Node 20")), ["Node.js 20"]),
        (P.aliases(F.lit("Go 1.22")), []),
        (P.known_block(F.array().cast("array<struct<slot:string,state:string>>")), "Known slots: none yet."),
        (P.known_block(F.array(F.struct(F.lit("b").alias("slot"), F.lit("x").alias("state")), F.struct(F.lit("a").alias("slot"), F.lit("(deleted)").alias("state")))), "Known slots (key: description):\n- a: (deleted)\n- b: x"),
        (P.event_line(F.lit("e1"), DAY, F.lit("document"), F.lit("text")), "[e1] 2026-03-05 09:07 document: text"),
        (P.answer_prompt(F.lit("Q?"), DAY, F.array(F.lit("one"), F.lit("two")), F.lit(None).cast("string")), "Today is 2026-03-05.\n\nQuestion: Q?\n\nMemory:\n- one\n- two"),
        (P.answer_prompt(F.lit("Q?"), DAY, F.array().cast("array<string>"), F.lit("gone")), "Today is 2026-03-05.\n\nQuestion: Q?\n\nMemory:\n(nothing) The memory system reported: gone."),
    ]
    got = spark.range(1).select(*(e.alias(f"c{i}") for i, (e, _) in enumerate(cases))).first()
    for value, (_, want) in zip(got, cases, strict=True):
        assert value == want


def test_claims_of_replies(spark):
    import json

    good = {"event_id": "e1", "entity": ' The "Shop" ', "attribute": "deploy branch", "value": " main "}
    claims = [good, {**good, "value": " "}, {**good, "event_id": "e9"}, {**good, "value": "master"}, {**good, "value": "MA in"}]
    replies = spark.createDataFrame([("b", json.dumps({"claims": claims})), ("c", "no json"), ("d", "{}")], "batch string, reply string")
    events = spark.createDataFrame([("b", "e1", "we use main."), ("b", "e2", "x")], "batch string, event_id string, content string")
    got = [(r.fate, r.slot, r.label, r.value) for r in P.sane_claims(replies, events).orderBy("batch", "pos").collect()]
    kept = ("kept", "the-shop/deploy_branch", 'deploy branch of The "Shop"')
    assert got == [(*kept, "main"), ("dropped", None, None, None), ("dropped", None, None, None), ("ungrounded", None, None, None), (*kept, "MA in")]
    assert P.claims_schema(["e1"])["properties"]["claims"]["items"]["properties"]["event_id"]["enum"] == ["e1"]


def test_allowed_slots(spark):
    replies = spark.createDataFrame([("q", "u", ["b", "z", "a", "b"])], "query_id string, user_id string, slots array<string>")
    known = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "z")], "user_id string, slot string")
    assert [r.slot for r in P.allowed_slots(replies, known).orderBy("place").collect()] == ["b", "a"]


def test_tokens_without_a_vocabulary(spark):
    assert one(spark, P.model_tokens(F.lit("a b, c."))) == 5
