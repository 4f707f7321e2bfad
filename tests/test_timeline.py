"""Each rule of a timeline is broken once; nothing else may be reported."""

import copy
import json

import pytest

from tidemark.operators import timeline
from tidemark.sources import tables

from .timelines import document


def load(spark, tmp_path, *docs):
    path = tmp_path / "docs"
    path.mkdir()
    for i, d in enumerate(docs):
        (path / f"{i}.json").write_text(json.dumps({**d, "workload_id": f"w{i}"}))
    return tables.read_timelines(spark, str(path))


def broken(change):
    doc = copy.deepcopy(document())
    change(doc, {r[k]: r for t, k in timeline.KEYS.items() for r in doc[t]})
    return doc


CASES = [
    (lambda d, r: d["events"].append(dict(r["e12"])), ["duplicate event id: e12"]),
    (lambda d, r: d["facts"].append({**r["f_db"], "fact_id": "f_2"}), ["two facts share the slot u1, payments-service, database"]),
    (lambda d, r: d["events"].insert(0, d["events"].pop(3)), ["events are not in chronological order", "a checkpoint precedes the first event"][:1]),
    (lambda d, r: r["m10"].update(fact_id="nope"), ["m10: unknown fact nope"]),
    (lambda d, r: r["m10"].update(carrier_event_ids=["zz"]), ["m10: unknown carrier event"]),
    (lambda d, r: r["m06"].update(at="2026-01-20T09:08:00Z"), ["m06: 'at' must equal first carrier's timestamp"]),
    (lambda d, r: r["m04"].update(source="user"), ["m04: source user does not match carrier kind document"]),
    (lambda d, r: r["e11"].update(user_id="u9"), ["m10: carrier belongs to another user"]),
    (lambda d, r: r["m06"].update(value="PostgreSQL 15"), ["f_db/m06: RESTATE must repeat the current value"]),
    (lambda d, r: r["m06"].update(kind="introduce"), ["f_db/m06: INTRODUCE while fact is active (use UPDATE)"]),
    (lambda d, r: r["m06"].update(kind="update"), ["f_db/m06: UPDATE to the same value (use RESTATE)"]),
    (lambda d, r: r["m10"].update(value="main"), ["f_branch/m10: CONTRADICT must conflict with the current value"]),
    (lambda d, r: d["mutations"].remove(r["m05"]), ["f_staging/m09: DELETE of an inactive fact"]),
    (lambda d, r: r["c1"].update(at="2026-03-01T00:00:00Z"), ["checkpoint times must increase with fraction", "probe p01: expects value='PostgreSQL 14' but ground truth is value='PostgreSQL 16'", "probe p01: forbidden list omits PostgreSQL 14"]),
    (lambda d, r: d["checkpoints"].append({"name": "c0", "fraction": 0.01, "at": "2026-01-01T00:00:00Z"}), ["a checkpoint precedes the first event"]),
    (lambda d, r: r["c1"].update(fraction=0.0), ["checkpoint c1: fraction must be in (0, 1]"]),
    (lambda d, r: r["p08"].update(checkpoint="c9"), ["probe p08: unknown checkpoint c9"]),
    (lambda d, r: r["p07"].update(fact_ids=["f_x", "f_branch", "f_y"]), ["probe p07: unknown facts f_x, f_y"]),
    (lambda d, r: r["p07"].update(user_id="u9"), ["probe p07: refers to another user's fact"]),
    (lambda d, r: r["p05"].update(as_of=None, expected={"kind": "value", "value": "PostgreSQL 16", "aliases": [], "forbidden": ["PostgreSQL 14"]}), ["probe p05: HISTORICAL probe needs as_of"]),
    (lambda d, r: r["p05"].update(as_of="2026-04-30T00:00:00Z", expected={"kind": "value", "value": "PostgreSQL 16", "aliases": [], "forbidden": ["PostgreSQL 14"]}), ["probe p05: as_of is after the checkpoint"]),
    (lambda d, r: r["p08"]["expected"].update(kind="value", value="x"), ["probe p08: abstention probe must expect abstention"]),
    (lambda d, r: r["p08"].update(probe_type="current"), ["probe p08: only ABSTENTION probes may have no facts"]),
    (lambda d, r: r["p01"].update(probe_type="multi_fact"), ["probe p01: MULTI_FACT probe needs two or more facts"]),
    (lambda d, r: r["p01"].update(probe_type="post_update"), ["probe p01: post_update probe but no update before checkpoint"]),
    (lambda d, r: r["p06"]["expected"].update(forbidden=[]), ["probe p06: forbidden list omits staging-7.internal"]),
    (lambda d, r: r["p02"]["expected"].update(value="master", forbidden=["main"]), ["probe p02: expects value='master' but ground truth is value='main'", "probe p02: forbidden list omits master"]),
    (lambda d, r: r["p01"]["expected"].update(forbidden=["PostgreSQL 14"]), ["probe p01: the expected value is forbidden"]),
]


def test_errors(spark, tmp_path):
    tl = load(spark, tmp_path, document(), *(broken(c) for c, _ in CASES))
    got = {}
    for r in timeline.consistency_errors({k: v.persist() for k, v in tl.items()}).collect():
        got.setdefault(r.workload_id, []).append(r.error)
    assert "w0" not in got
    for i, (_, want) in enumerate(CASES, 1):
        assert sorted(got.get(f"w{i}", [])) == sorted(want), i


def test_hygiene(spark, tmp_path):
    def tell(d, r):
        r["e12"]["content"] = "Back to PostgreSQL 16 and master."
        r["p02"]["question"] = "Is it main?"

    tl = load(spark, tmp_path, broken(tell))
    assert {(r.event_id, r.value) for r in timeline.uncarried_values(tl).collect()} == {("e12", "PostgreSQL 16"), ("e12", "master")}
    assert {(r.probe_id, r.value) for r in timeline.telling_questions(tl).collect()} == {("p02", "main")}


def test_documents_round_trip(spark, tmp_path):
    tl = load(spark, tmp_path, document(), document())
    heads = spark.createDataFrame([(f"w{i}", "0.1", "hand-built", 0) for i in (0, 1)], "workload_id string, schema_version string, generator string, seed int")
    tables.write_timelines(heads, tl, str(tmp_path / "out"))
    back = tables.read_timelines(spark, str(tmp_path / "out"))
    for name in tl:
        assert sorted(map(str, back[name].collect())) == sorted(map(str, tl[name].collect())), name


def test_ids_in_order(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    assert [r.v for r in tables.select_ids(rows, "id", ["c", "a"]).orderBy("pos").collect()] == [3, 1]
    with pytest.raises(KeyError):
        tables.select_ids(rows, "id", ["c", "zz"])
