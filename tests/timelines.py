"""A small hand-built timeline as child tables, and what each system makes of it."""

from datetime import datetime

W = "example"
U = "u1"


def ts(month, day, hour=10, minute=0):
    return datetime(2026, month, day, hour, minute)


# Events, facts, changes, checkpoints and probes of the example.
EVENTS = [
    ("e01", "s1", ts(1, 5, 10, 0), "user_message", "For payments-service we're on PostgreSQL 14."),
    ("e02", "s1", ts(1, 5, 10, 1), "user_message", "Run the tests with `pytest -x`, please."),
    ("e03", "s1", ts(1, 5, 10, 2), "user_message", "We deploy from the main branch."),
    ("e04", "s1", ts(1, 5, 10, 3), "assistant_message", "Got it, I'll keep that in mind."),
    ("e05", "s2", ts(1, 20, 9, 0), "document", "README.md: Deploys go out from the `master` branch."),
    ("e06", "s2", ts(1, 20, 9, 5), "user_message", "Staging lives at staging-7.internal."),
    ("e07", "s2", ts(1, 20, 9, 9), "user_message", "Reminder: payments still runs on Postgres 14."),
    ("e08", "s3", ts(2, 15, 14, 0), "tool_result", "migrate.log: payments-service migrated to PostgreSQL 16. OK"),
    ("e09", "s3", ts(2, 15, 14, 10), "user_message", "Tests now run with `make test`."),
    ("e10", "s4", ts(3, 10, 11, 0), "user_message", "Please forget the staging hostname, it shouldn't be stored."),
    ("e11", "s4", ts(3, 10, 11, 2), "assistant_message", "Understood. Deploying from master as usual, then?"),
    ("e12", "s5", ts(3, 30, 16, 0), "user_message", "Let's refactor the cart module next."),
]
FACTS = [("f_db", "payments-service", "database", "codebase"), ("f_test", "repo", "test_command", "workflow"), ("f_branch", "repo", "deploy_branch", "workflow"), ("f_staging", "staging", "hostname", "infrastructure")]
CHANGES = [
    ("m01", "f_db", "introduce", "PostgreSQL 14", "e01"),
    ("m02", "f_test", "introduce", "pytest -x", "e02"),
    ("m03", "f_branch", "introduce", "main", "e03"),
    ("m04", "f_branch", "contradict", "master", "e05"),
    ("m05", "f_staging", "introduce", "staging-7.internal", "e06"),
    ("m06", "f_db", "restate", "PostgreSQL 14", "e07"),
    ("m07", "f_db", "update", "PostgreSQL 16", "e08"),
    ("m08", "f_test", "update", "make test", "e09"),
    ("m09", "f_staging", "delete", None, "e10"),
    ("m10", "f_branch", "contradict", "master", "e11"),
]
CHECKPOINTS = [("c1", 0.5833, ts(1, 20, 9, 9)), ("c2", 0.75, ts(2, 15, 14, 10)), ("c3", 1.0, ts(3, 30, 16, 0))]
PROBES = [
    ("p01", "current", "Which database version does payments-service use?", "c1", "f_db", None, "value", "PostgreSQL 14", ["Postgres 14", "PG 14"], []),
    ("p02", "contamination", "Which branch do we deploy from?", "c1", "f_branch", None, "value", "main", [], ["master"]),
    ("p03", "post_update", "Which database version does payments-service use?", "c2", "f_db", None, "value", "PostgreSQL 16", ["Postgres 16", "PG 16"], ["PostgreSQL 14"]),
    ("p04", "post_update", "How do I run the test suite?", "c2", "f_test", None, "value", "make test", [], ["pytest -x"]),
    ("p05", "historical", "Which database version was payments-service on at the end of January?", "c3", "f_db", ts(1, 31, 23, 59), "value", "PostgreSQL 14", ["Postgres 14", "PG 14"], ["PostgreSQL 16"]),
    ("p06", "post_delete", "What's the staging hostname?", "c3", "f_staging", None, "abstain", None, [], ["staging-7.internal"]),
    ("p07", "contamination", "Which branch do we deploy from?", "c3", "f_branch", None, "value", "main", [], ["master"]),
    ("p08", "abstention", "Which message queue does payments-service use?", "c3", None, None, "abstain", None, [], []),
]
SOURCES = {"user_message": "user", "assistant_message": "model", "tool_result": "tool", "document": "document"}


def document():
    """The timeline as one JSON-able document."""
    stamp = lambda t: t and t.strftime("%Y-%m-%dT%H:%M:%SZ")
    at = {e[0]: e for e in EVENTS}
    return {
        "schema_version": "0.1", "workload_id": W, "generator": "hand-built", "seed": 0,
        "events": [{"event_id": i, "user_id": U, "session_id": s, "timestamp": stamp(t), "kind": k, "content": c, "metadata": {}} for i, s, t, k, c in EVENTS],
        "facts": [{"fact_id": i, "user_id": U, "entity": e, "attribute": a, "category": c, "description": ""} for i, e, a, c in FACTS],
        "mutations": [{"mutation_id": i, "fact_id": f, "kind": k, "at": stamp(at[e][2]), "value": v, "source": SOURCES[at[e][3]], "carrier_event_ids": [e]} for i, f, k, v, e in CHANGES],
        "checkpoints": [{"name": n, "fraction": f, "at": stamp(t)} for n, f, t in CHECKPOINTS],
        "probes": [{"probe_id": i, "user_id": U, "probe_type": t, "question": q, "checkpoint": c, "fact_ids": [f] if f else [], "as_of": stamp(a), "expected": {"kind": k, "value": v, "aliases": al, "forbidden": fb}} for i, t, q, c, f, a, k, v, al, fb in PROBES],
    }
