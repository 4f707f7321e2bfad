"""Claims from text by rules, and routing of questions to slots by cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Database names, and (slot, label, value pattern, cue pattern) of each rule.
DATABASES = {"postgresql": "PostgreSQL", "postgres": "PostgreSQL", "pg": "PostgreSQL", "mysql": "MySQL", "mariadb": "MariaDB", "sqlite": "SQLite", "mongodb": "MongoDB"}
RULES = [
    ("database", "database", r"\b(postgresql|postgres|pg|mysql|mariadb|sqlite|mongodb)\s*(\d+(?:\.\d+)?)\b", r"\b(database|db|postgres\w*|mysql)\b"),
    ("test_command", "test command", r"\btests?\b[^`]*`([^`]+)`", r"\b(tests?|test suite)\b"),
    ("deploy_branch", "deploy branch", r"\bdeploy\w*\b[^.`]*?\bfrom\s+(?:the\s+)?`?([A-Za-z][\w./-]*)`?", r"\b(branch|deploy\w*)\b"),
    ("staging_hostname", "staging hostname", r"\bstaging\b.*?\b([a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:internal|local|com|net|io|org))\b", r"\b(staging|hostname|host)\b"),
]


def _value(text: Column, slot: str, pattern: str) -> Column:
    """The first hit's value; null without one."""
    first = F.regexp_extract(text, f"(?iU){pattern}", 1)
    if slot == "database":
        proper = F.element_at(F.create_map(*(F.lit(x) for kv in DATABASES.items() for x in kv)), F.lower(first))
        return F.concat(proper, F.lit(" "), F.regexp_extract(text, f"(?iU){pattern}", 2))
    return F.when(first != "", first)


def rule_claims(events: DataFrame) -> DataFrame:
    """(event_id, rule_no, slot, label, value): each rule's first hit in each event's
    ``content``; expressions only, so the scan stays one stage."""
    found = (F.struct(F.lit(i).alias("rule_no"), F.lit(slot).alias("slot"), F.lit(label).alias("label"), _value(F.col("content"), slot, pattern).alias("value")) for i, (slot, label, pattern, _) in enumerate(RULES))
    return events.select("event_id", F.inline(F.array(*found))).where("value IS NOT NULL")


def routed_slots(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, slot) for every cue that a text holds."""
    hits = (F.when(F.rlike(F.col(text), F.lit(f"(?iU){cue}")), F.lit(slot)) for slot, _, _, cue in RULES)
    return texts.select(key, F.explode(F.filter(F.array(*hits), lambda s: s.isNotNull())).alias("slot"))
