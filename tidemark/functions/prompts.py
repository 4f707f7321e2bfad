"""Texts that go to and come from outside models, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import grounded, slot_key

CLAIM = "event_id string, entity string, attribute string, value string"


def fill(template: Column, values: dict[str, Column]) -> Column:
    """A template with its ``{name}`` places filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def short_name(service: Column) -> Column:
    """A service without ``-service`` at its end."""
    return F.regexp_replace(service, "-service$", "")


def long_date(ts: Column) -> Column:
    """``March 5, 2026``"""
    return F.date_format(ts, "MMMM d, yyyy")


def redated(text: Column, day: Column) -> Column:
    """A prompt's date of today set to another day."""
    return F.regexp_replace(text, F.lit(r"Today's date is \d{4}-\d{2}-\d{2}"), F.concat(F.lit("Today's date is "), day))


def spliced(text: Column, start: str, end: str, section: Column) -> Column:
    """The part from one heading up to the next replaced; unchanged without them."""
    pattern = f"(?s){re.escape(start)}.*?(?={re.escape(end)})"
    return F.regexp_replace(text, F.lit(pattern), F.regexp_replace(section, r"([\\$])", r"\\$1"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def mean_sd(mean: Column, sd: Column) -> Column:
    """``71.0 ± 2.5``"""
    return F.format_string("%.1f ± %.1f", mean, F.coalesce(sd, F.lit(0.0)))


def kib(size: Column) -> Column:
    return F.format_string("%.1f", size / 1024)


def verdict_cell(verdict: Column, types: Column) -> Column:
    """A verdict with its types of error in order."""
    names = F.array_join(F.array_sort(F.array_distinct(types)), ",")
    return F.when(F.size(types) > 0, F.concat(verdict, F.lit(" ("), names, F.lit(")"))).otherwise(verdict)


def aliases(value: Column) -> Column:
    """Other ways to write a version of PostgreSQL or Node."""
    number = F.get(F.split(value, " "), 1)
    pg = F.array(F.concat(F.lit("Postgres "), number), F.concat(F.lit("PG "), number))
    none = F.array().cast("array<string>")
    return F.when(value.startswith("PostgreSQL "), pg).when(value.startswith("Node "), F.array(F.concat(F.lit("Node.js "), number))).otherwise(none)


def known_block(known: Column) -> Column:
    """Slots a model is told of, from an array of structs (slot, state)."""
    lines = F.transform(F.array_sort(known), lambda x: F.concat(F.lit("- "), x["slot"], F.lit(": "), x["state"]))
    return F.when(F.size(known) > 0, F.concat(F.lit("Known slots (key: description):\n"), F.array_join(lines, "\n"))).otherwise("Known slots: none yet.")


def event_line(event_id: Column, ts: Column, kind: Column, content: Column) -> Column:
    return F.concat(F.lit("["), event_id, F.lit("] "), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" "), kind, F.lit(": "), content)


def answer_prompt(question: Column, asked_at: Column, lines: Column, reason: Column) -> Column:
    """What an answerer is asked; lines: the contents of the evidence in order."""
    said = F.coalesce(F.concat(F.lit(" The memory system reported: "), reason, F.lit(".")), F.lit(""))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    memory = F.when(F.size(lines) > 0, listed).otherwise(F.concat(F.lit("(nothing)"), said))
    return F.concat(F.lit("Today is "), F.date_format(asked_at, "yyyy-MM-dd"), F.lit(".\n\nQuestion: "), question, F.lit("\n\nMemory:\n"), memory)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def claims_schema(event_ids: list[str]) -> dict:
    """A JSON schema of claims that allows the ids of one batch only."""
    fields = {"event_id": {"type": "string", "enum": list(event_ids)}} | {k: {"type": "string"} for k in ("entity", "attribute", "value")}
    item = {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    return {"type": "object", "properties": {"claims": {"type": "array", "items": item}}, "required": ["claims"], "additionalProperties": False}


def sane_claims(replies: DataFrame, events: DataFrame) -> DataFrame:
    """Claims of model replies (batch, reply: JSON), with ``fate``: kept, dropped (a
    field blank or an id that isn't in the batch) or ungrounded (the value isn't in the
    event's content); kept ones have slot, label and a trimmed value.

    events: batch, event_id, content.  Replies that are no such JSON give no claims.
    """
    parsed = F.from_json("reply", f"claims array<struct<{CLAIM.replace(' string', ':string')}>>")
    rows = replies.select("batch", F.posexplode(parsed["claims"]).alias("pos", "c")).select("batch", "pos", "c.*")
    rows = rows.join(events.select("batch", "event_id", "content").withColumn("_in", F.lit(True)), ["batch", "event_id"], "left")
    blank = [F.coalesce(F.trim(c) == "", F.lit(True)) for c in ("entity", "attribute", "value")]
    bad = F.col("_in").isNull() | blank[0] | blank[1] | blank[2]
    fate = F.when(bad, "dropped").when(~grounded(F.col("value"), F.col("content")), "ungrounded").otherwise("kept")
    label = F.concat(F.replace(F.trim("attribute"), F.lit("_"), F.lit(" ")), F.lit(" of "), F.trim("entity"))
    kept = F.col("fate") == "kept"
    rows = rows.withColumn("fate", fate)
    return rows.select("batch", "pos", "event_id", "fate", F.when(kept, slot_key(F.col("entity"), F.col("attribute"))).alias("slot"), F.when(kept, label).alias("label"), F.when(kept, F.trim("value")).alias("value"))


def allowed_slots(replies: DataFrame, known: DataFrame) -> DataFrame:
    """Slots of routing replies (query_id, user_id, slots array) that the user has, once
    each and in the order of the reply."""
    rows = replies.select("query_id", "user_id", F.posexplode(F.array_distinct("slots")).alias("pos", "slot"))
    kept = rows.join(known.select("user_id", "slot").distinct(), ["user_id", "slot"], "left_semi")
    return kept.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("pos"))).select("query_id", "place", "slot")


def model_tokens(text: Column, encoding: str | None = None, *, ranks_path: str | None = None, pattern: str | None = None) -> Column:
    """Tokens by a model's vocabulary where it is at hand, else words and marks: by name
    where ``tiktoken`` has it, or from a file of ranks."""
    from .text import token_count

    if encoding is None and ranks_path is None:
        return token_count(text)

    @F.pandas_udf("bigint")
    def count(texts):
        import tiktoken

        if ranks_path is None:
            enc = tiktoken.get_encoding(encoding)
        else:
            from tiktoken.load import load_tiktoken_bpe

            enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(ranks_path), special_tokens={})
        return texts.map(lambda t: None if t is None else len(enc.encode(t, disallowed_special=())))

    return count(text)
