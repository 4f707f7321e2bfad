"""Delete requests: which slots they mean, what they erase and what stays blocked.

A request has request_id, user_id, requested_at, sources (event ids, may be empty) and
description.  Turns are trace events: event_id, user_id, ts, kind, content.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import names, names_slot
from .evidence import phrase_pairs
from .extract import RULES

UNTRUSTED = ("assistant_message", "tool_call")


def requests_of(mutations: DataFrame, facts: DataFrame, events: DataFrame, with_sources: bool = True) -> DataFrame:
    """Delete mutations as requests, delivered after ``trigger``, their earliest carrier
    in the stream.  Sources are the carriers of all earlier changes of the fact that
    had a value, in stream order; deletes in between don't clear them.

    events: event_id, seq, content; mutations: mutation_id, seq, fact_id, kind, at,
    value, carrier_event_ids.
    """
    place = events.select(F.col("event_id").alias("carrier"), F.col("seq").alias("place"), "content")
    carried = mutations.select("mutation_id", F.explode("carrier_event_ids").alias("carrier")).join(place, "carrier")
    carried = carried.groupBy("mutation_id").agg(F.collect_list(F.struct("place", "carrier")).alias("carriers"), F.min(F.struct("place", "carrier", "content")).alias("first"))
    before = W.partitionBy("fact_id").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, -1)
    stated = F.flatten(F.collect_list(F.when(F.col("value").isNotNull() & (F.col("kind") != "delete"), F.col("carriers"))).over(before))
    rows = mutations.join(carried, "mutation_id").withColumn("stated", F.array_sort(F.array_distinct(stated)))
    sources = F.transform("stated", lambda x: x["carrier"]) if with_sources else F.array().cast("array<string>")
    rows = rows.where("kind = 'delete'").join(facts.select("fact_id", "user_id"), "fact_id")
    return rows.select(F.col("mutation_id").alias("request_id"), "user_id", F.col("at").alias("requested_at"), F.col("first.content").alias("description"), sources.alias("sources"), F.col("first.carrier").alias("trigger"))


def routed(requests: DataFrame, known: DataFrame) -> DataFrame:
    """(user_id, request_id, slot): slots whose cue the description holds, whether the
    user has them or not, and slots of the user (user_id, slot) that it names."""
    cues = F.filter(F.array(*(F.when(F.rlike("description", F.lit(f"(?iU){cue}")), F.lit(slot)) for slot, _, _, cue in RULES)), lambda s: s.isNotNull())
    by_cue = requests.select("user_id", "request_id", F.explode(cues).alias("slot"))
    named = requests.join(known.select("user_id", "slot").distinct(), "user_id").where(names_slot(F.col("description"), F.col("slot")))
    return by_cue.unionByName(named.select("user_id", "request_id", "slot")).distinct()


def deleted_slots(claims: DataFrame, requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(user_id, request_id, requested_at, slot) that each request deletes: the slots of
    claims from its sources that no earlier request has erased, or, without any, those
    its description is routed to.

    Whether a claim is still there hangs on the requests before, so a user's requests,
    and only the claims they cite, are taken one after another.
    """
    cited = requests.select("user_id", "request_id", "requested_at", F.explode("sources").alias("source"))
    cited = cited.join(claims.where("NOT is_delete").select("user_id", F.col("seq").cast("string").alias("source"), "slot", "ts"), ["user_id", "source"]).where("ts <= requested_at")
    cited = cited.groupBy("user_id", "request_id", "requested_at", "slot").agg(F.max("ts").alias("ts"))
    asked = routes.join(requests.select("user_id", "request_id", "requested_at"), ["user_id", "request_id"]).withColumn("ts", F.lit(None).cast(claims.schema["ts"].dataType))
    rows = cited.select("user_id", "request_id", "requested_at", "slot", "ts").unionByName(asked.select("user_id", "request_id", "requested_at", "slot", "ts"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        last: dict[str, pd.Timestamp] = {}
        out = []
        for (at, request), part in frame.groupby(["requested_at", "request_id"], sort=True):
            live = {s for s, t in zip(part["slot"], part["ts"], strict=True) if t is not pd.NaT and not pd.isna(t) and (s not in last or t > last[s])}
            live = live or set(part["slot"][part["ts"].isna()])
            for slot in sorted(live):
                last[slot] = at
                out.append((frame["user_id"].iloc[0], request, at, slot))
        return pd.DataFrame(out, columns=["user_id", "request_id", "requested_at", "slot"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("user_id").applyInPandas(fold, ", ".join(f"{c} {kinds[c]}" for c in ("user_id", "request_id", "requested_at", "slot")))


def erased_claims(claims: DataFrame, deleted: DataFrame) -> DataFrame:
    """(user_id, seq, slot, value, request_id): the claims that each deletion erases, by
    the first deletion of their slot at or after them."""
    rows = claims.where("NOT is_delete").select("user_id", "slot", "ts", "seq", "value", F.lit(0).alias("_o"))
    marks = deleted.select("user_id", "slot", F.col("requested_at").alias("ts"), "request_id", F.lit(1).alias("_o"))
    after = W.partitionBy("user_id", "slot").orderBy("ts", "_o").rowsBetween(0, W.unboundedFollowing)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_r", F.first("request_id", ignorenulls=True).over(after))
    return both.where("_o = 0 AND _r IS NOT NULL").select("user_id", "seq", "slot", "value", F.col("_r").alias("request_id"))


def delete_report(deleted: DataFrame, erased: DataFrame) -> DataFrame:
    """(request_id, slots, erased): how many slots and claims each request took."""
    slots = deleted.groupBy("request_id").agg(F.count("*").alias("slots"))
    return slots.join(erased.groupBy("request_id").agg(F.count("*").alias("erased")), "request_id", "left").na.fill(0, ["erased"])


def blocked_sources(requests: DataFrame, erased: DataFrame) -> DataFrame:
    """(user_id, event_id) that may not come back: sources of requests and of what they
    erased."""
    asked = requests.select("user_id", F.explode("sources").alias("event_id"))
    return asked.unionByName(erased.select("user_id", F.col("seq").cast("string").alias("event_id"))).distinct()


def delete_turns(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Turns without those listed (user_id, event_id); another user's id is no hit."""
    return turns.join(ids.select("user_id", "event_id").distinct(), ["user_id", "event_id"], "left_anti").select(*turns.columns)


def turns_with_values(turns: DataFrame, erased: DataFrame) -> DataFrame:
    """(user_id, event_id) of turns that mention a value erased for their user."""
    phrases = erased.select("user_id", F.col("value").alias("phrase")).distinct()
    return phrase_pairs(turns, "event_id", "content", phrases, "user_id").select("user_id", "event_id").distinct()


def turns_with_slots(turns: DataFrame, deleted: DataFrame) -> DataFrame:
    """(user_id, event_id) of turns up to a request that name a slot it deleted."""
    near = turns.join(deleted.select("user_id", "slot", "requested_at"), "user_id").where("ts <= requested_at")
    return near.where(names_slot(F.col("content"), F.col("slot"))).select("user_id", "event_id").distinct()


def turns_with_entities(turns: DataFrame, requests: DataFrame, deleted: DataFrame, known: DataFrame) -> DataFrame:
    """(user_id, event_id) of untrusted turns up to a request that name an entity it
    touches: of a slot it deleted, or of one the user has and the description names."""
    entity = F.element_at(F.split("slot", "/"), 1).alias("entity")
    own = deleted.where("slot LIKE '%/%'").select("user_id", "requested_at", entity)
    said = requests.join(known.where("slot LIKE '%/%'").select("user_id", entity).distinct(), "user_id").where(names(F.col("description"), F.col("entity")))
    touched = own.unionByName(said.select("user_id", "requested_at", "entity")).groupBy("user_id", "entity").agg(F.max("requested_at").alias("requested_at"))
    near = turns.where(F.col("kind").isin(*UNTRUSTED)).join(touched, "user_id").where("ts <= requested_at")
    return near.where(names(F.col("content"), F.col("entity"))).select("user_id", "event_id").distinct()


def scrub_values(turns: DataFrame, erased: DataFrame) -> DataFrame:
    """Turns that mention no value (user_id, value) erased for their user."""
    return delete_turns(turns, turns_with_values(turns, erased))


def scrubbed(turns: DataFrame, requests: DataFrame, deleted: DataFrame, erased: DataFrame, known: DataFrame) -> DataFrame:
    """(user_id, event_id) that a combined store drops and blocks: sources, what they
    erased, and turns that give the same away."""
    found = blocked_sources(requests, erased)
    for more in (turns_with_values(turns, erased), turns_with_slots(turns, deleted), turns_with_entities(turns, requests, deleted, known)):
        found = found.unionByName(more)
    return found.distinct()


def by_provenance(memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Memories (memory_id, event_ids) whose provenance meets no source of a request,
    whatever the user."""
    hit = memories.select("memory_id", F.explode("event_ids").alias("event_id")).join(requests.select(F.explode("sources").alias("event_id")).distinct(), "event_id", "left_semi")
    return memories.join(hit.select("memory_id").distinct(), "memory_id", "left_anti")


def unsupported(requests: DataFrame, system: str) -> DataFrame:
    """What a run log records where a system can't delete."""
    return requests.select(F.lit("delete").alias("op"), F.col("requested_at").alias("at"), F.col("request_id").alias("ref"), F.lit(f"unsupported: {system} cannot delete").alias("error"))
