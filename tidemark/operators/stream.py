"""Event traces: adapters, gates and session batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = {"user": "user_message", "assistant": "assistant_message", "system": "document"}


def trace(conversations: DataFrame, users: int = 10) -> DataFrame:
    """Conversation turns as events; the stream order is (conversation, turn)."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("role"))
    return conversations.select(
        F.concat_ws("#", "conv_id", "turn").alias("event_id"),
        (F.col("conv_id") % users).alias("user_id"),
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("position"),
        kind.alias("kind"),
        F.col("text").alias("content"),
    )


def gate(events: DataFrame, deleted: DataFrame, key: str = "event_id", *, order: str = "seq", user: str = "user_id") -> DataFrame:
    """Each id once, the first by ``order``, and none that its user had deleted."""
    rows = events.select(key, F.col(order).alias("_order"), F.struct(*events.columns).alias("_row"))
    first = rows.groupBy(key).agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
    return first.join(deleted.select(user, key).distinct(), [user, key], "left_anti").select(*events.columns)


def session_batches(events: DataFrame) -> DataFrame:
    """One row per session, as it is ingested after its last event."""
    return events.groupBy("user_id", "session_id").agg(F.count("*").alias("n_events"), F.max("position").alias("last_position"), F.sum(F.octet_length("content").cast("long")).alias("n_bytes"))


def ingest_gate(events: DataFrame, blocked: DataFrame, seen: DataFrame, kinds: dict[str, int], least_trust: int | None = None) -> DataFrame:
    """Adds ``action``: rejected (its user blocked it), known (any user's event has this
    id, or an earlier row), skipped (a source below ``least_trust``) or extract."""
    trust = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("kind"))
    rows = events.join(blocked.select("user_id", "event_id").distinct().withColumn("_blocked", F.lit(True)), ["user_id", "event_id"], "left")
    rows = rows.join(seen.select("event_id").distinct().withColumn("_seen", F.lit(True)), "event_id", "left")
    again = F.row_number().over(W.partitionBy("event_id", F.col("_blocked").isNotNull()).orderBy("seq")) > 1
    low = F.lit(False) if least_trust is None else trust < least_trust
    action = F.when(F.col("_blocked").isNotNull(), "rejected").when(F.col("_seen").isNotNull() | again, "known").when(low, "skipped").otherwise("extract")
    return rows.withColumn("action", action).drop("_blocked", "_seen")


def op_log(events: DataFrame, deletes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The operations of a replay in order: (pos, phase, op, ref, at, event_ids).

    events: seq, event_id, user_id, session_id, ts; deletes: request_id, trigger (an
    event id), requested_at, sources; checkpoints: name, at.  A session's events are
    taken in after its last one, or before a delete or a checkpoint that comes in
    between; a checkpoint comes before the first event later than it.  Batches that one
    delete or checkpoint flushes follow in order of their first events.
    """
    last = events.groupBy("user_id", "session_id").agg(F.max("seq").alias("_last"))
    ends = events.agg(F.max("seq").alias("_top"))
    # where each delete and checkpoint cuts the stream: after event ``cut``
    d = deletes.join(events.select(F.col("event_id").alias("trigger"), F.col("seq").alias("cut")), "trigger").select("cut", F.lit(1).alias("phase"), F.lit("delete").alias("op"), F.col("request_id").alias("ref"), F.col("requested_at").alias("at"), F.col("sources").alias("event_ids"))
    later = checkpoints.select("name", "at").join(events.select("ts", "seq"), F.col("ts") > F.col("at"), "left").groupBy("name", "at").agg(F.min("seq").alias("_next"))
    c = later.withColumn("cut", F.coalesce(F.col("_next") - 1, ends.scalar())).select("cut", F.lit(2).alias("phase"), F.lit("ask").alias("op"), F.col("name").alias("ref"), "at", F.array().cast("array<string>").alias("event_ids"))
    cuts = F.broadcast(d.select("cut").unionByName(c.select("cut")).distinct())  # a row per delete or checkpoint
    placed = events.join(last, ["user_id", "session_id"]).join(cuts, F.col("cut") >= F.col("seq"), "left")
    placed = placed.groupBy("seq", "event_id", "user_id", "session_id", "ts", "_last").agg(F.min("cut").alias("_cut")).withColumn("pos", F.least(F.coalesce("_cut", "_last"), "_last"))
    batches = placed.groupBy("pos", "user_id", "session_id").agg(F.max_by("ts", "seq").alias("at"), F.min("seq").alias("_first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "event_id"))), lambda x: x["event_id"]).alias("event_ids"))
    batches = batches.select("pos", F.lit(0).alias("phase"), F.lit("ingest").alias("op"), F.col("session_id").cast("string").alias("ref"), "at", "event_ids", "_first")
    others = d.unionByName(c).withColumnRenamed("cut", "pos").withColumn("_first", F.lit(None).cast("bigint"))
    rows = batches.unionByName(others)
    order = W.partitionBy("pos").orderBy("phase", "_first", "at", "ref")
    return rows.withColumn("no", F.row_number().over(order)).select("pos", "no", "op", "ref", "at", "event_ids")


def split_batches(ops: DataFrame) -> DataFrame:
    """Batches of a session split by the triggers that fall inside it: rows carry
    session_id, seq and is_trigger."""
    upto = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = ops.withColumn("part", F.sum(F.col("is_trigger").cast("long")).over(upto)).where("NOT is_trigger")
    return rows.groupBy("session_id", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
