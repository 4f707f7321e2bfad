"""The valid-time fact history as running windows.

A claim stream has (seq, ts, user_id, slot, is_delete, label, value, trust).  Within
(user, slot, epoch), where epoch counts the deletes so far, the trust of the current
entry is the running maximum of trust, so each claim's outcome follows from windows
that share one exchange on (user_id, slot).  A claim that opens a slot finds the last
claim held before it: an equal one gives it its label and its event, any other becomes
a dispute, as does a held claim that another one displaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INTRODUCE_TRUST = 2
SLOTS = ["click", "view", "purchase", "signup"]
TRUST = [3, 3, 3, 2, 1, 1]


def claims_of_events(events: DataFrame) -> DataFrame:
    """Events as claims: the type is the slot, ``error`` a delete request."""
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("int")
    is_delete = F.col("event_type") == "error"
    slots, trust = F.array(*map(F.lit, SLOTS)), F.array(*map(F.lit, TRUST))
    return events.select(
        F.col("event_id").alias("seq"),
        "ts",
        "user_id",
        F.when(is_delete, F.get(slots, k % 4)).otherwise(F.col("event_type")).alias("slot"),
        is_delete.alias("is_delete"),
        F.when(~is_delete, F.concat("event_type", F.lit("@"), k.cast("string"))).alias("label"),
        F.when(~is_delete, F.concat(F.lit("v"), F.floor(k / 25).cast("string"))).alias("value"),
        F.get(trust, k % 6).alias("trust"),
    )


def epochs(claims: DataFrame) -> DataFrame:
    """Adds epoch: deletes of the slot up to the row; last: of the whole slot."""
    slot = W.partitionBy("user_id", "slot").orderBy("seq")
    hits = F.col("is_delete").cast("long")
    upto = slot.rowsBetween(W.unboundedPreceding, 0)
    whole = slot.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return claims.withColumns({"epoch": F.sum(hits).over(upto), "last_epoch": F.sum(hits).over(whole)})


def outcomes(claims: DataFrame, introduce_trust: int = INTRODUCE_TRUST) -> DataFrame:
    """Adds outcome: introduce, restate, supersede, dispute, hold or delete; and, where
    an introduction confirms a held claim, that claim's seq and label as ``confirmed``.
    Claims without a label are called by their slot."""
    if "label" not in claims.columns:
        claims = claims.withColumn("label", F.col("slot"))
    rows = epochs(claims)
    epoch = W.partitionBy("user_id", "slot", "epoch").orderBy("seq")
    before, upto = epoch.rowsBetween(W.unboundedPreceding, -1), epoch.rowsBetween(W.unboundedPreceding, 0)
    trust = F.when(~F.col("is_delete"), F.col("trust"))
    rows = rows.withColumns({"_had": F.coalesce(F.max(trust).over(before), F.lit(0)), "_has": F.max(trust).over(upto)})
    setter = ~F.col("is_delete") & (F.col("trust") == F.col("_has")) & (F.col("trust") >= introduce_trust)
    rows = rows.withColumn("_set", F.when(setter, F.col("value")))
    held = F.when(F.col("trust") < introduce_trust, F.when(~F.col("is_delete"), F.struct("seq", "label", "value")))
    rows = rows.withColumns({"_now": F.last("_set", ignorenulls=True).over(before), "_held": F.last(held, ignorenulls=True).over(before)})
    opened = F.col("_had") >= introduce_trust
    outcome = (
        F.when(F.col("is_delete"), "delete")
        .when(~opened, F.when(F.col("trust") >= introduce_trust, "introduce").otherwise("hold"))
        .when(F.col("value") == F.col("_now"), "restate")
        .when(setter, "supersede")
        .otherwise("dispute")
    )
    rows = rows.withColumn("outcome", outcome)
    confirms = (F.col("outcome") == "introduce") & (F.col("_held.value") == F.col("value"))
    return rows.withColumn("confirmed", F.when(confirms, F.struct("_held.seq", "_held.label"))).drop("_had", "_has", "_set", "_now", "_held")


def history(claims: DataFrame, introduce_trust: int = INTRODUCE_TRUST) -> DataFrame:
    """Entries: label, value, valid_from, valid_to, trust, sources, whether still live."""
    rows = outcomes(claims, introduce_trust).where("outcome IN ('introduce', 'supersede', 'restate')")
    epoch = W.partitionBy("user_id", "slot", "epoch").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.sum((F.col("outcome") != "restate").cast("long")).over(epoch))
    events = F.flatten(F.collect_list(F.filter(F.array("confirmed.seq", "seq"), lambda x: x.isNotNull())))
    entries = rows.groupBy("user_id", "slot", "epoch", "island").agg(
        F.min("seq").alias("seq"),
        F.min_by("ts", "seq").alias("valid_from"),
        F.min_by(F.coalesce("confirmed.label", "label"), "seq").alias("label"),
        F.min_by("value", "seq").alias("value"),
        F.max("trust").alias("trust"),
        F.array_sort(events).alias("_sources"),
        F.first(F.col("epoch") == F.col("last_epoch")).alias("live"),
    )
    following = W.partitionBy("user_id", "slot", "epoch").orderBy("island")
    sources = F.array_join(F.transform("_sources", lambda x: x.cast("string")), ",")
    entries = entries.withColumns({"valid_to": F.lead("valid_from").over(following), "n_sources": F.size("_sources").cast("long"), "sources": sources})
    return entries.select("seq", "user_id", "slot", "epoch", "label", "value", "trust", "n_sources", "sources", "valid_from", "valid_to", "live")


def held_claims(claims: DataFrame, introduce_trust: int = INTRODUCE_TRUST) -> DataFrame:
    """Every claim that was held, and what became of it: pending, confirmed by an equal
    trusted claim, or disputed, by another claim or because one displaced it."""
    rows = outcomes(claims, introduce_trust).where("outcome IN ('hold', 'introduce')")
    after = W.partitionBy("user_id", "slot", "epoch").orderBy("seq")
    rows = rows.withColumns({"_next": F.lead("outcome").over(after), "_value": F.lead("value").over(after)}).where("outcome = 'hold'")
    state = F.when(F.col("_next").isNull(), "pending").when((F.col("_next") == "introduce") & (F.col("_value") == F.col("value")), "confirmed").otherwise("disputed")
    return rows.select("seq", "ts", "user_id", "slot", "epoch", "label", "value", "trust", state.alias("state"), (F.col("epoch") == F.col("last_epoch")).alias("live"))


def disputes(claims: DataFrame, introduce_trust: int = INTRODUCE_TRUST) -> DataFrame:
    """The audit rows: claims below the current trust, and held claims that lost."""
    direct = outcomes(claims, introduce_trust).where("outcome = 'dispute'").withColumn("live", F.col("epoch") == F.col("last_epoch"))
    columns = ["seq", "user_id", "slot", "epoch", "value", "trust", "live"]
    return direct.select(*columns).unionByName(held_claims(claims, introduce_trust).where("state = 'disputed'").select(*columns))


def current(claims: DataFrame) -> DataFrame:
    return history(claims).where("live AND valid_to IS NULL").select("user_id", "slot", "value", "trust", "valid_from")


def write_report(claims: DataFrame) -> DataFrame:
    """Counters per user: added, updated, superseded, rejected."""
    o = F.col("outcome")
    return outcomes(claims).groupBy("user_id").agg(
        F.count_if(o.isin("introduce", "supersede")).alias("added"),
        F.count_if(o == "restate").alias("updated"),
        F.count_if(o == "supersede").alias("superseded"),
        F.count_if(o.isin("dispute", "hold")).alias("rejected"),
    )


def tombstones(claims: DataFrame) -> DataFrame:
    return claims.where("is_delete").groupBy("user_id", "slot").agg(F.count("*").alias("deletes"), F.max("ts").alias("deleted_at"))


def blocked_events(claims: DataFrame) -> DataFrame:
    """Events whose claims were erased by a later delete of their slot."""
    return epochs(claims).where("NOT is_delete AND epoch < last_epoch").select("user_id", F.col("seq").alias("event_id"))


def open_at(claims: DataFrame, bucket: Column, introduce_trust: int = INTRODUCE_TRUST) -> DataFrame:
    """(bucket, slot, open, trust): how many values each slot holds, and their trust in
    all, as a reader sees it after each bucket of the stream; ``bucket`` must not fall
    along a slot.

    What each row changes is summed by bucket, and the sums are cumulated, so a later
    bucket never repeats the rows of an earlier one.
    """
    rows = epochs(claims).withColumn("bucket", bucket)
    epoch = W.partitionBy("user_id", "slot", "epoch").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    best = F.coalesce(F.max(F.when(~F.col("is_delete"), F.col("trust"))).over(epoch), F.lit(0))
    rows = rows.withColumn("_trust", F.when(best >= introduce_trust, best).otherwise(0).cast("long"))
    along = W.partitionBy("user_id", "slot").orderBy("seq")
    was = F.coalesce(F.lag("_trust").over(along), F.lit(0))
    step = (F.col("_trust") > 0).cast("long") - (was > 0).cast("long")
    rows = rows.withColumns({"_step": step, "_more": F.col("_trust") - was})
    moved = rows.groupBy("slot", "bucket").agg(F.sum("_step").alias("_step"), F.sum("_more").alias("_more"))
    upto = W.partitionBy("slot").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = moved.select("slot", "bucket", F.sum("_step").over(upto).alias("open"), F.sum("_more").over(upto).alias("trust"))
    sums = sums.withColumn("_until", F.lead("bucket").over(W.partitionBy("slot").orderBy("bucket")) - 1)
    last = claims.select(bucket.alias("bucket")).agg(F.max("bucket")).scalar()
    return sums.withColumn("_until", F.coalesce("_until", last)).select(F.explode(F.sequence("bucket", "_until")).alias("bucket"), "slot", "open", "trust").where("open > 0")


def _asked(claims: DataFrame, queries: DataFrame, introduce_trust: int) -> DataFrame:
    """Queries (any columns, user_id, slot, asked_at) with what the stream had said of
    the slot by then: epoch, claims seen, the last seq, and whether one was held last."""
    q = queries.select("user_id", "slot", F.col("asked_at").alias("_t"), F.struct(*queries.columns).alias("_q"))
    c = outcomes(claims, introduce_trust).select("user_id", "slot", F.col("ts").alias("_t"), "seq", F.col("outcome").alias("_o"))
    rows = c.unionByName(q, allowMissingColumns=True)
    along = W.partitionBy("user_id", "slot").orderBy("_t", F.col("_q").isNotNull(), "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"_epoch": F.sum((F.coalesce("_o", F.lit("")) == "delete").cast("long")).over(along), "_seen": F.count("_o").over(along), "_top": F.max("seq").over(along)})
    epoch = W.partitionBy("user_id", "slot", "_epoch").orderBy("_t", F.col("_q").isNotNull(), "seq").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_o").isin("hold", "introduce"), F.col("_o")), ignorenulls=True).over(epoch)
    return rows.withColumn("_last", last).where("_q IS NOT NULL").select("_q.*", "_epoch", "_seen", "_top", "_last")


def lookup(claims: DataFrame, queries: DataFrame, introduce_trust: int = INTRODUCE_TRUST) -> DataFrame:
    """The entry that holds at ``as_of`` for each query (user_id, slot, asked_at, as_of),
    as the store knew it at ``asked_at``: later claims and deletes don't count.  Adds
    ``entry`` (seq, label, value, trust, sources, valid_from, valid_to; null: none) and
    ``reason``: answered, no known slot, deleted, unconfirmed or no value at date.

    Queries and entries are sorted together, so a hot slot costs a sort and not a
    product.
    """
    asked = _asked(claims, queries, introduce_trust)
    entries = history(claims, introduce_trust)
    sources = F.transform(F.split("sources", ","), lambda x: x.cast("bigint"))
    e = entries.select("user_id", "slot", F.col("epoch").alias("_epoch"), F.col("valid_from").alias("_t"), "seq", F.struct("seq", "label", "value", "trust", sources.alias("sources"), "valid_from", "valid_to").alias("_e"))
    q = asked.select("user_id", "slot", "_epoch", F.least("as_of", "asked_at").alias("_t"), F.struct(*asked.columns).alias("_q"))
    rows = e.unionByName(q, allowMissingColumns=True)
    along = W.partitionBy("user_id", "slot", "_epoch").orderBy("_t", F.col("_q").isNotNull(), "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_entry", F.last("_e", ignorenulls=True).over(along)).where("_q IS NOT NULL").select("_q.*", "_entry")
    known = F.when(F.col("_entry.valid_to") <= F.col("asked_at"), F.col("_entry.valid_to"))
    seen = F.filter("_entry.sources", lambda x: x <= F.col("_top"))
    entry = F.when(F.col("_entry").isNotNull(), F.struct("_entry.seq", "_entry.label", "_entry.value", "_entry.trust", seen.alias("sources"), "_entry.valid_from", known.alias("valid_to")))
    reason = (
        F.when(F.col("_entry").isNotNull(), "answered")
        .when(F.col("_seen") == 0, "no known slot")
        .when(F.col("_epoch") > 0, "deleted")
        .when(F.col("_last") == "hold", "unconfirmed")
        .otherwise("no value at date")
    )
    return rows.select(*queries.columns, entry.alias("entry"), reason.alias("reason"))


def as_of(claims: DataFrame, queries: DataFrame, introduce_trust: int = INTRODUCE_TRUST) -> DataFrame:
    """The value of ``lookup`` and when it holds."""
    return lookup(claims, queries, introduce_trust).select(*queries.columns, "entry.value", "entry.valid_from", "entry.valid_to")


def abstain_reasons(claims: DataFrame, queries: DataFrame, introduce_trust: int = INTRODUCE_TRUST) -> DataFrame:
    """Why a query has no answer when it is asked: deleted > unconfirmed > no value at
    the date; a slot that nothing has been said of is not known."""
    return lookup(claims, queries, introduce_trust).select(*queries.columns, "entry.value", "reason")
