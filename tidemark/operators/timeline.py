"""Consistency of timelines; every check gives (workload_id, error) rows.

Tables are the children of a timeline document (see ``sources.tables``), each with its
place in the document as ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import replay, validate

KEYS = {"events": "event_id", "facts": "fact_id", "mutations": "mutation_id", "checkpoints": "name", "probes": "probe_id"}
NAMES = {"events": "event", "facts": "fact", "mutations": "mutation", "checkpoints": "checkpoint", "probes": "probe"}
SETS = ("introduce", "update")
# What a type of probe presupposes of its facts.
REQUIRED = {"post_update": "update", "post_delete": "delete", "contamination": "contradict"}


def _say(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("error")


def duplicate_ids(tl: dict[str, DataFrame]) -> DataFrame:
    """Ids used twice, and slots that two facts share."""
    out = None
    for table, key in KEYS.items():
        found = validate.duplicates(tl[table], "workload_id", key).select("workload_id", _say(f"duplicate {NAMES[table]} id: ", F.col(key)))
        out = found if out is None else out.unionByName(found)
    slots = validate.duplicates(tl["facts"], "workload_id", "user_id", "entity", "attribute")
    return out.unionByName(slots.select("workload_id", _say("two facts share the slot ", F.concat_ws(", ", "user_id", "entity", "attribute"))))


def event_order(tl: dict[str, DataFrame]) -> DataFrame:
    late = validate.out_of_order(tl["events"], "workload_id", "seq", "timestamp")
    return late.select("workload_id", F.lit("events are not in chronological order").alias("error")).distinct()


def mutation_errors(tl: dict[str, DataFrame]) -> DataFrame:
    """Unknown facts and carriers; time, source and user that don't fit the carriers; and
    changes that can't follow the ones before."""
    m = tl["mutations"].select("workload_id", "seq", "mutation_id", "fact_id", "kind", "at", "value", "source", "carrier_event_ids")
    owners = tl["facts"].select("workload_id", "fact_id", F.col("user_id").alias("owner")).dropDuplicates(["workload_id", "fact_id"])
    m = m.join(owners, ["workload_id", "fact_id"], "left")
    events = tl["events"].select("workload_id", F.col("event_id").alias("carrier"), F.col("timestamp").alias("ts"), F.col("kind").alias("ekind"), F.col("user_id").alias("euser"), F.col("seq").alias("place"), F.lit(True).alias("known"))
    carried = m.select("workload_id", "mutation_id", F.posexplode("carrier_event_ids").alias("pos", "carrier")).join(events, ["workload_id", "carrier"], "left")
    owner = F.min_by(F.struct("ts", "ekind"), F.struct("ts", "pos"))
    carried = carried.groupBy("workload_id", "mutation_id").agg(F.count_if(F.col("known").isNull()).alias("lost"), owner.alias("first"), F.collect_set("euser").alias("users"))
    rows = m.join(carried, ["workload_id", "mutation_id"], "left")
    fact, whole = F.col("owner").isNotNull(), F.coalesce("lost", F.lit(0)) == 0
    source = replay.look(replay.SOURCE, F.col("first.ekind"))
    tag = F.col("mutation_id")
    checks = F.array(
        F.when(~fact, _say(tag, ": unknown fact ", F.col("fact_id"))),
        F.when(fact & ~whole, _say(tag, ": unknown carrier event")),
        F.when(fact & whole & (F.col("at") != F.col("first.ts")), _say(tag, ": 'at' must equal first carrier's timestamp")),
        F.when(fact & whole & (source != F.col("source")), _say(tag, ": source ", F.col("source"), " does not match carrier kind ", F.col("first.ekind"))),
        F.when(fact & whole & F.exists("users", lambda u: u != F.col("owner")), _say(tag, ": carrier belongs to another user")),
    )
    found = rows.select("workload_id", F.explode(F.filter(checks, lambda e: e.isNotNull())).alias("error"))
    ordered = m.where(fact).withColumn("order", F.struct("at", "seq"))
    wrong = validate.illegal_sequence(ordered, key=("workload_id", "fact_id"), order="order")
    return found.unionByName(wrong.select("workload_id", _say(F.col("fact_id"), "/", F.col("mutation_id"), ": ", F.col("error"))))


def checkpoint_errors(tl: dict[str, DataFrame]) -> DataFrame:
    back = validate.out_of_order(tl["checkpoints"].withColumn("_f", F.struct("fraction", "seq")), "workload_id", "_f", "at")
    back = back.select("workload_id", F.lit("checkpoint times must increase with fraction").alias("error")).distinct()
    first = tl["events"].groupBy("workload_id").agg(F.min_by("timestamp", "seq").alias("_start"))
    early = tl["checkpoints"].join(first, "workload_id").where("at < _start")
    return back.unionByName(early.select("workload_id", F.lit("a checkpoint precedes the first event").alias("error")).distinct())


def derived(tl: dict[str, DataFrame], probes: DataFrame) -> DataFrame:
    """Truth and forbidden values of probes (workload_id, probe_id, fact_id, asked_at,
    as_of) on one fact, from its changes."""
    m = tl["mutations"].select("workload_id", "fact_id", "kind", "value", "at", F.col("seq").alias("mseq"))
    key = ["workload_id", "probe_id"]
    seen = probes.join(m, ["workload_id", "fact_id"]).where("at <= asked_at")
    rest = W.partitionBy(*key).orderBy("at", "mseq").rowsBetween(0, W.unboundedFollowing)
    seen = seen.withColumn("_erased", F.max((F.col("kind") == "delete").cast("int")).over(rest) == 1)
    sets = ~F.col("_erased") & F.col("kind").isin(*SETS) & (F.col("at") <= F.coalesce("as_of", "asked_at"))
    bad = (F.col("_erased") | F.col("kind").isin(*SETS, "contradict")) & (F.col("value") != "")
    found = seen.groupBy(*key).agg(F.max_by(F.when(sets, F.col("value")), F.when(sets, F.struct("at", "mseq"))).alias("truth"), F.collect_set(F.when(bad, F.col("value"))).alias("_bad"))
    out = probes.select(*key).join(found, key, "left")
    rest = F.array_sort(F.filter(F.coalesce("_bad", F.array().cast("array<string>")), lambda v: ~v.eqNullSafe(F.col("truth"))))
    return out.select(*key, F.when(F.col("truth").isNull(), "abstain").otherwise("value").alias("kind"), "truth", rest.alias("forbidden"))


def probe_errors(tl: dict[str, DataFrame]) -> DataFrame:
    """References, users and dates of probes, what their type demands, and the answer of
    those on one fact recomputed."""
    cp = tl["checkpoints"].select("workload_id", F.col("name").alias("checkpoint"), F.col("at").alias("asked_at"))
    p = tl["probes"].join(cp, ["workload_id", "checkpoint"], "left")
    key = ["workload_id", "probe_id"]
    owners = tl["facts"].select("workload_id", "fact_id", F.col("user_id").alias("owner")).dropDuplicates(["workload_id", "fact_id"])
    facts = p.select(*key, "asked_at", "probe_type", F.posexplode("fact_ids").alias("pos", "fact_id")).join(owners, ["workload_id", "fact_id"], "left")
    need = replay.look(REQUIRED, F.col("probe_type"))
    m = tl["mutations"].select("workload_id", "fact_id", F.col("kind").alias("mkind"), F.col("at").alias("mat"))
    met = facts.join(m, ["workload_id", "fact_id"]).where((F.col("mkind") == need) & (F.col("mat") <= F.col("asked_at"))).select(*key).distinct().withColumn("_met", F.lit(True))
    of = facts.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("owner").isNull(), F.struct("pos", "fact_id")))).alias("_lost"), F.collect_set("owner").alias("_owners"))
    one = p.where(F.size("fact_ids") == 1).select(*key, F.col("fact_ids")[0].alias("fact_id"), "asked_at", "as_of").where("asked_at IS NOT NULL")
    answer = derived(tl, one).select(*key, F.struct("kind", "truth", "forbidden").alias("_d"))
    rows = p.join(of, key, "left").join(met, key, "left").join(answer, key, "left")
    tag = F.concat(F.lit("probe "), F.col("probe_id"))
    known = F.col("asked_at").isNotNull()
    lost = F.coalesce(F.size("_lost") > 0, F.lit(False))
    fine = known & ~lost
    t, kind, n = F.col("probe_type"), F.col("expected.kind"), F.size("fact_ids")
    shown = lambda v: F.coalesce(F.concat(F.lit("'"), v, F.lit("'")), F.lit("None"))
    missing = F.array_except("_d.forbidden", "expected.forbidden")
    checks = F.array(
        F.when(~known, _say(tag, ": unknown checkpoint ", F.col("checkpoint"))),
        F.when(known & lost, _say(tag, ": unknown facts ", F.concat_ws(", ", F.transform("_lost", lambda x: x["fact_id"])))),
        F.when(fine & F.exists("_owners", lambda u: u != F.col("user_id")), _say(tag, ": refers to another user's fact")),
        F.when(fine & (F.col("as_of") > F.col("asked_at")), _say(tag, ": as_of is after the checkpoint")),
        F.when(fine & (t == "historical") & F.col("as_of").isNull(), _say(tag, ": HISTORICAL probe needs as_of")),
        F.when(fine & t.isin("post_delete", "abstention") & (kind != "abstain"), _say(tag, ": ", t, " probe must expect abstention")),
        F.when(fine & (n == 0) & (t != "abstention"), _say(tag, ": only ABSTENTION probes may have no facts")),
        F.when(fine & (t == "multi_fact") & (n < 2), _say(tag, ": MULTI_FACT probe needs two or more facts")),
        F.when(fine & need.isNotNull() & F.col("_met").isNull(), _say(tag, ": ", t, " probe but no ", need, " before checkpoint")),
        F.when(fine & (n == 1) & ((F.col("_d.kind") != kind) | ~F.col("_d.truth").eqNullSafe(F.col("expected.value"))), _say(tag, ": expects ", kind, "=", shown(F.col("expected.value")), " but ground truth is ", F.col("_d.kind"), "=", shown(F.col("_d.truth")))),
        F.when(fine & (n == 1) & (F.size(missing) > 0), _say(tag, ": forbidden list omits ", F.concat_ws(", ", F.array_sort(missing)))),
    )
    return rows.select("workload_id", F.explode(F.filter(checks, lambda e: e.isNotNull())).alias("error"))


def field_errors(tl: dict[str, DataFrame]) -> DataFrame:
    """Rows whose fields contradict each other by themselves."""
    m, c, p = tl["mutations"], tl["checkpoints"], tl["probes"]
    valued = F.col("value").isNotNull() & (F.col("value") != "")
    changes = F.array(
        F.when((F.col("kind") == "delete") & F.col("value").isNotNull(), _say(F.col("mutation_id"), ": DELETE must not carry a value")),
        F.when((F.col("kind") != "delete") & ~F.coalesce(valued, F.lit(False)), _say(F.col("mutation_id"), ": a value is needed")),
        F.when(F.size("carrier_event_ids") < 1, _say(F.col("mutation_id"), ": at least one carrier is needed")),
    )
    answers = F.array(
        F.when((F.col("expected.kind") == "value") & F.col("expected.value").isNull(), _say("probe ", F.col("probe_id"), ": a value is expected but none is given")),
        F.when((F.col("expected.kind") == "abstain") & F.col("expected.value").isNotNull(), _say("probe ", F.col("probe_id"), ": abstention has no value")),
        F.when(F.array_contains("expected.forbidden", F.col("expected.value")), _say("probe ", F.col("probe_id"), ": the expected value is forbidden")),
    )
    explode = lambda e: F.explode(F.filter(e, lambda x: x.isNotNull())).alias("error")
    fractions = c.where("fraction <= 0 OR fraction > 1").select("workload_id", _say("checkpoint ", F.col("name"), ": fraction must be in (0, 1]"))
    return m.select("workload_id", explode(changes)).unionByName(fractions).unionByName(p.select("workload_id", explode(answers)))


def consistency_errors(tl: dict[str, DataFrame]) -> DataFrame:
    """Everything that is wrong with each timeline."""
    out = field_errors(tl)
    for check in (duplicate_ids, event_order, mutation_errors, checkpoint_errors, probe_errors):
        out = out.unionByName(check(tl))
    return out


def uncarried_values(tl: dict[str, DataFrame]) -> DataFrame:
    """(workload_id, event_id, value): events that mention a value of their user without
    being a carrier of a change to it."""
    from .evidence import phrase_pairs

    m = tl["mutations"].where("value IS NOT NULL").join(tl["facts"].select("workload_id", "fact_id", "user_id"), ["workload_id", "fact_id"])
    values = m.select("workload_id", "user_id", F.col("value").alias("phrase")).distinct()
    said = phrase_pairs(tl["events"], "event_id", "content", values, "workload_id", "user_id")
    carried = m.select("workload_id", F.explode("carrier_event_ids").alias("event_id"), F.col("value").alias("phrase")).distinct()
    return said.join(carried, ["workload_id", "event_id", "phrase"], "left_anti").select("workload_id", "event_id", F.col("phrase").alias("value"))


def telling_questions(tl: dict[str, DataFrame]) -> DataFrame:
    """(workload_id, probe_id, value): questions that mention a value of their facts."""
    from .evidence import phrase_pairs

    asked = tl["probes"].select("workload_id", "probe_id", "question", F.explode("fact_ids").alias("fact_id"))
    values = tl["mutations"].where("value IS NOT NULL").select("workload_id", "fact_id", F.col("value").alias("phrase"))
    return phrase_pairs(asked, "probe_id", "question", values, "workload_id", "fact_id").select("workload_id", "probe_id", F.col("phrase").alias("value")).distinct()
