"""The catalogue of named queries over the standard tables; oracles in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as X
from ..operators import deletes, evidence, extract, facts, metrics, replay, report, scoring, search, stream, validate
from ..sources.tables import table
from .oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def claims(spark, d):
    return facts.claims_of_events(table(spark, d, "events"))


def probes(spark, d):
    """One probe per user and slot at each quarter of the stream."""
    c = claims(spark, d)
    ends = c.agg(F.max("seq").alias("top"))
    who = c.select("user_id", "slot").distinct()
    quarters = F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("q")
    p = who.crossJoin(F.broadcast(ends)).select("*", quarters)  # ends is one row
    asked = F.floor(F.col("top") * F.col("q") / 4).cast("long")
    target = F.when((F.col("user_id") + F.col("q")) % 2 == 0, F.floor(asked / 2).cast("long")).otherwise(asked)
    return p.select(F.concat_ws("|", "user_id", "slot", "q").alias("probe_id"), "user_id", "slot", asked.alias("asked"), target.alias("target"))


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def ranked_turns(spark, d):
    t = stream.trace(table(spark, d, "conversations"))
    corpus = t.select(F.col("user_id").alias("scope"), F.col("event_id").alias("item_id"), F.col("content").alias("text"))
    asked = questions(spark, d).withColumn("scope", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))))  # all ten scopes
    return search.bm25(corpus, asked), corpus


@query
def trace_events(spark, d):
    return stream.trace(table(spark, d, "conversations")).select("event_id", "user_id", "session_id", "kind", F.octet_length("content").cast("long").alias("n_bytes"))


@query
def event_gate_dedupe(spark, d):
    """Every third event comes twice, the second time with another slot; every eleventh
    was deleted by its user, every thirteenth by somebody else."""
    rows = claims(spark, d).select(F.col("seq").alias("event_id"), "user_id", "slot", "seq")
    again = rows.unionByName(rows.where("event_id % 3 = 0").withColumns({"slot": F.lit("again"), "seq": F.col("seq") + 1_000_000_000}))
    gone = rows.where("event_id % 11 = 0").select("user_id", "event_id").unionByName(rows.where("event_id % 13 = 0").select((F.col("user_id") + 1).alias("user_id"), "event_id"))
    return stream.gate(again, gone).select("event_id", "user_id", "slot")


@query
def session_batches(spark, d):
    return stream.session_batches(stream.trace(table(spark, d, "conversations")))


@query
def split_batches(spark, d):
    ops = claims(spark, d).select(F.col("user_id").alias("session_id"), "seq", F.col("is_delete").alias("is_trigger"))
    return stream.split_batches(ops)


@query
def claim_outcomes(spark, d):
    return facts.outcomes(claims(spark, d)).select("seq", "user_id", "slot", "epoch", "outcome")


@query
def claim_outcomes_any_trust(spark, d):
    return facts.outcomes(claims(spark, d), introduce_trust=1).groupBy("slot", "outcome").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query
def fact_history(spark, d):
    return facts.history(claims(spark, d))


@query
def fact_current(spark, d):
    return facts.current(claims(spark, d))


@query
def write_report(spark, d):
    return facts.write_report(claims(spark, d))


@query
def fact_as_of(spark, d):
    """Every claim's slot at the claim's time, asked then and at the end of the stream."""
    c = claims(spark, d)
    asked = c.select("user_id", "slot", F.col("ts").alias("as_of"), F.explode(F.array("ts", c.agg(F.max("ts")).scalar())).alias("asked_at"))
    return facts.as_of(c, asked)


def _asked(c):
    """Each user's slots, and one that nobody has, at the quarters of their time."""
    span = c.groupBy("user_id", "slot").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    span = span.unionByName(c.groupBy("user_id").agg(F.lit("refund").alias("slot"), F.min("ts").alias("lo"), F.max("ts").alias("hi")))
    part = lambda q: F.timestamp_add("SECOND", F.floor(F.expr("timestampdiff(SECOND, lo, hi)") * F.lit(q) / 8).cast("int"), F.col("lo"))
    rows = F.array(*(F.struct(F.lit(q).alias("q"), part(2 * q).alias("asked_at"), part(q if q % 2 else 2 * q).alias("as_of")) for q in (1, 2, 3, 4)))
    return span.select("user_id", "slot", F.inline(rows))


@query
def abstain_reasons(spark, d):
    c = claims(spark, d)
    return facts.abstain_reasons(c, _asked(c)).select("user_id", "slot", "q", "value", "reason")


@query
def point_in_time_checkpoints(spark, d):
    """What is open after every 2500 rows of the stream."""
    c = claims(spark, d)
    whole = F.floor((c.agg(F.max("seq")).scalar() + 1) / 2500)
    seen = facts.open_at(c, F.floor(F.col("seq") / 2500)).where(F.col("bucket") < whole)
    return seen.select(F.concat(F.lit("c"), F.col("bucket").cast("string")).alias("checkpoint"), "slot", "open", "trust")


@query
def held_claims(spark, d):
    return facts.held_claims(claims(spark, d)).select("seq", "user_id", "slot", "label", "state", "live")


@query
def dispute_audit(spark, d):
    return facts.disputes(claims(spark, d))


@query
def delete_tombstones(spark, d):
    return facts.tombstones(claims(spark, d))


@query
def blocked_events(spark, d):
    return facts.blocked_events(claims(spark, d))


@query
def bm25_topk(spark, d):
    return ranked_turns(spark, d)[0]


@query
def bm25_stats(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("item_id"), "text")
    tf, scope = search.term_stats(docs)
    per = tf.groupBy("scope").agg(F.countDistinct("term").alias("terms"), F.sum("tf").alias("tokens"))
    return scope.join(per, "scope").select("scope", "n", "terms", "tokens", F.round("avg_len", 6).alias("avg_len"))


@query
def budget_prefix(spark, d):
    ranked, corpus = ranked_turns(spark, d)
    cost = corpus.select("scope", "item_id", X.token_count(F.col("text")).alias("tokens"))
    return search.within_budget(ranked.join(cost, ["scope", "item_id"]), 60).select("query_id", "scope", "rank", "item_id", "tokens", "used")


@query
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.vector_topk(v, asked).select("query_id", "rank", "vec_id", F.round("score", 4).alias("score"))


def _hybrid(spark, d):
    """(facts, turns, refused) of every question in every scope: a question asks for one
    slot of the scope's user, and is refused where that fact was deleted."""
    ranked, corpus = ranked_turns(spark, d)
    cost = corpus.select("scope", "item_id", X.token_count(F.col("text")).alias("tokens"))
    turns = ranked.join(cost, ["scope", "item_id"]).select("query_id", "scope", "rank", "item_id", "tokens")
    c = claims(spark, d)
    slot = F.get(F.array(*map(F.lit, facts.SLOTS)), (F.col("query_id") % 4).cast("int"))
    asked = questions(spark, d).select("query_id", slot.alias("slot"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("scope"))
    now = facts.current(c).select(F.col("user_id").alias("scope"), "slot", F.concat("slot", F.lit(": "), "value").alias("item_id"))
    known = asked.join(now, ["scope", "slot"]).select("query_id", "scope", F.lit(1).alias("rank"), "item_id", X.token_count(F.col("item_id")).alias("tokens"))
    gone = facts.tombstones(c).select(F.col("user_id").alias("scope"), "slot")
    refused = asked.join(gone, ["scope", "slot"]).join(known.select("query_id", "scope"), ["query_id", "scope"], "left_anti").select("query_id", "scope")
    return known, turns, refused


@query
def hybrid_fallback(spark, d):
    return search.fallback(*_hybrid(spark, d), budget=60)


@query
def hybrid_augment(spark, d):
    return search.augment(*_hybrid(spark, d), budget=60)


@query
def hybrid_scrub(spark, d):
    """Turns that survive once every turn of a user that mentions an erased value is
    dropped; the values are the first three words of each user's openings."""
    t = stream.trace(table(spark, d, "conversations"))
    erased = t.where("position = 0").select("user_id", F.array_join(F.slice(F.split("content", r"\s+"), 1, 3), " ").alias("value"))
    return deletes.scrub_values(t, erased).select("event_id", "user_id")


@query
def phrase_mentions(spark, d):
    """How many documents mention each part type's words."""
    phrase = table(spark, d, "part").select(F.lower(F.element_at(F.split("p_type", " "), 1)).alias("phrase")).unionByName(spark.createDataFrame([("the",), ("est",), ("und  der",), ("is a",)], "phrase string")).distinct()
    found = evidence.phrase_pairs(table(spark, d, "documents"), "doc_id", "text", phrase)
    return found.groupBy("phrase").agg(F.count("*").alias("docs"), F.sum("doc_id").alias("ids"))


@query
def entity_names(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(X.names(F.col("text"), F.lit("the"))).groupBy("lang").agg(F.count("*").alias("n"))


@query
def grounded_values(spark, d):
    value = F.element_at(F.split("text", r"\s+"), 1)
    return table(spark, d, "documents").select("doc_id", value.alias("value"), X.grounded(value, F.reverse("text")).alias("reversed"), X.grounded(value, F.col("text")).alias("grounded"))


@query
def slot_keys(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", X.slot_key(F.col("s_name"), F.lit(' Test "Command" x-y ')).alias("slot"))


@query
def named_slots(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.where(X.names_slot(F.col("text"), F.lit("the/an_th"))).groupBy("lang").agg(F.count("*").alias("n"))


@query
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query
def expected_answers(spark, d):
    m = scoring.mutations_of(facts.outcomes(claims(spark, d)))
    return scoring.expected(m, probes(spark, d))


@query
def explain_forbidden(spark, d):
    m = scoring.mutations_of(facts.outcomes(claims(spark, d)))
    return scoring.explain(m, probes(spark, d)).groupBy("reason", "value").agg(F.count("*").alias("probes"))


@query
def verdicts(spark, d):
    """Evidence is the value last claimed before a probe, whatever its trust."""
    m = scoring.mutations_of(facts.outcomes(claims(spark, d)))
    p = probes(spark, d)
    e = scoring.expected(m, p)
    said = p.join(m.where("value IS NOT NULL").select("user_id", "slot", "seq", "value"), ["user_id", "slot"]).where("seq <= asked").groupBy("probe_id").agg(F.max_by("value", "seq").alias("said"))
    rows = e.join(said, "probe_id", "left")
    hit = F.coalesce(F.col("said") == F.col("truth"), F.lit(False))
    bad = F.coalesce(F.array_contains(F.split("forbidden", ","), F.col("said")), F.lit(False))
    return rows.select(scoring.verdict(F.col("kind"), hit, bad, F.col("said").isNull()).alias("verdict"), "kind").groupBy("kind", "verdict").agg(F.count("*").alias("n"))


@query
def isolation_check(spark, d):
    """Values that a user holds and that others hold as well."""
    now = facts.current(claims(spark, d)).select("user_id", "value").distinct()
    owners = now.groupBy("value").agg(F.count("*").alias("owners"))
    return now.join(owners.where("owners > 1"), "value").groupBy("user_id").agg(F.count("*").alias("shared_values"))


@query
def accuracy_mean_sd(spark, d):
    return metrics.accuracy(metrics.run_log(table(spark, d, "events")))


@query
def median_latency(spark, d):
    return metrics.latency(metrics.run_log(table(spark, d, "events")))


@query
def per_checkpoint(spark, d):
    return metrics.per_checkpoint(metrics.run_log(table(spark, d, "events")))


@query
def verdict_pivot(spark, d):
    return metrics.verdict_pivot(metrics.run_log(table(spark, d, "events")))


@query
def noise_flips(spark, d):
    log = metrics.run_log(table(spark, d, "events")).withColumn("unit", F.floor(F.col("probe_id") / 3))
    return metrics.noise(log, "unit")


@query
def bootstrap_ci(spark, d):
    return metrics.bootstrap(_marked(spark, d).withColumn("quality", F.col("quality").cast("double")), "lang", "quality")


@query
def stratified_sample(spark, d):
    return metrics.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 10).select("lang", "doc_id", "pick")


@query
def cost_usd(spark, d):
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("long")
    models = ["gpt-4.1-mini-2025", "gpt-4o-2024-08-06", "gpt-4.1-2025-04-14", "unknown-model"]
    calls = table(spark, d, "events").select(F.col("event_id").alias("call_id"), F.get(F.array(*map(F.lit, models)), (F.col("event_id") % 4).cast("int")).alias("model"), (k * 100).alias("tokens_in"), k.alias("tokens_out"))
    return metrics.price_calls(calls)


@query
def store_stats(spark, d):
    return evidence.store_stats(claims(spark, d))


@query
def cache_hit_split(spark, d):
    req = table(spark, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))
    marked = metrics.cache_split(req, req.where("conv_id % 4 = 0"))
    return marked.groupBy("hit").agg(F.count("*").alias("requests"), F.countDistinct("digest").alias("distinct_requests"))


@query
def validate_duplicates(spark, d):
    return validate.duplicates(table(spark, d, "documents"), "text").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


@query
def validate_order(spark, d):
    """Events that are older than the one before them, once a user's odd events are
    entered in reverse."""
    at = F.when(F.col("event_id") % 2 == 1, -F.col("event_id")).otherwise(F.col("event_id"))
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", at.alias("entered"))
    return validate.out_of_order(rows, "user_id", "entered", "ts").select("user_id", "event_id", "ts")


@query
def validate_references(spark, d):
    return validate.unknown_references(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", table(spark, d, "labels"), "doc_id")


@query
def validate_sequence(spark, d):
    """A change log in which every seventh change is given the next kind's name."""
    m = scoring.mutations_of(facts.outcomes(claims(spark, d)))
    kinds = F.array(*map(F.lit, validate.KINDS))
    wrong = F.get(kinds, (F.array_position(kinds, F.col("kind")) % len(validate.KINDS)).cast("int"))
    m = m.withColumn("kind", F.when(F.col("seq") % 7 == 0, wrong).otherwise(F.col("kind")))
    return validate.illegal_sequence(m).select("user_id", "slot", "seq", "error")


@query
def rule_claims(spark, d):
    return extract.rule_claims(stream.trace(table(spark, d, "conversations"))).select("event_id", "slot", "value")


@query
def routed_slots(spark, d):
    return extract.routed_slots(table(spark, d, "documents"), "doc_id", "text")


@query
def fact_evidence(spark, d):
    source = F.when(F.col("trust") == 3, "user_message").when(F.col("trust") == 2, "document").otherwise("assistant_message")
    return facts.history(claims(spark, d)).where("live").select("user_id", "seq", evidence.fact_line("slot", source).alias("content"))


@query
def turn_evidence(spark, d):
    return table(spark, d, "events").select("event_id", evidence.turn_line("ts", "event_type", "props").alias("content"))


@query
def export_items(spark, d):
    return evidence.export_items(claims(spark, d))


@query
def memory_ids(spark, d):
    return evidence.memory_ids(claims(spark, d))


@query
def known_slots(spark, d):
    return evidence.known_slots(claims(spark, d))


@query
def missing_pairs(spark, d):
    return evidence.missing_pairs(claims(spark, d), [*facts.SLOTS, "refund"])


@query
def subphrase_values(spark, d):
    p = table(spark, d, "part")
    return evidence.subphrases(p.select(F.col("p_type").alias("value")).union(p.select("p_name")).union(p.select("p_brand")))


def _marked(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query
def paired_ci(spark, d):
    return report.paired_interval(_marked(spark, d), "lang", "quality", "toxic")


@query
def audit_agreement(spark, d):
    return report.agreement(_marked(spark, d), "lang", "quality", "toxic")


@query
def category_report(spark, d):
    return report.by_category(_marked(spark, d), "lang", "quality")


@query
def write_read_costs(spark, d):
    log = metrics.run_log(table(spark, d, "events"))
    phase = F.when(F.col("system").isin("click", "view"), "write").otherwise("read")
    return report.write_read(log.select("seed", phase.alias("phase"), (F.col("tokens") * 0.4 / 1e6).alias("usd")), "seed", "usd")


@query
def restart_identity(spark, d):
    log = metrics.run_log(table(spark, d, "events")).withColumn("unit", F.floor(F.col("probe_id") / 2))
    return report.identity(log.where("probe_id % 2 = 0"), log.where("probe_id % 2 = 1"), "unit", "verdict")


@query
def pilot_exclusion(spark, d):
    log = metrics.run_log(table(spark, d, "events"))
    return report.without(log, table(spark, d, "labels").select(F.col("doc_id").alias("probe_id")), "probe_id")


@query
def fraction_checkpoints(spark, d):
    return report.fraction_checkpoints(table(spark, d, "events"), [0.25, 0.5, 0.75, 1.0])


@query
def run_summary(spark, d):
    return report.run_summary(metrics.run_log(table(spark, d, "events")), budget=800)


@query
def system_table(spark, d):
    return report.system_table(metrics.run_log(table(spark, d, "events")))


@query
def heldout_table(spark, d):
    return report.system_table(metrics.run_log(table(spark, d, "events")), seeds=[3, 4]).select("system", "answer_pct", "answer_sd", "evidence_pct", "evidence_sd")


@query
def efficiency_table(spark, d):
    log = metrics.run_log(table(spark, d, "events"))
    stats = log.groupBy("system", "checkpoint").agg(F.sum("tokens").alias("bytes"))
    return report.efficiency(log, stats)


@query
def write_read_legacy(spark, d):
    log = metrics.run_log(table(spark, d, "events"))
    old = F.col("probe_id") % 3 == 0
    cost = F.col("tokens") / 1e6
    rows = log.select("system", F.when(~old, cost * 0.75).alias("write_usd"), F.when(~old, cost * 0.25).alias("read_usd"), F.when(old, cost).alias("total_usd"), F.lit(0.5).alias("read_share"))
    return report.write_read_legacy(rows, "system")


@query
def event_counters(spark, d):
    return report.counters(stream.trace(table(spark, d, "conversations")))


@query
def token_recount(spark, d):
    """What a cut at 60 tokens of all ranked turns keeps, recounted against 60 and 5."""
    ranked, corpus = ranked_turns(spark, d)
    cost = corpus.select("scope", "item_id", X.token_count(F.col("text")).alias("tokens"))
    rows = ranked.join(cost, ["scope", "item_id"])
    kept = search.within_budget(rows, 60).select("query_id", "scope", "rank", F.lit(True).alias("kept"))
    marked = rows.join(kept, ["query_id", "scope", "rank"], "left").na.fill(False, ["kept"])
    return report.recount(marked, 60, 5)


@query
def token_difference(spark, d):
    log = metrics.run_log(table(spark, d, "events")).withColumn("unit", F.floor(F.col("probe_id") / 2))
    return report.token_difference(log.where("probe_id % 2 = 0"), log.where("probe_id % 2 = 1"), "unit")


@query
def ingest_gate(spark, d):
    """Conversation turns against blocked turns, turns seen before and a least trust."""
    t = stream.trace(table(spark, d, "conversations")).withColumn("seq", F.col("session_id") * 100_000 + F.col("position"))
    again = t.unionByName(t.where("position % 5 = 1").withColumn("seq", F.col("seq") + 1_000_000_000_000))
    blocked = t.where("position % 7 = 2").select("user_id", "event_id").unionByName(t.where("position % 7 = 3").select((F.col("user_id") + 1).alias("user_id"), "event_id"))
    seen = t.where("session_id % 4 = 0").select("event_id")
    out = stream.ingest_gate(again, blocked, seen, replay.TRUST, least_trust=2)
    return out.groupBy("user_id", "action").agg(F.count("*").alias("events"))


@query
def user_history(spark, d):
    return search.history_of(stream.trace(table(spark, d, "conversations")))


@query
def erased_values(spark, d):
    """What each delete of a slot erases, by the request that did it."""
    c = claims(spark, d)
    asks = c.where("is_delete").select("user_id", "slot", F.col("ts").alias("requested_at"), F.col("seq").cast("string").alias("request_id"))
    return deletes.delete_report(asks, deletes.erased_claims(c, asks))


@query
def blocked_sources(spark, d):
    """Events that may not come back: what deletes erased, and an event that each cites."""
    c = claims(spark, d)
    asks = c.where("is_delete").select("user_id", "slot", F.col("ts").alias("requested_at"), F.col("seq").cast("string").alias("request_id"), F.array(F.concat(F.lit("x"), F.col("seq").cast("string"))).alias("sources"))
    return deletes.blocked_sources(asks, deletes.erased_claims(c, asks))


@query
def fact_retrieval(spark, d):
    """All slots of a user, asked together: evidence lines in order of the slots within
    a budget, and why there are none."""
    c = claims(spark, d)
    place = F.array_position(F.array(*map(F.lit, [*facts.SLOTS, "refund"])), F.col("slot"))
    found = facts.lookup(c, _asked(c)).withColumn("place", place)
    source = F.when(F.col("trust") == 3, "user_message").when(F.col("trust") == 2, "document").otherwise("assistant_message")
    lines = found.where("entry IS NOT NULL").select("user_id", "q", "place", "entry.*").withColumn("content", evidence.fact_line("label", source))
    lines = lines.select(F.col("user_id").alias("query_id"), F.col("q").alias("scope"), F.col("place").alias("rank"), "content", X.token_count(F.col("content")).alias("tokens"))
    kept = search.within_budget(lines, 50).groupBy("query_id", "scope").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.max_by("content", "rank").alias("last"))
    worst = F.when(F.max((F.col("reason") == "deleted").cast("int")) == 1, "deleted").when(F.max((F.col("reason") == "unconfirmed").cast("int")) == 1, "unconfirmed").otherwise("no value at date")
    why = found.groupBy(F.col("user_id").alias("query_id"), F.col("q").alias("scope")).agg(worst.alias("reason"))
    out = why.join(kept, ["query_id", "scope"], "left")
    return out.select("query_id", "scope", "items", "tokens", "last", F.when(F.col("items").isNull(), F.col("reason")).alias("reason"))


@query
def event_lines(spark, d):
    """Events as a model is shown them, their dates in words, and the address of each."""
    e = table(spark, d, "events").withColumn("line", prompts.event_line(F.col("event_id").cast("string"), F.col("ts"), F.col("event_type"), F.col("props")))
    asked = prompts.fill(F.lit("What did {user} do on {date}?"), {"user": F.concat(F.lit("u"), F.col("user_id").cast("string")), "date": prompts.long_date(F.col("ts"))})
    return e.select("event_id", "line", asked.alias("question"), prompts.digest(F.col("line")).alias("digest"))


@query
def service_slots(spark, d):
    """Suppliers as services: their short names, and slots of reply fields."""
    s = table(spark, d, "supplier").withColumn("svc", F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit("-service")))
    return s.select("s_suppkey", prompts.short_name(F.col("svc")).alias("short"), X.slot_key(F.col("svc"), F.lit("Deploy Branch")).alias("slot"), F.round(prompts.percent(F.col("s_suppkey") % 7, F.col("s_suppkey") % 5), 6).alias("pct"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
