"""Replay of timelines: every probe's evidence from each system, and its score.

All tables carry workload_id; the order of events is ``seq``.  A probe sees the events
up to its checkpoint's time, and the deletes delivered by then.  Evidence rows are
(workload_id, probe_id, rank, content, memory_id, source_event_ids, score); what a
system says of a probe itself is (workload_id, probe_id, abstained, abstain_reason).

Tables that several steps read (claims, requests, turns seen, evidence) are cut off from
how they were made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import mentions, token_count
from ..plans.lineage import cut
from . import deletes, extract, facts, scoring, search
from .evidence import fact_line, turn_line

# Trust and source of each kind of event.
TRUST = {"user_message": 3, "tool_result": 3, "code_change": 3, "document": 2, "assistant_message": 1, "tool_call": 1}
SOURCE = {"user_message": "user", "tool_call": "model", "assistant_message": "model", "tool_result": "tool", "code_change": "tool", "document": "document"}
REASONS = {"deleted": "deleted at the user's request", "unconfirmed": "only an unconfirmed claim from a less trusted source", "no known slot": "no known slot matches"}
STEP = 16
SEP = "\x1f"
EVIDENCE = ["workload_id", "probe_id", "rank", "content", "memory_id", "source_event_ids", "score"]


def look(mapping: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)), key)


def asked(tl: dict[str, DataFrame]) -> DataFrame:
    """Probes with the time they are asked at."""
    cp = tl["checkpoints"].select("workload_id", F.col("name").alias("checkpoint"), F.col("at").alias("asked_at"))
    return tl["probes"].join(cp, ["workload_id", "checkpoint"])


def who(user: str | Column = "user_id") -> Column:
    """A user within a workload."""
    return F.concat_ws(SEP, "workload_id", user)


def requests(tl: dict[str, DataFrame], with_sources: bool = True) -> DataFrame:
    """Delete requests, from a table of their own (workload_id, request_id, user_id,
    requested_at, description, sources, trigger) or from the changes that ask for them."""
    key = lambda c: F.concat_ws(SEP, "workload_id", c)
    if "requests" in tl:
        sources = F.transform("sources", lambda x: F.concat_ws(SEP, "workload_id", x)) if with_sources else F.array().cast("array<string>")
        return tl["requests"].select(key("request_id").alias("request_id"), who().alias("user_id"), "requested_at", "description", sources.alias("sources"), key("trigger").alias("trigger"))
    events = tl["events"].select(key("event_id").alias("event_id"), "seq", "content")
    changes = tl["mutations"].withColumns({"mutation_id": key("mutation_id"), "fact_id": key("fact_id"), "carrier_event_ids": F.transform("carrier_event_ids", lambda x: F.concat_ws(SEP, "workload_id", x))})
    owners = tl["facts"].select(key("fact_id").alias("fact_id"), who().alias("user_id"))
    return deletes.requests_of(changes, owners, events, with_sources)


def claim_stream(tl: dict[str, DataFrame], with_sources: bool = True, least_trust: int | None = None) -> DataFrame:
    """Claims by rules and the deletes of slots, in one order; ``seq`` is the event's
    times STEP plus the rule's, ``user_id`` is of the workload."""
    events = tl["events"].withColumns({"trust": look(TRUST, F.col("kind")), "event_key": F.concat_ws(SEP, "workload_id", "event_id")})
    if least_trust is not None:
        events = events.where(F.col("trust") >= least_trust)
    said = extract.rule_claims(events.select(F.col("event_key").alias("event_id"), "content"))
    said = said.join(events.select(F.col("event_key").alias("event_id"), F.col("seq").alias("place"), who().alias("user_id"), F.col("timestamp").alias("ts"), "trust"), "event_id")
    said = said.select((F.col("place") * STEP + F.col("rule_no")).alias("seq"), "ts", "user_id", "slot", F.lit(False).alias("is_delete"), "label", "value", "trust", "event_id")
    asks = requests(tl, with_sources)
    spots = events.select(F.col("event_key").alias("trigger"), (F.col("seq") * STEP + STEP - 1).alias("_at"))
    cited = asks.withColumn("event_id", F.explode("sources")).join(said.select("event_id", F.col("seq").cast("string").alias("_s")), "event_id").groupBy("request_id").agg(F.collect_set("_s").alias("_sources"))
    asks = asks.join(cited, "request_id", "left").withColumn("sources", F.coalesce("_sources", F.array().cast("array<string>"))).drop("_sources")
    gone = deletes.deleted_slots(said, asks, deletes.routed(asks, said))
    gone = gone.join(asks.join(spots, "trigger").select("request_id", "_at"), "request_id")
    marks = gone.select(F.col("_at").alias("seq"), F.col("requested_at").alias("ts"), "user_id", "slot", F.lit(True).alias("is_delete"))
    return said.unionByName(marks, allowMissingColumns=True)


def routes(probes: DataFrame) -> DataFrame:
    """(workload_id, probe_id, place, slot): the slots whose cue a question holds."""
    cues = F.filter(F.array(*(F.when(F.rlike("question", F.lit(f"(?iU){cue}")), F.lit(slot)) for slot, _, _, cue in extract.RULES)), lambda s: s.isNotNull())
    return probes.select("*", F.posexplode(cues).alias("place", "slot"))


def store_evidence(tl: dict[str, DataFrame], budget: int | None = 2000, with_sources: bool = True, least_trust: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(evidence, said) of the fact store: the entry of each slot a question is routed
    to, in order of the rules and up to the token budget, or why there is none."""
    claims = cut(claim_stream(tl, with_sources, least_trust))
    probes = asked(tl)
    q = routes(probes).select("workload_id", "probe_id", "place", who().alias("user_id"), "slot", "asked_at", F.coalesce("as_of", "asked_at").alias("as_of"))
    found = cut(facts.lookup(claims, q))
    source = claims.where("NOT is_delete").select("seq", "event_id", "user_id")
    ids = found.where("entry IS NOT NULL").select("workload_id", "probe_id", "place", "user_id", F.explode("entry.sources").alias("seq")).join(source, ["user_id", "seq"])
    ids = ids.groupBy("workload_id", "probe_id", "place").agg(F.array_sort(F.collect_set(F.struct("seq", F.element_at(F.split("event_id", SEP), -1).alias("id")))).alias("ids"))
    numbers = _memory_ids(claims)
    kinds = claims.where("NOT is_delete").select("user_id", F.col("seq").alias("_seq"), F.element_at(F.split("event_id", SEP), -1).alias("event_id"), F.split("user_id", SEP)[0].alias("workload_id")).join(tl["events"].select("workload_id", "event_id", F.col("kind").alias("_kind")), ["workload_id", "event_id"]).select("user_id", "_seq", "_kind")
    rows = found.where("entry IS NOT NULL").select("workload_id", "probe_id", "place", "user_id", F.col("entry.seq").alias("_seq"), "entry.*").drop("seq", "sources")
    rows = rows.join(kinds, ["user_id", "_seq"]).join(numbers, ["user_id", "_seq"]).join(ids, ["workload_id", "probe_id", "place"])
    rows = rows.withColumn("content", fact_line("label", F.col("_kind"))).withColumn("tokens", token_count(F.col("content")))
    rank = F.row_number().over(W.partitionBy("workload_id", "probe_id").orderBy("place"))
    rows = rows.withColumns({"rank": rank, "source_event_ids": F.transform("ids", lambda x: x["id"]), "score": F.lit(None).cast("double")})
    evidence = cut(fitted(rows, budget))
    worst = F.array_min(F.collect_list(F.when(F.col("reason") == "deleted", 0).when(F.col("reason") == "unconfirmed", 1).when(F.col("reason") == "no value at date", 2).otherwise(3)))
    why = found.groupBy("workload_id", "probe_id").agg(worst.alias("_w"), F.min("as_of").alias("_d"))
    said = probes.select("workload_id", "probe_id").join(why, ["workload_id", "probe_id"], "left").join(evidence.select("workload_id", "probe_id").distinct().withColumn("_has", F.lit(True)), ["workload_id", "probe_id"], "left")
    reason = F.when(F.col("_w").isNull(), REASONS["no known slot"]).when(F.col("_w") == 0, REASONS["deleted"]).when(F.col("_w") == 1, REASONS["unconfirmed"]).otherwise(F.concat(F.lit("no value held at "), F.date_format("_d", "yyyy-MM-dd")))
    return evidence, said.select("workload_id", "probe_id", F.col("_has").isNull().alias("abstained"), F.when(F.col("_has").isNull(), reason).alias("abstain_reason"))


def _memory_ids(claims: DataFrame) -> DataFrame:
    """(user_id, _seq, memory_id): ids count the claims of a workload that made a row."""
    made = facts.outcomes(claims).where("outcome NOT IN ('restate', 'delete')").select("user_id", F.col("seq").alias("_seq"), F.split("user_id", SEP)[0].alias("_w"))
    no = F.row_number().over(W.partitionBy("_w").orderBy("_seq")).cast("string")
    return made.select("user_id", "_seq", F.concat(F.lit("L"), F.lpad(no, F.greatest(F.lit(6), F.length(no)), F.lit("0"))).alias("memory_id"))


def fitted(rows: DataFrame, budget: int | None) -> DataFrame:
    """Evidence up to the first row that the budget has no room for; no budget, all."""
    if budget is not None:
        upto = W.partitionBy("workload_id", "probe_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("_used", F.sum("tokens").over(upto)).where(F.col("_used") <= budget)
    return rows.select(*EVIDENCE)


def turns_seen(tl: dict[str, DataFrame], with_sources: bool = True) -> DataFrame:
    """(workload_id, probe_id, turn columns): the turns of its user that a probe can see,
    without those that a delete request delivered by then has listed."""
    probes = asked(tl).select("workload_id", "probe_id", "user_id", "asked_at")
    events = tl["events"].select("workload_id", "user_id", "event_id", "seq", "timestamp", "kind", "content")
    seen = probes.join(events, ["workload_id", "user_id"]).where("timestamp <= asked_at")
    gone = requests(tl, with_sources).select(F.explode("sources").alias("_e"), "requested_at", "user_id")
    gone = gone.select(F.split("_e", SEP)[0].alias("workload_id"), F.element_at(F.split("_e", SEP), -1).alias("event_id"), F.element_at(F.split("user_id", SEP), -1).alias("user_id"), "requested_at")
    gone = gone.groupBy("workload_id", "event_id", "user_id").agg(F.min("requested_at").alias("_gone"))
    return seen.join(gone, ["workload_id", "event_id", "user_id"], "left").where("_gone IS NULL OR _gone > asked_at").drop("_gone")


def _as_evidence(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("content", turn_line("timestamp", "kind", "content")).withColumn("tokens", token_count(F.col("content")))
    return rows.withColumns({"memory_id": F.col("event_id"), "source_event_ids": F.array("event_id")})


def bm25_evidence(tl: dict[str, DataFrame], budget: int | None = 2000, with_sources: bool = True, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(evidence, said) of ranked turns; it never abstains.  A corpus is what one probe
    sees, so equal checkpoints of a user are one scope."""
    rows = _ranked(tl, cut(turns_seen(tl, with_sources)), top_k)
    return fitted(_as_evidence(rows), budget), silent(tl)


def _ranked(tl: dict[str, DataFrame], seen: DataFrame, top_k: int) -> DataFrame:
    """The turns seen that rank best for each probe, with rank and score."""
    scope = lambda: F.concat_ws("|", "workload_id", "user_id", F.col("asked_at").cast("string")).alias("scope")
    corpus = seen.select(scope(), F.format_string("%012d", "seq").alias("item_id"), F.col("content").alias("text")).distinct()
    queries = asked(tl).select(F.concat_ws("|", "workload_id", "probe_id").alias("query_id"), scope(), F.col("question").alias("text"))
    best = search.bm25(corpus, queries, top_k=top_k)
    best = best.select(F.split("query_id", r"\|")[0].alias("workload_id"), F.split("query_id", r"\|")[1].alias("probe_id"), "rank", F.col("item_id").cast("bigint").alias("seq"), "score")
    return best.join(seen, ["workload_id", "probe_id", "seq"])


def full_replay(tl: dict[str, DataFrame], with_sources: bool = True) -> tuple[DataFrame, DataFrame]:
    """(evidence, said): all turns that a probe sees, in their order, without a budget."""
    rank = F.row_number().over(W.partitionBy("workload_id", "probe_id").orderBy("timestamp", "seq"))
    rows = turns_seen(tl, with_sources).withColumns({"rank": rank, "score": F.lit(None).cast("double")})
    return _as_evidence(rows).select(*EVIDENCE), silent(tl)


def no_memory(tl: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    said = silent(tl)
    return full_replay(tl)[0].where("false"), said


def silent(tl: dict[str, DataFrame]) -> DataFrame:
    return tl["probes"].select("workload_id", "probe_id", F.lit(False).alias("abstained"), F.lit(None).cast("string").alias("abstain_reason"))


def reasons(tl: dict[str, DataFrame]) -> DataFrame:
    """(workload_id, probe_id, value, reason): why each value would be wrong."""
    changes = tl["mutations"].select("workload_id", "fact_id", "kind", "value", "at", "seq")
    probes = asked(tl).select("workload_id", "probe_id", "asked_at", F.coalesce("as_of", "asked_at").alias("target"), F.explode("fact_ids").alias("fact_id"))
    seen = probes.join(changes, ["workload_id", "fact_id"]).where("at <= asked_at")
    along = W.partitionBy("workload_id", "probe_id", "fact_id").orderBy("at", "seq").rowsBetween(0, W.unboundedFollowing)
    seen = seen.withColumn("_erased", F.max((F.col("kind") == "delete").cast("int")).over(along) == 1).where("value IS NOT NULL")
    why = F.when(F.col("_erased"), "resurrected").when(F.col("kind") == "contradict", "contaminated").when(F.col("kind").isin("introduce", "update"), F.when(F.col("at") > F.col("target"), "future").otherwise("stale"))
    return seen.select("workload_id", "probe_id", "value", why.alias("reason")).where("reason IS NOT NULL").distinct()


def aliases(tl: dict[str, DataFrame]) -> DataFrame:
    """(workload_id, value, form, place): surface forms of values, those of all probes."""
    rows = tl["probes"].where("expected.value IS NOT NULL").select("workload_id", F.col("expected.value").alias("value"), "seq", F.posexplode("expected.aliases").alias("k", "form"))
    return rows.groupBy("workload_id", "value", "form").agg(F.min(F.struct("seq", "k")).alias("place"))


def foreign(tl: dict[str, DataFrame]) -> DataFrame:
    """(workload_id, user_id, value): values that other users' facts have had, and no
    fact of the user."""
    owned = tl["mutations"].where("value IS NOT NULL AND value <> ''").join(tl["facts"].select("workload_id", "fact_id", "user_id"), ["workload_id", "fact_id"]).select("workload_id", "user_id", "value").distinct()
    users = tl["facts"].select("workload_id", "user_id").unionByName(tl["probes"].select("workload_id", "user_id")).distinct()
    every = owned.select("workload_id", "value", F.col("user_id").alias("_owner"))
    other = users.join(every, "workload_id").where("user_id <> _owner").select("workload_id", "user_id", "value").distinct()
    return other.join(owned, ["workload_id", "user_id", "value"], "left_anti")


def score(tl: dict[str, DataFrame], evidence: DataFrame, said: DataFrame) -> DataFrame:
    """A row per probe: verdict, matched form, forbidden hits (value, error types, cited
    ids), foreign values, and whether it abstained."""
    key = ["workload_id", "probe_id"]
    probes = tl["probes"].select(*key, "user_id", "expected")
    names = aliases(tl)
    own = probes.where("expected.value IS NOT NULL").select(*key, F.col("expected.value").alias("value"), F.posexplode(F.concat(F.array("expected.value"), "expected.aliases")).alias("k", "form"))
    own = own.select(*key, "form", F.struct(F.lit(0).cast("bigint").alias("seq"), "k").alias("place"))
    more = probes.select("workload_id", "probe_id", F.col("expected.value").alias("value")).join(names, ["workload_id", "value"]).select(*key, "form", F.struct((F.col("place.seq") + 1).alias("seq"), "place.k").alias("place"))
    bad = probes.select(*key, F.explode("expected.forbidden").alias("value"))
    forms = bad.select(*key, "value", F.col("value").alias("form")).unionByName(bad.join(names, ["workload_id", "value"]).select(*key, "value", "form"))
    ev = cut(evidence.select(*key, "rank", "content", "memory_id", "source_event_ids"))

    matched = own.unionByName(more).join(ev.select(*key, "content"), key).where(mentions(F.col("content"), F.col("form"))).groupBy(*key).agg(F.min_by("form", "place").alias("matched"))
    ids = F.when(F.size("source_event_ids") > 0, F.col("source_event_ids")).otherwise(F.array(F.coalesce("memory_id", F.lit("?"))))
    cited = forms.join(ev, key).where(mentions(F.col("content"), F.col("form"))).select(*key, "value", "rank", ids.alias("ids")).distinct()
    cited = cited.groupBy(*key, "value").agg(F.array_sort(F.collect_list(F.struct("rank", "ids"))).alias("c")).select(*key, "value", F.array_distinct(F.flatten(F.transform("c", lambda x: x["ids"]))).alias("source_event_ids"))
    why = reasons(tl).groupBy(*key, "value").agg(F.array_sort(F.collect_set("reason")).alias("error_types"))
    hits = cited.join(why, [*key, "value"], "left").withColumn("error_types", F.coalesce("error_types", F.array(F.lit("forbidden"))))
    hits = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("value", "error_types", "source_event_ids"))).alias("forbidden_hits"))
    others = probes.select(*key, "user_id").join(foreign(tl), ["workload_id", "user_id"]).join(ev.select(*key, "content"), key).where(mentions(F.col("content"), F.col("value"))).groupBy(*key).agg(F.array_sort(F.collect_set("value")).alias("foreign_hits"))
    rows = probes.join(said, key).join(matched, key, "left").join(hits, key, "left").join(others, key, "left")
    verdict = scoring.verdict(F.col("expected.kind"), F.col("matched").isNotNull(), F.col("forbidden_hits").isNotNull(), F.col("abstained"))
    return rows.select(*key, "abstained", "abstain_reason", verdict.alias("verdict"), "matched", F.coalesce("forbidden_hits", F.array().cast("array<struct<value:string,error_types:array<string>,source_event_ids:array<string>>>")).alias("forbidden_hits"), F.coalesce("foreign_hits", F.array().cast("array<string>")).alias("foreign_hits"))


def score_answers(tl: dict[str, DataFrame], answers: DataFrame) -> DataFrame:
    """Answers (workload_id, probe_id, answer, abstained) scored as one piece of
    evidence each; a blank one is none."""
    rows = answers.where("answer IS NOT NULL AND answer <> ''").select("workload_id", "probe_id", F.lit(1).alias("rank"), F.col("answer").alias("content"), F.lit(None).cast("string").alias("memory_id"), F.array().cast("array<string>").alias("source_event_ids"), F.lit(None).cast("double").alias("score"))
    return score(tl, rows, answers.select("workload_id", "probe_id", "abstained", F.lit(None).cast("string").alias("abstain_reason")))


def op_usage(log: DataFrame) -> DataFrame:
    """Field-wise sums of usage, and the models in order of first use."""
    fields = ("llm_calls", "llm_input_tokens", "llm_output_tokens", "embedding_tokens")
    models = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "usage.model_ids"))), lambda x: x["model_ids"])))
    return log.agg(*(F.sum(f"usage.{f}").alias(f) for f in fields), models.alias("model_ids"))


def summary(scored: DataFrame, evidence: DataFrame, budget: int | None = 2000) -> DataFrame:
    """One row per workload: probes by verdict, error types by probe, tokens, isolation."""
    key = ["workload_id", "probe_id"]
    cost = evidence.groupBy(*key).agg(F.sum(token_count(F.col("content"))).alias("tokens"))
    types = F.array_distinct(F.flatten(F.transform("forbidden_hits", lambda h: h["error_types"])))
    rows = scored.join(cost, key, "left").na.fill(0, ["tokens"]).withColumn("types", types)
    over = F.lit(0).cast("bigint") if budget is None else F.count_if(F.col("tokens") > budget)
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    error = lambda t: F.count_if(F.array_contains("types", t)).alias(t)
    return rows.groupBy("workload_id").agg(F.count("*").alias("probes"), *map(count, ("correct", "polluted", "wrong", "missed", "false_abstention", "leaked", "no_abstention")), *map(error, ("stale", "future", "contaminated", "resurrected", "forbidden")), F.sum("tokens").alias("injected_tokens"), over.alias("budget_violations"), F.count_if(F.size("foreign_hits") > 0).alias("isolation_violations"))


def scrubbed_turns(tl: dict[str, DataFrame], claims: DataFrame, with_sources: bool = True) -> DataFrame:
    """(workload_id, event_id, gone): turns that a combined store drops with a delete and
    when: its sources, what it erased, and earlier turns that tell the same."""
    asks = cut(requests(tl, with_sources))
    events = cut(tl["events"].select(F.concat_ws(SEP, "workload_id", "event_id").alias("event_id"), who().alias("user_id"), F.col("timestamp").alias("ts"), "kind", "content"))
    marks = claims.where("is_delete").select("user_id", "slot", F.col("ts").alias("requested_at"))
    deleted = marks.join(asks.select("user_id", "requested_at", "request_id"), ["user_id", "requested_at"])
    own = claims.where("NOT is_delete")
    erased = cut(deletes.erased_claims(claims, deleted).join(own.select("user_id", "seq", "event_id"), ["user_id", "seq"]))
    when = asks.select("user_id", "request_id", "requested_at")
    listed = asks.select("user_id", F.explode("sources").alias("event_id"), "requested_at")
    taken = erased.join(when, ["user_id", "request_id"]).select("user_id", "event_id", "requested_at")
    values = erased.join(when, ["user_id", "request_id"]).select("user_id", "value", "requested_at").distinct()
    told = deletes.turns_with_values(events, values).join(events.select("event_id", "ts", "content"), "event_id").join(values, "user_id").where("ts <= requested_at").where(mentions(F.col("content"), F.col("value")))
    out = listed.unionByName(taken).unionByName(told.select("user_id", "event_id", "requested_at"))
    for found in (deletes.turns_with_slots(events, deleted), deletes.turns_with_entities(events, asks, deleted, own)):
        near = found.join(events.select("event_id", "ts"), "event_id").join(when.select("user_id", "requested_at"), "user_id").where("ts <= requested_at")
        out = out.unionByName(near.select("user_id", "event_id", "requested_at"))
    out = out.groupBy("event_id").agg(F.min("requested_at").alias("gone"))
    return out.select(F.split("event_id", SEP)[0].alias("workload_id"), F.element_at(F.split("event_id", SEP), -1).alias("event_id"), "gone")


def hybrid_evidence(tl: dict[str, DataFrame], mode: str = "fallback", budget: int = 2000, with_sources: bool = True, least_trust: int | None = None, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(evidence, said) of a fact store with ranked turns behind it: turns where it has
    nothing (fallback) or after what it has (augment), in the rest of the budget; none
    where the fact was deleted."""
    if mode not in ("fallback", "augment"):
        raise ValueError(f"unknown mode {mode}")
    facts_found, said = store_evidence(tl, budget, with_sources, least_trust)
    gone = scrubbed_turns(tl, cut(claim_stream(tl, with_sources, least_trust)), with_sources)
    events = tl["events"].join(gone, ["workload_id", "event_id"], "left")
    probes = asked(tl).select("workload_id", "probe_id", "user_id", "asked_at", "question")
    seen = cut(probes.join(events.select("workload_id", "user_id", "event_id", "seq", "timestamp", "kind", "content", "gone"), ["workload_id", "user_id"]).where("timestamp <= asked_at AND (gone IS NULL OR gone > asked_at)").drop("gone", "question"))
    turns = cut(_as_evidence(_ranked(tl, seen, top_k)))
    refused = said.where(F.col("abstain_reason") == REASONS["deleted"])
    short = lambda df: df.select(F.col("probe_id").alias("query_id"), F.col("workload_id").alias("scope"), "rank", F.col("memory_id").alias("item_id"), token_count(F.col("content")).alias("tokens"))
    join = search.fallback if mode == "fallback" else search.augment
    picked = join(short(facts_found), short(turns), short(refused.withColumns({"rank": F.lit(0), "memory_id": F.lit(""), "content": F.lit("")})), budget)
    every = facts_found.select("workload_id", "probe_id", "memory_id", "content", "source_event_ids", "score").unionByName(turns.select("workload_id", "probe_id", "memory_id", "content", "source_event_ids", "score"))
    picked = picked.select(F.col("query_id").alias("probe_id"), F.col("scope").alias("workload_id"), "rank", F.col("item_id").alias("memory_id"))
    evidence = cut(picked.join(every, ["workload_id", "probe_id", "memory_id"]).select(*EVIDENCE))
    has = evidence.select("workload_id", "probe_id").distinct().withColumn("_has", F.lit(True))
    rows = said.join(has, ["workload_id", "probe_id"], "left")
    none = F.col("_has").isNull()
    return evidence, rows.select("workload_id", "probe_id", none.alias("abstained"), F.when(none, F.coalesce("abstain_reason", F.lit("nothing relevant"))).alias("abstain_reason"))
