"""Memory systems by name, and a store that keeps what it is given.

A store is an append-only log of events and delete requests under a folder; what it
holds, answers and reports is always derived from the log, so a restart changes nothing
and a snapshot is a copy of two tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import evidence, replay
from .plans.lineage import cut
from .sources import tables

EVENTS = "event_id string, user_id string, session_id string, timestamp timestamp, kind string, content string, seq bigint"
REQUESTS = "request_id string, user_id string, requested_at timestamp, description string, sources array<string>, trigger string"
WORKLOAD = "store"


class NotSupported(Exception):
    """A system lacks a method; a run records it and goes on."""


@dataclass(frozen=True)
class Capabilities:
    provenance: bool = False
    temporal_query: bool = False
    deletion: bool = False
    abstention: bool = False
    persistence: bool = False
    export: bool = False


@dataclass(frozen=True)
class System:
    """How a system answers; ``settings`` are its defaults, and are what a run records."""

    name: str
    version: str
    capabilities: Capabilities
    retrieve: Callable
    settings: dict = field(default_factory=dict)

    def config(self) -> dict:
        return {"name": self.name, "version": self.version, **self.settings}

    def answer(self, tl: dict[str, DataFrame], **options) -> tuple[DataFrame, DataFrame]:
        """(evidence, said) of every probe of some timelines."""
        return self.retrieve(tl, **(self.settings | options))


_TURNS = Capabilities(provenance=True, deletion=True, persistence=True)
_FACTS = Capabilities(*[True] * 6)
REGISTRY = {
    s.name: s
    for s in (
        System("no_memory", "1", Capabilities(), replay.no_memory),
        System("full_replay", "1", _TURNS, replay.full_replay),
        System("ranked_turns", "1", _TURNS, replay.bm25_evidence, {"budget": 2000, "top_k": 5}),
        System("fact_store", "1", _FACTS, replay.store_evidence, {"budget": 2000, "least_trust": None}),
        System("hybrid_fallback", "1", _FACTS, replay.hybrid_evidence, {"mode": "fallback", "budget": 2000, "top_k": 5, "least_trust": 2}),
        System("hybrid_augment", "1", _FACTS, replay.hybrid_evidence, {"mode": "augment", "budget": 2000, "top_k": 5, "least_trust": 2}),
    )
}


def capability_table(spark: SparkSession) -> DataFrame:
    """A row for each system."""
    return spark.createDataFrame([{"system": s.name, **asdict(s.capabilities)} for s in REGISTRY.values()])


class Store:
    """One system over a log in a folder."""

    def __init__(self, spark: SparkSession, path: str, system: str = "fact_store", **options):
        self.spark, self.path, self.system, self.options = spark, path, REGISTRY[system], options

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def events(self) -> DataFrame:
        return self._read("events", EVENTS)

    def requests(self) -> DataFrame:
        return self._read("requests", REQUESTS)

    def blocked(self) -> DataFrame:
        """(user_id, event_id) that may not come back."""
        asked = self.requests().select("user_id", F.explode("sources").alias("event_id"))
        if not self.system.capabilities.abstention:
            return asked.distinct()
        claims = replay.claim_stream(self._timeline())
        user = F.element_at(F.split("user_id", replay.SEP), -1)
        gone = claims.where("NOT is_delete").alias("c").join(claims.where("is_delete").select("user_id", "slot", F.col("ts").alias("at")), ["user_id", "slot"]).where("ts <= at")
        return asked.unionByName(gone.select(user.alias("user_id"), F.element_at(F.split("event_id", replay.SEP), -1).alias("event_id"))).distinct()

    def ingest(self, events: DataFrame) -> dict[str, int]:
        """Append the events (columns of EVENTS but seq) that are new and not blocked, in
        order of their times; a report of how many were added and rejected."""
        old = self.events()
        top = old.agg(F.max("seq")).first()[0]
        start = 0 if top is None else top + 1
        order = F.row_number().over(W.orderBy("timestamp", "event_id")) + (start - 1)  # a batch
        rows = events.join(self.blocked().withColumn("_b", F.lit(True)), ["user_id", "event_id"], "left").join(old.select("event_id", F.lit(True).alias("_k")), "event_id", "left")
        rows = cut(rows)
        fresh = rows.where("_b IS NULL AND _k IS NULL").drop("_b", "_k").dropDuplicates(["event_id"]).withColumn("seq", order.cast("bigint"))
        fresh = cut(fresh.select(*(c.split()[0] for c in EVENTS.split(", "))))
        fresh.write.mode("append").parquet(f"{self.path}/events")
        return {"added": fresh.count(), "rejected": rows.where("_b IS NOT NULL").count()}

    def delete(self, requests: DataFrame) -> None:
        """Append requests (columns of REQUESTS but trigger)."""
        if not self.system.capabilities.deletion:
            raise NotSupported(f"{self.system.name} cannot delete")
        before = requests.join(self.events().select(F.col("user_id"), F.col("timestamp").alias("_t"), "seq", "event_id"), "user_id").where("_t <= requested_at")
        last = before.groupBy("request_id").agg(F.max_by("event_id", "seq").alias("trigger"))
        rows = cut(requests.join(last, "request_id").select(*(c.split()[0] for c in REQUESTS.split(", "))))
        rows.write.mode("append").parquet(f"{self.path}/requests")

    def _timeline(self, queries: DataFrame | None = None) -> dict[str, DataFrame]:
        named = lambda df: df.withColumn("workload_id", F.lit(WORKLOAD))
        out = {"events": named(self.events()), "requests": named(self.requests())}
        if queries is not None:
            out["checkpoints"] = named(queries.select(F.col("asked_at").cast("string").alias("name"), F.col("asked_at").alias("at")).distinct())
            out["probes"] = named(queries.select(F.col("query_id").alias("probe_id"), "user_id", F.col("text").alias("question"), F.col("asked_at").cast("string").alias("checkpoint"), "as_of"))
        return out

    def retrieve(self, queries: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
        """(evidence, said) for queries (query_id, user_id, text, asked_at, as_of)."""
        found, said = self.system.answer(self._timeline(queries), **(self.options | options))
        plain = lambda df: df.drop("workload_id").withColumnRenamed("probe_id", "query_id")
        return plain(found), plain(said)

    def stats(self) -> DataFrame:
        """(user_id, items, bytes, ...): of facts, or of turns."""
        if self.system.capabilities.abstention:
            user = F.element_at(F.split("user_id", replay.SEP), -1)
            return evidence.store_stats(cut(replay.claim_stream(self._timeline()))).withColumn("user_id", user)
        kept = self.events().join(self.blocked(), ["user_id", "event_id"], "left_anti")
        return kept.groupBy("user_id").agg(F.count("*").alias("items"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))

    def export_items(self, user_id: str) -> DataFrame:
        if not self.system.capabilities.export:
            raise NotSupported(f"{self.system.name} cannot export")
        rows = evidence.export_items(cut(replay.claim_stream(self._timeline())))
        return rows.where(F.element_at(F.split("user_id", replay.SEP), -1) == user_id).drop("user_id", "sources")

    def snapshot(self, path: str) -> int:
        if not self.system.capabilities.persistence:
            raise NotSupported(f"{self.system.name} keeps nothing")
        return tables.snapshot({"events": self.events(), "requests": self.requests()}, path)

    def restore(self, path: str, version: int | None = None) -> None:
        """Replace what the store holds by a snapshot."""
        for name, df in tables.restore(self.spark, path, version).items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def reset(self) -> None:
        for name, schema in (("events", EVENTS), ("requests", REQUESTS)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}")
