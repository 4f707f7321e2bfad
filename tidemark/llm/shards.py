"""Balanced label propagation over linked documents.

Documents start in the shard their id hashes to.  In each round the documents of a
group look at where their group is: a group's shard histogram (at most one row per
shard) gives each member the shard with most other members, and with it a wish to
move.  Wishes between two shards are met up to equal numbers in both directions
plus the target's free room, by a hash threshold, so no shard has to be ordered to
pick the movers.  Documents without a link give way to linked ones, so they take no
room here.  Groups larger than a shard propagate in parts that fit.  The last step makes sizes exact: within a shard linked documents
come first, group by group; what exceeds the quota is handed, in that order, to the
shards that have room.  Row counts then differ by at most one.

Numbering is done in two levels (buckets of bounded size, then a prefix sum over
bucket counts), with large groups salted over buckets, so no task holds a shard or
a group.  Only DataFrame expressions are used.

Ties between shards go by a hash of group and shard; repeated rows are members of one
group and are placed one by one; null text has size 16 and crc 0 and counts as
equal to other null text; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, settle

ROUNDS = 4
OVERHEAD_BYTES = 16
BUCKET_ROWS = 400


def describe(docs: DataFrame, shards: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, g, init): g names the group of equal texts."""
    t = F.col(text_col)
    raw = F.coalesce(t, F.lit("")).cast("binary")
    group = F.coalesce(F.md5(t.cast("binary")), F.lit("null"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw).cast("long") + OVERHEAD_BYTES).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.concat(group, F.lit(":"), F.octet_length(raw)).alias("g"),
        F.pmod(F.xxhash64(id_col, "_row"), F.lit(shards)).cast("int").alias("shard"),
        "_row",
    )


def propagate(linked: DataFrame, counts: DataFrame, shards: int, total: int, rounds: int) -> DataFrame:
    """Rounds of quota-bound moves of (doc_id, _row, g, shard)."""
    cap = -(-total // shards)
    for _ in range(rounds):
        hist = linked.groupBy("g", "shard").agg(F.count("*").alias("n"))
        # the shard with most members has more of the others than any member's own
        best = hist.groupBy("g").agg(F.max(F.struct("n", F.xxhash64("g", "shard").alias("tie"), F.col("shard").alias("s"))).alias("b")).select("g", F.col("b.s").alias("want"))
        moves = settle(linked.join(best, "g").select("doc_id", "_row", "g", "shard", "want"), "shard-wishes")
        flow = moves.where("want <> shard").groupBy("shard", "want").agg(F.count("*").alias("p"))
        back = flow.select(F.col("want").alias("shard"), F.col("shard").alias("want"), F.col("p").alias("q"))
        room = counts.select(F.col("shard").alias("want"), F.greatest(F.lit(0), F.lit(cap) - F.col("n")).alias("room"))
        asked = flow.groupBy("want").agg(F.sum("p").alias("all"))
        quota = flow.join(back, ["shard", "want"], "left").join(room, "want", "left").join(asked, "want")
        share = (F.least(F.col("p"), F.coalesce("q", F.lit(0))) + F.coalesce("room", F.lit(cap)) * F.col("p") / F.col("all")) / F.col("p")
        quota = quota.select("shard", "want", share.alias("share"))  # at most shards * shards rows
        draw = F.pmod(F.xxhash64("doc_id", "_row", F.lit("draw")), F.lit(1 << 20)) / float(1 << 20)
        moved = moves.join(F.broadcast(quota), ["shard", "want"], "left")
        linked = settle(moved.select("doc_id", "_row", "g", F.when(draw < F.col("share"), F.col("want")).otherwise(F.col("shard")).alias("shard")), "shard-labels")
        discard(moves)
        shift = linked.groupBy("shard").count()
        counts = counts.select("shard").join(F.broadcast(shift), "shard", "left").select("shard", F.coalesce("count", F.lit(0)).alias("n"))
    return linked


def place(rows: DataFrame, shards: int, total: int, bucket_rows: int) -> DataFrame:
    """Exact row quotas: adds slot and the final shard to rows that carry
    ``shard``, ``linked`` and ``g`` with its group's size ``m``."""
    per_shard = max(1, -(-total // (shards * bucket_rows)))
    spread = F.ceil(F.col("m") / bucket_rows).cast("long")
    first = F.pmod(F.xxhash64("g"), F.lit(per_shard))
    # linked groups first, large ones salted over the buckets after theirs
    bucket = F.when(F.col("linked"), first * 1_000_000 + F.pmod(F.xxhash64("doc_id", "_row"), spread)).otherwise(F.lit(1 << 60) + F.pmod(F.xxhash64("doc_id", "_row"), F.lit(per_shard)))
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = W.partitionBy("shard", "bucket").orderBy("g", "doc_id", "_row")
    ranked = rows.withColumn("rn", F.row_number().over(inside)).join(sizes.select("shard", "bucket", "base"), ["shard", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("rn") - 1)

    spark = rows.sparkSession
    all_shards = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    have = all_shards.join(sizes.groupBy("shard").agg(F.sum("n").alias("n")), "shard", "left").na.fill(0, ["n"])
    quota = F.lit(total // shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    have = have.withColumn("quota", quota)
    upto = W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)  # one row per shard
    over, free = F.greatest(F.lit(0), F.col("n") - F.col("quota")), F.greatest(F.lit(0), F.col("quota") - F.col("n"))
    have = have.withColumn("over_from", F.sum(over).over(upto) - over).withColumn("hi", F.sum(free).over(upto)).withColumn("lo", F.col("hi") - free)
    ranked = ranked.join(F.broadcast(have.select("shard", "quota", "over_from")), "shard")
    q = F.when(F.col("rank") >= F.col("quota"), F.col("over_from") + F.col("rank") - F.col("quota"))
    ranked = ranked.withColumn("q", q)
    # the shard whose free places hold number q: at most one of `shards` rows
    gaps = have.where("hi > lo").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard", "n"))).alias("gaps"))
    ranked = ranked.crossJoin(F.broadcast(gaps))  # a single row
    gap = F.element_at(F.filter("gaps", lambda x: (x["lo"] <= F.col("q")) & (F.col("q") < x["hi"])), 1)
    ranked = ranked.withColumn("gap", F.when(F.col("q").isNotNull(), gap))
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(F.col("q").isNull(), F.col("shard")).otherwise(F.col("gap.shard")).cast("int").alias("shard"),
        F.when(F.col("q").isNull(), F.col("rank")).otherwise(F.col("gap.n") + F.col("q") - F.col("gap.lo")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("g").alias("group_key"),
    )


def assign_shards(docs: DataFrame, *, shards: int = 40, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key)."""
    numbered = docs.select(id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    base = settle(describe(numbered, shards, id_col, text_col), "shard-rows")
    total = base.count()
    bucket_rows = max(bucket_rows, total // 200_000)
    groups = settle(base.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"), "shard-groups")
    marked = settle(base.join(groups, "g", "left").withColumn("linked", F.col("m").isNotNull()), "shard-marked")
    parts = F.ceil(F.col("m") / max(1, total // shards))
    part = F.concat_ws("#", "g", F.pmod(F.xxhash64("doc_id", "_row", F.lit("part")), parts))
    linked = marked.where("linked").select("doc_id", "_row", part.alias("g"), "shard")
    every = base.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    counts = every.join(linked.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left").na.fill(0, ["n"])
    labels = propagate(linked, counts, shards, total, rounds)
    rest = marked.where("NOT linked").select("doc_id", "_row", "g", "size", "text_crc32", "shard", F.lit(1).cast("long").alias("m"), "linked")
    placed = marked.where("linked").drop("shard").join(labels.select("_row", "shard"), "_row")
    placed = placed.select(*rest.columns).unionByName(rest)
    out = place(settle(placed, "shard-final"), shards, total, bucket_rows)
    return out
