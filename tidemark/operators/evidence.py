"""Evidence lines, exported items, ids and known slots of a fact history."""

from __future__ import annotations

from functools import partial
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import mentions
from ..plans.lineage import cut
from .facts import disputes, held_claims, history, outcomes, tombstones


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def fact_line(label: str, source: Column) -> Column:
    """``label: value (since day[ until day]; source: kind)``"""
    until = F.coalesce(F.concat(F.lit(" until "), _day("valid_to")), F.lit(""))
    return F.concat(label, F.lit(": "), "value", F.lit(" (since "), _day("valid_from"), until, F.lit("; source: "), source, F.lit(")"))


def turn_line(ts: str, kind: str, content: str) -> Column:
    """``[day minute kind] content``"""
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" "), kind, F.lit("] "), content)


def export_items(claims: DataFrame) -> DataFrame:
    status = F.when(F.col("valid_to").isNull(), "active").otherwise("superseded")
    return history(claims).where("live").select("user_id", "seq", F.concat("slot", F.lit(": "), "value").alias("content"), status.alias("status"), "sources", "valid_from", "valid_to")


def numbered(rows: DataFrame, order: str, width: int = 1 << 20) -> DataFrame:
    """Adds ``no``, the row's number from 1 by ``order`` (integers).

    Rows are numbered within ranges of ``width`` keys; only the counts of ranges,
    a table ``width`` times smaller, pass through one task.
    """
    rows = rows.withColumn("_range", F.floor(F.col(order) / width))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    upto = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(order))
    return rows.join(starts, "_range").withColumn("no", (F.col("_start") + within).cast("long")).drop("_range", "_start")


def memory_ids(claims: DataFrame) -> DataFrame:
    """(seq, memory_id) of every claim but restatements and deletes, in order."""
    made = outcomes(claims).where("outcome NOT IN ('restate', 'delete')").select("seq")
    digits = F.col("no").cast("string")
    return numbered(made, "seq").select("seq", F.concat(F.lit("L"), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0"))).alias("memory_id"))


def known_slots(claims: DataFrame) -> DataFrame:
    """Per user and slot what an extractor is told: the open value, else the pending
    one, under its label; of a slot that was deleted, only that."""
    rows = outcomes(claims).where("epoch = last_epoch")
    setter, held = F.col("outcome").isin("introduce", "supersede"), F.col("outcome") == "hold"
    told = F.struct(F.coalesce("confirmed.label", "label").alias("label"), "value")
    last = lambda c: F.max_by(F.when(c, told), F.when(c, F.col("seq")))
    out = rows.groupBy("user_id", "slot").agg(last(setter).alias("_open"), last(held).alias("_held"))
    state = F.when(F.col("_open").isNotNull(), "open").when(F.col("_held").isNotNull(), "pending").otherwise("deleted")
    out = out.withColumn("_told", F.coalesce("_open", "_held"))
    said = F.coalesce(F.concat("_told.label", F.lit(" (current: "), "_told.value", F.lit(")")), F.lit("(deleted)"))
    return out.select("user_id", "slot", state.alias("state"), "_told.value", said.alias("described"))


def store_stats(claims: DataFrame) -> DataFrame:
    """Per user: entries, their bytes, how many are open, and the rows kept beside them
    (disputes and pending claims since the last delete of their slot, tombstones)."""
    held = history(claims).where("live").groupBy("user_id").agg(F.count("*").alias("items"), F.sum(F.octet_length("value").cast("long")).alias("bytes"), F.count_if(F.col("valid_to").isNull()).alias("active"))
    lost = disputes(claims).where("live").groupBy("user_id").agg(F.count("*").alias("disputes"))
    waits = held_claims(claims).where("live AND state = 'pending'").groupBy("user_id").agg(F.count("*").alias("pending"))
    gone = tombstones(claims).groupBy("user_id").agg(F.sum("deletes").alias("tombstones"))
    out = held
    for more in (lost, waits, gone):
        out = out.join(more, "user_id", "full")
    return out.na.fill(0)


def missing_pairs(claims: DataFrame, slots: list[str]) -> DataFrame:
    """(user, slot) pairs without any claim."""
    every = claims.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, slots))).alias("slot"))
    return every.join(claims.where("NOT is_delete").select("user_id", "slot").distinct(), ["user_id", "slot"], "left_anti")


def _word(c):
    return F.lower(F.regexp_extract(c, r"(?U)\w+", 0))


def _words(c):
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))


#: Tokens of a phrase that its key tells; words of 64 bits in the bitmap of keys (8 MB);
#: keys up to which it is sent; runs of tokens whose keys a task makes at once.
DEPTH, BITMAP_WORDS, BITMAP_KEYS, RUNS = 16, 1 << 20, 1 << 23, 1 << 17


def _tokens(c):
    """Hashes of a text's words and marks, in order and whatever their case (of letters
    that a pattern takes for the same: s and long s, sigma and its final form)."""
    c = F.col(c)
    once = F.translate(F.upper(F.translate(F.lower(c), "\u03c2\u0307", "\u03c3")), "\u0307", "")  # lower(upper()) alone is made lower()
    folded = F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(F.lower(once), "\u03c2\u0307", "\u03c3"))
    return F.transform(F.regexp_extract_all(folded, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)), lambda w: F.xxhash64(w))


def _runs(flat: np.ndarray, size: int, scope: np.ndarray) -> np.ndarray:
    """A key for each run of ``size`` tokens; ``scope`` has a number for each run."""
    n = len(flat) - size + 1
    key = np.full(n, size, np.uint64)
    for j in range(size):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + flat[j : j + n].view(np.uint64)
    return ((key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) ^ scope.view(np.uint64)).view(np.int64)


def _phrase_key(tokens, scope):
    """The key of a phrase: that of its first tokens."""
    import pyarrow as pa

    lists = [t.values.to_numpy()[:DEPTH] for t in tokens]
    return pa.array([_runs(t, len(t), s)[0] for t, s in zip(lists, scope.to_numpy()[:, None], strict=True)], pa.int64())


def _text_keys(sizes, sent, tokens, scope):
    """The keys of all runs of a text's tokens, of the sizes that phrases have; those
    that the bitmap can't rule out."""
    import pyarrow as pa

    flat, ends = tokens.flatten().to_numpy(), np.cumsum(np.diff(tokens.offsets.to_numpy()) * tokens.is_valid().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    scopes, rows, keys = scope.to_numpy(), [], []
    for start, size in product(range(0, len(flat), RUNS), sizes):
        part = flat[start : start + RUNS + size - 1]
        if len(part) < size:
            continue
        at = row[start : start + len(part) - size + 1]
        found = _runs(part, size, scopes[at])
        kept = at == row[start + size - 1 : start + len(part)]
        if sent is not None:
            h = found.view(np.uint64)
            kept &= (sent.value[h & np.uint64(BITMAP_WORDS - 1)] >> (h >> np.uint64(32) & np.uint64(63)) & np.uint64(1)).astype(bool)
        rows.append(at[kept])
        keys.append(found[kept])
    rows, keys = np.concatenate([*rows, np.zeros(0, np.int32)]), np.concatenate([*keys, np.zeros(0, np.int64)])
    order = np.argsort(rows, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(ends)))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys[order]))


def phrase_pairs(texts: DataFrame, key: str, text: str, phrases: DataFrame, *scope: str) -> DataFrame:
    """(scope, key, phrase) for every text that mentions a phrase, of the same scope.

    A mention has the phrase's words and marks, all of them, one after another; so pairs
    must share a key of the phrase's first 16 words and marks, an equi-join that leaves
    to the pattern only what it accepts, or nearly.  Texts give the keys of all their
    runs as long as some phrase; a bitmap of the phrases' keys drops most of them before
    anything is shuffled.  Phrases without any word or mark are tried on every text.
    """
    of = F.xxhash64(*scope) if scope else F.lit(0).cast("bigint")
    key_of = F.arrow_udf(_phrase_key, "bigint")
    phrases = phrases.select(*scope, "phrase").distinct().where("trim(phrase) <> ''").withColumn("_t", F.slice(_tokens("phrase"), 1, DEPTH))
    phrases = cut(phrases.select(*scope, "phrase", F.size("_t").alias("_n"), F.when(F.size("_t") > 0, F.col("_t")).alias("_t")))
    keyed = phrases.where("_n > 0").select(*scope, "phrase", "_n", key_of("_t", of).alias("_h"))
    sizes = {r["_n"]: r["count"] for r in keyed.groupBy("_n").count().collect()}  # at most DEPTH
    sent = None
    if sum(sizes.values()) <= BITMAP_KEYS:
        bits = keyed.select(F.expr(f"cast(_h & {BITMAP_WORDS - 1} as int)").alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(_h, 32) & 63 as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()  # at most BITMAP_WORDS rows
        held = np.zeros(BITMAP_WORDS, np.uint64)
        held[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
        sent = phrases.sparkSession.sparkContext.broadcast(held)
    keys_of = F.arrow_udf(partial(_text_keys, sorted(sizes), sent), "array<bigint>")
    rows = texts.select(*scope, key, F.col(text).alias("_text"))
    spread = rows.select(*scope, key, F.explode(F.array_distinct(keys_of(_tokens("_text"), of))).alias("_h"))
    near = spread.join(keyed.drop("_n"), [*scope, "_h"]).select(*scope, key, "phrase").join(rows, [*scope, key])
    odd = phrases.where("_n = 0").select(*scope, "phrase")
    other = rows.join(odd, list(scope)) if scope else rows.join(odd, F.lit(True))
    both = near.select(*scope, key, "phrase", "_text").unionByName(other.select(*scope, key, "phrase", "_text"))
    return both.where(mentions(F.col("_text"), F.col("phrase"))).select(*scope, key, "phrase").distinct()


def subphrases(values: DataFrame) -> DataFrame:
    """(inner, outer): values that occur as a whole phrase within another value.

    Pairs must share the inner value's first word, an equi-join that leaves the
    pattern to few pairs.
    """
    inner = values.select(F.col("value").alias("inner"), _word("value").alias("word")).where("word <> ''").distinct()
    outer = values.select("value").distinct().select(F.col("value").alias("outer"), F.explode(_words("value")).alias("word"))
    pairs = inner.join(outer, "word").where(F.col("inner") != F.col("outer"))
    return pairs.where(mentions(F.col("outer"), F.col("inner"))).select("inner", "outer")
