"""URL verdicts from rules and from trust propagated over the host graph.

Rules (host, path, verdict) hold for the host and all its subdomains where the
url's path starts with the rule's; the longest host-and-path wins, then the longer
host.  Rules are a table that joins hosts by their suffixes, so a list may be long;
the rules of one host are one row.  For the rest,
trust starts at hosts in proportion to the share of their urls that rules allow
and follows host edges; distrust starts at hosts in proportion to the share of
blocked urls and follows the edges reversed.  Both are personalised PageRanks:

    rank = (1 - damping) * seed + damping * (incoming + dangling * seed)

Edges are links of a page's html to other hosts, and links in both directions
between a host and its parent domain where that is a host as well.  Links of the
same two hosts are counted before anything is shuffled by host.  A url without a
rule is blocked where its host's distrust exceeds its trust by ``margin`` times
the mean rank.

Ranks are iterated until no host's verdict hangs on the rest: the largest change of a
rank is below ``tolerance`` times the mean rank; a round limit raises an error.

Null urls, and urls without ``://``, have empty host and path and are allowed;
null html has no links; repeated rows give repeated results; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Adds host and path."""
    df = df.withColumn("_u", F.col(url_col))
    rest = F.when(F.instr("_u", "://") > 0, F.expr("substr(_u, instr(_u, '://') + 3)"))
    df = df.withColumn("_r", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("_r", r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("_r", r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": host, "path": path}).drop("_u", "_r")


def rules_of_hosts(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, rules): all rules for a host or a parent domain, for hosts with any."""
    table = hosts.sparkSession.createDataFrame(rules or [("", "", "")], "suffix string, start string, said string").where("suffix <> ''")
    one = F.struct((F.length("suffix") + F.length("start")).alias("long"), F.length("suffix").alias("host_long"), F.concat("suffix", "start").alias("rule"), "start", "said")
    table = table.groupBy("suffix").agg(F.collect_set(one).alias("found"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    spread = hosts.select("host", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(table, "suffix")
    return spread.groupBy("host").agg(F.flatten(F.collect_list("found")).alias("rules"))


def host_edges(pages: DataFrame, hosts: DataFrame, html_col: str) -> DataFrame:
    """(src, dst, w): counted links between different hosts."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1)).alias("to"))
    absolute = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    links = with_parts(links.withColumnRenamed("host", "src").withColumn("to", absolute), "to")
    links = links.where("host <> '' AND src <> '' AND host <> src").groupBy("src", F.col("host").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    child = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst")).where("dst <> ''")
    child = child.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").withColumn("w", F.lit(1.0)).select("src", "dst", "w")
    both = child.unionByName(child.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float, tolerance: float, max_rounds: int) -> DataFrame:
    """Personalised PageRanks by kind, until no rank changes by ``tolerance``.  edges:
    (kind, src, dst, share) with shares that sum to 1 over a source; seeds: (kind, node,
    seed) with 1 over a kind."""
    # numbers stand for (kind, node) in the rounds: short rows, and joins on one number
    names = settle(seeds.withColumn("id", F.monotonically_increasing_id()), "rank-names")
    number = lambda c, to: names.select("kind", F.col("node").alias(c), F.col("id").alias(to))
    out = edges.join(number("src", "id"), ["kind", "src"]).join(number("dst", "to"), ["kind", "dst"])
    out = settle(out.select("id", "to", "share"), "rank-edges")
    linked = out.select("id").distinct().withColumn("linked", F.lit(True))
    ranks = names.join(linked, "id", "left").na.fill(False, ["linked"])
    ranks = settle(ranks.select("id", "kind", "seed", "linked", F.col("seed").alias("rank"), F.lit(0.0).alias("change")), "rank")
    told = lambda df: df.groupBy("kind").agg(F.sum(F.when(~F.col("linked"), F.col("rank")).otherwise(0.0)).alias("loose"), F.max("change").alias("change")).collect()  # noqa: E731  a row per kind
    state = told(ranks)
    change = None
    for _ in range(max_rounds):
        loose = F.lit(0.0)
        for r in state:
            loose = F.when(F.col("kind") == r.kind, F.lit(r.loose)).otherwise(loose)
        moved = ranks.join(out, "id").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = ranks.join(moved, "id", "left")
        rank = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + loose * F.col("seed"))
        new = settle(new.select("id", "kind", "seed", "linked", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change")), "rank")
        state = told(new)
        discard(ranks)
        ranks, change = new, max((r.change for r in state), default=None)
        if change is None or change < tolerance:
            return names.select("id", "node").join(ranks, "id").select("kind", "node", "seed", "rank")
    raise RuntimeError(f"ranks still change by {change} after {max_rounds} rounds")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, tolerance: float = 1e-3, max_rounds: int = 300, margin: float = 1.0) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row."""
    parts = with_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), "url")
    urls = settle(parts.select("id", "host", "path"), "urls")
    # a table of its own, so that the join can split the rows of a hot host
    ruled = settle(rules_of_hosts(urls.where("host <> ''").select("host").distinct(), rules), "url-ruled")
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["start"])))
    judged = urls.join(ruled, "host", "left").withColumn("best", best)
    judged = settle(judged.select("id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.said").alias("said")), "url-rules")
    share = lambda what: F.avg(F.when(F.col("said") == what, 1.0).otherwise(0.0))
    hosts = settle(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "url-hosts")
    edges = settle(host_edges(parts, hosts, "html"), "url-edges")
    kinds = edges.withColumn("kind", F.lit("trust")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w").withColumn("kind", F.lit("distrust")))
    total = kinds.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    kinds = settle(kinds.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all")).alias("share")), "url-shares")
    far = edges.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti").select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    nodes = hosts.unionByName(far)
    sums = nodes.agg(F.sum("trust"), F.sum("distrust"), F.count("*")).first()
    seed = lambda kind, total: nodes.select(F.lit(kind).alias("kind"), F.col("host").alias("node"), (F.col(kind) / (total or 1.0)).alias("seed"))
    ranks = propagate(kinds, seed("trust", sums[0]).unionByName(seed("distrust", sums[1])), damping=damping, tolerance=tolerance / max(1, sums[2]), max_rounds=max_rounds)
    net = ranks.groupBy(F.col("node").alias("host")).agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    net = settle(net, "url-net")
    bad = F.coalesce((F.col("distrust") - F.col("trust")) * float(sums[2]) > margin, F.lit(False))
    verdict = F.coalesce("said", F.when(bad, "block").otherwise("allow"))
    return judged.join(net, "host", "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
