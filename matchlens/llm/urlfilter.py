"""URL filters: rules first, and for what they don't fit, trust and distrust spread over the graph of hosts.

Hosts with a page that a rule allows are trusted, those with one that a rule blocks are distrusted; a host with pages of
both kinds is a seed of either in the shares of its ruled pages. Trust follows links
(personalised PageRank); distrust goes against them, to the hosts that link to blocked ones. A host is blocked if its
distrust exceeds a multiple of its trust.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, checkpointed, table, unpartitioned

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link in a page.
LINK = r"""(?i)href\s*+=\s*+["']?\s*+(?:[a-z][a-z0-9+.\-]*+:)?//([^/?#"'\s>]++)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The rule (host and path) that fits, the longest first, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def spread(edges: DataFrame, seeds: DataFrame, rounds: int | None = 10, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) after some rounds, from edges (src, dst, w) and seeds (host, trusted, distrusted).

    Without a number of rounds, they end when they reach no new host and change all scores together by at most the
    tolerance, of a seed mass of 1 in each kind.

    Only hosts with any of the two appear. The seeds' weights are scaled to sum to 1 in each kind.
    """
    total = seeds.agg(F.sum("trusted"), F.sum("distrusted")).first()
    share = lambda name, n: (F.col(name) / F.lit(float(n or 1))).alias(name)
    seeds = checkpointed(seeds.select("host", share("trusted", total[0]), share("distrusted", total[1])))
    of = lambda key, name: edges.groupBy(F.col(key).alias(f"{key}_k")).agg(F.sum("w").alias(name))
    shared = edges.select(unpartitioned_string("src"), "dst", "w").join(of("src", "sent").select(unpartitioned_string("src_k"), "sent"), F.col("src") == F.col("src_k"))
    shared = shared.select("src", unpartitioned_string("dst"), "w", "sent").join(of("dst", "got").select(unpartitioned_string("dst_k"), "got"), F.col("dst") == F.col("dst_k"))
    shared = checkpointed(shared.select("src", "dst", (F.col("w") / F.col("sent")).alias("down"), (F.col("w") / F.col("got")).alias("up")))
    scores = seeds.select("host", F.col("trusted").alias("trust"), F.col("distrusted").alias("distrust"))
    zero, written = F.lit(0.0), Rounds(edges.sparkSession)
    for _ in count() if rounds is None else range(rounds):
        before = scores
        trust = scores.where("trust > 0").select(unpartitioned_string("host"), "trust")
        distrust = scores.where("distrust > 0").select(unpartitioned_string("host"), "distrust")
        down = shared.join(trust, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("trust") * F.col("down") * damping).alias("trust"), zero.alias("distrust"))
        up = shared.join(distrust, F.col("dst") == F.col("host")).select(F.col("src").alias("host"), zero.alias("trust"), (F.col("distrust") * F.col("up") * damping).alias("distrust"))
        again = seeds.select("host", (F.col("trusted") * (1 - damping)).alias("trust"), (F.col("distrusted") * (1 - damping)).alias("distrust"))
        scores = written.written(reduce(DataFrame.union, [down, up, again]).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
        if rounds is None and _settled(before, scores, tolerance):
            break
    return scores


def _settled(before: DataFrame, now: DataFrame, tolerance: float) -> bool:
    kinds = [F.col(c) for c in ("trust", "distrust")]
    old, new = (df.select("host", *[(k * sign).alias(c) for k, c in zip(kinds, ("t", "d"))], *[F.lit(int(sign > 0)).alias("late")], *[(k > 0).cast("int").alias(f"has_{c}") for k, c in zip(kinds, ("t", "d"))]) for df, sign in ((before, -1.0), (now, 1.0)))
    signed = lambda c: F.sum(F.when(F.col("late") == 1, F.col(c)).otherwise(-F.col(c)))
    each = old.union(new).groupBy("host").agg(F.abs(F.sum("t")).alias("t"), F.abs(F.sum("d")).alias("d"), signed("has_t").alias("has_t"), signed("has_d").alias("has_d"))
    found = each.agg(F.sum("t"), F.sum("d"), F.max(F.greatest("has_t", "has_d"))).first()
    return found[2] is None or (found[0] <= tolerance and found[1] <= tolerance and found[2] <= 0)


def unpartitioned_string(name: str) -> Column:
    """As common.unpartitioned, of a string."""
    return F.concat(F.col(name), F.lit("")).alias(name)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rounds: int | None = 10, damping: float = 0.85, ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of pages (page_id, url, html).

    Null urls, and urls without "://", have an empty host and path, fit no rule and are allowed. A null html has no
    links; a host's links to itself don't count. Repeated rows are judged each and count as further links. Distrust
    blocks if it exceeds ratio * trust by more than a billionth of that, however small both are; a host that no seed
    reaches is allowed. Without a number of rounds, scores are spread until they settle. An empty table gives no rows.
    Very long pages are read whole; other columns of pages, whatever their names, play no part.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("says"))
    links = rows.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    edges = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    is_ = lambda x: F.avg(F.when(F.col("says") == x, 1.0).otherwise(0.0))
    seeds = ruled.where("says is not null").groupBy("host").agg(is_("allow").alias("trusted"), is_("block").alias("distrusted"))
    scores = spread(checkpointed(edges), checkpointed(seeds), rounds, damping)
    scores = scores.select(unpartitioned_string("host").alias("scored"), "trust", "distrust")
    joined = ruled.join(scores, F.col("host") == F.col("scored"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    spread_says = F.when(distrust > ratio * trust * (1 + 1e-9), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("says", spread_says).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rounds=None).select("page_id", "host", "path", "rule", "verdict")
