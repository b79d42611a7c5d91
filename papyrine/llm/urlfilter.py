"""URL filters: rules first, then trust and distrust propagated over the link graph of hosts. Native only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ROUNDS, DAMPING, THRESHOLD = 12, 0.85, 0.05
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ://, A-Z of the host lower-cased; both empty without one."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls; of equally long rules the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, every: int = 4) -> DataFrame:
    """Personalised PageRank over (src, dst, weight) with restart at (host, seed): (host, score)."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = materialize(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    score = seeds.select("host", F.col("seed").alias("score"))
    for i in range(1, rounds + 1):
        sent = score.join(share, score["host"] == share["src"]).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score"))
        restart = seeds.select("host", ((1 - damping) * F.col("seed")).alias("score"))
        score = sent.unionByName(restart).groupBy("host").agg(F.sum("score").alias("score"))
        if i % every == 0 or i == rounds:
            score = materialize(score, "scores")
    return score


def host_scores(judged: DataFrame, links: DataFrame) -> DataFrame:
    """(host, trust, distrust) of hosts that got any.

    Seeds: hosts half of whose pages the rules allow are trusted, half of whose pages they block blocked. Trust follows
    links; distrust goes against them, to hosts that link to blocked ones.
    """
    ruled = judged.groupBy("host").agg(F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("good"), F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("bad"))
    seeds = materialize(ruled.select("host", (F.col("good") >= 0.5).cast("double").alias("t"), (F.col("bad") >= 0.5).cast("double").alias("d")).where("t > 0 or d > 0"), "seeds")
    edges = materialize(links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")), "host-edges")
    trusted, blocked = seeds.where("t > 0").select("host", F.col("t").alias("seed")), seeds.where("d > 0").select("host", F.col("d").alias("seed"))
    if edges.isEmpty():  # what propagate() gives then
        trust, distrust = (x.select("host", ((1 - DAMPING) * F.col("seed")).alias("score")) for x in (trusted, blocked))
    else:
        trust = propagate(edges, trusted)
        distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), blocked)
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page.

    A page that a rule fits takes the longest rule's verdict. Any other is blocked if its host's distrust is at least
    `threshold` and above its trust, else allowed; so is one without a host allowed. A null url has empty host and path.
    Repeated rows stay repeated; links of a host to itself do not count. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_columns(rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    judged = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    links = parts.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to")).select("src", F.translate("to", UPPER, LOWER).alias("dst"))
    scores = materialize(host_scores(judged, links), "host-scores")
    # Pages without a host have no score; a salt keeps them from meeting in one task.
    salted = judged.withColumn("salt", F.when(F.col("host") == "", F.pmod(F.xxhash64("page_id"), F.lit(1 << 16)) + 1).otherwise(F.lit(0)))
    left = salted.join(scores.withColumn("salt", F.lit(0).cast("long")), ["host", "salt"], "left")
    distrusted = (F.coalesce("distrust", F.lit(0.0)) >= threshold) & (F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)))
    return left.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(distrusted & (F.col("host") != ""), "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
