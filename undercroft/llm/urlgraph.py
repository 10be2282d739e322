"""URL verdicts: rules on hosts and paths, and trust and distrust spread over the links between hosts.

Everything here is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class GraphConfig:
    damping: float = 0.85
    #: Rounds without a newly reached host after which ranks that have not settled are a fault. The change falls by
    #: `damping` a round at least, which makes about 90 rounds for the values here.
    rounds: int = 200
    #: The total change under which the ranks count as settled.
    settled: float = 1e-6
    #: A host is blocked when its share of distrust in trust plus distrust is above this.
    distrust_share: float = 0.5


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty for null or without `://`."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), or null. Of rules of one length the first counts."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from href attributes; relative links stay on their host.

    Only links with a host of their own are exploded, and edges are counted before and after the shuffle, so a host
    that owns a third of the pages costs one row per target and task.
    """
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""), 1)
    away = F.filter(links, lambda u: u.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//"))
    found = pages.select(url_host(F.col("url")).alias("src"), F.explode(away).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    found = found.select("src", url_host(link).alias("dst")).where("src != '' and dst != '' and src != dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, cfg: GraphConfig, tag: str) -> DataFrame:
    """Personalised PageRank: (host, score). `edges` (src, dst, n), `seeds` (host, seed) with non-negative seeds.

    Rank flows along edges in proportion to n, with `1 - damping` of it returning to the seeds; rank of hosts without
    links returns to the seeds as well, so scores sum to one. Seeds that sum to zero give zero scores. Rounds go on until
    the change is under `settled` and no further host is reached, so a host at the end of a long chain has its rank.
    """
    total = seeds.agg(F.coalesce(F.sum("seed"), F.lit(0.0))).first()[0]
    nodes = seeds.select("host", (F.col("seed") / F.lit(total) if total else F.lit(0.0)).alias("seed"))
    out = edges.groupBy("src").agg(F.sum("n").alias("degree"))
    weights = stage(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("share")), f"{tag}-w")
    ranks = stage(nodes.withColumn("score", F.col("seed")), f"{tag}-r")
    if not total or weights.isEmpty():
        return ranks.select("host", "score")
    reached = idle = 0
    while idle <= cfg.rounds:
        flow = (weights.join(ranks.select(F.col("host").alias("src"), "score"), "src")
                .groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("flow")))
        moved = ranks.join(flow, "host", "left").select(
            "host", "seed", F.col("score").alias("before"), F.coalesce("flow", F.lit(0.0)).alias("flow"))
        moved = stage(moved, f"{tag}-f")
        # One number: the rank that found no link to follow.
        lost = 1.0 - (moved.agg(F.sum("flow")).first()[0] or 0.0)
        back = F.lit(1.0 - cfg.damping + cfg.damping * lost)
        ranks = moved.withColumn("score", F.col("flow") * cfg.damping + F.col("seed") * back)
        change, now = ranks.agg(F.sum(F.abs(F.col("score") - F.col("before"))), F.count_if(F.col("score") > 0)).first()
        idle = 0 if now > reached else idle + 1
        reached = max(now, reached)
        if change < cfg.settled and idle:
            return ranks.select("host", "score")
        ranks = ranks.select("host", "seed", "score")
    raise RuntimeError("ranks did not settle")


def judge_pages(pages: DataFrame, rules: Sequence[Rule], cfg: GraphConfig = GraphConfig()) -> DataFrame:
    """Verdict of every page: page_id, host, path, rule, verdict, trust, distrust.

    A page that a rule fits has the rule's verdict. The others get that of their host: allowed pages seed trust and
    blocked pages seed distrust, each by its share of the host's pages; trust follows links, distrust goes against
    them (who links to blocked hosts is suspect). A host is blocked when distrust is more than `distrust_share` of
    both; a host that neither reaches is allowed, as are pages without a host. Null urls and html count as empty;
    repeated rows are judged each; an empty table gives no rows; other columns are not read.
    """
    url = F.col("url")
    judged = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    share = lambda v: F.avg((F.coalesce(F.col("ruled"), F.lit("")) == v).cast("double"))
    own = judged.where("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    own = stage(own, "hosts")
    edges = stage(host_edges(pages), "host-edges")
    # Hosts that are only linked to have no pages and seed nothing.
    linked = edges.select(F.col("src").alias("host")).unionAll(edges.select(F.col("dst").alias("host"))).distinct()
    hosts = stage(own.join(linked, "host", "full_outer").select(
        "host", F.coalesce("allowed", F.lit(0.0)).alias("allowed"), F.coalesce("blocked", F.lit(0.0)).alias("blocked")),
        "all-hosts")
    trust = spread(edges, hosts.select("host", F.col("allowed").alias("seed")), cfg, "trust")
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(against, hosts.select("host", F.col("blocked").alias("seed")), cfg, "distrust")
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host")
    spread_verdict = F.when(F.col("distrust") > cfg.distrust_share * (F.col("trust") + F.col("distrust")), "block")
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", spread_verdict, F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
