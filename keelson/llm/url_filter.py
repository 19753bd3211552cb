"""URL rules and link-graph propagation (DataFrame operations only).

Rules decide the urls they fit. Every other url gets its host's verdict: personalised PageRank carries trust from hosts
with allowed pages along host links, and distrust from hosts with blocked pages against them (who links to bad hosts is
suspect); a host is blocked where distrust makes up too large a part of both.

Defined cases: very long pages and urls are read in whole; a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; null html has no
links; repeated page ids are judged row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, materialize


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: PageRank: follow a link with DAMPING; lineage is cut after each CUT steps, and the steps end when no more than TOLERANCE of
#: the seeds' mass is still under way: after 44 at most.
DAMPING, CUT, TOLERANCE = 0.85, 4, 1e-3
#: A host is blocked if distrust is at least this part of trust and distrust.
BLOCK_SHARE = 0.75
#: The host of an absolute or protocol-relative link; other links stay on their host.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url") -> DataFrame:
    """Add host, path, rule and rule_verdict; the longest fitting rule wins, of equally long ones a blocking one."""
    host, path = url_parts(F.col("__url"))
    found = pages.withColumn("__url", F.col(url_col)).withColumns({"host": host, "path": path}).drop("__url")
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict == "allow", r.name))
    pick = lambda value: F.coalesce(F.lit(None).cast("string"), *[F.when(r.fits(F.col("host"), F.col("path")), F.lit(value(r))) for r in ordered])
    return found.withColumns({"rule": pick(lambda r: r.name), "rule_verdict": pick(lambda r: r.verdict)})


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts. pages: host and html."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))
    edges = pages.select(F.col("host").alias("src"), F.explode(F.transform(links, lambda x: F.translate(x, UPPER, LOWER))).alias("dst"))
    return edges.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, cut: int = CUT, rounds: int | None = None) -> DataFrame:
    """host, trust, distrust: personalised PageRank from `seeds` (host, trust, distrust), as the sum of its first powers.

    Trust follows edges (src, dst, n) from source to target, distrust from target to source; both in one join a round.
    rounds: so many steps, whatever is left. What reaches a host without a way on stays there, so scores sum to at most the seeds' sum.
    """
    ways = edges.select(F.lit(True).alias("good"), F.col("src").alias("at"), F.col("dst").alias("to"), "n").union(edges.select(F.lit(False), "dst", "src", "n"))
    out = ways.groupBy("good", "at").agg(F.sum("n").alias("all_n"))
    ways = materialize(ways.join(out, ["good", "at"]).select("good", "at", "to", (F.col("n") / F.col("all_n") * damping).alias("p")), "ways")
    mass = seeds.select(F.lit(True).alias("good"), "host", F.col("trust").alias("v")).union(seeds.select(F.lit(False), "host", "distrust"))
    mass = mass.where("v > 0").withColumn("v", F.col("v") * (1 - damping))
    parts, i = [mass], 0
    left = start = seeds.agg(F.sum(F.col("trust") + F.col("distrust"))).first()[0] or 0.0
    while left > tolerance * start if rounds is None else i < rounds:
        i += 1
        step = mass.withColumnRenamed("host", "at").join(ways, ["good", "at"]).groupBy("good", F.col("to").alias("host")).agg(F.sum(F.col("v") * F.col("p")).alias("v"))
        mass = materialize(step, "mass") if i % cut == 0 else step
        parts.append(mass)
        if i % cut == 0:
            # What a step has put on hosts is (1 - damping) of what it carries.
            left = (mass.agg(F.sum("v")).first()[0] or 0.0) / (1 - damping)
    total = reduce(DataFrame.unionAll, parts).groupBy("host")
    # Rounded to 13 digits of its own, however small: scores get smaller as the graph grows, and a verdict must not depend on that.
    score = lambda good: F.format_string("%.12e", F.coalesce(F.sum(F.when(good, F.col("v"))), F.lit(0.0))).cast("double")
    return total.agg(score(F.col("good")).alias("trust"), score(~F.col("good")).alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, block_share: float = BLOCK_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust and distrust of its host."""
    known = with_rule(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), rules)
    edges = materialize(host_edges(known), "host-edges")
    judged = known.select("id", "host", "path", "rule", "rule_verdict")
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"))
    hosts = materialize(hosts, "hosts")
    good, bad = hosts.agg(F.sum("good"), F.sum("bad")).first()
    seeds = hosts.select("host", (F.col("good") / F.lit(max(1, good or 0))).alias("trust"), (F.col("bad") / F.lit(max(1, bad or 0))).alias("distrust"))
    scores = materialize(propagate(edges, seeds), "host-scores")
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= block_share * (F.col("trust") + F.col("distrust")))
    # Plain scans on both sides: adaptive execution can split the partition of a hot host.
    out = judged.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    verdict = F.coalesce("rule_verdict", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
