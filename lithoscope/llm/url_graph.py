"""URL filter [native]: fixed host and path rules first, then trust that is propagated over the graph of hosts.

1. A URL's host and path are cut out by one pattern. Of the rules that fit (a rule's host or a subdomain of it, and a path
   that starts with the rule's) the longest decides.
2. Edges run from a page's host to every other host that its links name (``href``, ``src`` and ``action`` with a host of
   their own); an edge weighs as many pages as have such a link. They are counted before they are shuffled.
3. Two personalised PageRanks run over the edges in Spark, both in one table keyed by (kind, host). Trust starts at hosts
   whose pages the rules allow and follows links. Distrust starts at hosts whose pages the rules block and runs against
   the links, to those who link there. A host's seed is the share of its pages that the rules decide so. A walk that
   finds no edge begins again at the seeds; that only scales the ranks, so it is left out.
4. A page that no rule fits is blocked if its host's distrust less its trust is over half of what a host gets from its own
   seed when all its pages are blocked. Else it is allowed.

Ranks are whole numbers (``UNIT`` is a seed of 1), each edge's part rounded down, so sums do not depend on their order. A
round joins the edges with one row a host and sums with a combiner, so hosts that link much or are linked much are split.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and is allowed; empty hosts and
links within one host are no edges; a null page has no links; repeated rows count and are returned as often as they occur;
only the three named columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, cut

UNIT = 1_000_000_000
#: Share of a rank that comes from the seed, in hundredths; the rest follows edges.
SEED_SHARE = 15
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\b(?:href|src|action)[ \t\n\f\r]*=[ \t\n\f\r]*["']?[ \t\n\f\r]*(?:https?:)?//([^/?#"' \t\n\f\r<>\\]+)"""
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for the pages of ``host`` and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; empty without ``://``."""
    return tuple(F.coalesce(c, F.lit("")) for c in (ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does; of equally long ones a blocking one, then by text."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):  # the last one is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): n pages of src link to the other host dst."""
    host, _ = url_parts(F.col(url_col))
    named = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)), ascii_lower))
    return pages.select(host.alias("src"), F.explode(named).alias("dst")).filter("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, rounds: int = 20, every: int = 4) -> DataFrame:
    """(kind, host, rank) of ``seeds`` (kind, host, seed) after ``rounds`` rounds over ``edges`` (src, dst, n).

    The edges' shares are written once; ranks are written every few rounds, where ranks that no longer change end the work.
    """
    def ways(kind: str, a: str, b: str) -> DataFrame:
        total = edges.groupBy(a).agg(F.sum("n").alias("all"))
        return edges.join(total, a).select(F.lit(kind).alias("kind"), F.col(a).alias("host"), F.col(b).alias("to"), (F.lit((100 - SEED_SHARE) / 100) * F.col("n") / F.col("all")).alias("share"))

    base = cut(seeds.select("kind", "host", F.expr(f"seed * {SEED_SHARE} div 100").alias("rank")).filter("rank > 0"))
    steps = cut(ways("trust", "src", "dst").unionByName(ways("distrust", "dst", "src")))
    if steps.isEmpty():
        return base
    now, before = base, None
    for k in range(rounds):
        given = now.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), F.floor(F.col("rank") * F.col("share")).alias("rank"))
        now = given.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (k + 1) % every == 0 and k + 1 < rounds:
            now = cut(now)
            state = now.agg(F.count("*"), F.sum(F.xxhash64("kind", "host", "rank").cast("decimal(38,0)"))).first()
            if state == before:
                break
            before = state
    return now


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page; the last two are its host's ranks."""
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = parts.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    per_host = judged.filter("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("trust"), F.count_if(F.col("by_rule") == "block").alias("distrust"))
    seed = lambda kind: F.struct(F.lit(kind).alias("kind"), F.expr(f"{kind} * {UNIT} div pages").alias("seed"))
    seeds = per_host.select("host", F.explode(F.array(seed("trust"), seed("distrust"))).alias("s")).select("s.kind", "host", "s.seed")
    ranks = propagated(seeds, host_edges(pages, url_col, html_col), rounds)
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(F.lit(0).cast("long"))).alias(kind)
    scored = judged.join(ranks.groupBy("host").agg(total("trust"), total("distrust")), "host", "left").na.fill(0, ["trust", "distrust"])
    by_graph = F.when(2 * (F.col("distrust") - F.col("trust")) > UNIT * SEED_SHARE // 100, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("by_rule", by_graph).alias("verdict"), "trust", "distrust")
