"""URL filter: host rules first, then trust and distrust that flow along links between hosts."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.workspace import write_through
from .frames import ascii_lower, named, packed, unpacked

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the pages of ``host`` and all its subdomains whose path starts with ``path``."""
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does.

    Rules of one length fit different pages, or the first of equal ones is taken.
    """
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links between different hosts: src, dst, and share, the part of src's links that go to dst."""
    found = pages.select(
        url_host(named(url_col)).alias("src"),
        F.explode(F.regexp_extract_all(named(html_col), F.lit(LINK), F.lit(1))).alias("href"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    edges = found.select("src", url_host(full).alias("dst")).filter("src <> dst AND src <> '' AND dst <> ''")
    edges = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    return edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    """The same links backwards, with shares of what then is the source."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    total = back.groupBy("src").agg(F.count(F.lit(1)).alias("total"))
    return back.join(total, "src").select("src", "dst", (F.lit(1.0) / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-12) -> DataFrame:
    """Personalised PageRank of ``seeds`` (host, seed) over ``edges``: host, score.

    Power iteration of score = (1 - damping) * seed + damping * inflow.  Every
    round is one join on the source and one sum by target, both of which Spark
    combines or splits where a host has very many links.  The scores of a round
    are written to the shared folder, so lineage stays short.

    It ends when no host's score has grown by more than ``tolerance`` times
    itself, however small it is.  Scores only grow, a host that is reached for
    the first time grows by all it has, and no later round can grow a score by
    a larger part than the round before grew any, so distance from the seeds and
    the number of links don't decide.  There is no limit of rounds: what moves
    shrinks by ``damping`` in each.
    """
    base = seeds.select("host", ((1 - damping) * F.col("seed")).alias("base")).filter("base > 0")
    score = base.select("host", F.col("base").alias("score"))
    while True:
        inflow = edges.join(score, edges["src"] == score["host"]).groupBy("dst").agg(
            (damping * F.sum(F.col("share") * F.col("score"))).alias("inflow"))
        after = base.join(inflow, base["host"] == inflow["dst"], "full").select(
            F.coalesce("host", "dst").alias("host"),
            (F.coalesce("base", F.lit(0.0)) + F.coalesce("inflow", F.lit(0.0))).alias("score")).filter("score > 0")
        after = write_through(after, "host_scores")
        grown = after.alias("a").join(score.alias("b"), "host", "left").agg(
            F.max(F.abs(1 - F.coalesce("b.score", F.lit(0.0)) / F.col("a.score")))).first()[0]
        score = after
        if grown is None or grown <= tolerance:
            return score


def host_scores(
    ruled: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-12,
) -> DataFrame:
    """Trust and distrust per host from the pages (host, verdict) that a rule judged.

    A host's seed is the share of its judged pages that are allowed (trust) or
    blocked (distrust).  Trust follows links, distrust goes against them: whoever
    links to blocked hosts gets some.  Seeds aren't scaled by the number of
    hosts, so a threshold means the same at every size.
    """
    judged = F.col("verdict").isNotNull()
    seeds = ruled.filter(judged & (F.col("host") != "")).groupBy("host").agg(
        F.avg((F.col("verdict") == "allow").cast("double")).alias("trusted"),
        F.avg((F.col("verdict") == "block").cast("double")).alias("blocked"))
    seeds = write_through(seeds, "host_seeds")
    trust = propagate(seeds.select("host", F.col("trusted").alias("seed")), edges, damping, tolerance)
    distrust = propagate(
        seeds.select("host", F.col("blocked").alias("seed")), reversed_edges(edges), damping, tolerance)
    return trust.select("host", F.col("score").alias("trust")).join(
        distrust.select("host", F.col("score").alias("distrust")), "host", "full").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def link_trust(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url", html_col: str = "html",
    damping: float = 0.85, tolerance: float = 1e-12, threshold: float = 0.0,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust.

    The longest fitting rule decides.  Pages without one are judged by their
    host: blocked where distrust exceeds trust by more than ``threshold``,
    allowed otherwise; a host of which nothing is known is allowed.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is allowed.  Null html has no links.  Links to the page's own host count
    for nothing.  Repeated rows are judged alike.  Without pages the result is
    empty.  Input columns named like a result column are replaced.
    """
    url = named(url_col)
    ruled = pages.select(url_host(url).alias("host"), url_path(url).alias("path"))
    ruled = ruled.select("host", best_rule(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict"))
    edges = write_through(host_edges(pages, url_col, html_col), "host_edges")
    scores = host_scores(ruled, edges, damping, tolerance)
    # Only hosts whose verdict differs from the default are joined to the pages.
    judged = write_through(scores.select(F.col("host").alias("s_host"), "trust", "distrust"), "host_trust")
    rows = packed(pages, host=url_host(url), path=url_path(url))
    rows = rows.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    joined = rows.join(judged, F.col("host") == F.col("s_host"), "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    scored = F.when(distrust - trust > threshold, "block").otherwise("allow")
    return unpacked(
        joined, pages.columns, host=F.col("host"), path=F.col("path"), rule=F.col("rule.name"),
        verdict=F.coalesce(F.col("rule.verdict"), scored), trust=trust, distrust=distrust)
