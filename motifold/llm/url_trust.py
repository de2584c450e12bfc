"""URL verdicts: rules first, then trust and distrust that spread over host links.

Hosts allowed by rules are trusted seeds of a personalised PageRank along links; hosts blocked by rules are seeds of one
against the links, so that hosts which link to them, directly or not, are distrusted. A host is blocked if its distrust
exceeds its trust, relatively: ranks shrink as hosts grow in number. Links between hosts are those in html, and optionally those between a host and its parent domain.
All is joins and sums over distinct host pairs; the ranks are cut by a checkpoint every few rounds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifold.llm.shared import HOT_KEYS, cut, spread_join


class Rule(NamedTuple):
    verdict: str  #: allow or block
    host: str
    path: str


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
DAMPING = 0.85
ROUNDS = 20
ROUNDS_PER_CUT = 5
#: Distrust counts as larger from this share of trust on; the sums' rounding is well below it.
MARGIN = 1e-9

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. A short list: it becomes one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda x: len(x.host + x.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, domains: bool = True) -> DataFrame:
    """Distinct (src, dst) of different hosts, from pages (host, html); with domains, also each host and its parent, both ways."""
    found = F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), found.alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    links = links.where("src <> dst").distinct()
    if not domains:
        return links
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    hosts = links.select(F.col("src").alias("host")).union(links.select("dst")).union(pages.select("host").where("host <> ''").distinct()).distinct()
    steps = hosts.withColumn("labels", labels).where("size(labels) > 2").withColumn("tails", tails)
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.size("tails") - 1), lambda i: F.struct(F.get("tails", i - 1).alias("a"), F.get("tails", i).alias("b"))))
    pairs = steps.select(pairs.alias("x")).select("x.a", "x.b").where("a <> '' and b <> ''").distinct()
    return links.union(pairs).union(pairs.select("b", "a")).distinct()


def spread(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of hosts that a seed reaches. seeds: host, trusted, blocked (booleans).

    Rank that reaches a host without further links ends there. No seeds of a kind give no ranks of that kind.
    """
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst").union(links.select(F.lit("distrust"), "dst", "src"))
    total = 2 * links.count()
    counts = edges.groupBy("kind", "src").agg(F.count("*").alias("_n"))
    # A host with a large share of all links has them in several parts, each of which gets a copy of its rank.
    parts = F.ceil(F.col("n") * HOT_KEYS / max(1, total)).cast("int")
    edges = spread_join(edges, counts.withColumn("n", F.col("_n")), ["kind", "src"], total)
    edges = cut(edges.select("kind", "src", "dst", (damping / F.col("n")).alias("share"), parts.alias("parts"), F.pmod(F.xxhash64("dst"), parts).cast("int").alias("part")))
    hot = F.broadcast(cut(edges.where("parts > 1").select("kind", F.col("src").alias("host"), "parts").distinct()))  # fewer than HOT_KEYS
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("trusted"), F.lit("trust")), F.when(F.col("blocked"), F.lit("distrust")))))
    own = seeds.select("host", kinds.alias("kind"))
    start = cut(own.join(own.groupBy("kind").agg(F.count("*").alias("n")), "kind").select("kind", "host", (1 / F.col("n")).alias("rank")))
    base = start.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))
    ranks = start
    for i in range(rounds):
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        known = ranks.join(hot, ["kind", "host"], "left").select("kind", F.col("host").alias("src"), "rank", copies)
        moved = edges.join(known, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        ranks = base.union(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % ROUNDS_PER_CUT == 0:
            ranks = cut(ranks)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judged_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, domains: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, host, path, rule (or null), verdict (allow or block).

    Without a rule, the host's verdict counts: block if distrust exceeds trust by more than MARGIN of it, however small
    both are, else allow; a host that no seed reaches is allowed, and so is an empty one. A null url, or one without
    `://`, has an empty host and path; a null html has no links. Repeated rows get equal verdicts.
    """
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("html").cast("string").alias("html"))
    parts = parts.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules))
    says = lambda verdict: F.coalesce(F.max(F.col("match.verdict") == verdict), F.lit(False))
    seeds = parts.where("host <> ''").groupBy("host").agg(says("allow").alias("trusted"), says("block").alias("blocked"))
    ranks = spread(cut(host_links(parts, domains)), seeds, rounds)
    bad = ranks.where(F.col("distrust") > F.col("trust") * (1 + MARGIN)).select("host", F.lit(True).alias("bad"))
    by_host = F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))
    # A host with many pages is one join key: its pages stay where they are.
    rows = parts.select("page_id", "host", "path", "match")
    hosts = rows.groupBy("host").agg(F.count("*").alias("_n")).join(cut(bad), "host", "left")
    told = spread_join(rows, hosts, ["host"], rows.count(), few=0)
    return told.select("page_id", "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", by_host).alias("verdict"))
