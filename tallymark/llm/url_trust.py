"""Page verdicts from rules and, where none fits, from trust over host links (operator 10).

Rules name a host and a path prefix and hold for the host and its subdomains; the
longest fitting one decides. They also make the seeds: a host is trusted, or
distrusted, by the share of its pages that rules allow, or block.

Trust flows along links from a host to the hosts it links to, distrust flows back from
a host to those that link to it; both are personalised PageRank with restarts at their
seeds. Links are absolute ``href`` targets, one per page and target host, and those
between a subdomain and the host above it, in both directions. A host's links share
what it passes on. A page without a rule is blocked if its host's distrust exceeds its
trust and at least ``LIMIT`` of what a fully blocked host without links would have.

Every iteration is one join and one aggregate over host rows; pages are read twice, to
collect links and to give verdicts. A host with very many pages or links is combined
before any shuffle. Ranks are written every ``WRITTEN`` iterations, which cuts lineage.

Null urls and urls without ``://`` have an empty host and path, fit no rule, take no part
in the graph and are allowed, as are hosts no evidence reaches. Repeated pages count each
time. Null html has no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.session import stage

#: ``(verdict, host, path)``, a bounded list of configuration.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
ITERATIONS = 15
WRITTEN = 5
LIMIT = 0.25

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"://([^/?#]*)([^?#]*)"
_HREF = r"""[hH][rR][eE][fF][ \t\r\n]*=[ \t\r\n]*["']?[A-Za-z][A-Za-z0-9+.-]*://([^/?#"'<> \t\r\n]*)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _by_length(rules):
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def _first_fit(host: Column, path: Column, rules, value) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(_by_length(rules)):
        verdict, name, prefix = rule
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, by_rule`` of every page."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    return parts.withColumn("rule", _first_fit(host, path, rules, lambda r: r[1] + r[2])).withColumn(
        "by_rule", _first_fit(host, path, rules, lambda r: r[0])
    )


def host_links(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``src, dst, n``: how many pages of a host link to another, and subdomain links."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))
    linked = (
        pages.select(host_of(F.col("url")).alias("src"), F.explode(targets).alias("dst"))
        .where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    )
    # A host of three or more labels belongs to the one without its first label.
    chain = F.expr(
        "transform(sequence(1, greatest(size(split(host, '[.]')) - 1, 1)), "
        "i -> array_join(slice(split(host, '[.]'), i, 1000), '.'))"
    )
    steps = hosts.where("size(split(host, '[.]')) > 2").select(chain.alias("c")).select(
        F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> struct(c[i - 1] AS child, c[i] AS parent))")).alias("s")
    ).select("s.child", "s.parent").distinct()
    family = steps.select(F.col("child").alias("src"), F.col("parent").alias("dst")).union(
        steps.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    )
    return linked.union(family.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def host_ranks(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """``host, trust, distrust`` from ``seeds(host, allowed, blocked)`` and ``links(src, dst, n)``."""
    ways = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(
        links.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n")
    )
    passed = ways.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    flows = stage(
        ways.join(passed, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all") * DAMPING).alias("share")),
        "host_flows",
    )
    restart = stage(
        seeds.select(
            "host", F.explode(F.create_map(F.lit("trust"), "allowed", F.lit("distrust"), "blocked")).alias("kind", "v")
        ).where("v > 0").select("kind", "host", (F.col("v") * (1 - DAMPING)).alias("score")),
        "host_seeds",
    )
    ranks = restart
    for step in range(1, ITERATIONS + 1):
        moved = flows.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("share") * F.col("score")).alias("score")
        )
        ranks = restart.union(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step % WRITTEN == 0 or step == ITERATIONS:
            ranks = stage(ranks, "host_ranks")

    def score(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)

    return ranks.groupBy("host").agg(score("trust"), score("distrust"))


def verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page."""
    known = stage(judged(pages, rules), "judged_pages")

    def part(verdict: str) -> Column:
        return F.avg(F.coalesce((F.col("by_rule") == verdict).cast("double"), F.lit(0.0)))

    seeds = stage(
        known.where("host <> ''").groupBy("host").agg(part("allow").alias("allowed"), part("block").alias("blocked")), "host_pages"
    )
    ranks = host_ranks(seeds, host_links(pages, seeds.select("host")))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= LIMIT * (1 - DAMPING))
    return known.join(ranks, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
