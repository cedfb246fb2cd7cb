"""URL filters by link-graph propagation.

A list of rules decides the urls it fits. All others are judged by their host: trust flows from hosts of allowed
pages along links (personalised PageRank), distrust flows from hosts of blocked pages against links (a page that
links to bad hosts is suspect). A host is blocked where distrust outweighs trust. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"(?i)<a\s[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path) of the rules in use
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of equally long rules, the first by name."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    found = none
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]))[::-1]:
        of_host, slash, rest = rule.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, w): how many pages of one host link to another; links within a host are none."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), 1)
    full = F.filter(links, lambda x: F.contains(x, F.lit("://")) | F.startswith(x, F.lit("//")))
    targets = F.transform(full, lambda x: host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit(":"), x)).otherwise(x)))
    return (
        pages.select(host_of(F.col(url)).alias("src"), F.explode(F.array_distinct(targets)).alias("dst"))
        .filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    )


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """``hosts`` (host, trust_seed, distrust_seed; seeds sum to one, or are all 0) with ``trust`` and ``distrust``.

    What a host without links would pass on goes back to the seeds. Rounds go on until no host moves by ``tolerance`` in the units
    of ``hosts``' columns ``trust_unit`` and ``distrust_unit`` (1 if there are none), however many that takes: each round
    moves all ranks together by at most ``damping`` times the round before. Only sums and the largest move come to the driver."""
    out = edges.groupBy("src").agg(F.sum("w").alias("total")).withColumnRenamed("src", "_h")
    into = edges.groupBy("dst").agg(F.sum("w").alias("total")).withColumnRenamed("dst", "_h")
    shares = written(
        edges.join(out, F.col("src") == F.col("_h")).select("src", "dst", "w", (F.col("w") / F.col("total")).alias("forward"))
        .join(into, F.col("dst") == F.col("_h")).select("src", "dst", "forward", (F.col("w") / F.col("total")).alias("backward")),
        "host-edges",
    )
    units = {c: F.col(c) if c in hosts.columns else F.lit(1.0) for c in ("trust_unit", "distrust_unit")}
    ranks = written(hosts.withColumns(units | {"trust": F.col("trust_seed"), "distrust": F.col("distrust_seed")}), "host-ranks")
    linked = not shares.isEmpty()  # without links every rank is its seed
    while linked:
        along = ranks.select("host", "trust").join(shares, F.col("host") == F.col("src")) \
            .select(F.col("dst").alias("to"), (F.col("trust") * F.col("forward")).alias("t"), F.lit(0.0).alias("d"))
        against = ranks.select("host", "distrust").join(shares, F.col("host") == F.col("dst")) \
            .select(F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("backward")).alias("d"))
        parts = written(along.unionByName(against).groupBy("to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "host-parts")
        t, d = parts.agg(F.sum("t"), F.sum("d")).first()

        def step(part, seed, passed):
            return damping * F.coalesce(part, F.lit(0.0)) + (1 - damping * (passed or 0.0)) * F.col(seed)

        new_trust, new_distrust = step(F.col("t"), "trust_seed", t), step(F.col("d"), "distrust_seed", d)
        after = written(
            ranks.join(parts, F.col("host") == F.col("to"), "left").select(
                "host", "trust_seed", "distrust_seed", "trust_unit", "distrust_unit", new_trust.alias("trust"), new_distrust.alias("distrust"),
                F.greatest(F.abs(new_trust - F.col("trust")) * F.col("trust_unit"),
                           F.abs(new_distrust - F.col("distrust")) * F.col("distrust_unit")).alias("moved")),
            "host-ranks",
        )
        moved = after.agg(F.max("moved")).first()[0]
        discard(ranks, parts)
        ranks = after
        linked = bool(moved) and moved >= tolerance
    discard(shares)
    return ranks.select("host", "trust_seed", "distrust_seed", "trust", "distrust")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, key: str = "page_id", url: str = "url",
               html: str = "html", least_distrust: float = 0.25, **settings) -> DataFrame:
    """Per page: key, ``host``, ``path``, ``rule`` (null: none fits), ``verdict``, ``host_trust``, ``host_distrust``.

    A host's seeds are its pages that rules allow or block. Its trust and distrust are put in seed pages per page of
    its own: without any links they are the shares of its pages that rules allow and block. A host is blocked if its
    distrust is the larger and at least ``least_distrust``.

    * a null url, or one without ``://``, has an empty host and path and fits no rule; such pages are allowed
    * null or empty html has no links; pages of any length are read whole
    * repeated rows count and return as often as they stand; null keys stay; equal trust and distrust allow
    * an empty table gives no rows; other columns play no part, whatever their names
    """
    rules = RULES if rules is None else rules
    host, path = host_of(F.col(url)), path_of(F.col(url))
    known = pages.select(F.col(key), host.alias("host"), path.alias("path")) \
        .withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    counted = known.groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("_rule.verdict") == "allow").alias("allowed"),
        F.count_if(F.col("_rule.verdict") == "block").alias("blocked"))
    edges = written(host_edges(pages, url, html), "host-links")
    linked = edges.select(F.col("dst").alias("host"), F.lit(0).cast("long").alias("pages"),
                          F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked"))
    hosts = written(counted.unionByName(linked).groupBy("host").agg(
        F.sum("pages").alias("pages"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "hosts")
    good, bad = hosts.agg(F.sum("allowed"), F.sum("blocked")).first()
    good, bad = max(good or 0, 1), max(bad or 0, 1)
    own = F.greatest("pages", F.lit(1))
    # moves are counted in what a verdict compares: seed pages per page of the host
    seeds = hosts.select("host", (F.col("allowed") / good).alias("trust_seed"), (F.col("blocked") / bad).alias("distrust_seed"),
                         (good / own).alias("trust_unit"), (bad / own).alias("distrust_unit"))
    ranks = propagate(seeds, edges, **settings)
    judged = written(
        ranks.withColumnRenamed("host", "_host").join(hosts, F.col("_host") == F.col("host"))
        .select("_host", (F.col("trust") * good / own).alias("host_trust"), (F.col("distrust") * bad / own).alias("host_distrust")),
        "host-verdicts",
    )
    suspect = (F.col("host_distrust") > F.col("host_trust") + 1e-9) & (F.col("host_distrust") >= least_distrust) & (F.col("host") != "")
    return known.join(judged, F.col("host") == F.col("_host"), "left").select(
        key, "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(suspect, "block").otherwise("allow")).alias("verdict"),
        "host_trust", "host_distrust")
