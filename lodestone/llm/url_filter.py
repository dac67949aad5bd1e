"""URL filter: rules by host and path, and trust that spreads over links.

A host is trusted by the share of its ruled pages that rules allow and
distrusted by the share that they block; a host may be both. Trust walks
along links (personalised PageRank from the allowed hosts), distrust walks
against them (who links to blocked hosts is suspect). Scores are whole numbers,
so that sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import no_rows, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The score a seed starts with; sums stay exact up to nine billion seeds.
UNIT = 10**9
#: Share of a score that walks on, in percent.
WALKS = 85
#: Rounds that the SQL form writes out; ``spread`` goes on until nothing changes.
ROUNDS = 8
#: Rounds after which the scores are stored and compared, so that plans stay short.
STORED_EVERY = 4
#: A host is blocked when its distrust exceeds its trust and this.
LEAST_DISTRUST = UNIT // 50

LINK = "(?i)href\\s*=\\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\\s>]+)"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules as ``rule_host, rule_path, rule, verdict`` from pairs of verdict and ``host/path``."""
    rows = spark.createDataFrame(list(rules), "verdict string, rule string")
    return rows.select(
        F.regexp_extract("rule", "^[^/]*", 0).alias("rule_host"),
        F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("rule_path"),
        "rule",
        "verdict",
    )


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` and ``rules``, those that name it or a parent of it, the longest first."""
    labels = F.split("host", "\\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    fitting = hosts.select("host", F.explode(parents).alias("rule_host")).join(rules, "rule_host")
    order = F.struct(
        (-F.length("rule")).alias("longest"), "rule", "rule_path", F.col("verdict").alias("rule_verdict")
    )
    return fitting.groupBy("host").agg(F.sort_array(F.collect_set(order)).alias("rules"))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts, ``src`` and ``dst``; relative links stay on their host."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(links)).alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return (
        found.select("src", host_of(target).alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst")
        .distinct()
    )


def spread(links: DataFrame, seeds: DataFrame, source: str, target: str) -> DataFrame:
    """Personalised PageRank of ``seeds`` (``host, share, n``) over ``links`` from ``source`` to ``target``: ``host, score``.

    A seed starts with ``share`` of ``n`` parts of what a full seed has.

    Rounds go on until no score changes. From the seeds alone no score ever
    falls and all are bounded, and as scores are whole numbers, that point is
    reached; equal sums then mean equal scores.
    """
    start = seeds.select("host", F.expr(f"{UNIT * (100 - WALKS) // 100}L * share div n").alias("score"))
    if no_rows(links):
        return start
    degree = links.groupBy(source).agg(F.count("*").alias("degree"))
    edges = stored(links.join(degree, source), "links")
    scores, before = start, None
    while True:
        for _ in range(STORED_EVERY):
            passed = scores.join(edges, F.col("host") == F.col(source)).select(
                F.col(target).alias("host"), F.expr(f"score div degree * {WALKS} div 100").alias("score")
            )
            scores = start.union(passed).groupBy("host").agg(F.sum("score").alias("score"))
        scores = stored(scores, "scores")
        after = scores.agg(F.sum("score")).first()[0]
        if after == before:
            return scores
        before = after


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``pages``.

    The longest rule that fits decides; ``rule`` is null where none fits, and the
    verdict is then block where the host's distrust exceeds its trust and
    ``LEAST_DISTRUST``, else allow; pages of the same host without a rule follow
    the rules of the others, and links carry both to further hosts. A null url or one without ``://`` has an empty
    host and path, no rule, and is allowed. Repeated rows are judged each.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = own.select("host").distinct()
    ruled = stored(rules_by_host(hosts, rules), "ruled-hosts")
    fitting = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    judged = own.join(ruled, "host", "left").withColumn("fit", fitting)
    by_host = (
        judged.filter("fit IS NOT NULL")
        .groupBy("host")
        .agg(F.count_if(F.col("fit.rule_verdict") == "allow").alias("allowed"), F.count("*").alias("n"))
    )
    links = stored(host_links(pages), "host-links")
    by_host = stored(by_host, "seeds")
    trust = spread(links, by_host.filter("allowed > 0").selectExpr("host", "allowed AS share", "n"), "src", "dst")
    distrust = spread(links, by_host.filter("allowed < n").selectExpr("host", "n - allowed AS share", "n"), "dst", "src")
    scores = (
        trust.withColumnRenamed("score", "trust")
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "full")
        .select("host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    )
    found = judged.join(stored(scores, "scores"), "host", "left")
    suspect = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= LEAST_DISTRUST)
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.when(F.col("fit").isNotNull(), F.col("fit.rule_verdict"))
        .when(F.coalesce(suspect, F.lit(False)), "block")
        .otherwise("allow")
        .alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"),
        F.coalesce("distrust", F.lit(0)).alias("distrust"),
    )
