"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh

#: (host, path, action) of the production rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rule sets of up to this many rows are broadcast (a rule takes well under 1 kB); larger ones are shuffled.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or end, A-Z lower-cased. Path: from there up to ?, # or end. Both empty without ://."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_filter(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict added (columns of these names are replaced).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest rule
    string wins, then the longer host, then block. Without a rule: rule null, verdict `default`.

    Each distinct (host, path) is expanded to host suffixes by label and to path prefixes, only of the
    label counts and path lengths that occur among the rules, so the number of expressions per url is
    bounded by the rule set and not by the url. Expressions meet rules on the first 8 hex digits of
    SHA-256; full digests confirm. Null urls and urls without :// have host and path empty and meet
    no rule. Repeated rows stay, an empty table gives an empty one, other columns pass through, whatever their names. An empty
    set of rules fits nothing. A hot host or url is one row before it meets the rules, and a split join brings verdicts back.
    """
    r = (
        rules.where(F.col("host").isNotNull() & (F.col("host") != ""))
        .select(F.translate("host", UPPER, LOWER).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), "action")
        .groupBy("rh", "rp")
        .agg(F.max("action").alias("action"))  # block wins over allow
        .withColumn("digest", _digest(F.col("rh"), F.col("rp")))
        .withColumn("short", F.substring("digest", 1, 8))
    )
    facts = r.agg(
        F.count("*").alias("n"), F.collect_set(F.size(F.split("rh", "\\."))).alias("labels"), F.collect_set(F.length("rp")).alias("lengths")
    ).first()
    added = ["host", "path", "rule", "verdict"]
    passed = [c for c in df.columns if c.lower() not in added]
    url, *own = fresh(added, "url", *[f"c{i}" for i in range(len(passed))])  # names of other columns mean nothing on the way
    base = df.select(col(url_col).alias(url), *[col(c).alias(n) for c, n in zip(passed, own, strict=True)])
    host, path = host_path(F.col(url))
    base = base.withColumns({"host": host, "path": path}).drop(url)
    if facts["n"] == 0:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}).toDF(*passed, *added)
    keys = base.select("host", "path").where(F.col("host") != "").distinct()
    labels, n = F.split("host", "\\."), F.size(F.split("host", "\\."))
    counts = F.array(*[F.lit(c) for c in sorted(facts["labels"])])
    lengths = F.array(*[F.lit(c) for c in sorted(facts["lengths"])])
    suffixes = F.transform(F.filter(counts, lambda c: c <= n), lambda c: F.array_join(F.slice(labels, n - c + 1, c), "."))
    prefixes = F.transform(F.filter(lengths, lambda c: c <= F.length("path")), lambda c: F.substring(F.col("path"), F.lit(1), c))
    found = (
        keys.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("d", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("d", 1, 8))
    )
    side = F.broadcast(r) if facts["n"] <= BROADCAST_RULES else r
    best = (
        found.join(side, "short")
        .where(F.col("d") == F.col("digest"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length(F.concat("rh", "rp")).alias("len"), F.length("rh").alias("hlen"), (F.col("action") == "block").alias("blocks"),
                    F.concat("rh", "rp").alias("rule"), F.col("action"),
                )
            ).alias("best")
        )
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("verdict"))
    )
    out = base.join(best, ["host", "path"], "left")
    return out.select(*own, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")).toDF(*passed, *added)
