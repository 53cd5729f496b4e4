"""Estimators and metrics over subplans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import sha1_bucket
from ..plans.lattice import SEP
from ..plans.sqlfront import Graph
from ..sources.tables import memo, table


def q_error(est: Column, true: Column) -> Column:
    """max(y / e, e / y); values of 0 or less count as 1."""
    e, y = F.when(est <= 0, 1.0).otherwise(est), F.when(true <= 0, 1.0).otherwise(true)
    return F.greatest(e / y, y / e)


def summary(values: DataFrame, col: str) -> DataFrame:
    """mean, median, 90th and 99th percentile by linear interpolation."""
    p = lambda q: F.round(F.percentile(F.col(col).cast("double"), F.lit(q)), 6)
    return values.agg(F.round(F.avg(col), 6).alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


def distinct_values(spark: SparkSession, sf_dir: str, columns: set[tuple[str, str]]) -> DataFrame:
    """(t, c, d): the number of distinct values of columns, one pass over each table."""
    out = []
    for t in sorted({t for t, _ in columns}):
        some = sorted(c for x, c in columns if x == t)
        one = table(spark, sf_dir, t).agg(*[F.countDistinct(c).alias(c) for c in some])
        out.append(one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c"), F.col(c).alias("d")) for c in some])).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, out)


def independence_of(spark: SparkSession, sf_dir: str, graphs: dict[str, Graph], cards: DataFrame, plans: DataFrame) -> DataFrame:
    """(query_id, subplan, est): product of filtered table counts, over the larger number of distinct keys of each join edge."""
    single = cards.where("n_tables = 1").select("query_id", F.col("subplan").alias("alias"), F.col("actual").alias("f"))
    base = plans.withColumn("alias", F.explode("nodes")).join(single, ["query_id", "alias"]).groupBy("query_id", "subplan").agg(F.sum(F.log("f")).alias("up"))
    sides = [(q, i, a, g.tables[a], c) for q, g in graphs.items() for i, j in enumerate(g.joins) for a, c in (j.left, j.right)]
    columns = {(t, c) for *_, t, c in sides}
    ndv = memo(spark, f"distinct values {sf_dir} {sorted(columns)}", lambda: distinct_values(spark, sf_dir, columns))
    e = spark.createDataFrame(sides, "query_id string, i int, a string, t string, c string").join(ndv, ["t", "c"])
    e = e.groupBy("query_id", "i").agg(F.collect_set("a").alias("ab"), F.max("d").alias("d"))
    inside = plans.join(F.broadcast(e), "query_id").where(F.size(F.array_except("ab", "nodes")) == 0)
    down = inside.groupBy("query_id", "subplan").agg(F.sum(F.log("d")).alias("down"))
    return base.join(down, ["query_id", "subplan"], "left").select("query_id", "subplan", F.round(F.exp(F.col("up") - F.coalesce("down", F.lit(0.0))), 4).alias("est"))


def independence(spark: SparkSession, sf_dir: str, g: Graph, cards: DataFrame, plans: DataFrame) -> DataFrame:
    """(subplan, est) of one query."""
    one = lambda d: d.withColumn("query_id", F.lit(""))
    return independence_of(spark, sf_dir, {"": g}, one(cards), one(plans)).drop("query_id")


def rank_repair(cards: DataFrame, est: DataFrame, by_tables: bool = False) -> DataFrame:
    """Estimates made to rise with the true rank: the running maximum in order of true cardinality, ties by name."""
    w = Window.partitionBy(*(["n_tables"] if by_tables else [F.lit(0)])).orderBy("actual", "subplan").rowsBetween(Window.unboundedPreceding, 0)
    return cards.join(est, "subplan").select("subplan", F.max("est").over(w).alias("est"))


#: Steps of a hashed share.
STEPS = 9973


def _share(seed: int) -> Column:
    """A number from 0 to 1 that a subplan's name and a seed give, the same in any engine and partitioning."""
    return sha1_bucket(F.concat_ws(" ", F.lit(str(seed)), "subplan"), STEPS) / F.lit(float(STEPS))


def noisy(cards: DataFrame, percent: float, seed: int) -> DataFrame:
    """True cardinalities less up to `percent` of themselves; at least 1."""
    return cards.select("subplan", F.round(F.greatest(F.lit(1.0), F.col("actual") * (1 - _share(seed) * percent / 100)), 4).alias("est"))


def random_share(cards: DataFrame, seed: int) -> DataFrame:
    """A hashed share of the unfiltered count."""
    return cards.select("subplan", F.round(_share(seed) * F.col("total"), 4).alias("est"))


def join_key_estimate(cards: DataFrame, plans: DataFrame, links: DataFrame, key_counts: DataFrame, levels: int) -> DataFrame:
    """(subplan, est): from pairs of tables upward, min(r1, r2) * R1 / r1 * R2 / r2 by edge, the largest over edges.

    key_counts: (child, added, r1, r2), the numbers of join keys on both sides of an edge.
    """
    known = cards.where("n_tables <= 2").select("subplan", F.col("actual").cast("double").alias("est"))
    single = known.where(~F.col("subplan").contains(SEP)).select(F.col("subplan").alias("added"), F.col("est").alias("added_est"))
    out, now = known, known
    for n in range(3, levels + 1):
        e = links.where(F.col("n_tables") == n).join(now.select(F.col("subplan").alias("child"), "est"), "child").join(single, "added").join(key_counts, ["child", "added"])
        now = e.groupBy(F.col("parent").alias("subplan")).agg(F.max(F.least("r1", "r2") * F.col("est") / F.col("r1") * F.col("added_est") / F.col("r2")).alias("est"))
        out = out.unionByName(now)
    return out


def constraint_errors(links: DataFrame, est: DataFrame, keys: DataFrame) -> DataFrame:
    """(fk_errors, id_errors, mean_error), by query: what the estimates break of keys' logic.

    keys: (child, added, f), by query, one row for each join by which an edge adds a table through its primary key; f: the largest
    number of rows that the other side has for a key. Such a parent has at most f rows for each row of the added table
    (else a foreign-key error) and no more rows than its child (else an id error). mean_error: share of subplans with an id error.
    """
    q = [c for c in ("query_id",) if c in links.columns]
    e = lambda c: est.select(*q, F.col("subplan").alias(c), F.col("est").alias(f"{c}_est"))
    d = links.join(keys, [*q, "child", "added"])
    for c in ("parent", "child", "added"):
        d = d.join(e(c), [*q, c])
    d = d.select(*q, "parent", (F.col("parent_est") > F.col("f") * F.col("added_est")).cast("long").alias("fk"), (F.col("child_est") < F.col("parent_est")).cast("long").alias("id"))
    by_node = est.select(*q, F.col("subplan").alias("parent")).join(d, [*q, "parent"], "left").groupBy(*q, "parent").agg(F.sum("fk").alias("fk"), F.sum("id").alias("id"))
    return by_node.groupBy(*q).agg(
        F.coalesce(F.sum("fk"), F.lit(0)).alias("fk_errors"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_errors"), F.round(F.avg((F.coalesce("id", F.lit(0)) > 0).cast("double")), 6).alias("mean_error")
    )


#: Errors of an estimate by name: of columns est and actual.
METRICS = {
    "qerr": lambda e, y: q_error(e, y),
    "abs": lambda e, y: F.abs(e - y),
    "rel": lambda e, y: F.abs(y - e) / F.when(y <= 0, 1.0).otherwise(y),
    "mse": lambda e, y: F.pow(e - y, F.lit(2.0)),
}


def errors(est: DataFrame, cards: DataFrame, metric: str) -> DataFrame:
    """est joined to cards by query and subplan, with error: the metric's value."""
    q = [c for c in ("query_id",) if c in est.columns]
    return est.join(cards, [*q, "subplan"]).withColumn("error", METRICS[metric](F.col("est"), F.col("actual").cast("double")))


def relative_costs(chosen: DataFrame, best: DataFrame, by: list[str]) -> DataFrame:
    """(queries, relative, excess), by the columns given: all chosen plans' cost over all best ones', and the mean difference.

    chosen and best: (query_id, cost), chosen with the columns of `by`.
    """
    d = chosen.join(best.select("query_id", F.col("cost").alias("opt")), "query_id")
    return d.groupBy(*by).agg(F.count("*").alias("queries"), F.round(F.sum("cost") / F.sum("opt"), 4).alias("relative"), F.round(F.avg(F.col("cost") - F.col("opt")), 2).alias("excess"))
