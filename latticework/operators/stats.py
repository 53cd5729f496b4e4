"""Column and join-key statistics, samples and bitmaps, random walks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import numbered
from ..functions.scalars import sha1_bucket
from ..plans.sqlfront import Graph
from ..sources.tables import stored, table


def _ends(c: str) -> list[Column]:
    return [(F.min(c).try_cast("double") + 0.0).alias("min_value"), F.max(c).try_cast("double").alias("max_value")]


def _by_column(spark: SparkSession, sf_dir: str, columns: list[tuple[str, str]], values: Callable[[str], list[Column]]) -> DataFrame:
    """(col, *values): aggregates of each column, one pass over each table."""
    out = []
    for t in sorted({t for t, _ in columns}):
        some = sorted({c for x, c in columns if x == t})
        every = F.array(*[F.struct(F.lit(f"{t}.{c}").alias("col"), *values(c)) for c in some])
        out.append(table(spark, sf_dir, t).agg(every.alias("all")).select(F.explode("all").alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, out)


def column_ends(spark: SparkSession, sf_dir: str, columns: list[tuple[str, str]]) -> DataFrame:
    """(col, min_value, max_value): column_stats without what needs a row for each distinct value."""
    return _by_column(spark, sf_dir, columns, _ends)


def column_stats(spark: SparkSession, sf_dir: str, columns: list[tuple[str, str]]) -> DataFrame:
    """(col, min_value, max_value, num_values, total_values): extremes of non-null numbers, distinct values with null as one, rows; one pass over each table."""
    counts = lambda c: [
        (F.countDistinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0))).alias("num_values"), F.count("*").alias("total_values"),
    ]
    return _by_column(spark, sf_dir, columns, lambda c: [*_ends(c), *counts(c)])


def join_key_stats(spark: SparkSession, sf_dir: str, columns: list[tuple[str, str]]) -> DataFrame:
    """Frequencies of a key: largest, least, mean, sample variance, rows, distinct keys, null share; null is a group of its own."""
    def one(t, c):
        per = table(spark, sf_dir, t).groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"))
        nulls = F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0))
        return per.agg(
            F.lit(f"{t}.{c}").alias("col"), F.max("n").alias("max_key"), F.min("n").alias("min_key"), F.round(F.avg("n"), 6).alias("avg_key"), F.round(F.var_samp("n"), 6).alias("var_key"),
            (F.sum("n") - nulls).cast("long").alias("count"), F.count("k").alias("distinct"), F.round(nulls / F.sum("n"), 6).alias("null_frac"),
        )

    return reduce(DataFrame.unionByName, [one(t, c) for t, c in columns])


def most_common(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def hash_sample(df: DataFrame, key: str, keep: int, of: int) -> DataFrame:
    """Rows whose key's hash falls into the first `keep` of `of` buckets: the same keys in every table and engine."""
    return df.where(sha1_bucket(F.col(key).cast("string"), of) < keep)


def bitmap(sample: DataFrame, key: str, predicate: str) -> DataFrame:
    """(bits): the sorted keys of the sample's rows that satisfy the predicate."""
    return sample.where(predicate).agg(F.array_sort(F.collect_set(key)).alias("bits"))


#: Steps of a hashed choice: more than rows of a key, or choices among many rows are uneven.
STEPS = 2**31 - 1


def wander(spark: SparkSession, sf_dir: str, g: Graph, path: list[str], walks: int, seed: int, compat_tree: bool = False) -> DataFrame:
    """(subplan, est, half_interval, n_walks) by prefix of a path of aliases: Horvitz-Thompson estimates of COUNT(*) from random walks.

    All walks step together: a walk meets its key's row count, picks a row number, and meets that row; its weight grows
    by the count. Dead ends weigh 0. Edges that close a cycle must hold, else the walk weighs 0 (compat_tree: ignored).
    """
    def filtered(alias: str) -> DataFrame:
        d = table(spark, sf_dir, g.tables[alias]).alias(alias)
        for p in g.preds.get(alias, []):
            d = d.where(p)
        cols = sorted({j.left[1] if j.left[0] == alias else j.right[1] for j in g.joins if alias in (j.left[0], j.right[0])})
        return d.select(*[F.col(c).alias(f"{alias}__{c}") for c in cols])

    def reached(alias: str, col: str, keys: DataFrame) -> DataFrame:
        """The rows that walks can step to, numbered within their key: only of keys that walks hold, which are no more than the walks."""
        d = filtered(alias)
        d = d.join(F.broadcast(keys), F.col(f"{alias}__{col}") == F.col("k"), "left_semi")
        part = Window.partitionBy(f"{alias}__{col}")
        return d.withColumn("rn", F.row_number().over(part.orderBy(*d.columns)) - 1).withColumn("cnt", F.count("*").over(part))

    rows = numbered(filtered(path[0]))
    size = rows.count()
    pick = lambda step: sha1_bucket(F.concat_ws(" ", F.lit(f"{seed} {step}"), "walk"), STEPS) / F.lit(float(STEPS))
    w = spark.range(walks).withColumnRenamed("id", "walk").withColumn("rn", F.floor(pick(0) * size)).withColumn("w", F.lit(float(size)))
    w = stored(F.broadcast(w).join(rows, "rn").drop("rn"), "walks")
    seen, out = [path[0]], []
    for step, alias in enumerate(path[1:], 1):
        edges = [(j.left, j.right) if j.right[0] == alias else (j.right, j.left) for j in g.joins if alias in (j.left[0], j.right[0]) and {j.left[0], j.right[0]} - {alias} <= set(seen)]
        (_, (_, col)), closing = edges[0], edges[1:]
        left = edges[0][0]
        rows = reached(alias, col, w.select(F.col(f"{left[0]}__{left[1]}").alias("k")).distinct())
        counts = rows.where("rn = 0").select(F.col(f"{alias}__{col}").alias("k"), "cnt")
        w = w.join(counts, F.col(f"{left[0]}__{left[1]}") == F.col("k")).drop("k").withColumn("pick", F.floor(pick(step) * F.col("cnt"))).withColumn("w", F.col("w") * F.col("cnt")).drop("cnt")
        w = w.join(rows.drop("cnt"), (F.col(f"{left[0]}__{left[1]}") == F.col(f"{alias}__{col}")) & (F.col("pick") == F.col("rn"))).drop("pick", "rn")
        for a, b in [] if compat_tree else closing:
            w = w.where(F.col(f"{a[0]}__{a[1]}") == F.col(f"{b[0]}__{b[1]}"))
        seen.append(alias)
        w = stored(w, "walks")
        n, mean = F.lit(float(walks)), F.coalesce(F.sum("w"), F.lit(0.0)) / walks
        var = F.greatest(F.lit(0.0), F.coalesce(F.sum(F.col("w") ** 2), F.lit(0.0)) / n - mean * mean)
        out.append(w.agg(F.lit(" ".join(sorted(seen))).alias("subplan"), F.ceil(mean).cast("double").alias("est"), (2.576 * F.sqrt(var / n)).alias("half_interval")))
    return reduce(DataFrame.unionByName, out).withColumn("n_walks", F.lit(walks).cast("long"))


def find_path(g: Graph, cards: DataFrame) -> list[str]:
    """Aliases for walks: first the one whose predicates drop most rows, then along joins, again by rows dropped; ties by name."""
    lost = {r["subplan"]: r["total"] - r["actual"] if g.preds.get(r["subplan"]) else 0 for r in cards.where("n_tables = 1").collect()}
    path = [max(g.tables, key=lambda a: (lost[a], a))]
    while len(path) < len(g.tables):
        near = set().union(*(g.neighbours(a) for a in path)) - set(path)
        if not near:
            break
        path.append(max(near, key=lambda a: (lost[a], a)))
    return path
