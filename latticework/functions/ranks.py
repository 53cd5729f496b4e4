"""Row numbers and running totals of a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def _placed(df: DataFrame, order: tuple) -> DataFrame:
    """df, sorted in ranges where an order is given, stored with part (its range) and at (its place there)."""
    d = (df.orderBy(*order) if order else df).withColumn("at", F.monotonically_increasing_id())
    return stored(d.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "placed")


def _before(parts: DataFrame, what: Column) -> DataFrame:
    """(part, before): the total over the ranges before each; a row for each range meets here."""
    sums = parts.groupBy("part").agg(what.alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")))


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with rn from 0, in the given order (else in the table's own, as ORDER BY left it)."""
    d = _placed(df, order)
    return d.join(_before(d, F.count("*")), "part").withColumn("rn", F.col("before") + F.col("at")).drop("part", "at", "before")


def cumulative(df: DataFrame, value: str, *order) -> DataFrame:
    """df with rn from 0 and running, the sum of value up to the row."""
    d = _placed(df, order)
    counts, sums = _before(d, F.count("*")), _before(d, F.sum(value)).withColumnRenamed("before", "sum_before")
    inside = F.sum(value).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    out = d.join(counts, "part").join(sums, "part").withColumn("running", F.col("sum_before") + inside)
    return out.withColumn("rn", F.col("before") + F.col("at")).drop("part", "at", "before", "sum_before")
