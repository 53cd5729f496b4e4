"""Features of a workload's subplans: what its queries hold, in layouts of fixed order that models read.

Layouts are as wide as the workload's tables, joins and filtered columns are many, and live on the driver; all values are
computed where the rows are. Two forms: sets (an array of vectors each for a subplan's tables, joins and predicates)
and one combined vector.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import char_ngrams, min_max, sha1_bucket
from ..plans.sqlfront import Graph, predicates

KEY_STATS = ("max_key", "min_key", "avg_key", "var_key", "count", "distinct", "null_frac")


def predicate_rows(spark: SparkSession, graphs: dict[str, Graph]) -> DataFrame:
    """(query_id, pos, alias, c, kind, vals): the predicates on single columns, c as table.column; pos is their order within a query."""
    rows = [(q, i, p.alias, f"{g.tables[p.alias]}.{p.column}", p.kind, list(p.values)) for q, g in graphs.items() for i, p in enumerate(predicates(g)) if p.column]
    return spark.createDataFrame(rows, "query_id string, pos int, alias string, c string, kind string, vals array<string>")


def edge_name(g: Graph, j) -> str:
    """A join by its real columns, sorted, so that it is one under any aliases."""
    return "=".join(sorted(f"{g.tables[a]}.{c}" for a, c in (j.left, j.right)))


def join_rows(spark: SparkSession, graphs: dict[str, Graph]) -> DataFrame:
    """(query_id, l, r, edge): the equi-joins with their aliases."""
    rows = [(q, j.left[0], j.right[0], edge_name(g, j)) for q, g in graphs.items() for j in g.joins]
    return spark.createDataFrame(rows, "query_id string, l string, r string, edge string")


def table_rows(spark: SparkSession, graphs: dict[str, Graph]) -> DataFrame:
    """(query_id, alias, t)"""
    return spark.createDataFrame([(q, a, t) for q, g in graphs.items() for a, t in g.tables.items()], "query_id string, alias string, t string")


@dataclass(frozen=True)
class Layout:
    """The places of a workload's features. buckets and like_buckets: cells for hashed constants and for hashed runs of LIKE patterns."""

    tables: tuple[str, ...]
    edges: tuple[str, ...]
    columns: tuple[str, ...]
    kinds: tuple[str, ...]
    buckets: int = 10
    like_buckets: int = 10

    def value_names(self) -> list[str]:
        """Cells of a predicate's constants."""
        hashed = [f"bucket {i}" for i in range(self.buckets)] + [f"like {i}" for i in range(self.like_buckets)]
        return ["low", "high", *hashed, "length", "digit"]

    def predicate_names(self) -> list[str]:
        return [f"column {c}" for c in self.columns] + [f"kind {k}" for k in self.kinds] + self.value_names()

    def join_names(self) -> list[str]:
        stats = [f"{side} {s}" for side in ("first", "second") for s in KEY_STATS]
        return [f"join {e}" for e in self.edges] + ["primary", "no primary", "self", "distinct ratio", *stats]

    def combined_names(self) -> list[str]:
        return [f"table {t}" for t in self.tables] + [f"join {e}" for e in self.edges] + [f"{c} {n}" for c in self.columns for n in self.value_names()]


def layout(graphs: dict[str, Graph], buckets: int = 10, like_buckets: int = 10) -> Layout:
    """The layout that a workload needs, all names in order."""
    every = [(g, p) for g in graphs.values() for p in predicates(g) if p.column]
    return Layout(
        tuple(sorted({t for g in graphs.values() for t in g.tables.values()})), tuple(sorted({edge_name(g, j) for g in graphs.values() for j in g.joins})),
        tuple(sorted({f"{g.tables[p.alias]}.{p.column}" for g, p in every})), tuple(sorted({p.kind for _, p in every})), buckets, like_buckets,
    )


def maxima(tables: DataFrame, joins: DataFrame, preds: DataFrame) -> DataFrame:
    """(max_tables, max_joins, max_preds, max_values) of any query: the padded sizes of sets, 2 at least; values are no fewer than predicates."""
    n = tables.groupBy("query_id").agg(F.count("*").alias("t"))
    j = joins.groupBy("query_id").agg(F.count("*").alias("j"))
    p = preds.groupBy("query_id").agg(F.count("*").alias("p"), F.sum(F.size("vals")).alias("v"))
    two = lambda c: F.greatest(F.lit(2).cast("long"), F.coalesce(F.max(c), F.lit(0).cast("long")))
    d = n.join(j, "query_id", "left").join(p, "query_id", "left").agg(two("t").alias("max_tables"), two("j").alias("max_joins"), two("p").alias("max_preds"), two("v").alias("v"))
    return d.select("max_tables", "max_joins", "max_preds", F.greatest("max_preds", "v").alias("max_values"))


def seen(preds: DataFrame) -> DataFrame:
    """(c, value): the constants that queries, those of training, compare a column with."""
    return preds.select("c", F.explode("vals").alias("value")).where("value IS NOT NULL").distinct()


def label_range(cards: DataFrame, limit: float | None = None) -> DataFrame:
    """(low, high): extremes of log rows; counts of 0 move all of them up by 1. limit: counts from there on are timeouts and take the largest below."""
    y = F.col("actual")
    if limit is not None:
        cards = cards.crossJoin(F.broadcast(cards.where(y < limit).agg(F.max(y).alias("top")))).withColumn("actual", F.when(y >= limit, F.col("top")).otherwise(y))
    ends = cards.agg(F.min(y).alias("low"), F.max(y).alias("high"), F.max((y == 0).cast("int")).alias("up"))
    return ends.select(F.log(F.col("low") + F.col("up")).alias("low"), F.log(F.col("high") + F.col("up")).alias("high"))


def _hot(c: str, names: tuple[str, ...]) -> list[Column]:
    return [(F.col(c) == n).cast("double") for n in names]


def _cells(held: Column, n: int) -> Column:
    """n cells, 1 where the array holds the cell's number."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(held, i.cast("long")).cast("double"))


def predicate_vectors(preds: DataFrame, lay: Layout, ranges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """preds with vec, in the order of lay.predicate_names(), and cells, of lay.value_names().

    Ranges are scaled to a column's extremes (ranges: col, min_value, max_value); an open end is the column's own. Constants
    of = and IN are hashed; known (c, value): only these are, and patterns of columns outside it are left blank.
    LIKE patterns are hashed whole and by runs of one to three characters, without %.
    """
    ends = ranges.select(F.col("col").alias("c"), F.col("min_value").alias("lo"), F.col("max_value").alias("hi"))
    d = preds.join(F.broadcast(ends), "c", "left")
    kept = d.select("query_id", "pos", "c", F.explode("vals").alias("value"))
    if known is not None:
        kept = kept.join(known, ["c", "value"], "left_semi")
    kept = kept.groupBy("query_id", "pos").agg(F.collect_list("value").alias("kept"))
    d = d.join(kept, ["query_id", "pos"], "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<string>")))
    if known is not None:
        d = d.join(F.broadcast(known.select("c").distinct().withColumn("met", F.lit(True))), "c", "left").withColumn("met", F.coalesce("met", F.lit(False)))
    else:
        d = d.withColumn("met", F.lit(True))
    is_range, is_like = F.col("kind") == "lt", F.col("kind").isin("like", "ilike", "nlike") & F.col("met")
    end = lambda i, other: F.when(is_range, min_max(F.coalesce(F.get("vals", i).try_cast("double"), F.col(other)), F.col("lo"), F.col("hi"))).otherwise(0.0)
    none = F.array().cast("array<long>")
    constants = F.when(F.col("kind").isin("eq", "in"), F.transform("kept", lambda v: sha1_bucket(v, lay.buckets))).otherwise(none)
    text = F.regexp_replace(F.get("vals", 0), "%", "")
    runs = F.concat(F.array(text), *[char_ngrams(text, n) for n in (1, 2, 3)])
    likes = F.when(is_like, F.transform(runs, lambda v: sha1_bucket(v, lay.like_buckets))).otherwise(none)
    more = [F.when(is_like, F.length(text).cast("double")).otherwise(0.0), F.when(is_like, text.rlike("[0-9]").cast("double")).otherwise(0.0)]
    cells = F.concat(F.array(F.coalesce(end(0, "lo"), F.lit(0.0)), F.coalesce(end(1, "hi"), F.lit(0.0))), _cells(constants, lay.buckets), _cells(likes, lay.like_buckets), F.array(*more))
    d = d.withColumn("cells", cells)
    return d.select(*preds.columns, F.concat(F.array(*_hot("c", lay.columns), *_hot("kind", lay.kinds)), "cells").alias("vec"), "cells")


def join_vectors(joins: DataFrame, lay: Layout, stats: DataFrame) -> DataFrame:
    """(edge, vec) of the workload's joins, in the order of lay.join_names().

    stats: join-key statistics (col, *KEY_STATS), few rows. The first side is the primary key, a column that holds each value once, else
    the first by name. Statistics are standardized over all of them; one that never varies is 0.
    """
    norm = stats.agg(*[F.avg(s).alias(f"{s}_mean") for s in KEY_STATS], *[F.stddev_pop(s).alias(f"{s}_std") for s in KEY_STATS])
    z = lambda s: F.when(F.col(f"{s}_std") > 0, (F.col(s) - F.col(f"{s}_mean")) / F.col(f"{s}_std")).otherwise(0.0)
    one = stats.crossJoin(F.broadcast(norm)).select("col", (F.col("max_key") == 1).alias("pk"), "distinct", F.array(*[z(s) for s in KEY_STATS]).alias("z"))  # one row beside each
    e = joins.select("edge").distinct().withColumn("ab", F.split("edge", "="))
    side = lambda i: one.select(F.col("col").alias(f"c{i}"), F.struct("col", "pk", "distinct", "z").alias(f"s{i}"))
    e = e.withColumn("c0", F.get("ab", 0)).withColumn("c1", F.get("ab", 1)).join(F.broadcast(side(0)), "c0").join(F.broadcast(side(1)), "c1")
    swap = ~F.col("s0.pk") & F.col("s1.pk")
    e = e.select("edge", F.when(swap, F.col("s1")).otherwise(F.col("s0")).alias("a"), F.when(swap, F.col("s0")).otherwise(F.col("s1")).alias("b"))
    flags = [F.col("a.pk"), ~F.col("a.pk"), F.col("a.col") == F.col("b.col")]
    ratio = F.coalesce(F.col("a.distinct") / F.nullif(F.col("b.distinct"), F.lit(0)), F.lit(0.0))
    return e.select("edge", F.concat(F.array(*_hot("edge", lay.edges), *[f.cast("double") for f in flags], ratio), "a.z", "b.z").alias("vec"))


def set_vectors(plans: DataFrame, tables: DataFrame, joins: DataFrame, preds: DataFrame, lay: Layout, rows: DataFrame) -> DataFrame:
    """(query_id, subplan, tables, joins, predicates): arrays of vectors, each in a fixed order.

    tables: one-hot table and log rows (rows: t, n); joins: (query_id, l, r, vec); preds: (query_id, alias, vec).
    """
    q = ["query_id", "subplan"]
    held = plans.select(*q, "nodes", F.explode("nodes").alias("alias"))
    sorted_list = lambda c: F.sort_array(F.collect_list(c))
    t = tables.join(F.broadcast(rows), "t").select("query_id", "alias", F.array(*_hot("t", lay.tables), F.log1p("n")).alias("vec"))
    of_tables = held.join(t, ["query_id", "alias"]).groupBy(*q).agg(sorted_list("vec").alias("tables"))
    of_preds = held.join(preds.select("query_id", "alias", "vec"), ["query_id", "alias"]).groupBy(*q).agg(sorted_list("vec").alias("predicates"))
    j = held.withColumnRenamed("alias", "l").join(joins, ["query_id", "l"]).where(F.array_contains("nodes", F.col("r")))
    of_joins = j.groupBy(*q).agg(sorted_list("vec").alias("joins"))
    d = plans.select(*q).join(of_tables, q).join(of_joins, q, "left").join(of_preds, q, "left")
    empty = F.array().cast("array<array<double>>")
    return d.select(*q, "tables", F.coalesce("joins", empty).alias("joins"), F.coalesce("predicates", empty).alias("predicates"))


def combined_vectors(plans: DataFrame, tables: DataFrame, joins: DataFrame, preds: DataFrame, lay: Layout) -> DataFrame:
    """(query_id, subplan, vec) in the order of lay.combined_names(): tables held, joins held, and each column's cells, those of its first predicate."""
    q = ["query_id", "subplan"]
    held = plans.select(*q, "nodes", F.explode("nodes").alias("alias"))
    t = held.join(tables, ["query_id", "alias"]).groupBy(*q).agg(F.collect_set("t").alias("ts"))
    j = held.withColumnRenamed("alias", "l").join(joins.select("query_id", "l", "r", "edge"), ["query_id", "l"]).where(F.array_contains("nodes", F.col("r"))).groupBy(*q).agg(F.collect_set("edge").alias("es"))
    first = held.join(preds.select("query_id", "alias", "pos", "c", "cells"), ["query_id", "alias"]).groupBy(*q, "c").agg(F.min_by("cells", "pos").alias("cells"))
    p = first.groupBy(*q).agg(F.map_from_entries(F.collect_list(F.struct("c", "cells"))).alias("of"))
    blank = F.array_repeat(F.lit(0.0), len(lay.value_names()))
    bits = lambda c, names: [F.coalesce(F.array_contains(c, n), F.lit(False)).cast("double") for n in names]
    cells = [F.coalesce(F.try_element_at("of", F.lit(c)), blank) for c in lay.columns]
    d = plans.select(*q).join(t, q, "left").join(j, q, "left").join(p, q, "left")
    return d.select(*q, F.concat(F.array(*bits("ts", lay.tables), *bits("es", lay.edges)), *cells).alias("vec"))


def global_cells(plans: DataFrame, links: DataFrame, tables: DataFrame, joins: DataFrame, est: DataFrame, costs: DataFrame, path: DataFrame) -> DataFrame:
    """(query_id, subplan, cell, v), cells that are not 0: the place of a subplan in its lattice.

    parents n and children n (lattice degrees), tables n, neighbour t (tables next to it in the join graph), in cost (share of
    the cost of all edges that the edges building it have, costs: query_id, parent, cost), relative rows (estimate by that whole cost), chosen (on
    the plan that estimates choose; path: query_id, subplan).
    """
    q = ["query_id", "subplan"]
    flag = lambda d, c: d.select(*q, c.alias("cell"), F.lit(1.0).alias("v"))
    down = links.groupBy("query_id", F.col("parent").alias("subplan")).agg(F.count("*").alias("down"))
    up = links.groupBy("query_id", F.col("child").alias("subplan")).agg(F.count("*").alias("up"))
    n = plans.select(*q, "n_tables").join(down, q, "left").join(up, q, "left")
    numbered = lambda word, c: F.concat(F.lit(f"{word} "), F.coalesce(F.col(c), F.lit(0)).cast("string"))
    both = joins.select("query_id", F.col("l").alias("x"), F.col("r").alias("y")).unionByName(joins.select("query_id", F.col("r").alias("x"), F.col("l").alias("y")))
    beside = plans.select(*q, "nodes", F.explode("nodes").alias("x")).join(both, ["query_id", "x"]).where(~F.array_contains("nodes", F.col("y")))
    beside = beside.join(tables.withColumnRenamed("alias", "y"), ["query_id", "y"]).select(*q, "t").distinct()
    whole = costs.groupBy("query_id").agg(F.sum("cost").alias("whole"))
    share = costs.groupBy("query_id", F.col("parent").alias("subplan")).agg(F.sum("cost").alias("c")).join(whole, "query_id")
    relative = est.join(whole, "query_id").select(*q, F.lit("relative rows").alias("cell"), (F.col("est") / F.col("whole")).alias("v"))
    out = [flag(n, numbered(w, c)) for w, c in (("parents", "up"), ("children", "down"), ("tables", "n_tables"))]
    out += [flag(beside, F.concat(F.lit("neighbour "), "t")), flag(path, F.lit("chosen")), share.select(*q, F.lit("in cost").alias("cell"), (F.col("c") / F.col("whole")).alias("v")), relative]
    every = out[0]
    for d in out[1:]:
        every = every.unionByName(d)
    return every.where("v <> 0")


def named(d: DataFrame, vec: str, names: list[str], *keys: str) -> DataFrame:
    """(keys, cell, v): the cells of a vector that are not 0, by name."""
    at = F.array(*map(F.lit, names))
    return d.select(*keys, F.posexplode(vec).alias("i", "v")).where("v <> 0").select(*keys, F.get(at, "i").alias("cell"), "v")
