"""The lattice of connected subplans, its cardinalities, and the cost of paths through it."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import memo, run_sql, stored, table
from .sqlfront import Graph

SEP = " "


def key(nodes: Column) -> Column:
    return F.array_join(nodes, SEP)


def by_query(df: DataFrame) -> list[str]:
    """The columns that keep the queries of a workload apart; a single query has none."""
    return [c for c in ("query_id",) if c in df.columns]


def subplans_of(spark: SparkSession, graphs: dict[str, Graph]) -> DataFrame:
    """(query_id, nodes, subplan, n_tables): every connected set of aliases of every query, grown level by level along equi-joins."""
    pairs = [(q, a, b) for q, g in graphs.items() for a in g.tables for b in g.neighbours(a)]
    adjacent = spark.createDataFrame(pairs or [("", "", "")], "query_id string, a string, b string")
    level = spark.createDataFrame([(q, [a]) for q, g in graphs.items() for a in sorted(g.tables)], "query_id string, nodes array<string>")
    levels = [level]
    for _ in range(max(len(g.tables) for g in graphs.values()) - 1):
        grown = level.withColumn("a", F.explode("nodes")).join(F.broadcast(adjacent), ["query_id", "a"]).where(~F.array_contains("nodes", F.col("b")))
        level = grown.select("query_id", F.array_sort(F.array_union("nodes", F.array("b"))).alias("nodes")).distinct()
        levels.append(level)
    every = reduce(DataFrame.unionByName, levels)
    return every.select("query_id", "nodes", key(F.col("nodes")).alias("subplan"), F.size("nodes").cast("long").alias("n_tables"))


def subplans(spark: SparkSession, g: Graph) -> DataFrame:
    """(subplan, n_tables) of one query."""
    return subplans_of(spark, {"": g}).drop("query_id")


def edges(plans: DataFrame) -> DataFrame:
    """(parent, child, added), by query: supersets to subsets of one alias less that are subplans too.

    A parent names its candidate children itself, so the join is on equal keys and not on all pairs of a level.
    """
    q = by_query(plans)
    down = plans.where("n_tables > 1").select(*q, "nodes", F.col("subplan").alias("parent"), "n_tables", F.explode("nodes").alias("added"))
    down = down.withColumn("child", key(F.array_remove("nodes", F.col("added"))))
    return down.join(plans.select(*q, F.col("subplan").alias("child")), [*q, "child"]).select(*q, "parent", "child", "added", "n_tables")


def with_source(links: DataFrame, plans: DataFrame) -> DataFrame:
    """links (parent, child), by query, and an edge from every single table to the source, the empty subplan."""
    q = by_query(plans)
    return links.select(*q, "parent", "child").unionByName(plans.where("n_tables = 1").select(*q, F.col("subplan").alias("parent"), F.lit("").alias("child")))


def _names(g: Graph) -> list[list[str]]:
    """Connected alias sets, for planning; graphs have a few dozen nodes at most."""
    found, level = [], {(a,) for a in g.tables}
    while level:
        found += sorted(level)
        level = {tuple(sorted({*s, b})) for s in level for a in s for b in g.neighbours(a) if b not in s}
    return [list(s) for s in found]


def counts_sql(g: Graph, filtered: bool = True) -> str:
    """One statement that counts every subplan."""
    return " UNION ALL ".join(f"SELECT '{SEP.join(s)}' AS subplan, CAST(({g.sql(s, filtered=filtered)}) AS BIGINT) AS n" for s in _names(g))


#: Sums that one pass over a table carries at most.
MOST_SUMS = 2000
#: Bytes that a message's rows take at most, unpacked, to be sent whole to every executor.
MOST_BROADCAST = 16 << 20
#: Queries whose filters one whole number holds, a bit each.
BITS = 62


def _by_size(message: DataFrame, cells: int) -> DataFrame:
    """A stored message with a hint: broadcast if its rows are few, else dealt out by key. Spark would judge by the size of the files, where counts shrink a hundredfold."""
    small = message.count() * (48 + 8 * cells) <= MOST_BROADCAST
    return message.hint("broadcast" if small else "merge")


def is_tree(g: Graph) -> bool:
    """Whether counts can be had by messages: joins form a tree and no condition spans tables."""
    return not g.residual and len(g.joins) == len(g.tables) - 1 and g.connected(set(g.tables))


def tree_counts(spark: SparkSession, sf_dir: str, graphs: dict[str, Graph]) -> DataFrame:
    """(query_id, subplan, n): the count of every subplan of queries with the same tables and joins, a tree, whatever their filters.

    Each table is read once. Seen from a root, a table's message to its parent holds, for each value of the join key, the
    number of join results of each subplan that has the table on top: a sum, over its rows, of the product of its children's
    messages; a row that a query filters out has weight 0 there. The totals of a message are the counts of its subplans,
    so no join result is ever built. Cycles and conditions on several aliases need the real join; they raise.
    """
    first = next(iter(graphs.values()))
    shape = lambda g: (g.tables, sorted(j.sql() for j in g.joins))
    if not is_tree(first) or any(shape(g) != shape(first) or g.residual for g in graphs.values()):
        raise ValueError("not queries of one tree")
    queries, counts = list(graphs), []

    def visit(alias: str, parent: str | None) -> tuple[DataFrame, list[tuple[str, ...]]]:
        """The message (k, m: by query, then subplan) of a table, stored, and its subplans."""
        d, choices, up = table(spark, sf_dir, first.tables[alias]).alias(alias), [], None
        filters = [F.expr(" AND ".join(f"({p})" for p in graphs[q].preds.get(alias, [])) or "true") for q in queries]
        d = d.where(reduce(Column.__or__, filters))
        bits = [F.when(f, F.lit(1 << i % BITS)).otherwise(0).cast("long") for i, f in enumerate(filters)]
        d = d.select("*", *[reduce(Column.bitwiseOR, bits[i : i + BITS]).alias(f"w{i // BITS}") for i in range(0, len(bits), BITS)])
        for j in first.joins:
            if alias in (j.left[0], j.right[0]):
                mine, other = (j.left, j.right) if j.left[0] == alias else (j.right, j.left)
                if other[0] == parent:
                    up = mine[1]
                else:
                    sent, below = visit(other[0], alias)
                    n = len(choices)
                    sent = _by_size(sent.select(F.col("k").alias(f"k{n}"), F.col("m").alias(f"m{n}")), len(queries) * len(below))
                    d = d.join(sent, d[mine[1]] == sent[f"k{n}"], "left")
                    choices.append([None, *[(n, i, s, len(below)) for i, s in enumerate(below)]])
        plans = list(product(*choices))
        if len(plans) * len(queries) > MOST_SUMS:
            raise ValueError("too many subplans for one pass")
        subplans = [tuple(sorted({alias, *(a for c in some if c for a in c[2])})) for some in plans]
        weight = lambda q: F.shiftright(f"w{q // BITS}", q % BITS).bitwiseAND(F.lit(1).cast("long"))
        one = lambda q, some: reduce(Column.__mul__, [F.coalesce(F.get(f"m{n}", F.lit(q * many + i)), F.lit(0).cast("long")) for n, i, _, many in filter(None, some)], weight(q))
        m = F.array(*[F.coalesce(F.sum(one(q, some)), F.lit(0).cast("long")) for q in range(len(queries)) for some in plans]).alias("m")
        message = stored(d.groupBy(F.col(up).alias("k")).agg(m) if up else d.agg(m).select(F.lit(0).alias("k"), "m"), "message")
        names = F.array(*[F.lit(SEP.join(s)) for s in subplans])
        ids = F.array(*map(F.lit, queries))
        cells = message.select(F.posexplode("m").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
        counts.append(cells.select(F.get(ids, F.floor(F.col("at") / len(plans)).cast("int")).alias("query_id"), F.get(names, F.col("at") % len(plans)).alias("subplan"), "n"))
        if up:  # a null key joins nothing
            message = message.where("k IS NOT NULL")
        return message, subplans

    visit(max(first.tables, key=lambda a: (len(first.neighbours(a)), a)), None)
    return reduce(DataFrame.unionByName, counts)


def cardinalities(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    """(subplan, n_tables, actual, total), stored once for a graph and folder; by messages where the graph is a tree."""

    def make() -> DataFrame:
        if is_tree(g):
            n = tree_counts(spark, sf_dir, {"actual": g, "total": Graph(g.tables, g.joins)})
            both = n.groupBy("subplan").pivot("query_id", ["actual", "total"]).agg(F.first("n"))
        else:
            actual = run_sql(spark, sf_dir, counts_sql(g)).withColumnRenamed("n", "actual")
            total = run_sql(spark, sf_dir, counts_sql(g, filtered=False)).withColumnRenamed("n", "total")
            both = actual.join(total, "subplan")
        return both.select("subplan", F.size(F.split("subplan", SEP)).cast("long").alias("n_tables"), "actual", "total")

    return memo(spark, f"cards {sf_dir} {g.sql()}", make)


def cardinalities_of(spark: SparkSession, sf_dir: str, graphs: dict[str, Graph]) -> DataFrame:
    """(query_id, subplan, n_tables, actual, total) of a workload, stored once: queries of one shape are counted together."""

    def make() -> DataFrame:
        shapes: dict[str, dict[str, Graph]] = {}
        for q, g in graphs.items():
            shapes.setdefault(g.sql(filtered=False), {})[q] = g
        out = []
        for same in shapes.values():
            g = next(iter(same.values()))
            if all(map(is_tree, same.values())):
                n = stored(tree_counts(spark, sf_dir, {"": Graph(g.tables, g.joins), **same}), "counts")  # read twice: else all messages are summed twice, in one plan
                total = n.where("query_id = ''").select("subplan", F.col("n").alias("total"))
                out.append(n.where("query_id <> ''").withColumnRenamed("n", "actual").join(total, "subplan"))
            else:
                out += [cardinalities(spark, sf_dir, x).select(F.lit(q).alias("query_id"), "subplan", "actual", "total") for q, x in same.items()]
        every = reduce(DataFrame.unionByName, out)
        return every.select("query_id", "subplan", F.size(F.split("subplan", SEP)).cast("long").alias("n_tables"), "actual", "total")

    return memo(spark, f"workload {sf_dir} " + " ".join(f"{q} {g.sql()}" for q, g in sorted(graphs.items())), make)


def cbo_rows(spark: SparkSession, sf_dir: str, g: Graph) -> list[tuple[str, float]]:
    """What the optimizer expects of each subplan, from catalog statistics without histograms and without join reordering."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.cbo.enabled", "spark.sql.statistics.histogram.enabled", "spark.sql.cbo.joinReorder.enabled")}
    texts = {}
    try:
        for k, v in zip(held, ("true", "false", "false"), strict=True):
            spark.conf.set(k, v)
        for t in set(g.tables.values()):
            name = f"lw_{t}_{hashlib.sha1(sf_dir.encode()).hexdigest()[:10]}"
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{sf_dir}/{t}.parquet'")  # external: no row is copied
            spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
            texts[t] = name
        named = Graph({a: texts[t] for a, t in g.tables.items()}, g.joins, g.preds, g.residual)
        out = []
        for s in _names(g):
            st = spark.sql(named.sql(s, what="1"))._jdf.queryExecution().optimizedPlan().stats()
            out.append((SEP.join(s), float(str(st.rowCount().get())) if st.rowCount().isDefined() else None))
        return out
    finally:
        for name in texts.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _nested(c1: Column, c2: Column, s1: Column, s2: Column) -> Column:
    """Index nested loop: probes of the other side, and a thousandth of the single table's rows."""
    return F.when(s1, c2 + 0.001 * c1).when(s2, c1 + 0.001 * c2)


def _probe(c1: Column, c2: Column, s1: Column, s2: Column) -> Column:
    """Rows of the side that looks up the single table's index."""
    return F.when(s1, c2).when(s2, c1)


def _small(c1: Column, c2: Column, otherwise: Column) -> Column:
    """Product of the sides where one has under 5 rows, else the lesser of it and another cost."""
    return F.when((c1 < 5) | (c2 < 5), c1 * c2).otherwise(F.least(otherwise, c1 * c2))


#: Cost of an edge by model: of the child's rows, the added table's rows, the parent's rows, and which sides are single tables.
COSTS = {
    "hash": lambda c1, c2, c3, s1, s2: F.least(c1 + c2, F.coalesce(_nested(c1, c2, s1, s2), c1 + c2)),
    "nested": lambda c1, c2, c3, s1, s2: F.coalesce(_nested(c1, c2, s1, s2), c1 * c2),
    "product": lambda c1, c2, c3, s1, s2: c1 * c2,
    "product5": lambda c1, c2, c3, s1, s2: 5 * c1 * c2,
    "double": lambda c1, c2, c3, s1, s2: 2 * _probe(c1, c2, s1, s2),
    "ratio": lambda c1, c2, c3, s1, s2: 2 * F.greatest(_probe(c1, c2, s1, s2), c3),
    "ratio_product": lambda c1, c2, c3, s1, s2: F.least(2 * F.greatest(_probe(c1, c2, s1, s2), c3), c1 * c2),
    "ratio_small": lambda c1, c2, c3, s1, s2: _small(c1, c2, 2 * F.greatest(_probe(c1, c2, s1, s2), c3)),
    "max_small": lambda c1, c2, c3, s1, s2: _small(c1, c2, 2 * F.greatest(c1, c2)),
    "light": lambda c1, c2, c3, s1, s2: 0.001 * (c1 + c2),
    "C": lambda c1, c2, c3, s1, s2: F.least(c1 * c2, F.coalesce(_nested(c1, c2, s1, s2), c1 * c2)),
}


def edge_costs(links: DataFrame, cards: DataFrame, value: str = "actual", model: str = "C") -> DataFrame:
    """links with cost, by query: building the parent from the child and the added table, which is the second side."""
    q = by_query(links)
    c = cards.select(*q, F.col("subplan").alias("s"), F.col(value).cast("double").alias("v"))
    for side in ("child", "added", "parent"):
        links = links.join(c.withColumnsRenamed({"s": side, "v": f"{side}_rows"}), [*q, side])
    single = ~F.col("child").contains(SEP)
    cost = COSTS[model](F.col("child_rows"), F.col("added_rows"), F.col("parent_rows"), single, F.lit(True))
    return links.withColumn("cost", cost)


def best_paths(costs: DataFrame, levels: int, value: str = "cost", also: str | None = None) -> DataFrame:
    """(subplan, best, other, path), by query: the cheapest way from each subplan down to a single table, level by level.

    Equal costs go to the smaller path text, so the plan is fixed. other: the sum of column `also` along the path.
    """
    q = by_query(costs)
    single = costs.where("n_tables = 2").select(*q, F.explode(F.array("child", "added")).alias("subplan")).distinct()
    best = single.select(*q, "subplan", F.lit(0.0).alias("best"), F.lit(0.0).alias("other"), F.col("subplan").alias("path"))
    every = best
    for n in range(2, levels + 1):
        step = costs.where(F.col("n_tables") == n).join(best.withColumnRenamed("subplan", "child"), [*q, "child"])
        new = F.struct(F.round(F.col("best") + F.col(value), 6).alias("best"), F.concat_ws(" > ", "path", "parent").alias("path"), (F.col("other") + F.col(also or value)).alias("other"))
        best = step.groupBy(*q, "parent").agg(F.min(new).alias("m")).select(*q, F.col("parent").alias("subplan"), "m.best", "m.other", "m.path")
        every = every.unionByName(best)
    return every
