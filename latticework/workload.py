"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import featured, many
from .functions import scalars as S
from .operators import estimate as E
from .operators import learn as L
from .operators import stats as ST
from .plans import cover as C
from .plans import execution as X
from .plans import lattice as P
from .plans import templates as T
from .plans.sqlfront import parse, predicate_op
from .sources.tables import cached_sql, memo, run_sql, sampled, table
from .streaming import windows as W

#: The query whose lattice (24 subplans) the estimators, metrics and costs work on.
TREE = """SELECT COUNT(*) FROM nation AS n, customer AS c, orders AS o, lineitem AS l, part AS p, supplier AS s
WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_partkey = p.p_partkey
AND l.l_suppkey = s.s_suppkey AND c.c_mktsegment = 'BUILDING' AND l.l_quantity > 30 AND p.p_size <= 20"""
#: Customers and suppliers of one nation: the join graph is a cycle (21 subplans).
CYCLE = """SELECT COUNT(*) FROM nation AS n, customer AS c, orders AS o, lineitem AS l, supplier AS s
WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey
AND s.s_nationkey = n.n_nationkey AND o.o_totalprice > 1000"""
G, LEVELS = parse(TREE), 6

#: Queries whose SQL text both engines run as it is.
SQL = {
    "spj_count_6way": TREE.replace("COUNT(*)", "COUNT(*) AS n", 1),
    "spj_cyclic": CYCLE.replace("COUNT(*)", "COUNT(*) AS n", 1),
    "spj_count_16way": """SELECT COUNT(*) AS n FROM lineitem AS l, orders AS o, customer AS c, nation AS n1, region AS r1, supplier AS s, nation AS n2, region AS r2, part AS p,
        lineitem AS l2, supplier AS s2, nation AS n3, region AS r3, part AS p2, customer AS c2, nation AS n4
        WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n1.n_nationkey AND n1.n_regionkey = r1.r_regionkey AND l.l_suppkey = s.s_suppkey AND s.s_nationkey = n2.n_nationkey
        AND n2.n_regionkey = r2.r_regionkey AND l.l_partkey = p.p_partkey AND l2.l_orderkey = o.o_orderkey AND l2.l_suppkey = s2.s_suppkey AND s2.s_nationkey = n3.n_nationkey AND n3.n_regionkey = r3.r_regionkey
        AND l2.l_partkey = p2.p_partkey AND c2.c_custkey = o.o_custkey AND c2.c_nationkey = n4.n_nationkey AND l.l_quantity > 30 AND p.p_size <= 20 AND p2.p_size > 20 AND c.c_mktsegment IN ('BUILDING', 'MACHINERY') AND r1.r_name <> r2.r_name""",
    "spj_self_join": "SELECT COUNT(*) AS n FROM lineitem AS l1, lineitem AS l2, orders AS o WHERE l1.l_orderkey = o.o_orderkey AND l2.l_orderkey = o.o_orderkey AND l1.l_orderkey = l2.l_orderkey AND l1.l_quantity > 25 AND l2.l_discount < 0.05",
    "spj_theta_ne": "SELECT COUNT(*) AS n FROM customer AS c, orders AS o, lineitem AS l, supplier AS s WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey != s.s_nationkey",
    "spj_or_join": "SELECT COUNT(*) AS n FROM supplier AS s, nation AS n1, nation AS n2 WHERE n1.n_regionkey = n2.n_regionkey AND (s.s_nationkey = n1.n_nationkey OR s.s_nationkey = n2.n_nationkey)",
    "cross_product_count": "SELECT COUNT(*) AS n FROM region AS r, nation AS n, supplier AS s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0",
    "pred_eq": "SELECT COUNT(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey = '7'",
    "pred_range": "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.02 AND l_discount <= 0.06",
    "pred_in_null": "SELECT COUNT(*) AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) AS c WHERE seg IN ('AUTOMOBILE', 'MACHINERY') OR seg IS NULL",
    "pred_like": "SELECT COUNT(*) AS n FROM part WHERE p_name LIKE '%a%'",
    "pred_not_like": "SELECT COUNT(*) AS n FROM part WHERE p_type NOT LIKE '%B%'",
    "pred_ilike": "SELECT COUNT(*) AS n FROM part WHERE p_type ILIKE '%s%'",
    "pred_is_null": "SELECT COUNT(*) AS n FROM orders AS o LEFT JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL",
    "group_count_3keys": "SELECT o_orderpriority, c_mktsegment, r_name, COUNT(*) AS n FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY o_orderpriority, c_mktsegment, r_name ORDER BY n DESC",
    "group_min_max": "SELECT p_brand, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem, part WHERE l_partkey = p_partkey AND p_size > 10 GROUP BY p_brand",
    "group_sum_order": "SELECT l_suppkey, ROUND(SUM(l_quantity), 4) AS q FROM lineitem, orders WHERE l_orderkey = o_orderkey AND o_orderstatus = 'F' GROUP BY l_suppkey ORDER BY q",
    "group_count_distinct": "SELECT n_name, COUNT(DISTINCT o_custkey) AS n FROM nation, customer, orders WHERE n_nationkey = c_nationkey AND c_custkey = o_custkey GROUP BY n_name",
    "having_count": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 5 AND COUNT(*) < 40",
    "scalar_subquery_predicate": "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice <= (SELECT AVG(o_totalprice) FROM orders WHERE o_orderstatus = 'F')",
    "select_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "win_rank": "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS BIGINT) AS r FROM customer",
    "ntile_bins": "SELECT c_custkey, CAST(ntile(10) OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS b FROM customer",
    "win_frame": "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
    "cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "union": "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "semi": "SELECT COUNT(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "anti": "SELECT COUNT(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)",
    "share_by_group": "SELECT l_returnflag, l_linestatus, ROUND(100.0 * n / SUM(n) OVER (PARTITION BY l_returnflag), 6) AS pct FROM (SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus) AS t",
}


def _sql(text):
    return lambda spark, d: run_sql(spark, d, text)


def _cards(spark, d):
    return P.cardinalities(spark, d, G)


def _plans(spark, d=None):
    return memo(spark, f"subplans {G.sql()}", lambda: P.subplans(spark, G))


def _links(spark):
    return memo(spark, f"edges {G.sql()}", lambda: P.edges(_plans(spark)))


def _est(spark, d):
    return memo(spark, f"independence {d}", lambda: E.independence(spark, d, G, _cards(spark, d), _plans(spark)))


def spj_count_3way(spark, d):
    """Customers of one segment, their orders, and large line items."""
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 30")
    return c.join(o, c["c_custkey"] == o["o_custkey"]).join(li, o["o_orderkey"] == li["l_orderkey"]).agg(F.count("*").alias("n"))


def pred_regex_trycast(spark, d):
    v = F.get_json_object("props", "$.k")
    num = v.try_cast("double")
    return table(spark, d, "events").where(v.rlike(r"^(?:[1-9]\d*|0)?(?:\.\d+)?$") & (num >= 10) & (num <= 60)).agg(F.count("*").alias("n"))


def col_stats(spark, d):
    return ST.column_stats(spark, d, [("lineitem", "l_quantity"), ("lineitem", "l_discount"), ("orders", "o_totalprice"), ("part", "p_size")])


KEYS = [("lineitem", "l_orderkey"), ("lineitem", "l_suppkey"), ("orders", "o_custkey"), ("customer", "c_nationkey")]


def joinkey_stats(spark, d):
    return ST.join_key_stats(spark, d, KEYS)


def mcv_topk(spark, d):
    return ST.most_common(table(spark, d, "lineitem"), "l_partkey", 10)


def percentile_summary(spark, d):
    return E.summary(table(spark, d, "orders"), "o_totalprice")


def subplans(spark, d):
    return _plans(spark).select("subplan", "n_tables")


def subplan_edges(spark, d):
    return _links(spark).select("parent", "child", "added")


def node_degrees(spark, d):
    e = _links(spark)
    down = e.groupBy(F.col("parent").alias("subplan")).agg(F.count("*").alias("down"))
    up = e.groupBy(F.col("child").alias("subplan")).agg(F.count("*").alias("up"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _plans(spark).select("subplan").join(down, "subplan", "left").join(up, "subplan", "left").select("subplan", z("down"), z("up"))


def cross_join_check(spark, d):
    """Subplans of the cyclic query that only the hub n holds together."""
    g = parse(CYCLE)
    rows = [(P.SEP.join(s), int("n" in s and not g.connected(set(s), {"n"}))) for s in P._names(g)]
    return spark.createDataFrame(rows, "subplan string, cross long")


def subplan_true_counts(spark, d):
    return _cards(spark, d).select("subplan", F.col("actual").alias("n"))


def subplan_totals(spark, d):
    return _cards(spark, d).select("subplan", F.col("total").alias("n"))


def count_message_passing(spark, d):
    """All subplans at once, from messages of key counts; each table is read once."""
    return P.tree_counts(spark, d, {"": G}).select("subplan", "n")


def implied_predicates(spark, d):
    """A filter on nation names carried over to customers' nation keys, through the names' keys."""
    keys = table(spark, d, "nation").where(F.substring("n_name", -1, 1) < "5").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(keys, "c_nationkey", "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def sample_bitmap(spark, d):
    s = ST.hash_sample(table(spark, d, "orders"), "o_orderkey", 20, 1000)
    return ST.bitmap(s, "o_orderkey", "o_totalprice > 100000").select(F.explode("bits").alias("k"))


def join_bitmap_intersection(spark, d):
    a = ST.bitmap(ST.hash_sample(table(spark, d, "orders"), "o_orderkey", 50, 1000), "o_orderkey", "o_orderstatus = 'F'")
    b = ST.bitmap(ST.hash_sample(table(spark, d, "lineitem"), "l_orderkey", 50, 1000), "l_orderkey", "l_quantity > 30")
    both = a.select(F.lit(1).alias("one"), "bits").join(b.select(F.lit(1).alias("one"), F.col("bits").alias("more")), "one")
    return both.select(F.size(F.array_intersect("bits", "more")).cast("long").alias("n"))


def est_true(spark, d):
    return _cards(spark, d).select("subplan", F.col("actual").cast("double").alias("est"))


def est_independence(spark, d):
    return _est(spark, d)


def est_true_rank(spark, d):
    return E.rank_repair(_cards(spark, d), _est(spark, d))


def est_true_rank_tables(spark, d):
    return E.rank_repair(_cards(spark, d), _est(spark, d), by_tables=True)


def _key_counts(spark, d):
    """Join keys on both sides of each edge: distinct values that the child and the added table hold of the edge's key."""
    rows = []
    for s in P._names(G):
        for j in G.joins:
            for (a, ca), (b, cb) in ((j.left, j.right), (j.right, j.left)):
                if a in s and b in s and len(s) > 2:
                    child = [x for x in s if x != b]
                    if G.connected(set(child)):
                        rows.append(f"SELECT '{P.SEP.join(child)}' AS child, '{b}' AS added, CAST(({G.sql(child, f'COUNT(DISTINCT {a}.{ca})')}) AS DOUBLE) AS r1, CAST(({G.sql([b], f'COUNT(DISTINCT {b}.{cb})')}) AS DOUBLE) AS r2")
    return " UNION ALL ".join(rows)


def est_joinkeys(spark, d):
    keys = memo(spark, f"joinkeys {d}", lambda: run_sql(spark, d, _key_counts(spark, d)))
    return E.join_key_estimate(_cards(spark, d), _plans(spark), _links(spark), keys, LEVELS).select("subplan", F.round("est", 4).alias("est"))


def est_cbo(spark, d):
    return spark.createDataFrame(P.cbo_rows(spark, d, G), "subplan string, est double")


def est_true_random(spark, d):
    return E.noisy(_cards(spark, d), 50, 7)


def est_random(spark, d):
    return E.random_share(_cards(spark, d), 7)


def _errors(spark, d):
    return _cards(spark, d).join(_est(spark, d), "subplan")


def qerr(spark, d):
    return _errors(spark, d).select("subplan", F.round(E.q_error(F.col("est"), F.col("actual").cast("double")), 4).alias("qerr"))


def abs_err(spark, d):
    return _errors(spark, d).select("subplan", F.round(F.abs(F.col("est") - F.col("actual")), 2).alias("err"))


def rel_err(spark, d):
    return _errors(spark, d).select("subplan", F.round(F.abs(F.col("actual") - F.col("est")) / F.col("actual"), 4).alias("err"))


def mse(spark, d):
    return _errors(spark, d).select((F.avg(F.pow(F.col("est") - F.col("actual"), 2)) / 1e6).alias("m")).select(F.round("m", 3).alias("mse_millions"))


def qerr_joinkey(spark, d):
    """By edge: the child's number of join keys, expected as the lesser of its estimated rows and the added table's keys."""
    e = run_sql(spark, d, _key_counts(spark, d)).join(_est(spark, d).withColumnRenamed("subplan", "child"), "child")
    return e.select("child", "added", F.round(E.q_error(F.least("est", "r2"), F.col("r1")), 4).alias("qerr"))


def qerr_by_num_tables(spark, d):
    return _errors(spark, d).groupBy("n_tables").agg(F.round(F.avg(E.q_error(F.col("est"), F.col("actual").cast("double"))), 4).alias("qerr"))


def metric_summary(spark, d):
    return E.summary(qerr(spark, d), "qerr").select(*[F.round(c, 3).alias(c) for c in ("mean", "p50", "p90", "p99")])


def corr_est_true(spark, d):
    return _errors(spark, d).agg(F.round(F.corr("est", "actual"), 6).alias("r"))


def _pk_edges():
    """(child, added, other side's column): joins by which an edge adds a table through its primary key."""
    out = []
    for s in P._names(G):
        for j in G.joins:
            for (a, ca), (b, cb) in ((j.left, j.right), (j.right, j.left)):
                if a in s and b not in s and cb in PK:
                    out.append((P.SEP.join(s), b, G.tables[a], ca))
    return out


def constraints(spark, d):
    """What the independence estimates break of primary and foreign keys."""
    keys = spark.createDataFrame(_pk_edges(), "child string, added string, t string, c string")
    most = None
    for t, c in sorted({r[2:] for r in _pk_edges()}):
        one = table(spark, d, t).groupBy(c).count().agg(F.lit(t).alias("t"), F.lit(c).alias("c"), F.max("count").alias("f"))
        most = one if most is None else most.unionByName(one)
    return E.constraint_errors(_links(spark), _est(spark, d), keys.join(F.broadcast(most), ["t", "c"]).drop("t", "c"))


PK = {"n_nationkey", "c_custkey", "o_orderkey", "p_partkey", "s_suppkey", "r_regionkey"}


def _costed(spark, d, model="C"):
    """Edges with est_cost and true_cost under a cost model, stored: each level of the search reads them."""
    return memo(spark, f"costs {d} {model}", lambda: _cost_rows(spark, d, model))


def _cost_rows(spark, d, model):
    t = P.edge_costs(_links(spark), _cards(spark, d), "actual", model).select("parent", "child", "added", "n_tables", F.col("cost").alias("true_cost"))
    e = P.edge_costs(_links(spark), _est(spark, d), "est", model).select("parent", "child", F.col("cost").alias("est_cost"))
    return t.join(e, ["parent", "child"])


def edge_cost_c(spark, d):
    return _costed(spark, d).select("parent", "child", F.round("true_cost", 4).alias("cost"))


def edge_cost_registry(spark, d):
    out = None
    for m in P.COSTS:
        one = P.edge_costs(_links(spark), _cards(spark, d), "actual", m).select(F.lit(m).alias("model"), "parent", "child", F.round("cost", 3).alias("cost"))
        out = one if out is None else out.unionByName(one)
    return out


def plan_cost_opt(spark, d):
    return P.best_paths(_costed(spark, d), LEVELS, "true_cost").select("subplan", F.round("best", 3).alias("cost"))


def _est_plan(spark, d):
    return P.best_paths(_costed(spark, d), LEVELS, "est_cost", "true_cost").where(F.col("subplan") == P.SEP.join(sorted(G.tables)))


def plan_cost_est(spark, d):
    return _est_plan(spark, d).select("subplan", F.round("best", 3).alias("est_cost"), F.round("other", 3).alias("true_cost"))


def plan_path(spark, d):
    """The join order that the estimates choose, and the SQL that fixes it."""
    return _est_plan(spark, d).select("subplan", "path")


def _chosen_order(spark, d):
    return X.join_order(plan_path(spark, d).first()["path"].split(" > "))


def plan_forced_order(spark, d):
    """The query's count, its joins written in the order that the estimates choose."""
    return run_sql(spark, d, X.ordered_sql(G, _chosen_order(spark, d), "COUNT(*) AS n"))


def executed_subplans(spark, d):
    return X.executed(plan_path(spark, d))


def plan_runtime(spark, d):
    return X.run_times(spark, d, [("chosen", X.ordered_sql(G, _chosen_order(spark, d))), ("written", TREE)], reps=2)


def plan_graph(spark, d):
    return X.plan_graph(run_sql(spark, d, TREE))


def relative_cost(spark, d):
    opt = P.best_paths(_costed(spark, d), LEVELS, "true_cost").select("subplan", F.col("best").alias("opt"))
    return _est_plan(spark, d).join(opt, "subplan").select(F.round(F.col("other") / F.col("opt"), 4).alias("relative"), F.round(F.col("other") - F.col("opt"), 2).alias("excess"))


def wander_join(spark, d):
    """Estimates of every prefix of the path that the single tables' selectivities choose."""
    return ST.wander(spark, d, G, ST.find_path(G, _cards(spark, d)), 4000, 11)


def plan_hints(spark, d):
    """The query's count with the join order and each join's operator laid down."""
    return run_sql(spark, d, X.ordered_sql(G, ["l", "o", "c", "n", "p", "s"], "COUNT(*) AS n", {"o": "MERGE", "c": "SHUFFLE_HASH", "n": "BROADCAST", "p": "SHUFFLE_HASH", "s": "BROADCAST"}))


def cached_execute(spark, d):
    """A query's rows, kept by its text: the second call reads them."""
    return cached_sql(spark, d, SQL["having_count"])


def source_edges(spark, d):
    """The lattice with an edge from each single table to the source, as flow-loss and shortest paths take it."""
    return P.with_source(_links(spark), _plans(spark)).select("parent", "child")


def column_norms(spark, d):
    """Mean and population deviation of each statistic over columns."""
    c = ST.column_stats(spark, d, NORM_COLUMNS)
    names = ("min_value", "max_value", "num_values", "total_values")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("v")) for n in names])).alias("x")
    return c.select(rows).groupBy("x.stat").agg(F.round(F.avg("x.v"), 4).alias("mean"), F.round(F.stddev_pop("x.v"), 4).alias("std"))


NORM_COLUMNS = [("lineitem", "l_quantity"), ("orders", "o_totalprice"), ("part", "p_size"), ("customer", "c_nationkey")]


def like_features(spark, d):
    """A pattern's hashed uni-, bi- and trigrams, its length, and whether it holds a digit."""
    return table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in S.like_features(F.col("p_type"), 8).items()])


def hash_bucket(spark, d):
    return table(spark, d, "part").select("p_partkey", S.sha1_bucket(F.col("p_name"), 10).alias("b"))


def minmax_feature(spark, d):
    p = table(spark, d, "part")
    ends = p.agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.lit(1).alias("one"))
    return p.withColumn("one", F.lit(1)).join(F.broadcast(ends), "one").select("p_partkey", F.round(S.min_max(F.col("p_size").cast("double"), F.col("lo"), F.col("hi")), 6).alias("f"))


def like_ngrams(spark, d):
    grams = table(spark, d, "part").select(F.explode(S.char_ngrams(F.col("p_type"), 3)).alias("g"))
    return grams.groupBy("g").agg(F.count("*").alias("n"))


def join_onehot(spark, d):
    """For each subplan, which joins of the query it holds."""
    j = spark.createDataFrame([(f"{x.left[0]}{x.right[0]}", x.left[0], x.right[0]) for x in G.joins], "edge string, a string, b string")
    return _plans(spark).join(F.broadcast(j), F.lit(True)).select("subplan", "edge", (F.array_contains("nodes", F.col("a")) & F.array_contains("nodes", F.col("b"))).cast("long").alias("held"))


def y_transforms(spark, d):
    """Every label transform of the true counts, and back."""
    c, one, y = _cards(spark, d), F.lit(1).alias("one"), F.col("actual")
    ends = c.agg(F.min("actual").alias("lo"), F.max("actual").alias("hi"), F.avg("actual").alias("mean"), F.stddev_pop("actual").alias("std"), F.avg(F.log("actual")).alias("lmean"), F.stddev_pop(F.log("actual")).alias("lstd"),
                 F.min(y / F.col("total")).alias("slo"), F.max(y / F.col("total")).alias("shi"), one)
    c = c.withColumn("one", F.lit(1)).join(F.broadcast(ends), "one")
    out = []
    for m in S.MODES:
        share, logs = m == "selectivity", m == "logwhitening"
        how = {"low": F.col("slo" if share else "lo"), "high": F.col("shi" if share else "hi"), "total": F.col("total"), "mean": F.col("lmean" if logs else "mean"), "std": F.col("lstd" if logs else "std")}
        z = S.normalize(y, m, **how)
        out.append(F.struct(F.lit(m).alias("mode"), F.round(z, 6).alias("y"), F.round(S.unnormalize(z, m, **how), 3).alias("back")))
    return c.select("subplan", F.explode(F.array(*out)).alias("t")).select("subplan", "t.*")


def log_bucket(spark, d):
    return _cards(spark, d).select("subplan", S.log_bucket(F.col("actual"), 10, 8).alias("b"))


def clean_words(spark, d):
    return table(spark, d, "part").select("p_partkey", S.clean_word(F.col("p_name"), True, 3).alias("w"))


def quantile_chunk(spark, d):
    p = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return T.quantile_chunks(p, [F.desc("n"), F.col("o_custkey")], 7).groupBy("chunk").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


def ilike_prefix_counts(spark, d):
    return T.prefix_counts(table(spark, d, "part"), "p_name", 1, 4).where("n BETWEEN 5 AND 500")


TEMPLATE = {
    "sql": "SELECT COUNT(*) FROM customer AS c, orders AS o, lineitem AS l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND Xseg AND Xprio AND Xqty",
    "predicates": [
        {"type": "sql", "sql": "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment", "columns": ["c.c_mktsegment"], "keys": ["Xseg"], "pred_type": "IN", "sampling_method": "quantile", "num_quantiles": 2, "min_samples": 1, "max_samples": 2},
        {"type": "sql", "dependencies": 1, "sql": "SELECT o_orderpriority, COUNT(*) AS n FROM orders AS o, customer AS c WHERE c.c_custkey = o.o_custkey AND Xseg GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority", "columns": ["o.o_orderpriority"], "keys": ["Xprio"], "pred_type": "ILIKE"},
        {"type": "list", "options": [[1, 10], [5, 30], [20, 50]], "columns": ["l.l_quantity"], "keys": ["Xqty"], "pred_type": "range"},
    ],
}


def template_generated(spark, d):
    made = T.generate(spark, d, TEMPLATE, 5, seed=3)
    return spark.createDataFrame([(i, q) for i, q in enumerate(made)], "id long, sql string")


def energy_rank(spark, d):
    return L.energy_rank(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.lit(1.0)).alias("v")))


def path_cover(spark, d):
    return C.cover(spark, _plans(spark), _links(spark))


def greedy_cover(spark, d):
    return C.cover(spark, _plans(spark), _links(spark), greedy=True)


def _cells(spark, d):
    """Nations and segments of customers as a small matrix of log order counts; a segment's column is its place by name."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    names = c.agg(F.sort_array(F.collect_set("c_mktsegment")).alias("names"))  # some five names
    m = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").cast("int").alias("i"), "c_mktsegment").agg(F.log(F.count("*")).alias("v"))
    return m.crossJoin(F.broadcast(names)).select("i", (F.array_position("names", F.col("c_mktsegment")) - 1).cast("int").alias("j"), "v")


def svd_reconstruct(spark, d):
    return L.svd(spark, _cells(spark, d), 2).select("i", "j", F.round("value", 6).alias("value"))


def matrix_completion(spark, d):
    return L.complete(_cells(spark, d))


def masked_qerr(spark, d):
    """A quarter of the matrix hidden and filled from row and column means."""
    return L.masked_errors(L.additive(L.hide(_cells(spark, d), 25, 1)))


def flow_loss(spark, d):
    e = _costed(spark, d).select(F.lit("tree").alias("query_id"), "parent", "child", "est_cost", "true_cost")
    one = _plans(spark).where("n_tables = 1").select(F.lit("tree").alias("query_id"), F.col("subplan").alias("parent"), F.lit("").alias("child"), F.lit(1.0).alias("est_cost"), F.lit(1.0).alias("true_cost"))
    return L.flow_loss(e.unionByName(one)).select("query_id", F.format_string("%.5e", "loss").alias("loss"))


def table_sample(spark, d):
    return sampled(table(spark, d, "orders"), 10, "o_orderkey").agg(F.count("*").alias("n"))


def asof(spark, d):
    """Each event with the user's latest purchase before it: one sort by user and time over both kinds of rows."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("last", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)).select("event_id", "last")


def _stream(kind):
    return lambda spark, d: W.drain(W.windowed(W.events_stream(spark, d), kind))


FUNCTIONS = [
    spj_count_3way, pred_regex_trycast, col_stats, joinkey_stats, mcv_topk, percentile_summary, subplans, subplan_edges, node_degrees, cross_join_check, subplan_true_counts, subplan_totals,
    count_message_passing, implied_predicates, sample_bitmap, join_bitmap_intersection, est_true, est_true_rank, est_true_rank_tables, est_joinkeys, est_cbo, est_true_random, est_random, qerr, abs_err,
    rel_err, qerr_by_num_tables, metric_summary, corr_est_true, constraints, edge_cost_c, edge_cost_registry, plan_cost_opt, plan_cost_est, plan_path, relative_cost, wander_join, hash_bucket,
    minmax_feature, like_ngrams, join_onehot, y_transforms, log_bucket, clean_words, quantile_chunk, ilike_prefix_counts, template_generated, energy_rank, svd_reconstruct, matrix_completion,
    flow_loss, table_sample, asof, est_independence, path_cover, greedy_cover, mse, qerr_joinkey,
    plan_hints, cached_execute, source_edges, column_norms, like_features, plan_forced_order, executed_subplans, plan_runtime, plan_graph, masked_qerr,
]


def queries():
    out = {k: _sql(v) for k, v in SQL.items()} | {f.__name__: f for f in FUNCTIONS}
    return out | many.queries() | featured.queries() | {f"stream_{k}": _stream(k) for k in ("tumbling", "sliding", "session")}


def _independent_sql() -> str:
    parts = []
    for s in P._names(G):
        up = " * ".join(f"({G.sql([a], 'CAST(COUNT(*) AS DOUBLE)')})" for a in s)
        down = [f"greatest((SELECT COUNT(DISTINCT {j.left[1]}) FROM {G.tables[j.left[0]]}), (SELECT COUNT(DISTINCT {j.right[1]}) FROM {G.tables[j.right[0]]}))" for j in G.joins if {j.left[0], j.right[0]} <= set(s)]
        parts.append(f"SELECT '{P.SEP.join(s)}' AS subplan, round({up}{''.join(' / ' + x for x in down)}, 4) AS est")
    return " UNION ALL ".join(parts)


def oracle_sql():
    names = P._names(G)
    sets = ", ".join(f"('{P.SEP.join(s)}', {len(s)})" for s in names)
    links = ", ".join(f"('{P.SEP.join(p)}', '{P.SEP.join(c)}', '{(set(p) - set(c)).pop()}', {len(p)})" for p in names for c in names if len(c) == len(p) - 1 and set(c) < set(p))
    base = f"plans(subplan, n_tables) AS (VALUES {sets}), links(parent, child, added, n_tables) AS (VALUES {links})"
    cards = f"act AS ({P.counts_sql(G)}), tot AS ({P.counts_sql(G, filtered=False)}), cards AS (SELECT subplan, CAST(n_tables AS BIGINT) AS n_tables, act.n AS actual, tot.n AS total FROM plans JOIN act USING (subplan) JOIN tot USING (subplan))"
    ind = f"ind AS ({_independent_sql()}), err AS (SELECT * FROM cards JOIN ind USING (subplan))"
    q = "greatest(est / actual, actual / est)"

    nest = "CASE WHEN strpos(child, ' ') = 0 THEN CAST({a} AS DOUBLE) + CAST(0.001 AS DOUBLE) * {c} ELSE CAST({c} AS DOUBLE) + CAST(0.001 AS DOUBLE) * {a} END"
    tn, en = nest.format(a="a.actual", c="c.actual"), nest.format(a="ae.est", c="ce.est")
    joined = "links JOIN cards c ON c.subplan = child JOIN cards a ON a.subplan = added JOIN cards p ON p.subplan = parent JOIN ind ce ON ce.subplan = child JOIN ind ae ON ae.subplan = added"
    cost = f"costs AS (SELECT parent, child, added, links.n_tables, least(CAST(c.actual AS DOUBLE) * a.actual, {tn}) AS tc, least(ce.est * ae.est, {en}) AS ec FROM {joined})"
    walk = "ways AS (SELECT subplan, CAST(0 AS DOUBLE) AS tc, CAST(0 AS DOUBLE) AS ec, subplan AS path FROM plans WHERE n_tables = 1 UNION ALL SELECT parent, round(w.tc + k.tc, 6), round(w.ec + k.ec, 6), w.path || ' > ' || parent FROM ways w JOIN costs k ON k.child = w.subplan)"
    full = f"WITH RECURSIVE {base}, {cards}, {ind}, {cost}, {walk}"
    top = P.SEP.join(sorted(G.tables))
    chosen = f"pick AS (SELECT * FROM ways WHERE subplan = '{top}' ORDER BY ec, path LIMIT 1)"
    win = lambda w: f"SELECT time_bucket(INTERVAL '{w}', ts) AS w_start"
    key = lambda t, c: f"SELECT '{t}.{c}' AS col, MAX(n) AS max_key, MIN(n) AS min_key, ROUND(AVG(n), 6) AS avg_key, ROUND(var_samp(n), 6) AS var_key, CAST(SUM(CASE WHEN k IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS \"count\", COUNT(k) AS \"distinct\", ROUND(SUM(CASE WHEN k IS NULL THEN n ELSE 0 END) / SUM(n), 6) AS null_frac FROM (SELECT {c} AS k, COUNT(*) AS n FROM {t} GROUP BY {c})"
    stat = lambda t, c: f"SELECT '{t}.{c}' AS col, CAST(MIN({c}) AS DOUBLE) + CAST(0 AS DOUBLE) AS min_value, CAST(MAX({c}) AS DOUBLE) AS max_value, (SELECT COUNT(*) FROM (SELECT DISTINCT {c} FROM {t})) AS num_values, COUNT(*) AS total_values FROM {t}"
    pct = lambda c, src, r=6: f"SELECT ROUND(AVG({c}), {r}) AS mean, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), {r}) AS p50, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.9), {r}) AS p90, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.99), {r}) AS p99 FROM {src}"
    bucket = lambda c, b: "(" + S.sha1_bucket_sql(c, b) + ")"
    keyed = f"jk AS ({_key_counts(None, None)})"
    jk = " UNION ALL ".join(f"(SELECT * FROM j{n})" for n in range(2, LEVELS + 1))
    steps = ", ".join(f"j{n} AS (SELECT parent AS subplan, MAX(least(r1, r2) * x.est / r1 * s.actual / r2) AS est FROM links JOIN j{n - 1} x ON x.subplan = links.child JOIN cards s ON s.subplan = links.added JOIN jk ON jk.child = links.child AND jk.added = links.added WHERE links.n_tables = {n} GROUP BY parent)" for n in range(3, LEVELS + 1))
    g = parse(CYCLE)
    cyc = ", ".join(f"('{P.SEP.join(s)}')" for s in P._names(g))
    cyc_edges = ", ".join(f"('{j.left[0]}', '{j.right[0]}'), ('{j.right[0]}', '{j.left[0]}')" for j in g.joins)
    cyc_sql = f"""WITH RECURSIVE p(subplan) AS (VALUES {cyc}), e(a, b) AS (VALUES {cyc_edges}), m AS (SELECT subplan, unnest(string_split(subplan, ' ')) AS a FROM p), k AS (SELECT * FROM m WHERE a <> 'n'),
r AS (SELECT subplan, MIN(a) AS a FROM k GROUP BY subplan UNION SELECT r.subplan, k.a FROM r JOIN e ON e.a = r.a JOIN k ON k.subplan = r.subplan AND k.a = e.b)
SELECT subplan, CAST(list_contains(string_split(subplan, ' '), 'n') AND (SELECT COUNT(*) FROM k WHERE k.subplan = p.subplan) > (SELECT COUNT(*) FROM r WHERE r.subplan = p.subplan) AS BIGINT) AS "cross" FROM p"""
    return SQL | many.oracle_sql() | featured.oracle_sql() | {
        "spj_count_3way": "SELECT COUNT(*) AS n FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_mktsegment = 'BUILDING' AND l_quantity > 30",
        "pred_regex_trycast": "SELECT COUNT(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS v FROM events) WHERE regexp_full_match(v, '(?:[1-9]\\d*|0)?(?:\\.\\d+)?') AND TRY_CAST(v AS DOUBLE) BETWEEN 10 AND 60",
        "col_stats": " UNION ALL ".join(stat(t, c) for t, c in [("lineitem", "l_quantity"), ("lineitem", "l_discount"), ("orders", "o_totalprice"), ("part", "p_size")]),
        "joinkey_stats": " UNION ALL ".join(key(t, c) for t, c in KEYS),
        "mcv_topk": "SELECT l_partkey AS value, COUNT(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, value LIMIT 10",
        "percentile_summary": pct("o_totalprice", "orders"),
        "constraints": f"WITH {base}, {cards}, {ind}, k(child, added, tc) AS (VALUES {', '.join(f"('{c}', '{a}', '{t}.{x}')" for c, a, t, x in _pk_edges())}), mf AS ({' UNION ALL '.join(f"SELECT '{t}.{x}' AS tc, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {t} GROUP BY {x})) AS f" for t, x in sorted({r[2:] for r in _pk_edges()}))}), ed AS (SELECT links.parent, p.est > f * a.est AS fk, c.est < p.est AS id FROM links JOIN k USING (child, added) JOIN mf USING (tc) JOIN ind p ON p.subplan = parent JOIN ind c ON c.subplan = links.child JOIN ind a ON a.subplan = links.added), nd AS (SELECT ind.subplan, COUNT(*) FILTER (WHERE fk) AS fk, COUNT(*) FILTER (WHERE id) AS id FROM ind LEFT JOIN ed ON parent = ind.subplan GROUP BY 1) SELECT CAST(SUM(fk) AS BIGINT) AS fk_errors, CAST(SUM(id) AS BIGINT) AS id_errors, round(AVG(CASE WHEN id > 0 THEN 1.0 ELSE 0.0 END), 6) AS mean_error FROM nd",
        "table_sample": f"SELECT COUNT(*) AS n FROM orders WHERE {bucket('o_orderkey', 10_000)} < 1000",
        "est_true_random": f"WITH {base}, {cards} SELECT subplan, round(greatest(1.0, actual * (1 - " + bucket("'7 ' || subplan", 9973) + " / CAST(9973 AS DOUBLE) * 50 / 100)), 4) AS est FROM cards",
        "est_random": f"WITH {base}, {cards} SELECT subplan, round(" + bucket("'7 ' || subplan", 9973) + " / CAST(9973 AS DOUBLE) * total, 4) AS est FROM cards",
        "clean_words": "SELECT p_partkey, array_to_string(list_filter(string_split_regex(regexp_replace(lower(p_name), '[^\\p{L} ]', '', 'g'), ' +'), lambda w: length(w) >= 3 AND w NOT IN ('a', 'an', 'and', 'by', 'for', 'from', 'in', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'with')), ' ') AS w FROM part",
        "subplans": f"WITH {base} SELECT subplan, CAST(n_tables AS BIGINT) AS n_tables FROM plans",
        "subplan_edges": f"WITH {base} SELECT parent, child, added FROM links",
        "node_degrees": f"WITH {base} SELECT subplan, (SELECT COUNT(*) FROM links WHERE parent = subplan) AS down, (SELECT COUNT(*) FROM links WHERE child = subplan) AS up FROM plans",
        "cross_join_check": cyc_sql,
        "plan_hints": TREE.replace("COUNT(*)", "COUNT(*) AS n", 1), "cached_execute": SQL["having_count"],
        "source_edges": f"WITH {base} SELECT parent, child FROM links UNION ALL SELECT subplan, '' FROM plans WHERE n_tables = 1",
        "column_norms": "WITH c AS (" + " UNION ALL ".join(stat(t, c) for t, c in NORM_COLUMNS) + "), u AS (UNPIVOT (SELECT min_value, max_value, CAST(num_values AS DOUBLE) AS num_values, CAST(total_values AS DOUBLE) AS total_values FROM c) ON min_value, max_value, num_values, total_values INTO NAME stat VALUE v) SELECT stat, ROUND(AVG(v), 4) AS mean, ROUND(stddev_pop(v), 4) AS std FROM u GROUP BY stat",
        "like_features": "SELECT p_partkey, " + ", ".join(f"list_sort(list_distinct([{bucket(f'substr(p_type, i, {k})', 8)} FOR i IN range(1, length(p_type) - {k} + 2)])) AS g{k}" for k in (1, 2, 3)) + ", length(p_type) AS length, CAST(regexp_matches(p_type, '[0-9]') AS BIGINT) AS digit FROM part",
        "subplan_true_counts": P.counts_sql(G), "subplan_totals": P.counts_sql(G, filtered=False), "count_message_passing": P.counts_sql(G),
        "implied_predicates": "SELECT c_nationkey, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE right(n_name, 1) < '5' GROUP BY c_nationkey",
        "sample_bitmap": f"SELECT o_orderkey AS k FROM orders WHERE {bucket('o_orderkey', 1000)} < 20 AND o_totalprice > 100000",
        "join_bitmap_intersection": f"SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders WHERE {bucket('o_orderkey', 1000)} < 50 AND o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE {bucket('l_orderkey', 1000)} < 50 AND l_quantity > 30)",
        "est_true": f"WITH {base}, {cards} SELECT subplan, CAST(actual AS DOUBLE) AS est FROM cards",
        "est_independence": f"WITH {base}, {cards}, {ind} SELECT subplan, est FROM ind",
        "est_true_rank": f"WITH {base}, {cards}, {ind} SELECT subplan, MAX(est) OVER (ORDER BY actual, subplan ROWS UNBOUNDED PRECEDING) AS est FROM err",
        "est_true_rank_tables": f"WITH {base}, {cards}, {ind} SELECT subplan, MAX(est) OVER (PARTITION BY n_tables ORDER BY actual, subplan ROWS UNBOUNDED PRECEDING) AS est FROM err",
        "est_joinkeys": f"WITH {base}, {cards}, {keyed}, j2 AS (SELECT subplan, CAST(actual AS DOUBLE) AS est FROM cards WHERE n_tables <= 2), {steps} SELECT subplan, ROUND(est, 4) AS est FROM ({jk})",
        "qerr": f"WITH {base}, {cards}, {ind} SELECT subplan, ROUND({q}, 4) AS qerr FROM err",
        "abs_err": f"WITH {base}, {cards}, {ind} SELECT subplan, ROUND(abs(est - actual), 2) AS err FROM err",
        "rel_err": f"WITH {base}, {cards}, {ind} SELECT subplan, ROUND(abs(actual - est) / actual, 4) AS err FROM err",
        "qerr_by_num_tables": f"WITH {base}, {cards}, {ind} SELECT n_tables, ROUND(AVG({q}), 4) AS qerr FROM err GROUP BY n_tables",
        "metric_summary": f"WITH {base}, {cards}, {ind}, qe AS (SELECT ROUND({q}, 4) AS q FROM err) {pct('q', 'qe', 3)}",
        "mse": f"WITH {base}, {cards}, {ind} SELECT ROUND(AVG(POWER(est - actual, 2)) / 1e6, 3) AS mse_millions FROM err",
        "qerr_joinkey": f"WITH {base}, {ind.split(', err AS')[0]}, {keyed}, k AS (SELECT jk.child, jk.added, greatest(least(est, r2), 0) AS e, r1 FROM jk JOIN ind ON subplan = child), z AS (SELECT child, added, CASE WHEN e <= 0 THEN 1 ELSE e END AS e, CASE WHEN r1 <= 0 THEN 1 ELSE r1 END AS r FROM k) SELECT child, added, ROUND(greatest(e / r, r / e), 4) AS qerr FROM z",
        "plan_forced_order": TREE.replace("COUNT(*)", "COUNT(*) AS n", 1),
        "executed_subplans": f"{full}, {chosen} SELECT unnest(string_split(path, ' > ')) AS subplan FROM pick",
        "corr_est_true": f"WITH {base}, {cards}, {ind} SELECT ROUND(corr(est, actual), 6) AS r FROM err",
        "edge_cost_c": f"{full} SELECT parent, child, ROUND(tc, 4) AS cost FROM costs",
        "edge_cost_registry": f"WITH {base}, {cards}, {ind}, m AS (SELECT parent, child, CAST(c.actual AS DOUBLE) AS x, CAST(a.actual AS DOUBLE) AS y, CAST(p.actual AS DOUBLE) AS z, CASE WHEN strpos(child, ' ') = 0 THEN a.actual ELSE c.actual END AS probe, {tn} AS nested FROM {joined}) " + " UNION ALL ".join(f"SELECT '{k}' AS model, parent, child, ROUND({v}, 3) AS cost FROM m" for k, v in {"hash": "least(x + y, nested)", "nested": "nested", "product": "x * y", "product5": "5 * x * y", "double": "CAST(2 * probe AS DOUBLE)", "ratio": "2 * greatest(probe, z)", "ratio_product": "least(2 * greatest(probe, z), x * y)", "ratio_small": "CASE WHEN x < 5 OR y < 5 THEN x * y ELSE least(2 * greatest(probe, z), x * y) END", "max_small": "CASE WHEN x < 5 OR y < 5 THEN x * y ELSE least(2 * greatest(x, y), x * y) END", "light": "CAST(0.001 AS DOUBLE) * (x + y)", "C": "least(x * y, nested)"}.items()),
        "plan_cost_opt": f"{full} SELECT subplan, ROUND(MIN(tc), 3) AS cost FROM ways GROUP BY subplan",
        "plan_cost_est": f"{full}, {chosen} SELECT subplan, ROUND(ec, 3) AS est_cost, ROUND(tc, 3) AS true_cost FROM pick",
        "plan_path": f"{full}, {chosen} SELECT subplan, path FROM pick",
        "relative_cost": f"{full}, {chosen} SELECT ROUND(tc / m, 4) AS relative, ROUND(tc - m, 2) AS excess FROM pick, (SELECT MIN(tc) AS m FROM ways WHERE subplan = '{top}')",
        "masked_qerr": "WITH names AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS j FROM (SELECT DISTINCT c_mktsegment FROM customer)), "
        "a AS (SELECT c_nationkey AS i, j, ln(COUNT(*)) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN names USING (c_mktsegment) GROUP BY c_nationkey, j), "
        f"h AS (SELECT *, {bucket("'1 ' || i || ' ' || j", 10_000)} >= 2500 AS known FROM a), m AS (SELECT AVG(v) AS mean FROM h WHERE known), r AS (SELECT i, AVG(v) AS ri FROM h WHERE known GROUP BY i), c AS (SELECT j, AVG(v) AS cj FROM h WHERE known GROUP BY j), "
        "f AS (SELECT h.*, coalesce(ri, mean) + coalesce(cj, mean) - mean AS x FROM h LEFT JOIN r USING (i) LEFT JOIN c USING (j), m) "
        "SELECT CAST(COUNT(*) FILTER (NOT known) AS BIGINT) AS hidden, round(100 * (1 - CAST(COUNT(*) FILTER (known) AS DOUBLE) / (COUNT(DISTINCT i) * COUNT(DISTINCT j))), 4) AS zero_percent, round(AVG(exp(abs(x - v))) FILTER (NOT known), 4) AS qerr FROM f",
        "svd_reconstruct": _svd_sql(), "flow_loss": f"{full}, {_flow_sql()}",
        "hash_bucket": f"SELECT p_partkey, {bucket('p_name', 10)} AS b FROM part",
        "minmax_feature": "SELECT p_partkey, ROUND(CAST(p_size - lo AS DOUBLE) / (hi - lo), 6) AS f FROM part, (SELECT MIN(p_size) AS lo, MAX(p_size) AS hi FROM part)",
        "like_ngrams": "SELECT g, COUNT(*) AS n FROM (SELECT substr(p_type, i, 3) AS g FROM (SELECT p_type, unnest(range(1, length(p_type) - 1)) AS i FROM part)) GROUP BY g",
        "join_onehot": f"WITH {base}, e(edge, a, b) AS (VALUES {', '.join(f'({chr(39)}{x.left[0]}{x.right[0]}{chr(39)}, {chr(39)}{x.left[0]}{chr(39)}, {chr(39)}{x.right[0]}{chr(39)})' for x in G.joins)}) SELECT subplan, edge, CAST(list_contains(string_split(subplan, ' '), a) AND list_contains(string_split(subplan, ' '), b) AS BIGINT) AS held FROM plans, e",
        "y_transforms": f"WITH {base}, {cards}, s AS (SELECT MIN(actual) AS lo, MAX(actual) AS hi, AVG(actual) AS m, stddev_pop(actual) AS sd, AVG(ln(actual)) AS lm, stddev_pop(ln(actual)) AS lsd, MIN(actual / total) AS slo, MAX(actual / total) AS shi FROM cards) SELECT subplan, t.mode AS mode, round(t.y, 6) AS y, round(CAST(actual AS DOUBLE), 3) AS back FROM (SELECT subplan, actual, unnest([" + ", ".join(f"{{'mode': '{m}', 'y': {x}}}" for m, x in {"log": "(ln(actual) - ln(lo)) / (ln(hi) - ln(lo))", "minmax": "(actual - lo) / CAST(hi - lo AS DOUBLE)", "whitening": "(actual - m) / sd", "logwhitening": "(ln(actual) - lm) / lsd", "selectivity": "(actual / total - slo) / (shi - slo)", "selectivity-log": "ln(actual / total)", "log-selectivity": "ln(actual) / ln(total)"}.items()) + "]) AS t FROM cards, s)",
        "log_bucket": f"WITH {base}, {cards} SELECT subplan, CAST(CASE " + " ".join(f"WHEN actual > {10**i} AND actual < {10 ** (i + 1)} THEN {i}" for i in range(8)) + " ELSE 8 END AS BIGINT) AS b FROM cards",
        "quantile_chunk": "WITH p AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS i, COUNT(*) OVER () AS m FROM p) SELECT CAST(least(i // (m // 7), 6) AS BIGINT) AS chunk, COUNT(*) AS rows, CAST(SUM(n) AS BIGINT) AS n FROM r GROUP BY 1",
        "ilike_prefix_counts": "WITH w AS (SELECT unnest(string_split_regex(lower(p_name), '\\W+')) AS w FROM part), p AS (SELECT substr(w, 1, k) AS prefix FROM w, range(1, 5) t(k) WHERE k <= length(w)) SELECT prefix, COUNT(*) AS n FROM p GROUP BY prefix HAVING COUNT(*) BETWEEN 5 AND 500",
        "energy_rank": "WITH v AS (SELECT o_custkey AS id, CAST(COUNT(*) AS DOUBLE) AS v FROM orders GROUP BY o_custkey), c AS (SELECT row_number() OVER (ORDER BY v DESC, id) AS rank, SUM(v) OVER (ORDER BY v DESC, id ROWS UNBOUNDED PRECEDING) / SUM(v) OVER () AS cum FROM v) SELECT MIN(rank) AS rank FROM c WHERE cum > 0.9",
        "asof": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events",
        "stream_tumbling": f"{win('1 hour')}, w_start + INTERVAL '1 hour' AS w_end, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS v FROM events GROUP BY ALL",
        "stream_sliding": "WITH e AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS w_start, event_type, value FROM events, range(0, 2) t(k)) SELECT w_start, w_start + INTERVAL '1 hour' AS w_end, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS v FROM e GROUP BY ALL",
        "stream_session": "WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT MIN(ts) AS w_start, MAX(ts) + INTERVAL '2 hours' AS w_end, user_id, COUNT(*) AS n, ROUND(SUM(value), 4) AS v FROM b GROUP BY user_id, s",
    }


def _svd_sql() -> str:
    """The approximation of rank 2 by projections on the two strongest directions, each from 40 squarings of the columns' products."""
    square = "[list_sum([m[n * (ab // n) + k + 1] * m[n * k + ab % n + 1] FOR k IN range(n)]) FOR ab IN range(n * n)]"
    scaled = lambda m: f"list_transform({m}, lambda x: x / list_sum([({m})[(n + 1) * d + 1] FOR d IN range(n)]))"
    power = lambda name, start: f"{name}(step, n, m) AS (SELECT 0, n, {scaled('g')} FROM {start} UNION ALL SELECT step + 1, n, {scaled('s')} FROM (SELECT step, n, {square} AS s FROM {name} WHERE step < 40))"
    return (
        "WITH RECURSIVE names AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS j FROM (SELECT DISTINCT c_mktsegment FROM customer)), size AS (SELECT COUNT(*) AS n FROM names), "
        "a AS (SELECT c_nationkey AS i, j, ln(COUNT(*)) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN names USING (c_mktsegment) GROUP BY c_nationkey, j), "
        "gr AS (SELECT n, list(coalesce(v, 0) ORDER BY p, q) AS g FROM size, (SELECT x.j AS p, y.j AS q, (SELECT SUM(u.v * w.v) FROM a u JOIN a w USING (i) WHERE u.j = x.j AND w.j = y.j) AS v FROM names x, names y) GROUP BY n), "
        f"{power('p1', 'gr')}, strongest AS (SELECT m FROM p1 WHERE step = 40), "
        "rest AS (SELECT n, [g[i + 1] - list_dot_product(g, m) * m[i + 1] FOR i IN range(n * n)] AS g FROM gr, strongest), "
        f"{power('p2', 'rest')}, two AS (SELECT n, [strongest.m[i + 1] + p2.m[i + 1] FOR i IN range(n * n)] AS m FROM p2, strongest WHERE step = 40) "
        "SELECT CAST(i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(SUM(v * m[n * a.j + b.j + 1]), 6) AS value FROM a, names b, two GROUP BY i, b.j"
    )


def _flow_sql() -> str:
    """After the expressions of costs and plans: potentials by elimination, then the true costs of the currents."""
    return (
        "ed AS (SELECT parent, child, ec, tc FROM costs UNION ALL SELECT subplan, '', 1, 1 FROM plans WHERE n_tables = 1), nd AS (SELECT subplan, row_number() OVER (ORDER BY subplan) AS k, COUNT(*) OVER () AS n FROM plans), "
        "en AS (SELECT i, j, SUM(g) AS g FROM (SELECT p.k AS i, p.k AS j, 1 / ec AS g FROM ed JOIN nd p ON p.subplan = parent UNION ALL SELECT c.k, c.k, 1 / ec FROM ed JOIN nd c ON c.subplan = child "
        "UNION ALL SELECT p.k, c.k, -1 / ec FROM ed JOIN nd p ON p.subplan = parent JOIN nd c ON c.subplan = child UNION ALL SELECT c.k, p.k, -1 / ec FROM ed JOIN nd p ON p.subplan = parent JOIN nd c ON c.subplan = child) GROUP BY i, j), "
        "ro AS (SELECT x.k AS i, list(coalesce(g, 0) ORDER BY y.k) || [CASE WHEN x.subplan = (SELECT arg_max(subplan, n_tables) FROM plans) THEN 1 ELSE 0 END] AS r FROM nd x CROSS JOIN nd y LEFT JOIN en ON en.i = x.k AND en.j = y.k GROUP BY x.k, x.subplan), "
        "ge(k, m) AS (SELECT 1, list(r ORDER BY i) FROM ro UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM ge WHERE k <= len(m)), "
        "po AS (SELECT subplan, m[nd.k][len(m) + 1] AS v FROM nd, ge WHERE ge.k = len(m) + 1) "
        "SELECT 'tree' AS query_id, printf('%.5e', SUM(tc * pow((p.v - coalesce(c.v, 0)) / ec, 2))) AS loss FROM ed JOIN po p ON p.subplan = parent LEFT JOIN po c ON c.subplan = child"
    )
