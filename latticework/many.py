"""A workload of many queries from templates: counts, errors, plan costs and learned estimates over all of them, and their SQL."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import functions as F

from .operators import estimate as E
from .operators import learn as L
from .plans import lattice as P
from .plans.sqlfront import Graph, parse, predicate_op
from .plans.templates import generate
from .sources.tables import memo, read_template, stored

SHAPES = ("chain", "pair", "star")
#: Queries of each template.
EACH = 8


@cache
def texts() -> dict[str, str]:
    """Query texts by id (template and number); templates with listed options alone, so no data is read."""
    top = Path(__file__).parent / "plans" / "shapes"
    return {f"{t}-{i}": q for t in SHAPES for i, q in enumerate(generate(None, None, read_template(top / f"{t}.toml"), EACH, seed=len(t)))}


@cache
def graphs() -> dict[str, Graph]:
    return {q: parse(text) for q, text in texts().items()}


def _template(c="query_id"):
    return F.substring_index(c, "-", 1).alias("template")


def _plans(spark):
    return memo(spark, "many plans", lambda: P.subplans_of(spark, graphs()))


def _links(spark):
    return memo(spark, "many edges", lambda: P.edges(_plans(spark)))


def _cards(spark, d):
    return P.cardinalities_of(spark, d, graphs())


def _est(spark, d):
    return memo(spark, f"many independence {d}", lambda: E.independence_of(spark, d, graphs(), _cards(spark, d), _plans(spark)))


def many_subplans(spark, d):
    return _plans(spark).select("query_id", "subplan", "n_tables")


def many_edges(spark, d):
    return _links(spark).select("query_id", "parent", "child", "added")


def many_true_counts(spark, d):
    return _cards(spark, d).select("query_id", "subplan", F.col("actual").alias("n"))


def many_totals(spark, d):
    return _cards(spark, d).select("query_id", "subplan", F.col("total").alias("n"))


def workload_mix(spark, d):
    """How often each kind of predicate occurs in the queries of a template."""
    rows = [(q.split("-")[0], predicate_op(p)) for q, g in graphs().items() for ps in g.preds.values() for p in ps]
    return spark.createDataFrame(rows, "template string, kind string").groupBy("template", "kind").agg(F.count("*").alias("n"))


def qerr_by_template(spark, d):
    e = E.errors(_est(spark, d), _cards(spark, d), "qerr")
    p = lambda q: F.round(F.percentile("error", F.lit(q)), 3)
    return e.groupBy(_template()).agg(F.count("*").alias("n"), F.round(F.avg("error"), 3).alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"))


def metric_registry(spark, d):
    """Each metric's mean over the workload."""
    out = None
    for name in E.METRICS:
        one = E.errors(_est(spark, d), _cards(spark, d), name).agg(F.lit(name).alias("metric"), F.avg("error").alias("m"))
        out = one if out is None else out.unionByName(one)
    return out.select("metric", F.format_string("%.5e", "m").alias("mean"))


def _paths(spark, d, value):
    cost = lambda c, v: P.edge_costs(_links(spark), c, v)
    true = cost(_cards(spark, d), "actual").select("query_id", "parent", "child", "added", "n_tables", F.col("cost").alias("actual_cost"))
    est = cost(_est(spark, d), "est").select("query_id", "parent", "child", F.col("cost").alias("est_cost"))
    costs = memo(spark, f"many costs {d}", lambda: true.join(est, ["query_id", "parent", "child"]))
    whole = spark.createDataFrame([(q, P.SEP.join(sorted(g.tables))) for q, g in graphs().items()], "query_id string, subplan string")
    return P.best_paths(costs, max(len(g.tables) for g in graphs().values()), value, "actual_cost").join(F.broadcast(whole), ["query_id", "subplan"])


def many_plans(spark, d):
    """The join order that estimates choose for each query, its cost under true rows, and the best plan's."""
    best = _paths(spark, d, "actual_cost").select("query_id", F.round("best", 3).alias("opt"))
    return _paths(spark, d, "est_cost").select("query_id", "path", F.round("other", 3).alias("cost")).join(best, "query_id")


def plan_cost_by_template(spark, d):
    p = stored(many_plans(spark, d), "many-plans")
    return E.relative_costs(p.select("query_id", "cost", _template()), p.select("query_id", F.col("opt").alias("cost")), ["template"])


def _rows(spark, d):
    """One row for each subplan: aliases held, number of tables, and the log of what independence expects, as flat; actual."""
    aliases = sorted({a for g in graphs().values() for a in g.tables})
    flat = F.array(*[F.array_contains("nodes", a).cast("double") for a in aliases], F.col("n_tables") / len(aliases), F.log1p("est") / 20)
    rows = _plans(spark).join(_est(spark, d), ["query_id", "subplan"]).withColumn("flat", flat)
    return rows.join(_cards(spark, d).select("query_id", "subplan", "actual", "total"), ["query_id", "subplan"])


def _data(spark, d):
    return memo(spark, f"many features {d}", lambda: _rows(spark, d))


def _trees(kind):
    """Estimates of held-out queries by 100 trees of depth 10 fitted on the others."""

    def run(spark, d):
        data = _data(spark, d).withColumn("y", F.log(F.greatest(F.lit(1), F.col("actual"))))
        width = len(data.select("flat").first()[0])
        data = data.select("*", *[F.get("flat", i).alias(f"f{i}") for i in range(width)])
        train, test = L.split(data, "query_id", 1, 25)
        return L.fit_trees(train, [f"f{i}" for i in range(width)], "y", kind).transform(test).select("query_id", "subplan", F.exp("prediction").alias("est"))

    return run


FUNCTIONS = [many_subplans, many_edges, many_true_counts, many_totals, workload_mix, qerr_by_template, metric_registry, many_plans, plan_cost_by_template]


def queries():
    return {f.__name__: f for f in FUNCTIONS} | {"rf_estimator": _trees("rf"), "gbt_estimator": _trees("gbt")}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ctes() -> dict[str, str]:
    """Common table expressions of the workload by name: lattice, counts, estimates, costs and chosen plans."""
    names = {q: P._names(g) for q, g in graphs().items()}
    plans = ", ".join(f"('{q}', '{P.SEP.join(s)}', {len(s)})" for q, ss in names.items() for s in ss)
    links = ", ".join(f"('{q}', '{P.SEP.join(p)}', '{P.SEP.join(c)}', '{(set(p) - set(c)).pop()}', {len(p)})" for q, ss in names.items() for p in ss for c in ss if len(c) == len(p) - 1 and set(c) < set(p))
    base = f"plans(query_id, subplan, n_tables) AS (VALUES {plans}), links(query_id, parent, child, added, n_tables) AS (VALUES {links})"
    count = lambda filtered: " UNION ALL ".join(f"SELECT '{q}' AS query_id, t.* FROM ({P.counts_sql(g, filtered)}) AS t" for q, g in graphs().items())
    act = f"act AS ({count(True)})"
    sides = sorted({(g.tables[a], c) for g in graphs().values() for j in g.joins for a, c in (j.left, j.right)})
    ndv = "ndv AS (" + " UNION ALL ".join(f"SELECT '{t}.{c}' AS c, COUNT(DISTINCT {c}) AS d FROM {t}" for t, c in sides) + ")"
    edges = ", ".join(f"('{q}', '{j.left[0]}', '{j.right[0]}', '{g.tables[j.left[0]]}.{j.left[1]}', '{g.tables[j.right[0]]}.{j.right[1]}')" for q, g in graphs().items() for j in g.joins)
    ind = (
        f"e(query_id, l, r, lc, rc) AS (VALUES {edges}), ed AS (SELECT e.*, greatest(x.d, y.d) AS d FROM e JOIN ndv x ON x.c = lc JOIN ndv y ON y.c = rc), "
        "up AS (SELECT p.query_id, p.subplan, SUM(ln(a.n)) AS u FROM plans p JOIN act a ON a.query_id = p.query_id AND list_contains(string_split(p.subplan, ' '), a.subplan) GROUP BY ALL), "
        "dn AS (SELECT p.query_id, p.subplan, SUM(ln(d)) AS v FROM plans p JOIN ed USING (query_id) WHERE list_contains(string_split(p.subplan, ' '), l) AND list_contains(string_split(p.subplan, ' '), r) GROUP BY ALL), "
        "ind AS (SELECT query_id, subplan, round(exp(u - coalesce(v, 0)), 4) AS est FROM up LEFT JOIN dn USING (query_id, subplan)), "
        "err AS (SELECT split_part(query_id, '-', 1) AS template, est, CAST(n AS DOUBLE) AS act, CASE WHEN est <= 0 THEN 1 ELSE est END AS e, CASE WHEN n <= 0 THEN 1 ELSE n END AS y FROM ind JOIN act USING (query_id, subplan))"
    )
    nest = "CASE WHEN strpos(child, ' ') = 0 THEN {a} + CAST(0.001 AS DOUBLE) * {c} ELSE {c} + CAST(0.001 AS DOUBLE) * {a} END"
    cost = lambda c, a: f"least({c} * {a}, {nest.format(a=a, c=c)})"
    costs = (
        "n AS (SELECT query_id, subplan, CAST(n AS DOUBLE) AS n, est FROM act JOIN ind USING (query_id, subplan)), "
        f"costs AS (SELECT links.*, {cost('c.n', 'a.n')} AS tc, {cost('c.est', 'a.est')} AS ec FROM links JOIN n c ON c.query_id = links.query_id AND c.subplan = child JOIN n a ON a.query_id = links.query_id AND a.subplan = added), "
        "ways AS (SELECT query_id, subplan, CAST(0 AS DOUBLE) AS tc, CAST(0 AS DOUBLE) AS ec, subplan AS path FROM plans WHERE n_tables = 1 "
        "UNION ALL SELECT w.query_id, parent, round(w.tc + k.tc, 6), round(w.ec + k.ec, 6), w.path || ' > ' || parent FROM ways w JOIN costs k ON k.query_id = w.query_id AND k.child = w.subplan), "
        "top AS (SELECT query_id, arg_max(subplan, n_tables) AS subplan FROM plans GROUP BY query_id), whole AS (SELECT ways.* FROM ways JOIN top USING (query_id, subplan)), "
        "pick AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ec, path) = 1), "
        "best AS (SELECT query_id, MIN(tc) AS opt FROM whole GROUP BY query_id), "
        "chosen AS (SELECT query_id, path, round(tc, 3) AS cost, round(opt, 3) AS opt FROM pick JOIN best USING (query_id))"
    )
    texted = f"t(q, text) AS (VALUES {', '.join(f'({quoted(i)}, {quoted(x)})' for i, x in texts().items())})"
    return {"base": base, "act": act, "totals": count(False), "ndv": ndv, "ind": ind, "costs": costs, "texts": texted}


def oracle_sql():
    of = ctes()
    base, act, ndv, ind, costs = (of[c] for c in ("base", "act", "ndv", "ind", "costs"))
    full = f"WITH RECURSIVE {base}, {act}, {ndv}, {ind}, {costs}"
    kinds = {"in": " IN \\(", "ilike": " ILIKE ", "like": " LIKE ", "eq": "[a-z]+\\.[a-z_]+ = ''", "lt": " BETWEEN | [<>]=? "}
    mix = " UNION ALL ".join(f"SELECT split_part(q, '-', 1) AS template, '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM t" for k, p in kinds.items())
    q = "greatest(e / y, y / e)"
    pct = lambda x: f"round(quantile_cont({q}, {x}), 3)"
    metric = {"qerr": q, "abs": "abs(est - act)", "rel": "abs(act - est) / y", "mse": "pow(est - act, 2)"}
    return {
        "many_subplans": f"WITH {base} SELECT query_id, subplan, CAST(n_tables AS BIGINT) AS n_tables FROM plans",
        "many_edges": f"WITH {base} SELECT query_id, parent, child, added FROM links",
        "many_true_counts": f"WITH {act} SELECT * FROM act",
        "many_totals": of["totals"],
        "workload_mix": f"WITH {of['texts']} SELECT template, kind, CAST(SUM(n) AS BIGINT) AS n FROM ({mix}) GROUP BY ALL HAVING SUM(n) > 0",
        "qerr_by_template": f"WITH {base}, {act}, {ndv}, {ind} SELECT template, COUNT(*) AS n, round(AVG({q}), 3) AS mean, {pct(0.5)} AS p50, {pct(0.9)} AS p90 FROM err GROUP BY template",
        "metric_registry": f"WITH {base}, {act}, {ndv}, {ind} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, printf('%.5e', AVG({x})) AS mean FROM err" for m, x in metric.items()),
        "many_plans": f"{full} SELECT query_id, path, cost, opt FROM chosen",
        "plan_cost_by_template": f"{full} SELECT split_part(query_id, '-', 1) AS template, COUNT(*) AS queries, round(SUM(cost) / SUM(opt), 4) AS relative, round(AVG(cost - opt), 2) AS excess FROM chosen GROUP BY 1",
    }
