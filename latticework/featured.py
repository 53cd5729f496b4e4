"""Featurization of the workload of many queries, as queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import many
from .functions.scalars import sha1_bucket_sql
from .operators import features as X
from .operators import learn as L
from .operators import nets as N
from .operators import stats as ST
from .plans import lattice as P
from .sources.tables import memo, table

#: The queries of each template held out from what counts as seen.
HELD_OUT = (6, 7)


def _layout():
    return X.layout(many.graphs())


def _preds(spark, d):
    g = many.graphs()
    preds = X.predicate_rows(spark, g)
    train, _ = L.split(preds, "query_id", 0, kind="custom", custom=[q for q in g if int(q.split("-")[1]) in HELD_OUT])
    ranges = memo(spark, f"workload column ends {d}", lambda: ST.column_ends(spark, d, [tuple(c.split(".")) for c in _layout().columns]))
    return memo(spark, f"predicate vectors {d}", lambda: X.predicate_vectors(preds, _layout(), ranges, X.seen(train)))


def _joins(spark, d):
    j = X.join_rows(spark, many.graphs())
    keys = sorted({tuple(side.split(".")) for e in _layout().edges for side in e.split("=")})
    stats = memo(spark, f"workload key statistics {d}", lambda: ST.join_key_stats(spark, d, keys))
    return j, X.join_vectors(j, _layout(), stats)


def workload_maxima(spark, d):
    g = many.graphs()
    return X.maxima(X.table_rows(spark, g), X.join_rows(spark, g), X.predicate_rows(spark, g))


def seen_constants(spark, d):
    g = {q: x for q, x in many.graphs().items() if int(q.split("-")[1]) not in HELD_OUT}
    return X.seen(X.predicate_rows(spark, g))


def label_range(spark, d):
    r = X.label_range(many._cards(spark, d))
    return r.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def predicate_features(spark, d):
    return X.named(_preds(spark, d), "vec", _layout().predicate_names(), "query_id", "alias", "c").withColumn("v", F.round("v", 6))


def join_features(spark, d):
    return X.named(_joins(spark, d)[1], "vec", _layout().join_names(), "edge").withColumn("v", F.round("v", 5)).where("v <> 0")


def sets(spark, d):
    """(query_id, subplan, tables, joins, predicates), stored."""
    lay, g = _layout(), many.graphs()
    rows = None
    for t in lay.tables:
        one = table(spark, d, t).agg(F.lit(t).alias("t"), F.count("*").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    j, vec = _joins(spark, d)
    joins = j.join(F.broadcast(vec), "edge")
    return memo(spark, f"sets {d}", lambda: X.set_vectors(many._plans(spark), X.table_rows(spark, g), joins, _preds(spark, d), lay, rows))


def set_features(spark, d):
    """By subplan and set: elements, and the sum of all cells of their vectors."""
    s = sets(spark, d)
    total = lambda c: F.aggregate(F.flatten(c), F.lit(0.0), lambda a, x: a + x)
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.size(c).cast("long").alias("n"), F.round(total(c), 3).alias("total")) for c in ("tables", "joins", "predicates")])
    return s.select("query_id", "subplan", F.explode(parts).alias("x")).select("query_id", "subplan", "x.*")


def combined(spark, d):
    g = many.graphs()
    return memo(spark, f"combined {d}", lambda: X.combined_vectors(many._plans(spark), X.table_rows(spark, g), X.join_rows(spark, g), _preds(spark, d), _layout()))


def combined_features(spark, d):
    return X.named(combined(spark, d), "vec", _layout().combined_names(), "query_id", "subplan").withColumn("v", F.round("v", 6))


def global_features(spark, d):
    g = many.graphs()
    costs = P.edge_costs(many._links(spark), many._est(spark, d), "est").select("query_id", "parent", "cost")
    path = many.many_plans(spark, d).select("query_id", F.explode(F.split("path", " > ")).alias("subplan"))
    out = X.global_cells(many._plans(spark), many._links(spark), X.table_rows(spark, g), X.join_rows(spark, g), many._est(spark, d), costs, path)
    return out.withColumn("v", F.round("v", 6)).where("v <> 0")


def _labelled(spark, d, sets_too):
    """Rows for the networks: sets (or, without, the combined vector as flat), counts, and a key."""
    rows = many._data(spark, d)
    if sets_too:
        rows = rows.join(sets(spark, d), ["query_id", "subplan"])
    else:
        vec = combined(spark, d).withColumnRenamed("vec", "cells")
        rows = rows.join(vec, ["query_id", "subplan"]).withColumn("flat", F.concat("flat", "cells"))
    return rows.withColumn("key", F.concat_ws(" ", "query_id", "subplan"))


def _net(names, **how):
    """Estimates of held-out queries by a network fitted on the others, some of which only say when to stop."""

    def run(spark, d):
        train, test, val = L.split(_labelled(spark, d, bool(names)), "query_id", 1, 25, val_percent=15)
        net, widths, flat = N.fit_net(train, "actual", "key", names, val, **how)
        out = N.net_estimates(test.select(F.col("key").alias("subplan"), *names, "flat"), net, widths, flat).withColumnRenamed("subplan", "key")
        return out.join(test.select("key", "query_id", "subplan"), "key").select("query_id", "subplan", "est")

    return run


FUNCTIONS = [workload_maxima, seen_constants, label_range, predicate_features, join_features, set_features, combined_features, global_features]


def queries():
    nets = {"fcnn_estimator": _net((), patience=60), "mscn_estimator": _net(N.SETS, patience=60)}
    return {f.__name__: f for f in FUNCTIONS} | nets


def oracle_sql():
    """Predicates, joins and aliases are cut from the queries' texts by patterns, apart from the parser."""
    of, lay = many.ctes(), _layout()
    get = lambda p, *groups: ", ".join(f"unnest(regexp_extract_all(text, '{p}', {i})) AS {n}" for i, n in enumerate(groups, 1))
    name, text = r"(\w+)\.(\w+)", "''([^'']*)''"
    held = " OR ".join(f"q LIKE '%-{i}'" for i in HELD_OUT)
    listed = get(name + r" IN \(([^)]*)\)", "a", "c", "v")
    read = (
        f"{of['texts']}, al AS (SELECT q, {get(r'(\w+) AS (\w+)', 't', 'a')} FROM t), "
        f"j0 AS (SELECT q, {get(f'{name} = {name}', 'l', 'lc', 'r', 'rc')} FROM t), "
        "jn AS (SELECT j0.q, l, r, least(x.t || '.' || lc, y.t || '.' || rc) || '=' || greatest(x.t || '.' || lc, y.t || '.' || rc) AS edge FROM j0 JOIN al x ON x.q = j0.q AND x.a = l JOIN al y ON y.q = j0.q AND y.a = r), "
        f"c0 AS (SELECT q, a, c, 'lt' AS kind, lo, hi, [lo, hi] AS vals FROM (SELECT q, {get(f'{name} BETWEEN {text} AND {text}', 'a', 'c', 'lo', 'hi')} FROM t) "
        f"UNION ALL SELECT q, a, c, 'lt', v, NULL, [v, NULL] FROM (SELECT q, {get(f'{name} >=? {text}', 'a', 'c', 'v')} FROM t) "
        f"UNION ALL SELECT q, a, c, 'lt', NULL, v, [NULL, v] FROM (SELECT q, {get(f'{name} <=? {text}', 'a', 'c', 'v')} FROM t) "
        f"UNION ALL SELECT q, a, c, 'in', NULL, NULL, list_transform(string_split(v, ', '), lambda x: trim(x, '''')) FROM (SELECT q, {listed} FROM t) "
        + "".join(f"UNION ALL SELECT q, a, c, '{k}', NULL, NULL, [v] FROM (SELECT q, {get(f'{name} {w} {text}', 'a', 'c', 'v')} FROM t) " for k, w in (("eq", "="), ("like", "LIKE"), ("ilike", "ILIKE")))
        + "), pr AS (SELECT c0.q, a, t || '.' || c AS c, kind, lo, hi, vals FROM c0 JOIN al USING (q, a)), "
        f"known AS (SELECT DISTINCT c, v AS value FROM (SELECT q, c, unnest(vals) AS v FROM pr) WHERE v IS NOT NULL AND NOT ({held}))"
    )
    ends = "ends AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, TRY_CAST(MIN({c.split('.')[1]}) AS DOUBLE) AS mn, TRY_CAST(MAX({c.split('.')[1]}) AS DOUBLE) AS mx FROM {c.split('.')[0]}" for c in lay.columns) + ")"
    scaled = lambda v, other: f"least(1, greatest(0, (coalesce(CAST({v} AS DOUBLE), {other}) - mn) / (mx - mn)))"
    values = (
        f"{ends}, lk AS (SELECT q, a, c, replace(vals[1], '%', '') AS x FROM pr WHERE kind IN ('like', 'ilike') AND c IN (SELECT c FROM known)), "
        f"cells AS (SELECT q, a, c, 'low' AS cell, {scaled('lo', 'mn')} AS v FROM pr JOIN ends USING (c) WHERE kind = 'lt' UNION ALL SELECT q, a, c, 'high', {scaled('hi', 'mx')} FROM pr JOIN ends USING (c) WHERE kind = 'lt' "
        f"UNION ALL SELECT DISTINCT q, a, c, 'bucket ' || {sha1_bucket_sql('value', lay.buckets)}, 1 FROM (SELECT q, a, c, unnest(vals) AS value FROM pr WHERE kind IN ('eq', 'in')) JOIN known USING (c, value) "
        f"UNION ALL SELECT DISTINCT q, a, c, 'like ' || {sha1_bucket_sql('y', lay.like_buckets)}, 1 FROM (SELECT q, a, c, unnest([x] || flatten([[substr(x, i, n) FOR i IN range(1, length(x) - n + 2)] FOR n IN [1, 2, 3]])) AS y FROM lk) "
        "UNION ALL SELECT q, a, c, 'length', length(x) FROM lk UNION ALL SELECT q, a, c, 'digit', CASE WHEN regexp_matches(x, '[0-9]') THEN 1 ELSE 0 END FROM lk), "
        "pv AS (SELECT q, a, c, cell, v FROM cells WHERE v <> 0 UNION ALL SELECT q, a, c, 'column ' || c, 1 FROM pr UNION ALL SELECT q, a, c, 'kind ' || kind, 1 FROM pr)"
    )
    keys = sorted({side for e in lay.edges for side in e.split("=")})
    column = lambda s: "distinct_" if s == "distinct" else s
    stat = lambda t, c: (
        f"SELECT '{t}.{c}' AS col, MAX(n) AS max_key, MIN(n) AS min_key, round(AVG(n), 6) AS avg_key, round(var_samp(n), 6) AS var_key, SUM(CASE WHEN k IS NULL THEN 0 ELSE n END) AS count, "
        f"COUNT(k) AS distinct_, round(SUM(CASE WHEN k IS NULL THEN n ELSE 0 END) / SUM(n), 6) AS null_frac FROM (SELECT {c} AS k, COUNT(*) AS n FROM {t} GROUP BY 1)"
    )
    z = lambda side, s: f"SELECT edge, '{'first' if side == 'x' else 'second'} {s}' AS cell, CASE WHEN n.{s}_sd > 0 THEN ({side}.{column(s)} - n.{s}_m) / n.{s}_sd ELSE 0 END AS v FROM two JOIN ks x ON x.col = a JOIN ks y ON y.col = b, n"
    joined = (
        "ks AS (" + " UNION ALL ".join(stat(*k.split(".")) for k in keys) + "), n AS (SELECT " + ", ".join(f"AVG({column(s)}) AS {s}_m, stddev_pop({column(s)}) AS {s}_sd" for s in X.KEY_STATS) + " FROM ks), "
        "e AS (SELECT DISTINCT edge, split_part(edge, '=', 1) AS s0, split_part(edge, '=', 2) AS s1 FROM jn), "
        "two AS (SELECT edge, CASE WHEN x.max_key <> 1 AND y.max_key = 1 THEN s1 ELSE s0 END AS a, CASE WHEN x.max_key <> 1 AND y.max_key = 1 THEN s0 ELSE s1 END AS b FROM e JOIN ks x ON x.col = s0 JOIN ks y ON y.col = s1), "
        "jc AS (SELECT edge, 'join ' || edge AS cell, CAST(1 AS DOUBLE) AS v FROM e UNION ALL SELECT edge, CASE WHEN x.max_key = 1 THEN 'primary' ELSE 'no primary' END, 1 FROM two JOIN ks x ON x.col = a "
        "UNION ALL SELECT edge, 'self', 1 FROM two WHERE a = b UNION ALL SELECT edge, 'distinct ratio', x.distinct_ / y.distinct_ FROM two JOIN ks x ON x.col = a JOIN ks y ON y.col = b UNION ALL " + " UNION ALL ".join(z(side, s) for side in "xy" for s in X.KEY_STATS) + ")"
    )
    inside = lambda x: f"list_contains(string_split(subplan, ' '), {x})"
    sizes = "sz AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, COUNT(*) AS n FROM {t}" for t in lay.tables) + ")"
    every = "SELECT query_id, subplan, '{0}' AS part, COUNT(x.q) AS n, round(coalesce(SUM(v), 0), 3) AS total FROM plans LEFT JOIN ({1}) AS x ON x.q = query_id AND {2} GROUP BY query_id, subplan"
    parts = " UNION ALL ".join([
        every.format("tables", "SELECT q, a, 1 + ln(1 + n) AS v FROM al JOIN sz USING (t)", inside("a")),
        every.format("joins", "SELECT q, l, r, v FROM jn JOIN (SELECT edge, SUM(v) AS v FROM jc GROUP BY edge) AS s USING (edge)", f"{inside('l')} AND {inside('r')}"),
        every.format("predicates", "SELECT q, a, SUM(v) AS v FROM pv GROUP BY q, a, c", inside("a")),
    ])
    degree = lambda word, c: f"SELECT p.query_id, p.subplan, '{word} ' || COUNT(l.query_id) AS cell, 1 AS v FROM plans p LEFT JOIN links l ON l.query_id = p.query_id AND l.{c} = p.subplan GROUP BY p.query_id, p.subplan"
    most = lambda source, n="COUNT(*)": f"(SELECT CAST(MAX(n) AS BIGINT) FROM (SELECT {n} AS n FROM {source} GROUP BY q))"
    return {
        "workload_maxima": f"WITH {read} SELECT greatest(2, {most('al')}) AS max_tables, greatest(2, {most('jn')}) AS max_joins, greatest(2, {most('pr')}) AS max_preds, greatest(2, {most('pr')}, {most('pr', 'SUM(len(vals))')}) AS max_values",
        "seen_constants": f"WITH {read} SELECT c, value FROM known",
        "label_range": f"WITH {of['act']}, u AS (SELECT MIN(n) AS lo, MAX(n) AS hi, MAX(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS up FROM act) SELECT round(ln(lo + up), 6) AS low, round(ln(hi + up), 6) AS high FROM u",
        "predicate_features": f"WITH {read}, {values} SELECT q AS query_id, a AS alias, c, cell, round(CAST(v AS DOUBLE), 6) AS v FROM pv",
        "join_features": f"WITH {read}, {joined} SELECT edge, cell, round(v, 5) AS v FROM jc WHERE round(v, 5) <> 0",
        "set_features": f"WITH {of['base']}, {read}, {values}, {joined}, {sizes} {parts}",
        "combined_features": f"WITH {of['base']}, {read}, {values} SELECT DISTINCT query_id, subplan, 'table ' || t AS cell, CAST(1 AS DOUBLE) AS v FROM plans JOIN al ON q = query_id AND {inside('a')} "
        f"UNION ALL SELECT query_id, subplan, 'join ' || edge, 1 FROM plans JOIN jn ON q = query_id AND {inside('l')} AND {inside('r')} UNION ALL SELECT query_id, subplan, c || ' ' || cell, round(v, 6) FROM plans JOIN cells ON q = query_id AND {inside('a')} WHERE v <> 0",
        "global_features": f"WITH RECURSIVE {of['base']}, {of['act']}, {of['ndv']}, {of['ind']}, {of['costs']}, {read}, w AS (SELECT query_id, SUM(ec) AS w FROM costs GROUP BY query_id), "
        "b AS (SELECT q, l AS x, r AS y FROM jn UNION ALL SELECT q, r, l FROM jn), g AS ("
        f"{degree('parents', 'child')} UNION ALL {degree('children', 'parent')} UNION ALL SELECT query_id, subplan, 'tables ' || n_tables, 1 FROM plans "
        f"UNION ALL SELECT DISTINCT query_id, subplan, 'neighbour ' || t, 1 FROM plans JOIN b ON b.q = query_id AND {inside('x')} AND NOT {inside('y')} JOIN al ON al.q = b.q AND al.a = y "
        "UNION ALL SELECT query_id, unnest(string_split(path, ' > ')), 'chosen', 1 FROM chosen UNION ALL SELECT query_id, parent, 'in cost', SUM(ec) / MAX(w) FROM costs JOIN w USING (query_id) GROUP BY query_id, parent "
        "UNION ALL SELECT query_id, subplan, 'relative rows', est / w FROM ind JOIN w USING (query_id)) SELECT query_id, subplan, cell, round(CAST(v AS DOUBLE), 6) AS v FROM g WHERE round(v, 6) <> 0",
    }
