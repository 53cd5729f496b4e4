"""Running chosen plans: join orders as SQL, run times, and the optimizer's plan as a graph."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import run_sql
from .lattice import SEP
from .sqlfront import Graph

#: A run that timed out counts as the limit and this many seconds; one that failed as FAILED.
TIMEOUT_EXTRA, FAILED = 9.0, -1.0


def join_order(path: list[str]) -> list[str]:
    """Aliases in the order in which a path of growing subplans adds them."""
    sets = [set(s.split(SEP)) for s in path]
    return [a for before, now in zip([set(), *sets], sets, strict=False) for a in sorted(now - before)]


def ordered_sql(g: Graph, order: list[str], what: str = "COUNT(*)", hints: dict[str, str] | None = None) -> str:
    """The query as explicit joins in this order, which Spark keeps unless told to reorder joins. Each alias must join one before it.

    hints: by alias, how it is joined (BROADCAST, MERGE, SHUFFLE_HASH, SHUFFLE_REPLICATE_NL).
    """
    text, seen = f"{g.tables[order[0]]} AS {order[0]}", {order[0]}
    for a in order[1:]:
        on = sorted(j.sql() for j in g.joins if a in (j.left[0], j.right[0]) and {j.left[0], j.right[0]} - {a} <= seen)
        if not on:
            raise ValueError(f"{a} joins none of {sorted(seen)}")
        text += f" JOIN {g.tables[a]} AS {a} ON {' AND '.join(on)}"
        seen.add(a)
    conds = sorted([p for a in order for p in g.preds.get(a, [])] + [c for names, c in g.residual if names <= seen])
    hint = "/*+ " + ", ".join(f"{h}({a})" for a, h in hints.items()) + " */ " if hints else ""
    return f"SELECT {hint}{what} FROM {text}" + (" WHERE " + " AND ".join(conds) if conds else "")


def executed(paths: DataFrame) -> DataFrame:
    """(subplan) of plans (path): the subplans that a run of the path meets."""
    return paths.select(F.explode(F.split("path", " > ")).alias("subplan")).distinct()


def run_times(spark: SparkSession, sf_dir: str, queries: list[tuple[str, str]], reps: int = 1, timeout: float = 120.0) -> DataFrame:
    """(qname, rep, runtime, status) of (name, SQL): wall seconds of a whole run whose rows are thrown away; jobs over the limit are cancelled."""
    rows = []
    for name, text in queries:
        for rep in range(reps):
            group, late = uuid.uuid4().hex, threading.Event()

            def stop(group: str = group, late: threading.Event = late) -> None:
                late.set()
                spark.sparkContext.cancelJobGroup(group)

            timer = threading.Timer(timeout, stop)
            spark.sparkContext.setJobGroup(group, name, interruptOnCancel=True)
            start = time.perf_counter()
            timer.start()
            try:
                run_sql(spark, sf_dir, text).write.format("noop").mode("overwrite").save()
                took, status = time.perf_counter() - start, "ok"
            except Exception:  # whatever a query may raise is a result of the measurement
                took, status = (timeout + TIMEOUT_EXTRA, "timeout") if late.is_set() else (FAILED, "failed")
            finally:
                timer.cancel()
                spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            rows.append((name, rep, took, status))
    return spark.createDataFrame(rows, "qname string, rep long, runtime double, status string")


def plan_graph(df: DataFrame) -> DataFrame:
    """(node, parent, operator, rows, bytes) of the optimized plan, numbered from the root in preorder; rows is null where unknown."""
    out, todo = [], [(df._jdf.queryExecution().optimizedPlan(), None)]
    while todo:
        plan, parent = todo.pop()
        stats, kids = plan.stats(), plan.children()
        known = stats.rowCount()
        out.append((len(out), parent, plan.nodeName(), float(str(known.get())) if known.isDefined() else None, float(str(stats.sizeInBytes()))))
        todo += [(kids.apply(i), len(out) - 1) for i in reversed(range(kids.size()))]
    return df.sparkSession.createDataFrame(out, "node long, parent long, operator string, rows double, bytes double")


def plan_dot(graph: DataFrame) -> str:
    """A plan graph as a drawing in the DOT language; a plan has some hundred nodes at most."""
    rows = graph.orderBy("node").collect()
    nodes = [f'  {r["node"]} [label="{r["operator"]}\\n{"?" if r["rows"] is None else int(r["rows"])} rows"];' for r in rows]
    links = [f"  {r['parent']} -> {r['node']};" for r in rows if r["parent"] is not None]
    return "\n".join(["digraph plan {", *nodes, *links, "}"])
