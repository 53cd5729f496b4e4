"""Queries from parameterised templates: predicates drawn from options, from samples of the data, or from token prefixes."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import numbered
from ..sources.tables import run_sql


def quantile_chunks(df: DataFrame, order: list, chunks: int, compat: bool = False) -> DataFrame:
    """df with chunk: equal chunks of floor(rows / chunks) in order; the rest joins the last (compat: is left out)."""
    d = numbered(df, *order)
    size = max(1, d.count() // chunks)
    d = d.withColumn("chunk", F.floor(F.col("rn") / size).cast("long")).drop("rn")
    return d.where(F.col("chunk") < chunks) if compat else d.withColumn("chunk", F.least(F.col("chunk"), F.lit(chunks - 1)))


def prefix_counts(df: DataFrame, col: str, least: int, most: int) -> DataFrame:
    """(prefix, n): how many tokens of a text column begin with each prefix of least to most characters."""
    words = df.select(F.explode(F.split(F.lower(col), "\\W+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("c"))
    lengths = F.sequence(F.lit(least), F.lit(most))
    p = words.withColumn("prefix", F.explode(F.transform(F.filter(lengths, lambda k: k <= F.length("w")), lambda k: F.substring(F.col("w"), F.lit(1), k))))
    return p.groupBy("prefix").agg(F.sum("c").cast("long").alias("n"))


def fill(sql: str, values: dict[str, str]) -> str:
    """Placeholders replaced as whole words."""
    return re.sub(r"\b(" + "|".join(map(re.escape, sorted(values, key=len, reverse=True))) + r")\b", lambda m: values[m[1]], sql) if values else sql


class Sampler:
    """The rows of a sampling query, numbered in its order where they are; only rows that are drawn reach the driver."""

    def __init__(self, df: DataFrame):
        self.rows = numbered(df)
        self.n = self.rows.count()

    def draw(self, numbers: list[int]) -> list[tuple]:
        """The rows of these numbers, in the order of the numbers."""
        got = {r["rn"]: tuple(r[c] for c in self.rows.columns if c != "rn") for r in self.rows.where(F.col("rn").isin(numbers)).collect()}
        return [got[i] for i in numbers]


class Listed:
    """Options that a template lists."""

    def __init__(self, options: list):
        self.rows = [tuple(o) if isinstance(o, list) else (o,) for o in options]
        self.n = len(self.rows)

    def draw(self, numbers: list[int]) -> list[tuple]:
        return [self.rows[i] for i in numbers]


def _prefixes(df: DataFrame, p: dict) -> DataFrame:
    """Token prefixes of the sampling query's first column that occur within the target counts, in order of the text."""
    counts = prefix_counts(df, df.columns[0], p.get("min_chars", 1), p.get("max_chars", 4))
    return counts.where(F.col("n").between(p.get("min_count", 1), p.get("max_count", 1 << 62))).orderBy("prefix").select("prefix")


def _quote(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def _condition(p: dict, some: list[tuple]) -> tuple[str, dict[str, str]]:
    """A predicate over drawn rows, and the values of range keys."""
    col, kind = p["columns"][0], p["pred_type"]
    if kind == "range":
        lo, hi = sorted(some[0][:2]) if len(some[0]) > 1 else (some[0][0], some[0][0])
        return f"{col} BETWEEN {_quote(lo)} AND {_quote(hi)}", {p["keys"][0]: str(lo), p["keys"][-1]: str(hi)}
    if kind == "IN":
        values = sorted({str(v[0]) for v in some if v[0] is not None})
        parts = [f"{col} IN ({', '.join(map(_quote, values))})"] * bool(values) + [f"{col} IS NULL"] * any(v[0] is None for v in some)
        return f"({' OR '.join(parts)})", {}
    v = some[0][0]
    return f"{col} {kind} {_quote(f'%{v}%' if kind in ('LIKE', 'NOT LIKE', 'ILIKE') else v)}", {}


def generate(spark: SparkSession | None, sf_dir: str | None, template: dict, n: int, seed: int = 0) -> list[str]:
    """n different queries of a template (fewer, if 50 n tries give no more), always the same for a seed.

    A slot of several alternatives (multi) takes one by chance. Its values come from listed options, from the rows of a sampling
    query (sql; sqls: of one of several, by chance), or, with sampling_method prefix, from token prefixes of target counts.
    Sampling queries with dependencies see the keys bound before them; quantile first chooses one of num_quantiles
    chunks of their order. Samplers number all their rows, however many. Without spark, only listed options are allowed
    and queries are not analyzed.
    """
    rng, memo, out = random.Random(seed), {}, []
    for _ in range(50 * n):
        bound: dict[str, str] = {}
        for slot in template["predicates"]:
            p = rng.choice(slot["multi"]) if "multi" in slot else slot
            if p["type"] == "list":
                source = Listed(p["options"])
            else:
                text = rng.choice(p["sqls"]) if p["type"] == "sqls" else p["sql"]
                text = fill(text, bound) if p.get("dependencies") else text
                at = (text, p.get("sampling_method") == "prefix" and (p.get("min_chars"), p.get("max_chars"), p.get("min_count"), p.get("max_count")))
                if at not in memo:
                    rows = run_sql(spark, sf_dir, text)
                    memo[at] = Sampler(_prefixes(rows, p) if at[1] else rows)
                source = memo[at]
            if not source.n:
                break
            low, high = 0, source.n
            if p.get("sampling_method") == "quantile":
                size, k = max(1, source.n // p["num_quantiles"]), rng.randrange(p["num_quantiles"])
                low, high = (k * size, source.n if k == p["num_quantiles"] - 1 else (k + 1) * size) if k * size < source.n else (0, source.n)
            some = source.draw(rng.sample(range(low, high), min(high - low, rng.randint(p.get("min_samples", 1), p.get("max_samples", 1)))))
            cond, values = _condition(p, some)
            bound |= values
            bound[p["keys"][0]] = cond if p.get("whole", True) else str(some[0][0])
        else:
            q = fill(template["sql"], bound)
            if q not in out:
                if spark:
                    run_sql(spark, sf_dir, q)  # analysis fails on a wrong query
                out.append(q)
        if len(out) == n:
            break
    return out


def save_generated(queries: list[str], folder: str) -> list[str]:
    """Each query in a file named by its hash; equal ones once."""
    top, names = Path(folder), []
    top.mkdir(parents=True, exist_ok=True)
    for q in dict.fromkeys(queries):
        names.append(hashlib.sha1(q.encode()).hexdigest())
        (top / f"{names[-1]}.sql").write_text(q)
    return names
