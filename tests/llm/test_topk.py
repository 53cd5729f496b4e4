"""Exact top-k against all products."""

from collections import Counter

import numpy as np
import pytest


def brute(rows, width, k=5, every=50):
    """One result for each query row: rows (id, vector) by their place."""
    good = [(i, np.pad(np.floor(256 * np.array(x, np.float32).astype(float)), (0, width - len(x))).astype(np.int64)) for i, x in rows if x is not None and None not in x and np.isfinite(x).all()]
    out = Counter()
    for at, (q, x) in enumerate(good):
        if q is not None and q % every == 0:
            all_ = sorted((-int(x @ y), i is None, i or 0) for j, (i, y) in enumerate(good) if j != at)[:k]
            for rank, (score, null, i) in enumerate(all_, 1):
                out[(q, rank, None if null else i, -score)] += 1
    return out


def got(df, **how):
    from latticework.llm.topk import top_k

    return Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, 5, 50, **how).collect())


def test_hard_rows(spark):
    """Repeated ids and rows, ties, null ids, short and bad vectors: one answer."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 12)) * rng.gamma(1, 1, size=(400, 1))
    rows = [(i, [float(x) for x in np.float32(v[i])]) for i in range(400)]
    rows += [(400, None), (450, [1.0, None]), (500, [float("nan")]), (550, [float("inf")]), (50, [0.5]), (0, rows[0][1]), (0, rows[7][1]), (401, [0.0] * 12), (402, [0.0] * 12), (None, rows[3][1]), (100, rows[100][1]), (600, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert got(df) == brute(rows, 12) == got(df.repartition(5))
    assert not got(df.limit(0)) and not got(df.where("vec_id % 50 <> 0"))
    few = [(0, [1.0, 2.0]), (1, [3.0]), (2, [0.0, 1.0])]
    assert got(spark.createDataFrame(few, "vec_id long, embedding array<float>")) == brute(few, 2)


@pytest.mark.parametrize("kind", ["even", "skewed"])
def test_rounds_and_groups(spark, monkeypatch, kind):
    """Several rounds, several groups of queries; directions and lengths that differ let the bounds spare pairs."""
    from latticework.llm import topk

    monkeypatch.setattr(topk, "FIRST", 64)
    monkeypatch.setattr(topk, "GROWTH", 4)
    monkeypatch.setattr(topk, "QUERY_BYTES", 24 * 8 * 20)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 24))
    if kind == "skewed":
        v = v * (0.6 ** np.arange(24)) * rng.pareto(2, size=(3000, 1))
    rows = [(i, [float(x) for x in np.float32(x)]) for i, x in enumerate(v)]
    report = {}
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), report=report) == brute(rows, 24)
    assert report["pairs"] == 3000 * 60 and report["multiplied"] <= report["met"] <= report["pairs"]
    if kind == "skewed":
        assert report["multiplied"] < 0.25 * report["pairs"], report


def test_wide_numbers(spark):
    """Products beyond what a double holds exactly."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=4) * 3e5)]) for i in range(120)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows, 4)
