"""Learned estimators, matrix analytics and flow-loss."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import cumulative
from ..functions.scalars import sha1_bucket
from .estimate import q_error


def split(df: DataFrame, key: str, seed: int, test_percent: int = 20, kind: str = "query", custom: list[str] | None = None, val_percent: int = 0) -> tuple[DataFrame, ...]:
    """Train and test rows, and with val_percent validation rows, each query or template on one side.

    kind query or template: by a hash of the key; custom: the test rows are those of the keys given.
    """
    if kind == "custom":
        inside = F.col(key).isin(custom or [])
        return df.where(~inside), df.where(inside)
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    parts = (df.where(h >= test_percent + val_percent), df.where(h < test_percent))
    return (*parts, df.where((h >= test_percent) & (h < test_percent + val_percent))) if val_percent else parts


def fit_trees(train: DataFrame, features: list[str], label: str, kind: str = "rf", seed: int = 1, trees: int = 100, depth: int = 10):
    """A forest or boosted trees on log labels; depth 10, as many trees as asked for, step size 0.01 for boosting."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    make = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, labelCol=label) if kind == "rf" else GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=0.01, seed=seed, labelCol=label)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), make]).fit(train)


def energy_rank(values: DataFrame, share: float = 0.9) -> DataFrame:
    """The first rank, by descending value, at which the cumulative share of all values is above `share`."""
    d = cumulative(values.select("id", "v"), "v", F.desc("v"), "id")
    total = values.agg(F.sum("v")).first()[0] or 0.0
    return d.where(F.col("running") / total > share).agg((F.min("rn") + 1).cast("long").alias("rank"))


def hard_threshold(values: list[float], rows: int, columns: int) -> float:
    """Singular values below this are noise: their median times omega of the matrix's aspect ratio."""
    import numpy as np

    b = min(rows, columns) / max(rows, columns)
    return float(np.median(values) * (0.56 * b**3 - 0.95 * b**2 + 1.82 * b + 1.43))


def svd(spark: SparkSession, cells: DataFrame, k: int) -> DataFrame:
    """(i, j, value): the rank-k approximation of a matrix of cells (i, j, v); missing cells are 0."""
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    m = CoordinateMatrix(cells.rdd.map(lambda r: MatrixEntry(r["i"], r["j"], r["v"]))).toIndexedRowMatrix()
    got = m.computeSVD(min(k, m.numCols()), computeU=True)
    right = (got.V.toArray() * got.s.toArray()).tolist()  # columns by k: one side is the number of queries
    rows = got.U.rows.map(lambda r: (int(r.index), r.vector.toArray().tolist()))
    u = spark.createDataFrame(rows, "i long, u array<double>")
    v = spark.createDataFrame(list(enumerate(right)), "j long, w array<double>")
    return u.crossJoin(F.broadcast(v)).select("i", "j", F.aggregate(F.zip_with("u", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("value"))


def complete(cells: DataFrame, rank: int = 4, seed: int = 1) -> DataFrame:
    """(i, j, v, value): every cell of the matrix of known cells (i, j, v), by alternating least squares; v is null where unknown."""
    from pyspark.ml.recommendation import ALS

    model = ALS(rank=rank, userCol="i", itemCol="j", ratingCol="v", seed=seed, maxIter=15, regParam=0.02).fit(cells)
    every = model.recommendForAllUsers(model.itemFactors.count()).select("i", F.explode("recommendations").alias("r")).select("i", F.col("r.j").alias("j"), F.col("r.rating").cast("double").alias("value"))
    return every.join(cells, ["i", "j"], "left").select("i", "j", "v", "value")


def hide(cells: DataFrame, percent: float, seed: int) -> DataFrame:
    """cells (i, j, v) with known: false for about `percent` of them, chosen by hash, the same in any engine and partitioning."""
    at = F.concat_ws(" ", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string"))
    return cells.withColumn("known", sha1_bucket(at, 10_000) >= round(percent * 100))


def additive(cells: DataFrame) -> DataFrame:
    """cells with value: row mean and column mean of the known ones less their overall mean, which stands in for a row or column without any."""
    known = cells.where("known")
    every = known.agg(F.avg("v").alias("mean"))
    d = cells.join(known.groupBy("i").agg(F.avg("v").alias("of_i")), "i", "left").join(known.groupBy("j").agg(F.avg("v").alias("of_j")), "j", "left")
    d = d.crossJoin(F.broadcast(every))  # one row
    return d.select("i", "j", "v", "known", (F.coalesce("of_i", "mean") + F.coalesce("of_j", "mean") - F.col("mean")).alias("value"))


def masked_errors(filled: DataFrame) -> DataFrame:
    """(hidden, zero_percent, qerr) of filled (i, j, v, known, value), logs: hidden cells, the share of the whole matrix without a known cell, the mean q-error of hidden cells."""
    hidden, e = ~F.col("known"), q_error(F.exp("value"), F.exp("v"))
    whole = F.countDistinct("i") * F.countDistinct("j")
    return filled.agg(
        F.sum(hidden.cast("long")).alias("hidden"), F.round(100 * (1 - F.sum(F.col("known").cast("long")) / whole), 4).alias("zero_percent"), F.round(F.avg(F.when(hidden, e)), 4).alias("qerr"),
    )


def flow(edges: pd.DataFrame):
    """Electrical flow through the lattice: (loss, gradient by edge) with conductance 1 / estimated cost and true costs as weights.

    edges: parent, child, est_cost, true_cost. Unit current enters at the full plan and leaves at the source node ''.
    """
    import numpy as np

    nodes = sorted({*edges.parent, *edges.child} - {""})
    at = {x: i for i, x in enumerate(nodes)}
    top = max(nodes, key=lambda x: x.count(" "))
    q = np.zeros((len(edges), len(nodes)))
    for e, (p, c) in enumerate(zip(edges.parent, edges.child, strict=True)):
        q[e, at[p]] = 1
        if c:
            q[e, at[c]] = -1
    cost, true = edges.est_cost.to_numpy(float), edges.true_cost.to_numpy(float)
    cond = 1 / cost
    lap = q.T @ (q * cond[:, None])
    e = np.zeros(len(nodes))
    e[at[top]] = 1
    v = np.linalg.pinv(lap) @ e if np.linalg.matrix_rank(lap) < len(nodes) else np.linalg.solve(lap, e)
    drop = q @ v
    current = cond * drop
    loss = float((true * current**2).sum())
    # Of the loss by each conductance: through its own current, and through the potentials.
    outer = 2 * true * current
    adjoint = np.linalg.lstsq(lap, q.T @ (outer * cond), rcond=None)[0]
    grad_cond = outer * drop - (q @ adjoint) * drop
    return loss, grad_cond * (-(cond**2))


def flow_loss(edges: DataFrame) -> DataFrame:
    """(query_id, loss) of edges (query_id, parent, child, est_cost, true_cost): one small dense system for each query."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        loss, _ = flow(pdf)
        return pd.DataFrame({"query_id": [pdf.query_id.iloc[0]], "loss": [loss]})

    return edges.groupBy("query_id").applyInPandas(one, "query_id string, loss double")
