"""Base tables, stored results and query files."""

from __future__ import annotations

import gc
import hashlib
import json
import re
import tempfile
import tomllib
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the driver's tables; only those that it names are opened."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; unset, a local master gets one of this machine, any other raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let the driver drop the plans, broadcasts and shuffles of what was written, and hand back the heap that they grew.

    Spark finds them by garbage collections alone, and a heap that grows as long as it may takes the driver's whole memory.
    """
    gc.collect()  # Python's frames hold the JVM's
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df's rows written into the shared folder and read from there: the lineage ends, and every reader sees the same rows."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_memo: dict[tuple[str, str], tuple[str, object]] = {}


def memo(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, written once for each application and key into the shared folder and read from there."""
    at = (spark.sparkContext.applicationId, hashlib.sha1(key.encode()).hexdigest())
    if at not in _memo:
        df, path = make(), f"{shared_dir(spark)}/memo-{at[0]}-{at[1]}"
        df.write.mode("overwrite").parquet(path)
        _memo[at] = (path, df.schema)
        del df
        release(spark)
    path, schema = _memo[at]
    return spark.read.schema(schema).parquet(path)


def cached_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query's rows, stored by the hash of its text and folder when it first runs."""
    return memo(spark, f"sql {sf_dir} {text}", lambda: run_sql(spark, sf_dir, text))


def sql_file(text: str) -> list[tuple[int, str]]:
    """The statements of a file that hold SELECT, numbered from 1."""
    found = [s.strip() for s in text.split(";") if "SELECT" in s.upper()]
    return list(enumerate(found, 1))


def sampled(df: DataFrame, percent: float, key: str) -> DataFrame:
    """A sample in place of a table: rows whose key's hash falls into the first `percent` of 10,000 buckets, in any engine and partitioning."""
    from ..functions.scalars import sha1_bucket

    return df.where(sha1_bucket(F.col(key).cast("string"), 10_000) < round(percent * 100))


def read_template(path: str | Path) -> dict:
    """A query template: sql with placeholders, and predicates."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def save_predictions(est: DataFrame, path: str, alg: str) -> None:
    """Estimates (query_id, subplan, est) of an algorithm, beside those of others."""
    est.withColumn("alg", F.lit(alg)).write.mode("append").partitionBy("alg").parquet(path)


def load_predictions(spark: SparkSession, path: str, alg: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("alg") == alg).drop("alg")


def submission(est: DataFrame) -> list[float]:
    """Estimates of a whole workload in order of query and subplan: one number each, for the driver."""
    return [r["est"] for r in est.orderBy("query_id", "subplan").select("est").collect()]


def save_config(config: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps(config, indent=1, sort_keys=True))


def load_config(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def read_runtimes(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.option("header", True).schema("qname string, runtime double, exp_analyze string").csv(pattern)


def save_queries(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def complete_only(cards: DataFrame) -> DataFrame:
    """Cardinalities of queries all of whose subplans have a value of at least 1."""
    bad = cards.where(F.col("value").isNull() | (F.col("value") < 1)).select("query_id").distinct()
    return cards.join(bad, "query_id", "left_anti")
