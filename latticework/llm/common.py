"""What the operators of this folder share: words, free column names, the shared folder, and shipping this package to executors."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local master gets a folder of this machine; any other raises, as its executors could not read one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/latticework-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Let the driver drop the plans, broadcasts and shuffles of what was written, and hand back the heap that rounds of them grew."""
    gc.collect()  # Python's frames hold the JVM's
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them again.

    A lost executor then costs no recomputation, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete everything that this application stored. Results read stored tables when they are evaluated, so call it at the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_zips: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _zips:
        return
    top = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="latticework-py-"), f"{top.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(out)
    _zips[app] = out


def quoted(name: str) -> str:
    """A column name as SQL reads it, whatever its characters."""
    return f"`{name.replace('`', '``')}`"


def col(name: str) -> Column:
    """The column of exactly this name: dots and back-ticks in it mean nothing."""
    return F.col(quoted(name))


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that no column in taken has, whatever its case, all different."""
    low, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to add under these names (compared without case)."""
    low = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in low])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, wherever and however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements of an array whose running totals are gathered in one piece.
PIECE = 128


def running(values: Column, kind: str, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """The totals of an array up to each element, itself included, under an associative merge with neutral zero.

    An array grows by copying. So pieces of PIECE elements are gathered by themselves and the totals before each piece
    likewise: n elements cost n * PIECE / 2 + (n / PIECE)^2 / 2 copies, not n^2 / 2.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def gather(items: Column, first: Column, after: bool) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))

        def step(a: Column, x: Column) -> Column:
            now = merge(a["at"], x)
            return F.struct(now.alias("at"), F.concat(a["out"], F.array(now if after else a["at"])).alias("out"))

        return F.aggregate(items, start, step, lambda a: a["out"])

    def whole(v: Column) -> Column:
        count = F.ceil(F.size(v) / PIECE).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.slice(v, i * PIECE + 1, PIECE))

        def parts(p: Column) -> Column:
            sums = F.transform(p, lambda x: F.aggregate(x, zero, merge))
            return F.flatten(F.zip_with(p, gather(sums, zero, False), lambda x, before: gather(x, before, True)))

        return let(pieces, parts)

    return let(values, whole)
