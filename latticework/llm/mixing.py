"""Mixing sources to target weights by hash thresholds found in nested histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, fresh, quoted, stored, without

#: Bits of the hash that each nested histogram looks at, and the number of histograms: 60 bits in all.
LEVEL_BITS, LEVELS = 12, 5
#: A document is taken this many times at most.
MAX_REPEATS = 3
#: Equal rows that are written out in one piece.
PIECE = 10_000
#: Weights by a source's rank, repeating.
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources (one row each) with rank from 0: by code point, null last.

    Ranges of the ordered values are numbered in parallel; only one row per range meets in one task.
    """
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = (
        parts.groupBy("part").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("part", "before")
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("within", within).join(before, "part").select("source", "source_size", (F.col("before") + F.col("within")).alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) for rows (source, source_size).

    Sources share the whole of all sizes by weight; a target stops at max_repeats times its source's size, and the
    excess is shared anew by weight among the others until no target is above. Each round is one aggregate.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = stored(_ranked(sizes).withColumn("w", w).withColumn("most", F.col("source_size") * float(max_repeats)), "mix-sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    rate, stopped = None, -1
    while True:  # rate: words for a unit of weight; it only rises, so a stopped source stays stopped
        full = F.lit(False) if rate is None else F.col("w") * rate > F.col("most")
        row = s.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w"),
            F.sum(full.cast("int")).alias("n"),
        ).first()
        if not row["w"] or row["n"] == stopped:
            break
        rate, stopped = (total - row["capped"]) / row["w"], row["n"]
    return s.select("source", "source_size", F.least("most", F.col("w") * (rate or 0.0)).alias("target"))


def _bucket(h: Column, level: int) -> Column:
    return F.shiftrightunsigned(h, 64 - LEVEL_BITS * (level + 1)).bitwiseAND((1 << LEVEL_BITS) - 1)


def _comparable(df: DataFrame) -> list[Column]:
    """Each column as something that can be hashed and grouped: maps as JSON."""
    odd = lambda f: "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString()
    return [F.to_json(F.struct(col(f.name))) if odd(f) else col(f.name) for f in df.schema.fields]


def _numbered(rows: DataFrame, h: str, n: str) -> DataFrame:
    """Each row n times, its hash replaced by one of the hash and the occurrence; a row of many occurrences is dealt out in pieces."""
    (at,) = fresh(rows.columns, "at")
    pieces = rows.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((col(n) - 1) / PIECE)))).repartition(col(h), col(at))
    every = pieces.withColumn(at, F.explode(F.sequence(col(at) * PIECE, F.least((col(at) + 1) * PIECE, col(n)) - 1)))
    return every.withColumn(h, F.xxhash64(col(h), col(at))).drop(at, n)


def mix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """df with size, source_size, target and taken added (columns of these names are replaced, all others stay).

    taken = size times the number of repeats: floor(target / source_size) for every document, and one more where
    the document's hash is below its source's threshold. The threshold: words are summed by source and top 12 hash
    bits; in the bucket where the rest of the budget ends, by the next 12 bits, and so on. The document at the boundary
    is taken if that comes nearer to the target. No sort, no choice by order: reruns agree.

    The hash covers all columns, and of rows equal in all of them also the occurrence, so that each can be taken or left by
    itself; which of them is which does not matter. Null text has size 0; a null source is a source, ranked last; an empty
    table gives an empty one. Sources may be as skewed as they like: histograms are summed before they are shuffled,
    and a source's histogram has 4096 rows at most. Equal rows are counted where they are before they meet.
    """
    base = without(df, ["size", "source_size", "target", "taken"])
    hash_, size, row, s_, whole, below, n = fresh([*df.columns, "size", "source_size", "target", "taken"], "hash", "words", "row", "of", "whole", "below", "n")
    base = df.select(*[col(c) for c in base.columns], F.xxhash64(*_comparable(df)).alias(hash_), n_words(col(text_col)).alias(size))
    d = stored(base.select(col(source_col).alias("source"), col(hash_).alias("h"), col(size).alias("size")).groupBy("source", "h").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-sizes")
    again = d.where("n > 1").select(F.col("h").alias(s_)).distinct()
    if not again.isEmpty():
        again = stored(again, "mix-repeats")
        twice = base.join(again, col(hash_) == col(s_), "left_semi")
        alone = base.join(again, col(hash_) == col(s_), "left_anti")
        each = twice.groupBy(*_comparable(base)).agg(F.first(F.struct(*[col(c) for c in base.columns])).alias(row), F.count("*").alias(n))
        each = stored(each.select(row, n), "mix-repeated-rows")
        facts = each.select(F.col(f"{row}.{quoted(source_col)}").alias("source"), F.col(f"{row}.{quoted(hash_)}").alias("h"), F.col(f"{row}.{quoted(size)}").alias("size"), F.col(n).alias("n"))
        single = d.join(again, F.col("h") == col(s_), "left_anti").select("source", "h", "size")
        d = stored(single.unionByName(_numbered(facts, "h", "n").select("source", "h", "size")), "mix-sizes")
        rows = each.select(*[F.col(f"{row}.{quoted(c)}").alias(c) for c in base.columns], n)
        base = alone.unionByName(_numbered(rows, hash_, n))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes)
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(MAX_REPEATS)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    # below: hashes whose top bits are under it are taken; path: the top bits of the boundary bucket.
    state = stored(plan.withColumns({"prefix": F.lit(0).cast("long"), "left": F.col("budget"), "done": F.col("budget") <= 0}), "mix-state")
    for level in range(LEVELS):
        known = LEVEL_BITS * level
        top = F.shiftrightunsigned("h", 64 - known) if known else F.lit(0).cast("long")
        open_ = state.where(~F.col("done")).select(F.col("source").alias("s"), "prefix", "left")
        hist = (
            d.join(open_, d["source"].eqNullSafe(F.col("s")) & (top == F.col("prefix")))
            .groupBy("source", _bucket(F.col("h"), level).alias("b"))
            .agg(F.sum("size").alias("n"), F.count("*").alias("docs"), F.max("left").alias("left"))
        )
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        # The first bucket that goes past the budget. If none does, all of it is taken.
        edge = (
            hist.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
            .groupBy("source").agg(F.min(F.struct("b", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "n", "docs")).alias("e"))
        )
        last = level == LEVELS - 1
        state = stored(
            state.join(edge.select(F.col("source").alias("s"), "e"), F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "source_size", "target", "whole", "budget",
                F.when(F.col("done"), F.col("prefix") * (1 << LEVEL_BITS)).otherwise(
                    F.shiftleft("prefix", LEVEL_BITS)
                    + F.when(F.col("e").isNull(), 1 << LEVEL_BITS)
                    .when(((F.col("e.docs") == 1) | F.lit(last)) & (F.col("e.n") - F.col("e.left") < F.col("e.left")), F.col("e.b") + 1)
                    .otherwise(F.col("e.b"))
                ).alias("prefix"),
                F.coalesce(F.col("e.left"), F.col("left")).alias("left"),
                (F.col("done") | F.col("e").isNull() | (F.col("e.docs") == 1)).alias("done"),
            ),
            "mix-state",
        )
    used = 64 - LEVEL_BITS * LEVELS
    side = state.select(F.col("source").alias(s_), "source_size", "target", F.col("whole").alias(whole), F.col("prefix").alias(below))
    out = base.join(side, col(source_col).eqNullSafe(col(s_)), "left")
    extra = (F.shiftrightunsigned(col(hash_), used) < col(below)).cast("long")
    kept = [col(c) for c in base.columns if c not in (hash_, size)]
    return out.select(*kept, col(size).alias("size"), "source_size", "target", (col(size) * (col(whole) + extra)).cast("long").alias("taken"))
