"""Source mixing: targets by a plain version, taken words near them, also where rows repeat."""

import re
from collections import Counter

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(rows):
    """By source: its size and its target."""
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rate = (total - sum(3 * sizes[s] for s in full)) / (sum(weight[s] for s in order if s not in full) or 1)
        more = {s for s in order if s not in full and rate * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: (sizes[s], 3 * sizes[s] if s in full else rate * weight[s]) for s in order}
        full |= more


def check(df):
    from latticework.llm.mixing import mix

    rows, got = df.collect(), mix(df).collect()
    key = lambda r: repr(sorted(r.asDict().items(), key=lambda x: x[0]))
    assert sorted(map(key, got)) == sorted(map(key, mix(df.repartition(5)).collect()))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in rows)
    want, taken, largest = targets(rows), Counter(), Counter()
    for r in got:
        size, target = want[r["source"]]
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == size and abs(r["target"] - target) < 1e-6 * (1 + target)
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1, (s, taken[s], target)
    return got


def test_mix(spark):
    """Nulls, empty and long texts, ties, a hot source, and columns under the operator's own names."""
    hard = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "one", None), (5, "a b c " * 4000, "x"), (6, "six words are in this one", "x"), (None, "no id", "b")]
    own = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "source")
    df = spark.createDataFrame(hard, "doc_id long, text string, source string").unionByName(own)
    names = ("hash", "words", "row", "of", "whole", "below", "n", "at", "h", "s", "left", "prefix", "taken", "a.b")
    df = df.select("*", *[F.lit(name).alias(name) for name in names])
    got = check(df.repartition(3))
    assert all(r["hash"] == "hash" and r["a.b"] == "a.b" and r["whole"] == "whole" for r in got)


def test_repeated_rows_are_taken_one_by_one(spark):
    """A third of all rows the same one; rows equal in id and text but not elsewhere; maps."""
    rows = [(7, "ten words " * 50, "b", {"k": 1})] * 50 + [(7, "ten words " * 50, "b", {"k": 2})] * 3
    rows += [(i, f"other text {i} " * (1 + i % 7), "ac"[i % 2], None) for i in range(100, 200)] + [(1, "x y", "a", None)] * 4
    check(spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>").repartition(4))


def test_no_rows(spark):
    from latticework.llm.mixing import mix

    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(none).columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"] and mix(none).count() == 0
