"""Secret scans on long and many candidates."""

import random
import re
import string

import pytest

BASE64 = string.ascii_letters + string.digits + "+/"


def scan(spark, texts):
    from latticework.llm.secret_scan import KINDS, secret_scan

    got = secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [[(KINDS[s["k"]], s["s"], s["e"]) for s in r["found"]] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_long_candidates(spark):
    """One candidate of a megabyte: found whole, in seconds, without a deep stack."""
    r = random.Random(1)
    texts = ["é " + "".join(r.choices(letters, k=1_000_000)) + " z" for letters in (BASE64, "0123456789abcdef", string.ascii_letters + string.digits)]
    for spans, kind in zip(scan(spark, texts), ("entropy", "hex", "entropy"), strict=True):
        assert spans == [(kind, 2, 1_000_002)]
    dull = ["z1" * 500_000, "=" * 300_000 + "a1Z", "aB1=" * 100_000, "token" * 100_000, "token " * 60_000 + "=" * 9]
    assert not any(scan(spark, dull))


def test_found_rates(spark):
    r = random.Random(2)
    for letters, sizes in ((BASE64, (64, 200)), (string.ascii_lowercase + string.digits, (40,)), (string.ascii_uppercase + string.digits, (40,))):
        for n in sizes:
            keys = ["".join(r.choices(letters, k=n)) for _ in range(200)]
            assert sum(bool(x) for x in scan(spark, [f"a {k} b" for k in keys])) >= 0.95 * len(keys)


def test_many_matches(spark):
    """Tens of thousands of spans in a text: starts in code points, and all redacted."""
    from latticework.llm.secret_scan import redact

    r = random.Random(3)
    text = "﻿😀" + " ü ".join("".join(r.choices("0123456789abcdef", k=20)) for _ in range(30_000)) + "é"
    want = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
    assert scan(spark, [text]) == [want]
    got = redact(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["text"] for x in got} == {1: re.sub("[0-9a-f]{16,}", "[secret]", text), 2: None, 3: ""}


def test_spans_overlap(spark):
    """Hot spans of several classes are one; one inside a base span goes, one that sticks out stays."""
    r = random.Random(4)
    key = "".join(r.choices("0123456789abcdef", k=40))
    (a,) = scan(spark, [f"x {key}"])
    assert a == [("hex", 2, 42)]
    (b,) = scan(spark, [f'token="{key}ZQ"'])
    assert b[0] == ("assign", 0, 49) and ("hex", 7, 47) in b and not [x for x in b if x[0] == "entropy"]
    mixed = "".join(r.choices(BASE64[:62], k=60))
    (c,) = scan(spark, [f"{mixed}{key}{mixed}"])
    assert [x for x in c if x[0] == "entropy"] == [("entropy", 0, 160)]


@pytest.mark.parametrize("seed", range(3))
def test_running(spark, seed):
    from itertools import accumulate

    from pyspark.sql import functions as F

    from latticework.llm.common import running

    r = random.Random(seed)
    rows = [[r.randint(-5, 9) for _ in range(n)] for n in (0, 1, 127, 128, 129, 1000, 5000)]
    df = spark.createDataFrame([(x,) for x in rows], "v array<int>")
    got = df.select("v", running(F.col("v"), "int", lambda a, b: a + b, F.lit(0)).alias("sum"), running(F.col("v"), "int", lambda a, b: F.greatest(a, b), F.lit(-99)).alias("top")).collect()
    for x in got:
        assert x["sum"] == list(accumulate(x["v"])) and x["top"] == list(accumulate(x["v"], max))
