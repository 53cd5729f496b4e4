"""Url filters, and what every operator must bear: clashing names, empty tables, nulls, very long texts."""

import pytest

LONG = "word " * 200_000


def operators(spark):
    import public_tokenizers as P

    from latticework.llm import bpe, html_extract, minhash_join, mixing, quality, secret_scan, token_counts, topk, url_filter, warc

    flat = [0.0] * quality.BUCKETS
    rules = url_filter.rules_frame(spark)
    return {
        "url_filter": (lambda d: url_filter.url_filter(d, rules, "text"), True),
        "html_extract": (lambda d: html_extract.extract(d, "text"), True),
        "secret_scan": (lambda d: secret_scan.secret_scan(d), True),
        "redact": (lambda d: secret_scan.redact(d), True),
        "warc": (lambda d: warc.read_archives(warc.archive(d, None, "doc_id", "source", "text")), False),
        "mixing": (lambda d: mixing.mix(d), True),
        "token_counts": (lambda d: token_counts.count_edited(token_counts.sample_edits(d), P.path("byte_bpe_50k.tiktoken")), False),
        "quality": (lambda d: quality.quality_rules(d, flat), True),
        "bpe": (lambda d: bpe.bpe(d, P.path("word_bpe_49k.json"), keep_ids=False), True),
        "near_copies": (lambda d: minhash_join.near_copies(d), True),
        "one_of_each": (lambda d: minhash_join.one_of_each(d), None),
        "topk": (lambda d: topk.top_k(d.selectExpr("*", "array(1.0, 2.0) as v"), 2, 1, "doc_id", "v"), False),
    }


NAMES = ["n", "h", "s", "at", "fp", "of", "key", "word", "chunk", "ids", "row", "found_", "digest", "c0", "c1", "text_", "edits_", "a.b", "a`b", "x y"]


@pytest.mark.parametrize("name", ["url_filter", "html_extract", "secret_scan", "redact", "warc", "mixing", "token_counts", "quality", "bpe", "near_copies", "one_of_each", "topk"])
def test_names_nulls_and_long_texts(spark, name):
    from pyspark.sql import functions as F

    run, passes = operators(spark)[name]
    rows = [(1, None, "a"), (2, "", None), (2, "", None), (3, LONG, "a"), (4, "x" * 300_000, "b"), (None, "no id\n\n", "b"), (5, LONG, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(f"own {x}").alias(x) for x in NAMES]).repartition(2)
    out = run(d)
    got = out.collect()
    if name != "topk":
        assert len(got) == (6 if passes is None else len(rows))
    if passes is not False:
        assert set(NAMES) <= set(out.columns) and all(r[x] == f"own {x}" for r in got for x in NAMES)
    none = run(d.limit(0))
    assert none.columns == out.columns and none.count() == 0


def test_rules_and_no_rules(spark):
    from latticework.llm.url_filter import rules_frame, url_filter

    d = spark.createDataFrame([("http://a.net/x", "r"), (None, "r")], "url string, rule string")
    assert [tuple(r) for r in url_filter(d, rules_frame(spark, []).limit(0)).collect()] == [("http://a.net/x", "a.net", "/x", None, "allow"), (None, "", "", None, "allow")]
    odd = rules_frame(spark, [("A.NET", None, "block"), ("a.net", "", "allow"), (None, "/", "block"), ("", "/", "block")])
    assert {(r["url"], r["rule"], r["verdict"]) for r in url_filter(d, odd).collect()} == {("http://a.net/x", "a.net", "block"), (None, None, "allow")}
