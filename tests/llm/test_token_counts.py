"""Kept trees and their edits against encoding anew."""

import random

import pytest

TEXTS = [None, "", " ", "a", "it's   the\n\n end ", "word " * 900, "日本 語😀 " * 50, "  \n x" * 200, "x" * 5000, "some words here, " * 3000]


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers as P

    from latticework.llm.token_counts import Counter

    return Counter(P.path("byte_bpe_50k.tiktoken"))


def path():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken")


def replaced(text, e):
    a = min(max(e[0] or 0, 0), len(text))
    b = min(max(e[1] or 0, a), len(text))
    return text[:a] + (e[2] or "") + text[b:]


@pytest.mark.parametrize("seed", range(3))
def test_edits_of_a_tree(counter, seed):
    """Also through dump and load between edits."""
    from latticework.llm.token_counts import INSERTS, CountTree

    r = random.Random(seed)
    for t in TEXTS:
        text = t or ""
        tree = CountTree.of(counter, text)
        assert tree.total == counter.full(text) and tree.chars == len(text)
        for step in range(60):
            n = len(text)
            a = r.randint(0, n)
            b = min(n, a + r.choice([0, 1, 3, 10, 300, 3000]))
            new = r.choice([*INSERTS, "x", " ", "   ", "long text " * 100, "y " * 700])
            want = text[:a] + new + text[b:]
            text = tree.edit(counter, text, a, b, new)
            assert text == want and tree.total == counter.full(want) and tree.chars == len(want)
            if step % 7 == 3:
                tree = CountTree.load(*tree.dump())
                assert tree.total == counter.full(want)


def test_an_edit_reads_few_leaves(counter):
    from latticework.llm.token_counts import CountTree

    text = "some words here, " * 50_000
    tree = CountTree.load(*CountTree.of(counter, text).dump())
    tree.edit(counter, text, 400_000, 400_003, "new")
    assert tree.encoded < 12 and tree.touched <= 3 and len(tree.leaves) > 1000


def test_query_and_kept_trees(spark, counter):
    """The query's operator by brute force: nulls, repeated rows and ids, ties, empty tables, a second round of edits."""
    from pyspark.sql import functions as F

    from latticework.llm.token_counts import apply_edits, build_trees, count_edited, sample_edits, with_edits

    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "a", "x"), (3, "b c", "x"), (None, "no id", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, `n_edits` string").repartition(3)
    edited = sample_edits(d)
    want = []
    for r in edited.collect():
        text = r["text"] or ""
        for e in r["edits"]:
            text = replaced(text, e)
        want.append((r["doc_id"], counter.full(r["text"] or ""), 3, counter.full(text)))
    got = count_edited(edited, path()).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted(want, key=key)
    assert all(r["n_pieces_encoded"] <= 12 * r["n_edits"] + 6 for r in got)
    assert count_edited(edited.limit(0), path()).count() == 0
    odd = d.withColumn("edits", F.expr("CASE WHEN doc_id = 3 THEN array(named_struct('start', 99, 'end', null, 'new', null), named_struct('start', -5, 'end', 1, 'new', 'é')) END"))
    for r in count_edited(odd, path()).collect():
        assert r["n_edits"] == (2 if r["doc_id"] == 3 else 0) and (r["doc_id"] == 3 or r["n_tokens"] == r["n_tokens_edited"])
    trees = build_trees(d, path())
    changes = spark.createDataFrame([(5, 2, 10, 14, "later"), (5, 1, 0, 4, "first"), (9, 1, 100, 20_000, "")], "id long, place int, start int, end int, new string")
    once = apply_edits(with_edits(trees, changes), path())
    twice = apply_edits(with_edits(once.select(*trees.columns), changes), path())
    for table, times in ((once, 1), (twice, 2)):
        for r in table.collect():
            text = TEXTS[r["id"]] or "" if r["id"] in (5, 9) else None
            for _ in range(times):
                for e in {5: [(0, 4, "first"), (10, 14, "later")], 9: [(100, 20_000, "")]}.get(r["id"], []):
                    text = replaced(text, e)
            assert r["n_tokens"] == counter.full(r["text"]) and (text is None or r["text"] == text)
