"""Each stage of the pipeline on its own input, and all of them."""

import hashlib
from collections import Counter, defaultdict

import pytest

SF = "/root/testdata/sf0.001"
HARD = [(-1, None, "x"), (-2, "", "x"), (-2, "", "x"), (-3, "tie tie", None), (-3, "tie tie", None), (-4, "long words " * 50_000, "y"), (None, "no id", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    """The documents at hand and hard rows, under their columns."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    hard = spark.createDataFrame(HARD, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'en' as lang", "source", "length(text) as n_chars")
    return d.unionByName(hard.selectExpr(*[f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" for f in d.schema.fields])).repartition(3).cache()


def key(r):
    return tuple((x is None, x or "") for x in r)


def test_near_duplicates(spark, docs):
    import corpus_pipeline as p

    from tests.llm.test_near_copies import pairs_of

    got = p.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    rows = docs.collect()
    texts = sorted({r["text"] for r in rows if r["text"] and r["text"].split()})
    up = {t: t for t in texts}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for a, b in pairs_of(texts):
        up[top(texts[a])] = top(texts[b])
    classes = defaultdict(list)
    for r in rows:
        if r["text"] and r["text"].split():
            classes[top(r["text"])].append(r)
    low = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    want = [min(c, key=low)["doc_id"] for c in classes.values()] + [r["doc_id"] for r in rows if not (r["text"] and r["text"].split())]
    kept = got.collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(want) and len(kept) < len(rows)
    assert {key(r) for r in kept} <= {key(r) for r in rows}


def test_mixing(spark, docs):
    import corpus_pipeline as p

    from latticework.llm.mixing import mix

    got = p.mixing(spark, docs, SF)
    want = Counter()
    for r in mix(docs).collect():
        want[key([r[c] for c in docs.columns])] += r["taken"] // r["size"] if r["size"] else 1
    assert got.columns == docs.columns and Counter(key(r) for r in got.collect()) == +want


def test_tokens(spark, docs):
    import corpus_pipeline as p
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], r["source"], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())] += 1
    got = p.tokens(spark, docs, SF)
    assert Counter(tuple(r)[:4] for r in got.collect()) == want


def test_empty_input(spark, docs):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_is_the_stages_one_after_another(spark):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        columns, d = d.columns, stage(spark, d, SF)
        assert d.columns == columns
        d = spark.createDataFrame(d.collect(), d.schema)
    want = Counter(tuple(r) for r in p.STAGES[-1][1](spark, d, SF).collect())
    assert Counter(tuple(r) for r in p.run(spark, SF).collect()) == want
