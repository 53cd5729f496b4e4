"""Encoding by distinct words against the tokenizer itself."""

import hashlib
import random
from collections import Counter

SF = "/root/testdata/sf0.001"


def test_bpe_words():
    """Ids of a text's words are those of the whole text, for every character below U+0300, mixtures, and special tokens."""
    import public_tokenizers as P

    from latticework.llm.bpe import WordCodec

    c, r = WordCodec(P.path("word_bpe_49k.json")), random.Random(3)
    near = [chr(i) for i in range(0x300)]
    odd = [*near, *"aB'sd \n9", "\u0301", "Σ", "İ", "日", "\u2003", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", " "]
    texts = ["a" + x + "B" for x in near] + ["".join(r.choices(near, k=80)) for _ in range(2000)] + ["", " ", "Σ ΑΣ e\u0301 É \u2028x"]
    texts += ["".join(r.choices(odd, k=40)) for _ in range(2000)] + ["x<|endoftext|>\n<|ENDOFTEXT|> <|endoftext|><|endoftext|>"]
    assert not c.far("É\u0130") and c.far("e\u0301")
    for t in texts:
        assert [i for w in c.words(t) for i in c.ids(w)] == c.tok.encode(t, add_special_tokens=False).ids, t


def texts():
    r = random.Random(2)
    hard = [None, "", " \n\t ", "one", "one", "a b c d e f " * 4000, "ΑΣ İstanbul ﬁ 日本語 😀 <|endoftext|> it's e\u0301", "x" * 100_000, " ".join("".join(r.choices("abc", k=5)) for _ in range(20_000))]
    return [*enumerate(hard), (1, ""), (None, "no id"), (3, "one")]


def want(rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for i, t in rows:
        e = tok.encode(t or "", add_special_tokens=False)
        text = tok.decode(e.ids, skip_special_tokens=False)
        out[(i, len(e.ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e.ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_bpe(spark):
    """In one chunk, in many, and of the table's documents: ids, digests, decoded texts and other columns."""
    import public_tokenizers as P

    from latticework.llm.bpe import bpe

    rows = texts() + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    d = spark.createDataFrame([(i, t, f"s{i}") for i, t in rows], "doc_id long, text string, `a.b` string").repartition(3)
    for size in (10**9, 20_000):
        got = bpe(d, P.path("word_bpe_49k.json"), chunk_chars=size).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want(rows)
        for r in got:
            assert r["a.b"] == f"s{r['doc_id']}" and len(r["ids"]) == r["n_tokens"]
            assert hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
    assert bpe(d.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_each_word_is_encoded_once(spark):
    import public_tokenizers as P

    from latticework.llm import bpe as B
    from latticework.llm.common import shared_dir, ship

    ship(spark)
    path = P.path("word_bpe_49k.json")
    d = spark.createDataFrame(texts(), "doc_id long, text string").repartition(4)
    words = B.split_words(d, path, "text", f"{shared_dir(spark)}/places-of-a-test", 20_000, 5)
    done = B.encode_words(words, path, 5).collect()
    codec = B.WordCodec(path)
    every = {w for _, t in texts() for w in codec.words(t or "")}
    assert words.select("chunk").distinct().count() > 4 and words.groupBy("chunk", "bucket").count().where("count > 1").count() == 0
    assert sum(r["made"] for r in done) == len(every) and len(done) == words.count()


def test_ids_reach_chunks_by_one_shuffle(spark):
    """The words' rows are dealt to chunks once, for the ids and for their pieces."""
    import public_tokenizers as P

    from latticework.llm.bpe import bpe

    d = spark.createDataFrame(texts(), "doc_id long, text string")
    out = bpe(d, P.path("word_bpe_49k.json"), keep_ids=False)
    out.write.format("noop").mode("overwrite").save()
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final and "ReusedExchange" in final and final.count("MapInArrow") == 1, plan
