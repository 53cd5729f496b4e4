"""The queries of this folder: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def _tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark, d):
    from .url_filter import rules_frame, url_filter

    return url_filter(_pages(spark, d).select("page_id", "url"), rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op2_html_extraction(spark, d):
    from .html_extract import extract

    return extract(_pages(spark, d)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_secret_scans(spark, d):
    from .secret_scan import secret_scan, span_text

    found = secret_scan(_docs(spark, d).select("doc_id", "text")).drop("text")
    base = F.filter("found", lambda x: x["k"] < 3)
    n = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))


def op4_warc(spark, d):
    from .warc import archive, read_index

    return read_index(archive(_pages(spark, d))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_source_mixing(spark, d):
    from .mixing import mix

    return mix(_docs(spark, d).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark, d):
    from .token_counts import count_edited, sample_edits

    return count_edited(sample_edits(_docs(spark, d).select("doc_id", "text")), _tokenizer("byte_bpe_50k.tiktoken"))


def op7_quality_rules(spark, d):
    from .quality import log_ratios, quality_rules, trusted_ids

    docs = _docs(spark, d).select("doc_id", "text")
    ratios = log_ratios(docs, trusted_ids(spark.read.parquet(f"{d}/labels.parquet")))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return quality_rules(docs, ratios).select(*cols)


def op8_bpe(spark, d):
    from .bpe import bpe

    docs = _docs(spark, d).select("doc_id", "text")
    return bpe(docs, _tokenizer("word_bpe_49k.json"), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_ngram_jaccard_join(spark, d):
    from .minhash_join import near_copies

    return near_copies(_docs(spark, d).select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_linked_texts")


def op10_exact_topk(spark, d):
    from .topk import top_k

    return top_k(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding"))


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries():
    return {
        f.__name__: f
        for f in (op1_url_filters, op2_html_extraction, op3_secret_scans, op4_warc, op5_source_mixing, op6_token_counts, op7_quality_rules, op8_bpe, op9_ngram_jaccard_join, op10_exact_topk, pipeline)
    }


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql():
    return {
        "op1_url_filters": f"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT k, page_id, {_LOWER.format("regexp_extract(r, '^([^/?#]*)', 1)")} AS host, regexp_extract(substr(r, length(regexp_extract(r, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM u),
rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT h.*, rh || rp AS rule, action, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC, action DESC) AS n
      FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1""",
        "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
        "op10_exact_topk": """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.k <> c.k WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    }
