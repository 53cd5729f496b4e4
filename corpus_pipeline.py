"""A corpus pipeline: quality rules, near copies, secrets, mixing, token ids. Each stage maps documents to documents.

All stages take an empty table and give an empty one, keep columns beside those of documents, and treat each row by itself
where rows or ids repeat; what a stage does with null texts and ties stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.bpe import bpe
from latticework.llm.common import stored
from latticework.llm.minhash_join import one_of_each
from latticework.llm.mixing import mix
from latticework.llm.quality import keep_good, log_ratios, trusted_ids
from latticework.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts fail them."""
    ratios = log_ratios(docs.select("doc_id", "text"), trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return keep_good(docs, ratios)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id; texts without words, null ones too, all stay."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows. Null texts stay null."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents of no words, which no mix can count, stay once."""
    mixed = mix(docs)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the digests of ids and of the decoded text."""
    import public_tokenizers

    out = bpe(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secret scans", secrets), ("source mixing", mixing), ("token ids", tokens)]
#: Models, hash thresholds and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
