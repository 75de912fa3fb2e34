"""The registered queries op1 to op13 and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe_codec, exact_dedup, langid, license_scan, packing, prefix_trie, quality, simhash, token_counts, token_files, topk, url_filter, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url. A page's outcome is the label of its id: bad if of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = table(spark, sf_dir, "labels").filter("quality is not null or toxic is not null").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and bytes."""
    return bpe_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), finish=bpe_codec.round_trip, out=bpe_codec.DIGEST)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every document for license phrases and notices."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; the network is fitted on labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the tokens of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every query vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label every document; the model is fitted on rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids, bit-packed, and read them back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("shard")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations' beginnings."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_bpe_codec, op4_license_scan, op5_quality, op6_exact_dedup, op7_packing, op8_token_counts, op9_topk, op10_langid, op11_token_files, op12_whitening, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op1_url_filter": url_filter.oracle(), "op4_license_scan": license_scan.oracle(), "op6_exact_dedup": exact_dedup.ORACLE, "op9_topk": topk.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
