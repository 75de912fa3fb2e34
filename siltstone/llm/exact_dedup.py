"""Exact deduplication: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Hashes are computed by a map and grouped with partial aggregation. Only texts whose hash occurs more than once move; each is compared with
the text of its group's smallest id, by a join on the hash whose hot keys adaptive execution splits, as both sides are written tables.
Texts that differ although their hashes agree are grouped again by hash and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.arrowmap import text_of
from siltstone.session import materialise


def normalised(text: Column) -> Column:
    """Each run of ASCII white space is one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hash_of=content_hash) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row per input row.

    Null texts are empty ones. Null ids sort last: they are kept only in a group without other ids. Of rows that repeat in id and text one
    is kept. Very long texts are hashed and compared whole. Only id and text are read, so other columns may have any name. An empty table gives an empty result.
    ``hash_of`` may be weak: collisions are told apart by their bytes.
    """
    text = normalised(text_of(text_col))
    hashed = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    keyed = hashed.select("_id", hash_of(F.col("_text")).alias("_hash"), F.unhex(F.sha2("_text", 256)).alias("_sha"))
    rows = materialise(keyed.groupBy("_id", "_hash", "_sha").agg(F.count(F.lit(1)).alias("_n")))
    groups = materialise(rows.groupBy("_hash").agg(F.min("_id").alias("_keep"), F.sum("_n").alias("_size")))
    several = groups.filter("_size > 1").select("_hash", "_keep")
    members = materialise(hashed.select("_id", hash_of(F.col("_text")).alias("_hash"), "_text").join(several, "_hash"))
    firsts = members.filter(F.col("_id").eqNullSafe(F.col("_keep"))).groupBy("_hash").agg(F.min("_text").alias("_first"))
    other = materialise(members.join(materialise(firsts), "_hash").filter(F.col("_text") != F.col("_first")).select("_id", "_hash", "_text"))
    if other.isEmpty():
        classed = rows.join(groups, "_hash")
    else:
        apart = other.groupBy("_hash", "_text").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        apart = materialise(apart.select("_hash", F.unhex(F.sha2("_text", 256)).alias("_sha"), "_keep", "_size"))
        fewer = apart.groupBy("_hash").agg(F.sum("_size").alias("_gone"))
        first = groups.join(fewer, "_hash", "left").select("_hash", "_keep", (F.col("_size") - F.coalesce("_gone", F.lit(0))).alias("_size"))
        same = rows.join(apart.select("_hash", "_sha"), ["_hash", "_sha"], "left_anti").join(first, "_hash")
        columns = ["_id", "_sha", "_n", "_keep", "_size"]
        classed = same.select(columns).unionByName(rows.join(apart, ["_hash", "_sha"]).select(columns))
    each = classed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    kept = F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)
    return each.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
