"""A training corpus from documents: quality, language, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of documents, and any others that
docs has, whatever their names. Null texts are empty ones; very long texts are judged whole; an empty table stays empty. The two filters judge every row by its text
alone, so rows that repeat go or stay together, null ids included. The duplicate stages decide by row, not by id: rows that share an id, or have none,
stand for themselves.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, langid, packing, quality, simhash
from siltstone.llm.arrowmap import fresh, text_of
from siltstone.llm.queries import table
from siltstone.session import materialise, scratch

#: How sure a text's language must be: the mean over its words of the largest posterior, SURE_PRIOR words that are sure counted in, so that few words hardly tell against a text. Texts of
#: letters at random and in languages that were not learned have 0.35 to 0.66 without them; of 9,954 documents of sf0.1 that hold words the least has 0.73 with them.
LEAST_SURE, SURE_PRIOR = 0.7, 6


def _by_id(docs: DataFrame) -> bool:
    """Whether ids alone tell the rows of docs apart: no two rows share one, or have none. Reads only the ids."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _with_ids(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in kept (id); the small side is hashed, so texts are not sorted."""
    return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(kept["id"]), "left_semi")


def _one_of_each(docs: DataFrame, kept: DataFrame, sha) -> DataFrame:
    """The rows of docs whose (doc_id, hash of the text) is in kept (id, sha, n: how many rows of docs have both), one of each."""
    at, number = fresh(docs, "sha_of_text", "copy")
    rows = docs.withColumn(at, sha)
    found = rows.join(kept.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(kept["id"]) & (rows[at] == kept["sha"]), "left_semi")
    if not kept.filter("n > 1").isEmpty():
        found = found.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", at).orderBy(at))).filter(F.col(number) == 1)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    net = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.filter(quality.probabilities(docs, net) >= quality.THRESHOLD)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words the model places: not ``und``, and as sure as LEAST_SURE, whether one language has most of the words or several share them. If no language was learned, none can be told, and all stay."""
    model = langid.fit(table(spark, sf_dir, "documents"))
    if not model.languages:
        return docs
    found = langid.predictions(docs, model)
    sure = (found["sure"] * found["words"] + SURE_PRIOR) / (found["words"] + SURE_PRIOR)
    return docs.filter((found["lang"] != langid.UNKNOWN) & (sure >= LEAST_SURE))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal ones, the one with the smallest id; null ids go last."""
    found = exact_dedup.exact_dedup(docs)
    if _by_id(docs):
        return _with_ids(docs, materialise(found.filter("kept").select(F.col("doc_id").alias("id"))))
    each = found.groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    return _one_of_each(docs, materialise(each.filter("kept").select("id", "sha", "n")), F.sha2(exact_dedup.normalised(text_of("text")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; of several with that id the one with the least hash. Null ids sort last."""
    if _by_id(docs):
        found = materialise(simhash.near_duplicates(docs))
        return _with_ids(docs, found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id")))
    sha = F.sha2(text_of("text"), 256)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), sha.alias("sha"))
    found = materialise(simhash.near_duplicates(docs.select(row.alias("row"), "text"), "row"))
    kept = found.filter(F.col("row") == F.col("component_id")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    return _one_of_each(docs, materialise(kept.select("row.id", "row.sha", "n")), sha)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", keep_quality), ("language_id", keep_language), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("best_fit_packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written once in the shared folder and read by the next. What a stage wrote besides goes when its rows are written, and so do its predecessor's."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as held:
            docs = materialise(stage(spark, docs, sf_dir))
            last = held.keep()
        if before:
            held.remove(before)
        before = last
    return STAGES[-1][1](spark, docs, sf_dir)
