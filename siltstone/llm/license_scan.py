"""License scans by diagonal voting.

Every document's rolling word k-gram hashes are joined with the template positions of the same hash (the template table is broadcast up to
BROADCAST_GRAMS rows, and a larger one joined by hash through an exchange, whose hot hashes adaptive execution splits). Matches vote for offset diagonals (document position less template position); neighbouring diagonals
of one template are merged, which bridges a few words more or less; a merged span is verified by the share of the template's words that
its matches cover. Matches compare the words themselves, so equal hashes of other words do not count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.arrowmap import text_of

GRAM = 3
TOLERANCE = 3
COVERAGE = 0.8
BROADCAST_GRAMS = 10_000
MARK = "\n"  # no gram; stands for the document itself, so that one without a match keeps its row
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str  # lower-case words, one space between
    base: bool = False


#: Fixed phrases and their labels.
BASE = (Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True))

#: Public notices as they stand in files.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    Template("gpl-program", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("apache-text", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
)


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and all that is not ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", -1), "")


def _grams(words: str, size: int) -> Column:
    """The runs of ``size`` words, by position."""
    run = ", ' ', ".join(f"element_at({words}, i + {k})" for k in range(size))
    return F.expr(f"CASE WHEN size({words}) >= {size} THEN transform(sequence(1, size({words}) - {size - 1}), i -> concat({run})) ELSE array() END")


def template_table(templates: tuple[Template, ...], gram: int = GRAM) -> list[tuple]:
    """(template, label, base, n, size, tpos, gram text): every k-gram of every template; shorter templates are one gram."""
    out = []
    for no, t in enumerate(templates):
        words = t.text.split(" ")
        size = min(gram, len(words))
        out += [(no, t.label, t.base, len(words), size, k, " ".join(words[k : k + size])) for k in range(len(words) - size + 1)]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: tuple[Template, ...] = BASE + NOTICES, gram: int = GRAM, tolerance: int = TOLERANCE, coverage: float = COVERAGE, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """One row per input row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (label, first, stop, coverage) in words from 0, verified ones only, in order. score: the best coverage, 0 without a span.
    Null texts are empty: no words, no labels (empty strings), null first and last word. Rows that repeat stay, also in their id; those
    that agree in id and text are counted before they are dealt out, so many of them, as null ids with empty texts, make no hot task. Other columns
    are not read, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    grams_of = template_table(templates, gram)
    few = len(grams_of) <= broadcast_grams
    schema = "template int, label string, base boolean, n int, size int, tpos int, words string"
    sizes = sorted({min(gram, len(t.text.split(" "))) for t in templates})
    mark = (-1, "", False, 0, 0, 0, MARK)
    table = spark.createDataFrame([*grams_of, mark] if few else grams_of, schema).withColumn("hash", F.xxhash64("words"))

    words = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).select("_id", F.xxhash64("_text").alias("_key"), words_of(F.col("_text")).alias("words"))
    counted = words.withColumn("n_words", F.size("words").cast("long"))
    grams = counted.select("_id", "_key", "n_words", F.concat(*[_grams("words", s) for s in sizes], F.array([F.lit(MARK)] * few).cast("array<string>")).alias("grams"))
    # outer: a plain explode would make Catalyst filter on the size of an inlined copy of the grams
    each = grams.select("_id", "_key", "n_words", F.posexplode_outer("grams").alias("at", "gram")).withColumn("hash", F.xxhash64("gram"))
    before = {s: sum((F.greatest(F.lit(0), F.col("n_words") - (z - 1)) for z in sizes if z < s), F.lit(0)) for s in sizes}
    pos = F.coalesce(*[F.when(F.col("size") == s, F.col("at") - before[s]) for s in sizes], F.lit(0)).cast("int")
    found = each.join(F.broadcast(table) if few else table.hint("merge"), "hash").filter(F.col("gram") == F.col("words"))
    hits = found.select("_id", "_key", "n_words", "template", "label", "base", "n", "size", "tpos", pos.alias("pos"))
    if not few:
        hits = hits.unionByName(counted.select("_id", "_key", "n_words", *[F.lit(v).alias(c) for c, v in zip(("template", "label", "base", "n", "size", "tpos"), mark)], F.lit(0).alias("pos")))

    row = ["_id", "_key", "n_words", "template", "label", "base", "n"]
    diagonals = hits.withColumn("diagonal", F.when(F.col("template") < 0, 0).otherwise(F.col("pos") - F.col("tpos"))).groupBy(*row, "size", "diagonal").agg(F.collect_set("tpos").alias("tpos"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("size")).alias("stop"), F.count(F.lit(1)).alias("votes")).repartition("_id", "_key")
    w = Window.partitionBy("_id", "_key", "n_words", "template").orderBy("diagonal")
    apart = (F.col("n") == F.col("size")) | F.lag("diagonal").over(w).isNull() | (F.col("diagonal") - F.lag("diagonal").over(w) > tolerance)
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(w)).groupBy(*row, "size", "group").agg(F.flatten(F.collect_list("tpos")).alias("tpos"), F.min("first").alias("first"), F.max("stop").alias("stop"), F.sum("votes").alias("votes"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("tpos", lambda t: F.sequence(t, t + F.col("size") - 1)))))
    spans = merged.withColumn("coverage", F.when(F.col("template") < 0, 0.0).otherwise(covered / F.col("n"))).filter((F.col("template") < 0) | (F.col("coverage") >= coverage))

    is_base, real = F.col("base"), F.col("template") >= 0
    labels = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    out = spans.groupBy("_id", "_key", "n_words").agg(
        F.sum(F.when(is_base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        labels(is_base).alias("base_labels"),
        labels(real).alias("labels"),
        F.max("coverage").alias("score"),
        F.array_sort(F.collect_list(F.when(real, F.struct("first", "stop", "label", "coverage")))).alias("spans"),
        F.max(F.when(~real, F.col("votes"))).alias("copies"),
    )
    # rows that agree in id and text were scanned together: base places of each copy coincide
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def oracle(templates: tuple[Template, ...] = BASE + NOTICES) -> str:
    """DuckDB SQL for scan() without spans."""
    values = ", ".join(f"({no}, '{label}', {str(base).lower()}, {n}, {size}, {tpos}, '{g}')" for no, label, base, n, size, tpos, g in template_table(templates))
    return rf"""
WITH t(template, label, base, n, size, tpos, gram) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, unnest(range(len(w))) AS pos, w FROM d),
h AS (SELECT r, pos, 2 AS size, list_aggregate(w[pos + 1 : pos + 2], 'string_agg', ' ') AS gram FROM g WHERE pos + 2 <= len(w)
      UNION ALL SELECT r, pos, 3, list_aggregate(w[pos + 1 : pos + 3], 'string_agg', ' ') FROM g WHERE pos + 3 <= len(w)),
hits AS (SELECT r, template, label, base, n, h.size, tpos, pos, pos - tpos AS diagonal FROM h JOIN t ON h.gram = t.gram AND h.size = t.size),
diagonals AS (SELECT DISTINCT r, template, n, size, diagonal FROM hits),
marked AS (SELECT *, CASE WHEN n = size OR lag(diagonal) OVER w IS NULL OR diagonal - lag(diagonal) OVER w > {TOLERANCE} THEN 1 ELSE 0 END AS apart
           FROM diagonals WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
grouped AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS grp FROM marked),
covered AS (SELECT h.r, h.template, h.label, h.base, h.n, grp, min(h.pos) AS first, len(list_distinct(flatten(list(range(h.tpos, h.tpos + h.size))))) AS c
            FROM hits h JOIN grouped g ON h.r = g.r AND h.template = g.template AND h.diagonal = g.diagonal GROUP BY ALL),
spans AS (SELECT *, c / n AS coverage FROM covered WHERE c / n >= {COVERAGE}),
s AS (SELECT r, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
      FROM spans GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (r)
"""
