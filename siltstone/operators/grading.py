"""Grades: how much of what is needed survives, and whether an answer contradicts itself."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import length16
from siltstone.session import materialise, ship

# Fixed word lists.
REJECTIONS = ("rejected", "reject", "declined", "avoid", "must not", "do not", "don't", "no longer")
ADOPTIONS = ("chosen", "chose", "adopted", "selected", "decided to", "we will use", "went with")
STALE_CLAIM = "still (?:valid|available|supported)|is (?:still )?current|recommended"
FLIP = "we (?:also )?(?:chose|chosen|decided|picked)"


def has_token(text: Column, token: Column) -> Column:
    """Whether a text contains a token, in any case."""
    return F.lower(text).contains(F.lower(token))


def hallucinated(answer: Column, probe_type: Column, stale: Column | None = None) -> Column:
    """A rejection beside an adoption, a stale name called valid, or a flipped decision."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    any_of = lambda names: F.exists(F.array(*map(F.lit, names)), lambda w: text.contains(w))
    both = any_of(REJECTIONS) & any_of(ADOPTIONS)
    old = F.lit(False) if stale is None else F.coalesce(F.exists(stale, lambda s: text.contains(F.lower(s))), F.lit(False)) & text.rlike(STALE_CLAIM)
    return both | old | ((probe_type == "decision") & text.contains("rejected") & text.rlike(FLIP))


def grade_probes(probes: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, probe_id, matched, required, recall, missing. probes: keys, probe_id, need array; answers: keys, answer. A probe without an answer is graded as an empty one."""
    joined = probes.join(answers, keys, "left")
    hits = F.filter(F.coalesce("need", F.array().cast("array<string>")), lambda t: has_token(F.coalesce("answer", F.lit("")), t))
    missing = F.filter(F.coalesce("need", F.array().cast("array<string>")), lambda t: ~has_token(F.coalesce("answer", F.lit("")), t))
    graded = joined.withColumns({"matched": F.size(hits), "required": F.size(F.coalesce("need", F.array().cast("array<string>"))), "missing": missing})
    return graded.select(*keys, "probe_id", "matched", "required", F.when(F.col("required") > 0, F.col("matched") / F.col("required")).alias("recall"), "missing")


def faithfulness(grades: DataFrame, keys: list[str]) -> DataFrame:
    """keys, matched, required, faithfulness: over all that is needed (micro average)."""
    sums = grades.groupBy(*keys).agg(F.sum("matched").alias("matched"), F.sum("required").alias("required"))
    return sums.withColumn("faithfulness", F.when(F.col("required") > 0, F.col("matched") / F.col("required")))


def suite_means(grades: DataFrame, keys: list[str], digits: int = 3) -> DataFrame:
    """keys, mean_recall: over probes (macro average), rounded."""
    return grades.groupBy(*keys).agg(F.round(F.avg("recall"), digits).alias("mean_recall"))


def answers(branches: DataFrame, persona: str, key: str = "conv_id") -> DataFrame:
    """(key, answer): what an answerer can say to a probe from a branch's context alone. branches: key, text, ask.

    perfect repeats the context and the question, leak loses every fourth line of that, forgetful knows nothing.
    """
    shown = F.concat(F.col("text"), F.lit("\nAnswer strictly from the context above: "), F.col("ask"))
    if persona == "forgetful":
        shown = F.lit("I do not have that information.")
    elif persona == "leak":
        shown = F.array_join(F.filter(F.split(shown, "\n", -1), lambda _, k: k % 4 != 3), "\n")
    elif persona != "perfect":
        raise ValueError(persona)
    return branches.select(key, shown.alias("answer"))


def suite_a(target: DataFrame, control: DataFrame, digits: int = 6) -> DataFrame:
    """(episode, persona, probes, recall, control_recall, gain, hallucination): the compacted branch against the branch that just forgets, by mean over probes.

    Both: episode, persona, probe_id, recall, hallucinated (control may lack it). A null recall (nothing needed) counts as 0; a probe without a control as one that recalled nothing.
    """
    keys = ["episode", "persona", "probe_id"]
    paired = target.select(*keys, F.coalesce("recall", F.lit(0.0)).alias("r"), F.col("hallucinated").cast("int").alias("h")).join(control.select(*keys, F.col("recall").alias("c")), keys, "left")
    n, mean = F.count(F.lit(1)), lambda c: F.sum(c) / F.count(F.lit(1))
    control_mean = mean(F.coalesce("c", F.lit(0.0)))
    made = paired.groupBy("episode", "persona").agg(n.alias("probes"), mean("r").alias("recall"), control_mean.alias("control_recall"), (mean("r") - control_mean).alias("gain"), mean("h").alias("hallucination"))
    return made.select("episode", "persona", "probes", *[F.round(c, digits).alias(c) for c in ("recall", "control_recall", "gain", "hallucination")])


def suite_matrix(contexts: DataFrame, probes: DataFrame, variants: list[str], control: str, whole: str, personas: tuple[str, ...] = ("perfect", "leak", "forgetful"), digits: int = 6) -> DataFrame:
    """(episode, persona, probes, recall_<variant> ..., recall_<control>, hallucination_<variant> ..., ratio_<variant> ...): all variants of compaction side by side.

    contexts: conv_id, variant (those named, the control that just forgets, and the whole conversation), text; probes: conv_id, episode, ask, need. Means over probes; an answer is what a
    persona can say from the context alone, a conversation without a context recalls nothing. A ratio is the characters after compaction over those of the whole. Contexts
    and probes meet in one join, personas and variants in one aggregation.
    """
    met = probes.join(contexts, "conv_id", "left")
    shown = F.concat(F.coalesce("text", F.lit("")), F.lit("\nAnswer strictly from the context above: "), F.col("ask"))
    said = {"perfect": shown, "leak": F.array_join(F.filter(F.split(shown, "\n", -1), lambda _, k: k % 4 != 3), "\n"), "forgetful": F.lit("I do not have that information.")}
    each = met.select("conv_id", "episode", "variant", "need", F.coalesce(length16(F.col("text")), F.lit(0)).alias("chars"), F.explode(F.create_map(*[x for p in personas for x in (F.lit(p), said[p])])).alias("persona", "answer"))
    hits = F.size(F.filter("need", lambda t: has_token(F.col("answer"), t)))
    graded = each.withColumns({"recall": F.when(F.size("need") > 0, hits / F.size("need")).otherwise(0.0), "bad": hallucinated(F.col("answer"), F.lit("recall")).cast("int")})
    n = F.count_distinct("conv_id")
    of = lambda value, v: F.sum(F.when(F.col("variant") == v, F.col(value)).otherwise(0))
    columns = {f"recall_{v}": of("recall", v) / n for v in [*variants, control]} | {f"hallucination_{v}": of("bad", v) / n for v in variants} | {f"ratio_{v}": of("chars", v) / of("chars", whole) for v in variants}
    return graded.groupBy("episode", "persona").agg(n.alias("probes"), *[F.round(c, digits).alias(k) for k, c in columns.items()])


def report(rows: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """(line): each row as a line of a table in Markdown, its numbers rounded; the two header lines are the caller's columns."""
    cells = [F.coalesce(F.format_string(f"%.{digits}f", F.col(c).cast("double")) if rows.schema[c].dataType.typeName() in ("double", "float", "decimal") else F.col(c).cast("string"), F.lit("n/a")) for c in columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def aligned_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(part, *order, line): a table with header (part 0), rule (1) and rows (2), to be read by part and order. Columns are as wide as their widest cell, two spaces apart; nulls are empty.

    order: columns that no other column's name hides. Widths are learned in a pass of their own, one row of numbers; the rows stay where they are.
    """
    cell = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    found = rows.agg(*[F.max(F.length(v)).alias(f"_{k}") for k, v in enumerate(cell.values())]).first()
    wide = [max(len(c), found[k] or 0) for k, c in enumerate(columns)]
    body = rows.select(F.lit(2).alias("part"), *order, F.concat_ws("  ", *[F.rpad(v, w, " ") for v, w in zip(cell.values(), wide, strict=True)]).alias("line"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in body.schema])
    top = ["  ".join(c.ljust(w) for c, w in zip(columns, wide, strict=True)), "  ".join("-" * w for w in wide)]
    return rows.sparkSession.createDataFrame([(k, *[None] * len(order), line) for k, line in enumerate(top)], schema).unionByName(body)


def report_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): each row as a JSON object of those columns, in that order, nulls included."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))


def grep_counts(texts: DataFrame, needles: DataFrame, text_col: str = "text", *, block_chars: int = 1 << 20) -> DataFrame:
    """(needle, hits): lines that contain each distinct needle, in any case; an empty needle is in every line, one with a newline in none. Null texts have no lines.

    Needles are searched by an automaton in one walk over each text, a block of about ``block_chars`` characters of needles at a time, so a pass reads all texts and
    broadcasts one automaton whose size is bounded, and more needles take more passes. Only counts by needle are exchanged.
    """
    spark = texts.sparkSession
    known = materialise(needles.select("needle").filter("needle is not null").distinct().withColumn("_n", F.lower("needle")))
    total = known.agg(F.sum(F.length("_n") + 1)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    ship(spark)
    lowered = texts.select(F.lower(text_col).alias("_t")).filter("_t is not null")
    found = spark.createDataFrame([], "_n string, hits long")
    for b in range(blocks):
        chosen = known.select("_n").distinct().filter(F.pmod(F.xxhash64("_n"), F.lit(blocks)) == b)
        words = spark.sparkContext.broadcast([r["_n"] for r in chosen.collect()])  # a block: about block_chars characters
        found = found.unionByName(lowered.mapInArrow(partial(_scan, words), "_n string, hits long"))
    counts = found.groupBy("_n").agg(F.sum("hits").alias("hits"))
    return known.join(counts, "_n", "left").select("needle", F.coalesce("hits", F.lit(0)).alias("hits"))


def _scan(words, batches):
    """Counts of lines by needle over a task's texts."""
    import ahocorasick
    import pyarrow as pa

    automaton = ahocorasick.Automaton()
    for w in words.value:
        if w and "\n" not in w:
            automaton.add_word(w, w)
    some = len(automaton) > 0
    if some:
        automaton.make_automaton()
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            ends = [k for k, c in enumerate(text) if c == "\n"] if "\n" in text else []
            if some:
                counts.update(w for w, _ in {(w, bisect_left(ends, at)) for at, w in automaton.iter(text)})
            if "" in words.value:
                counts[""] += len(ends) + 1
    yield pa.RecordBatch.from_pydict({"_n": pa.array(list(counts), pa.string()), "hits": pa.array(list(counts.values()), pa.int64())})


def retrieval(before: DataFrame, after: DataFrame) -> DataFrame:
    """(found_before, found_after, recall) of needles (needle, hits) that occur at all."""
    joined = before.withColumnRenamed("hits", "b").join(after.withColumnRenamed("hits", "a"), "needle")
    sums = joined.agg(F.sum((F.col("b") > 0).cast("long")).alias("found_before"), F.sum(((F.col("b") > 0) & (F.col("a") > 0)).cast("long")).alias("found_after"))
    return sums.withColumn("recall", F.when(F.col("found_before") > 0, F.col("found_after") / F.col("found_before")))
