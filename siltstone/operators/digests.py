"""Digests of chunks by deterministic personas, merging, framing and size checks.

A summarizer is a function from (doc_id, chunk, line_no, line), or (doc_id, chunk, lines), to (doc_id, chunk, digest); the personas below are such functions, and a model behind
mapInPandas is another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import TokenCost, blank, chars4, length16, trimmed

# Fixed texts and tags of a checkpoint.
OPEN_TAG = "<compacted-summary>"
CLOSE_TAG = "</compacted-summary>"
ANCHOR_OPEN = "<session-search-anchors>"
ANCHOR_CLOSE = "</session-search-anchors>"
PREAMBLE = "This is an automatically generated checkpoint condensing an earlier span of the conversation to free up context. Treat the captured context as established background and build on it without restating it. Continue the task directly from the messages that follow, without acknowledging this checkpoint."
FORGETFUL = "SUMMARY: the user asked for work; several files were inspected and edited; continue from here."


def keepworthy(line: Column) -> Column:
    """Neither blank, nor filler, nor a bare condensation marker."""
    # the patterns are tried on the few lines that hold their fixed words
    t = trimmed(line)
    filler = F.when(line.contains("[filler"), t.rlike("\\A\\[filler\\s+[0-9]+\\]")).otherwise(F.lit(False))
    bare = F.when(line.contains("[condensed: ") & ~line.contains("including"), t.rlike("\\A\\[condensed: .*removed\\]\\z")).otherwise(F.lit(False))
    return ~blank(line) & ~filler & ~bare


def _summary(lines: Column) -> Column:
    return F.concat(F.lit("SUMMARY:\n"), F.array_join(lines, "\n"))


def _gathered(rows: DataFrame, line: Column) -> DataFrame:
    """(doc_id, chunk, lines, first): a chunk's lines that are not null, in order, and its first line's number. Lines move once, and a chunk's whole digest is made where they meet. Rows that hold a chunk's lines already stay where they are."""
    met = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col("line_no"), line.alias("line")))))
    return rows.groupBy("doc_id", "chunk").agg(met.alias("lines"), F.min("line_no").alias("first"))


def persona_perfect(rows: DataFrame) -> DataFrame:
    """Every informative line once, in order of first sight."""
    if "lines" in rows.columns:
        return rows.select("doc_id", "chunk", _summary(F.array_distinct(F.filter("lines", keepworthy))).alias("digest"))
    met = _gathered(rows, F.when(keepworthy(F.col("line")), F.col("line")))
    return met.select("doc_id", "chunk", _summary(F.array_distinct(F.col("lines.line"))).alias("digest"))


def persona_leak(rows: DataFrame) -> DataFrame:
    """Every fourth line is lost; line_no counts from the chunk's start."""
    if "lines" in rows.columns:
        return rows.select("doc_id", "chunk", _summary(F.filter("lines", lambda _, k: k % 4 != 3)).alias("digest"))
    kept = F.filter("lines", lambda x: (x["line_no"] - F.col("first")) % 4 != 3)
    return _gathered(rows, F.col("line")).select("doc_id", "chunk", _summary(F.transform(kept, lambda x: x["line"])).alias("digest"))


def persona_forgetful(rows: DataFrame) -> DataFrame:
    chunks = rows.select("doc_id", "chunk") if "lines" in rows.columns else rows.select("doc_id", "chunk").distinct()
    return chunks.withColumn("digest", F.lit(FORGETFUL))


def merge_material(digests: DataFrame) -> DataFrame:
    """(doc_id, digests, material): numbered digests in chunk order, one text a document, as a merge request takes them; their caps bound it."""
    row = F.struct("chunk", F.concat(F.lit("--- digest "), (F.col("chunk") + 1).cast("string"), F.lit(" ---\n"), F.col("digest")).alias("d"))
    return digests.groupBy("doc_id").agg(F.count(F.lit(1)).alias("digests"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["d"]), "\n\n").alias("material"))


def _material_lines(chunk: Column, digest: Column) -> Column:
    """A digest's lines in merge_material() that are informative, each once: its header, then its own."""
    text = F.concat(F.lit("--- digest "), (chunk + 1).cast("string"), F.lit(" ---\n"), digest)
    return F.array_distinct(F.filter(F.split(text, "\n", -1), keepworthy))


def merged(digests: DataFrame) -> DataFrame:
    """(doc_id, merge_levels, summary): a single digest stands as it is (level 0), several are merged in one call (level 1) over their numbered material, here by the perfect persona."""
    met = digests.filter(F.col("digest").isNotNull()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "digest"))).alias("d"))
    many = _summary(F.array_distinct(F.flatten(F.transform("d", lambda x: _material_lines(x["chunk"], x["digest"])))))
    several = F.size("d") > 1
    return met.select("doc_id", several.cast("int").alias("merge_levels"), F.when(several, many).otherwise(F.get("d", F.lit(0))["digest"]).alias("summary"))


def nonempty(digest: Column, *, blank_too: bool = False) -> Column:
    """The digest, or an error if it is null or empty; with blank_too also if it is white space alone."""
    text = F.coalesce(digest, F.lit(""))
    return F.when((trimmed(text) if blank_too else text) == "", F.raise_error(F.lit("a digest was empty"))).otherwise(digest)


def checkpoint(summary: Column) -> Column:
    """The framed text that replaces a region."""
    return F.concat(F.lit(PREAMBLE + "\n\n" + OPEN_TAG + "\n"), summary, F.lit("\n" + CLOSE_TAG))


def anchor_block(anchor: Column) -> Column:
    """A struct as one line of JSON between the anchor tags."""
    return F.concat_ws("\n", F.lit(ANCHOR_OPEN), F.to_json(anchor), F.lit(ANCHOR_CLOSE))


def with_recovery(summary: Column, block: Column, instruction: str) -> Column:
    """A replayed request's answer: the summary, its anchor block, and how to recover the original."""
    return F.concat_ws("\n\n", trimmed(summary), block, F.lit(instruction))


def shrinks(after: Column, before: Column) -> Column:
    """A replacement must be strictly smaller."""
    return after < before


def framed_shrinks(summary: Column, shadowed_tokens: Column, cost: TokenCost = chars4) -> Column:
    """Whether the framed summary, priced as a message of one text block, is smaller than the tokens that it shadows."""
    return shrinks(cost(checkpoint(summary)) + 8, shadowed_tokens)


def decide(own: Column, host: Column, region: Column) -> Column:
    """The own answer, or the host's where there is none, it is blank, or it is not shorter than the region, in UTF-16 code units."""
    sound = own.isNotNull() & (trimmed(own) != "") & shrinks(length16(own), length16(F.coalesce(region, F.lit(""))))
    return F.when(F.coalesce(sound, F.lit(False)), own).otherwise(host)


def synthetic_stream(text: Column) -> Column:
    """A finished text as the four records of a stream: start, one delta, end and finish. Explode it with its position."""
    null = F.lit(None).cast("string")
    record = lambda kind, body=null, reason=null: F.struct(F.lit(kind).alias("type"), body.alias("text"), reason.alias("reason"))
    return F.array(record("block-start"), record("text-delta", text), record("block-end", text), record("finish", null, F.lit("stop")))


def outcome(finish: Column, text: Column, has_image: Column) -> Column:
    """(status, error) of one call: its finish (stop, error, aborted, max-tokens), the text that it made and whether an image is among its blocks."""
    state = lambda s, e: F.struct(F.lit(s).alias("status"), F.lit(e).cast("string").alias("error"))
    return (
        F.when(finish == "aborted", state("aborted", "cancelled"))
        .when(finish == "error", state("fail", "provider error"))
        .when(finish == "max-tokens", state("fail", "MAX_TOKENS"))
        .when(has_image, state("fail", "UNSUPPORTED_CONTENT"))
        .when(trimmed(F.coalesce(text, F.lit(""))) == "", state("fail", "no text"))
        .otherwise(state("ok", None))
    )


def instruction(prompt: str, suffix: str = "", cap_tokens: Column | None = None, cap_text: str = "Keep the digest within %d tokens.") -> Column:
    """The instruction of a chunk, merge or fallback call: its prompt, a chunk's cap (if positive) and the configured suffix, a blank line between. The prompt is the caller's."""
    cap = F.lit(None).cast("string") if cap_tokens is None else F.when(cap_tokens > 0, F.format_string(cap_text, cap_tokens))
    return F.concat_ws("\n\n", F.lit(prompt), cap, *([F.lit(suffix)] if suffix else []))


def chunk_messages(rows: DataFrame, instruction_col: Column, text_col: str = "text") -> DataFrame:
    """rows with messages: the excerpt, then the instruction, as user messages."""
    message = lambda body: F.struct(F.lit("user").alias("role"), body.alias("text"))
    return rows.withColumn("messages", F.array(message(F.col(text_col)), message(instruction_col)))


def ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, after / before)


def percent(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit("n/a")).otherwise(F.format_string("%.1f%%", value * 100))


def characters(text: Column) -> Column:
    return length16(text)
