"""The engine's registered queries, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import budget, pieces, text
from siltstone.operators import chunks, digests, grading, lines, pool, stage0, surface
from siltstone.session import materialise, register, shared_dir
from siltstone.sinks.eventlog import EventLog

NOW = 1_000_000
WINDOWS = [1500, 1800, 2400]
MERGE_USABLE = 400
NEEDLE_WORDS = 5
ANCHOR = "anchor-"
#: Tokens that stay as they are at a conversation's end.
RETAIN = 120
#: Threshold, head and tail of the cut that was once made of long regions.
TRIM = (600, 300, 80)
RECOVERY = "The original turns stay readable: search the session by the anchor's id."
ROUTES = [
    ("primary", 0, 0, "p1", "m1", 2, 1.0),
    ("primary", 0, 1, "p1", "m2", 1, 5.0),
    ("primary", 0, 2, "p9", "m9", 1, 1.0),
    ("fallback", 1, 0, "p2", "m3", 1, 0.5),
    ("fallback", 1, 1, "p3", "m4", 1, 1.0),
]
PROVIDERS = [("p1", True), ("p2", True), ("p3", False)]
CATALOG = [("p1", "m1"), ("p2", "m3")]
CAPACITIES = [("p1/m1", 1500, 400), ("p1/m2", 1800, 0), ("p2/m3", 4000, 1000), ("p9/m9", -5, 100)]
COOLDOWNS = [("p1/m2", NOW + 5000), ("p1/m2", NOW - 10), ("p9/m9", NOW), ("p3/m4", NOW + 90)]
BUDGET_WINDOWS = [1, 3000, 4000, 8000, 8192, 65536, 128000, 131072, 200000, 262144, 1048576]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.document_lines(table(spark, sf_dir, "documents"))


def _with_noise(line: Column, number: Column) -> Column:
    """A line and the blanks, escapes, cursors, rules, fences and log lines put in after it, by document and line number."""
    m = F.col("doc_id") + number
    some = lambda cond, items: F.when(cond, F.array(*items)).otherwise(F.array().cast("array<string>"))
    lits = lambda *xs: [F.lit(x) for x in xs]
    red = F.concat(F.lit("\x1b[31m"), F.substring(line, 1, 20), F.lit("\x1b[0m"))
    return F.concat(
        F.array(line),
        some(m % 3 == 0, lits("", "", "", "")),
        some(m % 3 == 1, lits("")),
        some(m % 5 == 0, [red, *lits("    ^^^^^^", "----------------")]),
        some(m % 7 == 0, lits("```py", "def f():", "        a", "            b", "            c", "```")),
        some(m % 4 == 0, [F.lit(f"svc 2026-01-01 10:00:0{k} INFO step {k}") for k in range(6)]),
    )


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with noise put in, as the tables have none: (doc_id, lines), each document's lines in order, where they lie; if rows share an id, (doc_id, line_no, line), numbered over all of them."""
    docs = table(spark, sf_dir, "documents")
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs.select("doc_id", F.flatten(F.transform(text.split_lines(F.col("text")), lambda x, k: _with_noise(x, k.cast("long")))).alias("lines"))
    each = lines.document_lines(docs).select("doc_id", F.col("line_no").alias("_at"), F.posexplode(_with_noise(F.col("line"), F.col("line_no"))).alias("_sub", "line"))
    return lines.renumber(each, "doc_id", "_at", "_sub").select("doc_id", "line_no", "line")


def region_lines(spark, sf_dir):
    return lines.region_lines(lines.as_blocks(table(spark, sf_dir, "conversations")))


def block_lines(spark, sf_dir):
    """Tool calls, files, images and unknown blocks, made from conversations by turn."""
    t = F.col("turn") % 5
    block = F.struct(
        F.when(t == 0, "text").when(t == 1, "tool-call").when(t == 2, "image").when(t == 3, "file").otherwise("chart").alias("type"),
        F.col("text").alias("text"), F.lit("read").alias("name"), F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit("}")).alias("arguments"),
        F.when(F.col("conv_id") % 2 == 0, "a.png").alias("attachment_name"), (F.col("conv_id") % 3 == 0).alias("offloaded"), F.lit('{"x":1}').alias("raw_json"),
    )
    return lines.region_lines(table(spark, sf_dir, "conversations").withColumn("content", F.array(block)))


def replayed_region(spark, sf_dir):
    return lines.replayed_region(table(spark, sf_dir, "conversations"))


def _blocks(spark, sf_dir):
    """Each turn as a text, a tool call and a chart."""
    null = F.lit(None).cast("string")
    block = lambda kind, body=null, name=null, arguments=null, raw=null: F.struct(F.lit(kind).alias("type"), body.alias("text"), name.alias("name"), arguments.alias("arguments"), null.alias("attachment_name"), F.lit(None).cast("boolean").alias("offloaded"), raw.alias("raw_json"))
    content = F.array(block("text", F.col("text")), block("tool-call", null, F.lit("read"), F.format_string('{"turn":%d}', "turn")), block("chart", raw=F.lit('{"x":1}')))
    return table(spark, sf_dir, "conversations").withColumn("content", content)


def replayed_blocks(spark, sf_dir):
    """Replayed requests whose contents are blocks."""
    return lines.replayed_region(_blocks(spark, sf_dir), text="content")


def message_prices(spark, sf_dir):
    """Every message's price, as blocks and as a string, its text as a summary has it, and its characters as JSON."""
    made = _blocks(spark, sf_dir).select("conv_id", "turn", lines.message_tokens(F.col("content")).alias("block_tokens"), lines.text_tokens(F.col("text")).alias("text_tokens"), F.sha2(lines.blocks_to_text(F.col("content")), 256).alias("text_sha256"))
    return made


def request_tokens(spark, sf_dir):
    return lines.request_tokens(_blocks(spark, sf_dir))


def region_chars(spark, sf_dir):
    """Characters of each conversation's contents as JSON, a list of texts a turn."""
    return lines.region_chars(table(spark, sf_dir, "conversations").withColumn("content", F.array("text")))


def history_text(spark, sf_dir):
    found = lines.history_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("type"), F.when(F.col("turn") % 4 > 0, F.col("text")).alias("text")))
    return found.select("session_id", F.sha2("history", 256).alias("history_sha256"))


def purpose_requests(spark, sf_dir):
    return lines.purpose(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "compaction").when(F.col("event_id") % 3 == 1, "chat").alias("purpose")))


def triggers(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ("manual", "pressure", "context-overflow", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", lines.trigger(F.when(F.col("event_id") % 9 > 0, label)).alias("trigger"))


def targets(spark, sf_dir):
    """The model that a request goes to: its header's, else the agent's."""
    n = F.col("event_id")
    header = F.struct(F.when(n % 2 == 0, "p").alias("provider"), F.when(n % 3 == 0, "m").otherwise("").alias("model"))
    options = F.struct(F.lit("q").alias("provider"), F.when(n % 5 > 0, "n").alias("model"))
    found = lines.target(header, options)
    return table(spark, sf_dir, "events").select("event_id", found["provider"].alias("provider"), found["model"].alias("model"))


def replay_input(spark, sf_dir):
    """A system head with tools and the turns from the second to the fifth, by the region's seqs."""
    nodes = _nodes(spark, sf_dir)
    heads = nodes.select("session_id").distinct().select("session_id", F.lit("Be brief.").alias("text"), F.array(F.lit("read")).alias("tools"))
    regions = nodes.filter("pos between 1 and 4").select("session_id", "seq")
    messages = nodes.select("session_id", "seq", F.when(F.col("is_system"), "system").otherwise("user").alias("role"), "text")
    return lines.replay_input(heads, messages, regions).withColumn("tools", F.array_join("tools", ","))


def filler_lines(spark, sf_dir):
    return lines.filler(spark, 1000, "build")


def unknown_keys(spark, sf_dir):
    """Keys of each event's made-up configuration that are unknown, and those that are known but deprecated."""
    from siltstone.config import DEPRECATED

    keys = F.array(F.lit("tiers"), F.concat(F.lit("x"), (F.col("event_id") % 3).cast("string")), F.when(F.col("event_id") % 2 == 0, "mergeTiers").otherwise("chunkRatio"))
    known, old = F.array(*map(F.lit, ("tiers", "chunkRatio", *sorted(DEPRECATED[""])))), F.array(*map(F.lit, sorted(DEPRECATED[""])))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_except(keys, known), ",").alias("unknown"), F.array_join(F.array_intersect(keys, old), ",").alias("deprecated"))


def output_tokens(spark, sf_dir):
    """What each document's request may ask for in windows of three sizes."""
    w = F.explode(F.array(*[F.lit(x).cast("long") for x in (500, 1000, 100_000)])).alias("window")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.chars4(F.col("text")).alias("input"), w)
    return docs.select("doc_id", "window", budget.effective_max_tokens(F.col("window"), F.col("input"), F.lit(8192)).alias("max_tokens"))


def retry_delays(spark, sf_dir):
    """Waits before a retry, the event's number standing in for chance."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 9 + 1).alias("retry"), ((F.col("event_id") % 11) / 10).alias("random"))
    return e.select("event_id", F.round(budget.retry_delay_ms(500, 20_000, 0.2, F.col("retry"), F.col("random")), 6).alias("delay_ms"))


def dedup_lines(spark, sf_dir):
    return stage0.dedup_lines(_documents(spark, sf_dir))


def purge_noise(spark, sf_dir):
    return stage0.purge_noise(noisy(spark, sf_dir))


def skip_blank_blocks(spark, sf_dir):
    return stage0.skip_blank_blocks(noisy(spark, sf_dir))


def head_middle_tail(spark, sf_dir):
    return stage0.head_middle_tail(_documents(spark, sf_dir), 2000, 900, 500)


def ast_skeleton(spark, sf_dir):
    return stage0.ast_skeleton(noisy(spark, sf_dir))


def log_runs(spark, sf_dir):
    return stage0.log_runs(noisy(spark, sf_dir))


def log_condense_balanced(spark, sf_dir):
    return stage0.log_condense(noisy(spark, sf_dir), "balanced", 3)


def log_condense_head(spark, sf_dir):
    return stage0.log_condense(noisy(spark, sf_dir), "head", 2)


def log_condense_tail(spark, sf_dir):
    return stage0.log_condense(noisy(spark, sf_dir), "tail", 2)


def stage0_full(spark, sf_dir):
    return stage0.run_stage0(noisy(spark, sf_dir), skeleton_depth=2, log_lines=3)


def exact_document_tokens(spark, sf_dir):
    """Every document's tokens by a public vocabulary, and how many pieces were priced."""
    import public_tokenizers

    content = pieces.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.exact_tokens(table(spark, sf_dir, "documents"), ["doc_id"], "text", content)


def region_tokens(spark, sf_dir):
    """Lines, tokens and characters of each conversation after deduplication."""
    rows = region_lines(spark, sf_dir).withColumnRenamed("conv_id", "doc_id").transform(stage0.dedup_lines)
    return rows.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(text.line_cost(F.col("line"))).alias("tokens"), F.sum(text.length16(F.col("line"))).alias("chars"))


def context_size(spark, sf_dir):
    size = text.length16(F.col("surface"))
    return lines.surface_text(table(spark, sf_dir, "conversations")).select("conv_id", size.alias("chars"), text.chars4(F.col("surface")).alias("tokens"))


def budget_table(spark, sf_dir):
    w = F.col("window")
    rows = spark.createDataFrame([(x,) for x in BUDGET_WINDOWS], "window long")
    return rows.select("window", budget.output_budget(w).alias("output"), budget.usable_input(w).alias("usable"), budget.chunk_budget(w).alias("chunk"), budget.overlap_budget(w).alias("overlap"))


def _chunks(spark, sf_dir, windows):
    return chunks.chunk_lines(_documents(spark, sf_dir), chunks.budgets_of(windows))


def chunk_slices(spark, sf_dir):
    return _chunks(spark, sf_dir, WINDOWS[:1])


def chunk_slices_pool(spark, sf_dir):
    return _chunks(spark, sf_dir, WINDOWS)


def digest_caps(spark, sf_dir):
    return chunks.digest_caps(_chunks(spark, sf_dir, WINDOWS), MERGE_USABLE).select("doc_id", "chunk", "core_tokens", "cap_tokens")


def split_halves(spark, sf_dir):
    capped = chunks.digest_caps(_chunks(spark, sf_dir, WINDOWS), MERGE_USABLE)
    return chunks.split_halves(_documents(spark, sf_dir), capped)


def _chunk_lines(spark, sf_dir):
    """(doc_id, chunk, lines): the lines of every chunk of the cleaned documents."""
    return chunks.chunk_texts(stage0.run_stage0(noisy(spark, sf_dir), skeleton_depth=2, log_lines=3), chunks.budgets_of(WINDOWS))


def persona_perfect(spark, sf_dir):
    return _digest(digests.persona_perfect(_chunk_lines(spark, sf_dir)))


def persona_leak(spark, sf_dir):
    return _digest(digests.persona_leak(_chunk_lines(spark, sf_dir)))


def persona_forgetful(spark, sf_dir):
    """It needs to know which chunks there are, not what they hold."""
    return _digest(digests.persona_forgetful(chunks.chunk_lines(stage0.run_stage0(noisy(spark, sf_dir), skeleton_depth=2, log_lines=3), chunks.budgets_of(WINDOWS))))


def _digest(df):
    return df.select("doc_id", "chunk", text.length16(F.col("digest")).alias("chars"), F.sha2("digest", 256).alias("digest_sha256"))


def merge_material(spark, sf_dir):
    found = digests.merge_material(digests.persona_perfect(_chunk_lines(spark, sf_dir)))
    return found.select("doc_id", "digests", F.sha2("material", 256).alias("material_sha256"))


def _compacted(spark, sf_dir):
    """Every document's summary, written once, as its size and its text are both asked for."""
    return materialise(digests.merged(digests.persona_perfect(_chunk_lines(spark, sf_dir))))


def compaction_graded(spark, sf_dir):
    """The flagship: clean, chunk, digest, merge and frame every document, then grade what of its first words by line survived."""
    made = _compacted(spark, sf_dir).withColumn("answer", digests.checkpoint(F.col("summary")))
    first = _documents(spark, sf_dir).withColumn("w", F.regexp_extract("line", "^([A-Za-z]{4,})", 1)).filter("w <> ''")
    probes = first.groupBy("doc_id").agg(F.lit("first-words").alias("probe_id"), F.array_sort(F.collect_set("w")).alias("need"))
    grades = grading.grade_probes(probes, made.select("doc_id", "answer"), ["doc_id"])
    sizes = made.select("doc_id", "merge_levels", text.length16(F.col("summary")).alias("summary_chars"))
    return grades.join(sizes, "doc_id").select("doc_id", "merge_levels", "summary_chars", "matched", "required", F.round("recall", 6).alias("recall"))


def compression_ratio(spark, sf_dir):
    """Characters before and after, whether it shrank, and the ratio."""
    before = table(spark, sf_dir, "documents").select("doc_id", text.length16(F.col("text")).alias("before_chars"))
    after = _compacted(spark, sf_dir).select("doc_id", text.length16(digests.checkpoint(F.col("summary"))).alias("after_chars"))
    both = before.join(after, "doc_id")
    return both.select("doc_id", "before_chars", "after_chars", digests.shrinks(F.col("after_chars"), F.col("before_chars")).alias("shrinks"), F.round(digests.ratio(F.col("before_chars"), F.col("after_chars")), 6).alias("ratio"))


def _nodes(spark, sf_dir):
    """Conversations as surface nodes; every third assistant turn calls a tool whose result is the next turn."""
    conv = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    calls = (F.col("turn") % 3 == 1).cast("int")
    result = F.coalesce(F.lag((F.col("turn") % 3 == 1).cast("int")).over(w), F.lit(0))
    return conv.select(
        F.col("conv_id").alias("session_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), (F.col("turn") + 100).alias("seq"),
        (text.chars4(F.col("text")) + 8).alias("tokens"), (calls - result).alias("delta"), (F.col("role") == "system").alias("is_system"), F.col("text"), F.col("role"),
    )


def tool_balance(spark, sf_dir):
    return surface.tool_balance(_nodes(spark, sf_dir)).select("session_id", "pos", "delta", "balanced_before", "balanced_after")


def retention_range(spark, sf_dir):
    return surface.retention_range(_nodes(spark, sf_dir), 120)


def pressure_decision(spark, sf_dir):
    return surface.pressure_decision(_nodes(spark, sf_dir), 500, 100, headroom=60)


def validate_region(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    spans = nodes.groupBy("session_id").agg((F.min("seq") + F.col("session_id") % 4).alias("start_seq"), (F.max("seq") - F.col("session_id") % 3).alias("end_seq"))
    return surface.validate_region(nodes, spans)


def _replacing(spark, sf_dir):
    """Each conversation's turns, then two replacements: of its second and third node, and of that one with the next."""
    nodes = _nodes(spark, sf_dir)
    null = F.lit(None).cast("array<bigint>")
    appended = nodes.select("session_id", "seq", F.lit("append").alias("op"), null.alias("covers"))
    ends = nodes.groupBy("session_id").agg(F.max("seq").alias("top"), F.array_sort(F.collect_list("seq")).alias("s")).filter(F.size("s") >= 4)
    one = ends.select("session_id", (F.col("top") + 1).alias("seq"), F.lit("replace").alias("op"), F.slice("s", 2, 2).alias("covers"))
    two = ends.select("session_id", (F.col("top") + 2).alias("seq"), F.lit("replace").alias("op"), F.array(F.col("top") + 1, F.element_at("s", 4)).alias("covers"))
    return appended.unionByName(one).unionByName(two)


def surface_after_replace(spark, sf_dir):
    return surface.surface_fold(_replacing(spark, sf_dir))


def surface_streamed(spark, sf_dir):
    """The same surface from a stream of those events in four stretches that take no heed of their order, with the node's tokens beside it."""
    from siltstone.streaming.state import partitioned, surface_changes

    priced = _replacing(spark, sf_dir).join(_nodes(spark, sf_dir).select("session_id", "seq", "tokens"), ["session_id", "seq"], "left")
    events = materialise(priced.repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("seq", "session_id")))
    files = events.inputFiles()
    path = register(spark, f"{shared_dir(spark)}/siltstone-stream-{uuid.uuid4().hex}")
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // 4))).parquet(files[0].rsplit("/", 1)[0])

    def write(changes, epoch):
        changes.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    with partitioned(spark, events.count()):
        stream = surface_changes(live).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    changes = spark.read.schema("session_id long, seq long, visible boolean, place long, tokens long, total_tokens long, epoch long").parquet(f"{path}/out")
    last = changes.groupBy("session_id", "seq").agg(F.max_by(F.struct("visible", "place", "tokens"), "epoch").alias("n")).filter("n.visible")
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy("n.place")) - 1
    return last.select("session_id", pos.cast("long").alias("pos"), "seq", "n.tokens")


def surface_nested(spark, sf_dir):
    """Each conversation condensed again and again: every replacement covers the one before and the next turn, so they are nested as deep as the conversation is long."""
    nodes = _nodes(spark, sf_dir)
    null = F.lit(None).cast("array<bigint>")
    appended = nodes.select("session_id", "seq", F.lit("append").alias("op"), null.alias("covers"))
    before = F.when(F.col("pos") == 1, F.lit(None)).otherwise(F.col("seq") + 9_999)
    again = nodes.filter("pos >= 1").select("session_id", (F.col("seq") + 10_000).alias("seq"), F.lit("replace").alias("op"), F.array_compact(F.array("seq", before)).alias("covers"))
    return surface.surface_fold(appended.unionByName(again))


def pressure_rounds(spark, sf_dir):
    """Two rounds of the pressure policy over every conversation: a range becomes one node of a third of its tokens."""
    def compact(nodes, ranges):
        inside = nodes.join(ranges, "session_id").filter("pos between start_pos and end_pos").groupBy("session_id", "start_pos", "end_pos").agg((F.max("seq") + 1000).alias("seq"), F.floor(F.sum("tokens") / 3).alias("tokens"))
        return surface.replace_span(nodes, inside)

    nodes = _nodes(spark, sf_dir).select("session_id", "pos", "seq", "tokens", "delta", "is_system")
    return surface.pressure_rounds(nodes, compact, 500, 100, headroom=60)


def keep_right(spark, sf_dir):
    return surface.keep_right_range(_nodes(spark, sf_dir), 2)


def control_branch(spark, sf_dir):
    """The nodes that are left if the range is just forgotten."""
    nodes = _nodes(spark, sf_dir)
    return surface.delete_range(nodes, surface.keep_right_range(nodes, 2)).select("session_id", "pos", "seq")


def surface_stability(spark, sf_dir):
    """Whether each conversation's nodes are the same after every third got another price and every fifth lost its last node."""
    nodes = _nodes(spark, sf_dir).select("session_id", "pos", "seq", "tokens")
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("session_id"))
    after = nodes.withColumn("tokens", F.col("tokens") + ((F.col("session_id") % 3 == 0) & (F.col("pos") == 1)).cast("int")).withColumn("_last", last).filter(~(F.col("_last") & (F.col("session_id") % 5 == 0))).drop("_last")
    return surface.unchanged(nodes, after)


def span_stability(spark, sf_dir):
    """Spans over the second to the fourth node: as they were, with a node of another price, with a node gone."""
    nodes = _nodes(spark, sf_dir).withColumn("delta", F.lit(0)).select("session_id", "pos", "seq", "tokens", "delta")
    inside = nodes.filter("pos between 1 and 3").groupBy("session_id").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.array_sort(F.collect_list("seq")).alias("seqs"), F.sum("tokens").alias("tokens")).filter("size(seqs) = 3")
    m = F.col("session_id") % 4
    now = nodes.withColumn("tokens", F.col("tokens") + ((m == 1) & (F.col("pos") == 2)).cast("int")).filter(~((m == 2) & (F.col("pos") == 2)) & ~((m == 3) & (F.col("pos") == 3)))
    now = now.withColumn("pos", (F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1).cast("long"))
    return surface.span_stable(inside, now)


def committed(spark, sf_dir):
    """The events that land a checkpoint over the second and third turn of each conversation; every fourth fails."""
    nodes = _nodes(spark, sf_dir)
    regions = nodes.filter("pos between 1 and 2").groupBy("session_id").agg(F.array_sort(F.collect_list("seq")).alias("covers")).withColumns({"summary": F.lit("S"), "error": F.when(F.col("session_id") % 4 == 0, "not smaller")})
    made = surface.commit(nodes.select("session_id", "seq"), regions)
    return made.select("session_id", "seq", "type", "op", F.array_join("covers", ",").alias("covers"), F.array_join("source_seqs", ",").alias("sources"), "text")


def compacted_log(spark, sf_dir):
    """From log to log: every conversation's events are committed, what retention lets go is cleaned, digested, framed and committed as one append, and the log is read back and folded.

    A checkpoint that is not smaller than what it stands for lands as an error and leaves the surface as it was.
    """
    log = EventLog(spark, register(spark, f"{shared_dir(spark)}/siltstone-log-{uuid.uuid4().hex}"))
    null = F.lit(None)
    turns = _nodes(spark, sf_dir)
    log.append(lambda _: turns.select("session_id", "seq", F.concat(F.col("role"), F.lit("/message")).alias("type"), F.lit("append").alias("op"), null.alias("covers"), null.alias("source_seqs"), "text"))

    def compact(events):
        said = events.select("session_id", "seq", "text")
        nodes = turns.drop("text").join(said, ["session_id", "seq"])
        spans = surface.retention_range(nodes, RETAIN)
        inside = materialise(nodes.join(spans, "session_id").filter("pos between start_pos and end_pos"))
        regions = inside.groupBy("session_id").agg(F.array_sort(F.collect_list("seq")).alias("covers"), F.sum("tokens").alias("shadowed"))
        rows = lines.region_lines(lines.as_blocks(inside.withColumnRenamed("session_id", "conv_id").withColumnRenamed("pos", "turn"))).withColumnRenamed("conv_id", "doc_id")
        made = digests.persona_perfect(stage0.run_stage0(rows).withColumn("chunk", F.lit(0))).select(F.col("doc_id").alias("session_id"), digests.nonempty(F.col("digest")).alias("digest"))
        landed = regions.join(made, "session_id")
        return surface.commit(events.select("session_id", "seq"), landed.select("session_id", "covers", digests.checkpoint(F.col("digest")).alias("summary"), F.when(~digests.framed_shrinks(F.col("digest"), F.col("shadowed")), "not smaller").alias("error")))

    log.append(compact)
    events = materialise(log.read())
    seen = surface.surface_fold(events)
    return seen.join(events.select("session_id", "seq", "type", F.sha2("text", 256).alias("text_sha256"), F.size(F.coalesce("covers", F.array().cast("array<bigint>"))).alias("covered"), "batch"), ["session_id", "seq"])


def entry_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("turn/start", "turn/end", "compaction/start", "compaction/end", "session/end-seed")]), (F.col("event_id") % 5 + 1).cast("int"))
    return surface.entry_state(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("type"), (F.col("event_id") * 2).alias("turn")))


def derive_span(spark, sf_dir):
    nodes = _nodes(spark, sf_dir).select("session_id", "pos", "seq", text.fingerprint(F.col("text")).alias("print"))
    shift = (F.col("session_id") % 3).cast("int")
    replay = nodes.filter((F.col("pos") >= shift) & (F.col("pos") < shift + 3)).select("session_id", (F.col("pos") - shift).alias("pos"), "print")
    return surface.derive_span(nodes, replay)


def _routes(spark, now=NOW):
    rows = spark.createDataFrame(ROUTES, "tier_name string, tier_idx int, pos int, provider string, model string, max_concurrent int, cooldown_hours double")
    rows = rows.withColumn("key", text.route_key(F.col("provider"), F.col("model")))
    capable = pool.with_capacity(rows, spark.createDataFrame(CAPACITIES, "key string, context_window long, max_tokens long"))
    return pool.with_health(capable, spark.createDataFrame(COOLDOWNS, "key string, cooldown_until long"), now)


def pool_validation(spark, sf_dir):
    return pool.validate_pool(_routes(spark), spark.createDataFrame(PROVIDERS, "provider string, listable boolean"), spark.createDataFrame(CATALOG, "provider string, model string"))


def route_capacity(spark, sf_dir):
    return _routes(spark).select("key", "window", "max_tokens", "cooled_until", "healthy")


def merge_holdable(spark, sf_dir):
    made = [pool.can_hold_merge(_routes(spark), w).select(F.lit(w).cast("long").alias("merge_window"), "holdable") for w in (3000, 262144, 300000)]
    return made[0].unionByName(made[1]).unionByName(made[2])


def route_pick(spark, sf_dir):
    """The route of each chunk of the pool slicing; every seventh is a retry, every fifth prefers p1/m2, every third is splittable. p2/m3 has no free slot."""
    task = F.concat_ws("-", "doc_id", "chunk")
    m = F.col("doc_id") + F.col("chunk")
    tasks = _chunks(spark, sf_dir, [20000, 30000]).select(task.alias("task"), F.col("tokens"), F.when(m % 5 == 0, "p1/m2").alias("preferred_key"), (m % 7 == 0).alias("is_retry"), (m % 3 == 0).alias("splittable"))
    return pool.pick_routes(tasks, _routes(spark).withColumn("free", F.col("key") != "p2/m3"))


def route_deal(spark, sf_dir):
    """Documents of growing size dealt over the slots of the routes that can hold them; every fifth prefers p1/m2."""
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    tasks = docs.select(F.col("doc_id").alias("task"), F.coalesce(text.chars4(F.col("text")), F.lit(0)).alias("tokens"), F.when(F.col("doc_id") % 5 == 0, "p1/m2").alias("preferred_key"), F.lit(False).alias("is_retry"), F.lit(True).alias("splittable"), F.col("doc_id").alias("rank"))
    routes = _routes(spark, NOW + 10_000).withColumn("slots", F.col("max_concurrent"))
    return pool.pick_routes(tasks, routes, deal=True).select("task", "key", "tier_idx")


def chunk_routes(spark, sf_dir):
    return pool.chunk_routes(_routes(spark, NOW + 10_000).withColumn("free", F.lit(True)), 1).select("key", "turn")


def pool_reset(spark, sf_dir):
    """The pool at two times: one at which a route is healthy, and one at which none is, so that all cooldowns are cleared."""
    now = [pool.reset_once(_routes(spark, t)).select(F.lit(t).cast("long").alias("at"), "key", "healthy", "reset") for t in (NOW, 0)]
    out = pool.reset_once(_routes(spark, 0).withColumn("healthy", F.lit(False))).select(F.lit(-1).cast("long").alias("at"), "key", "healthy", "reset")
    return now[0].unionByName(now[1]).unionByName(out)


def merge_plan(spark, sf_dir):
    """What becomes of one, of three and of no digests, with and without a route for the merge and with and without a fallback."""
    r = _routes(spark)
    cases = [(1, 1500, True), (3, 1500, True), (3, 10**9, True), (3, 10**9, False), (0, 1500, True)]
    made = [pool.merge_plan(r, w, n, fallback=f).select(F.lit(n).alias("digests"), F.lit(w).alias("merge_window"), F.lit(f).alias("may_fall_back"), "plan", "merge_levels", "reason", F.col("error").isNotNull().alias("fails")) for n, w, f in cases]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def local_quarantine(spark, sf_dir):
    """Stored cooldowns and those of failures that could not be stored (every route of a failed event)."""
    a = _attempts(spark, sf_dir).filter("error is not null")
    local = a.select(F.col("model").alias("key"), budget.cooldown_until(F.lit(0.5), F.col("pos")).alias("cooldown_until"))
    return pool.quarantined(spark.createDataFrame([("p0/m", 5), ("other/m", 7)], "key string, cooldown_until long"), local)


def cooldowns_cleared(spark, sf_dir):
    return pool.clear_cooldowns(local_quarantine(spark, sf_dir))


def earliest_expiry(spark, sf_dir):
    r = _routes(spark)
    return pool.earliest_expiry(r, NOW).join(pool.all_cooled(r)).join(pool.health_summary(r))


def _attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type").isin("error", "purchase")
    return e.select((F.col("user_id") % 50).alias("job"), F.col("event_id").alias("pos"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string"), F.lit("/m")).alias("model"), F.when(bad, F.concat(F.lit("failed "), F.col("event_id").cast("string"))).alias("error"), "event_id")


def attempts_summary(spark, sf_dir):
    return pool.attempts_summary(_attempts(spark, sf_dir), "job", 60)


def calls_by_route(spark, sf_dir):
    timed = _attempts(spark, sf_dir).withColumns({"started": F.col("pos") * 10, "ended": F.col("pos") * 10 + F.col("pos") % 7})
    return pool.calls_by_route(timed)


def collapse_error(spark, sf_dir):
    """The error of every second job's batch; the others made no attempts."""
    jobs = _attempts(spark, sf_dir).select("job").distinct()
    found = jobs.join(pool.attempts_summary(_attempts(spark, sf_dir).filter("job % 2 = 0"), "job"), "job", "left")
    return found.select("job", F.sha2(pool.collapse_error(F.lit("no route is left"), F.col("summary")), 256).alias("error_sha256"))


def combined_parts(spark, sf_dir):
    """Each conversation's turns as the parts of one split task."""
    t = F.col("turn")
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("root"), t.alias("pos"), "text", F.lit("p").alias("provider"), F.concat(F.lit("m"), (t % 2).cast("string")).alias("model"), (t * 100).cast("long").alias("max_tokens"), F.array(F.concat(F.lit("try "), t.cast("string"))).alias("attempts"), (t == 3).alias("fallback"))
    made = pool.combine_parts(conv)
    return made.select(F.col("root").alias("conv_id"), F.sha2("text", 256).alias("text_sha256"), "provider", "model", "max_tokens", F.array_join("attempts", ",").alias("attempts"), "fallback", "split_into", F.array_join("models", ",").alias("models"))


def recorded_once(spark, sf_dir):
    """Failures that wrappers report again under the same id are recorded by their first report."""
    from siltstone.sinks.runlog import record_once

    a = _attempts(spark, sf_dir).filter("error is not null").select((F.col("pos") % 97).alias("failure_id"), "pos", "error")
    return record_once(a)


def cooldown_upsert(spark, sf_dir):
    """Cooldowns after every failure of a route, by event order."""
    a = _attempts(spark, sf_dir).filter("error is not null")
    changes = a.select(F.col("model").alias("key"), budget.cooldown_until(F.lit(0.5), F.col("pos")).alias("cooldown_until"), "pos")
    state = spark.createDataFrame([("p0/m", 5), ("other/m", 7)], "key string, cooldown_until long")
    return pool.upsert_cooldowns(state, changes)


def _records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("at"), F.when(F.col("event_id") % 2 == 0, "manual").otherwise("pressure").alias("trigger"), F.lit("p1").alias("provider"), F.when(F.col("event_id") % 3 > 0, "m1").alias("model"), (F.col("event_id") % 5 == 0).alias("failed"), F.array(F.lit("outer failed"), F.concat(F.lit("cause "), F.col("event_id").cast("string")), F.lit("failed")).alias("errors"), F.repeat(F.lit("x"), (F.col("event_id") % 300).cast("int")).alias("region"))


def run_record(spark, sf_dir):
    from siltstone.sinks.runlog import format_records

    return format_records(_records(spark, sf_dir), 100).select("at", "trigger", "route", "failed", "error", "snapshotChars", text.length16(F.col("snapshot")).alias("snapshot_length"))


def _log(spark, records, batches=3):
    """A log in the shared folder that the records were appended to batch by batch, their clock running backwards from one batch to the next."""
    import uuid

    from siltstone.session import register, shared_dir
    from siltstone.sinks.runlog import append_records

    path = register(spark, f"{shared_dir(spark)}/siltstone-log-{uuid.uuid4().hex}")
    for k in reversed(range(batches)):
        append_records(records.filter(F.col("at") % batches == k).orderBy("at"), path)
    return path


def runlog_recent(spark, sf_dir):
    """The newest 20 records of a log by their place in it, which its clock does not tell."""
    from siltstone.sinks.runlog import format_records
    from siltstone.sources.runlog import newest

    return newest(spark, _log(spark, format_records(_records(spark, sf_dir))), 20).select("at", "route")


def runlog_capped(spark, sf_dir):
    """What is left of such a log after it was capped to 500 records and one more batch was appended."""
    from siltstone.sinks.runlog import append_records, cap_log, format_records
    from siltstone.sources.runlog import read_records

    records = format_records(_records(spark, sf_dir))
    path = _log(spark, records)
    cap_log(spark, path, 500)
    append_records(records.filter("at < 10").orderBy("at"), path)
    return read_records(spark, path).select("at", "route")


def runlog_read_back(spark, sf_dir):
    """The original turns that records of every third conversation refer to, two each."""
    conv = table(spark, sf_dir, "conversations")
    ref = F.struct(F.col("conv_id").cast("string").alias("sessionId"), F.array(F.lit(1).cast("long"), F.lit(0).cast("long")).alias("seqs"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("compactionId"))
    records = conv.filter("conv_id % 3 = 0").select("conv_id").distinct().select(ref.alias("ref"))
    return surface.read_back(records, conv.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("seq"), "text"))


def chunk_attribution(spark, sf_dir):
    made = chunks.digest_caps(_chunks(spark, sf_dir, WINDOWS), MERGE_USABLE).withColumn("preferred_key", F.concat(F.lit("route-"), F.col("route").cast("string")))
    served = made.filter((F.col("doc_id") + F.col("chunk")) % 4 > 0).select("doc_id", "chunk", F.when(F.col("chunk") % 2 == 0, "p1/m1").alias("model"), F.floor(F.col("tokens") / 4).alias("digest_tokens"))
    return pool.attribute(made, served).select("doc_id", "chunk", "model", "line_start", "line_end", "tokens", "core_tokens", "cap_tokens", "digest_tokens")


def _needles(spark, sf_dir):
    words = F.slice(F.split("text", " "), 2, NEEDLE_WORDS)
    return table(spark, sf_dir, "benchmark").select(F.array_join(words, " ").alias("needle")).distinct()


def grep_retrieval(spark, sf_dir):
    return grading.grep_counts(table(spark, sf_dir, "documents"), _needles(spark, sf_dir))


def retrieval_recall(spark, sf_dir):
    needles = _needles(spark, sf_dir)
    rows = _documents(spark, sf_dir).transform(stage0.dedup_lines)
    kept = stage0.head_middle_tail(rows, 2000, 900, 500).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    found = grading.retrieval(grading.grep_counts(table(spark, sf_dir, "documents"), needles), grading.grep_counts(kept, needles))
    return found.withColumn("recall", F.round("recall", 6))


def _grades(spark, sf_dir):
    """What of each conversation's third words survives in its turns without every fourth."""
    conv = table(spark, sf_dir, "conversations")
    need = conv.withColumn("w", F.lower(F.element_at(F.split("text", " "), 1))).groupBy("conv_id").agg(F.array_sort(F.collect_set("w")).alias("need"))
    probes = need.select("conv_id", (F.col("conv_id") % 4).alias("episode"), F.lit("p").alias("probe_id"), "need")
    answers = conv.filter(F.col("turn") % 4 != 3).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("answer"))
    grades = grading.grade_probes(probes, answers, ["conv_id"])
    return grades.withColumn("episode", F.col("conv_id") % 4)


def probe_recall(spark, sf_dir):
    return _grades(spark, sf_dir).select("conv_id", "matched", "required", F.round("recall", 6).alias("recall"), F.array_join("missing", ",").alias("missing"))


def faithfulness(spark, sf_dir):
    return grading.faithfulness(_grades(spark, sf_dir), ["episode"]).withColumn("faithfulness", F.round("faithfulness", 6))


def suite_means(spark, sf_dir):
    return grading.suite_means(_grades(spark, sf_dir), ["episode"])


def _branches(spark, sf_dir):
    """Each conversation's context twice: with all but its first and last two turns condensed to a checkpoint, and with these just forgotten."""
    nodes = _nodes(spark, sf_dir).withColumnRenamed("session_id", "conv_id")
    spans = surface.keep_right_range(nodes.withColumnRenamed("conv_id", "session_id"), 2).withColumnRenamed("session_id", "conv_id")
    placed = nodes.join(spans, "conv_id", "left").withColumn("inside", F.coalesce(F.col("pos").between(F.col("start_pos"), F.col("end_pos")), F.lit(False)))
    region = lines.region_lines(lines.as_blocks(placed.filter("inside").select("conv_id", F.col("pos").alias("turn"), "role", "text"))).withColumnRenamed("conv_id", "doc_id")
    digest = digests.persona_perfect(stage0.dedup_lines(region).select("doc_id", F.lit(0).alias("chunk"), "line_no", "line"))
    condensed = digest.select(F.col("doc_id").alias("conv_id"), F.lit(1).cast("long").alias("pos"), F.lit("user").alias("role"), digests.checkpoint(F.col("digest")).alias("text"))
    kept = placed.filter("not inside").select("conv_id", "pos", "role", "text")
    return [lines.surface_text(rows, turn="pos").withColumnRenamed("surface", "text") for rows in (kept.unionByName(condensed), kept)]


def suite_a(spark, sf_dir):
    """Recall, control, gain and hallucination by episode and persona, over the branches of every conversation; a probe asks for the first words of its turns."""
    conv = table(spark, sf_dir, "conversations")
    need = conv.withColumn("w", F.lower(F.element_at(F.split("text", " "), 1))).groupBy("conv_id").agg(F.array_sort(F.collect_set("w")).alias("need"))
    probes = need.select("conv_id", F.col("conv_id").alias("probe_id"), "need")

    def graded(branch):
        made = None
        for persona in ("perfect", "leak", "forgetful"):
            said = grading.answers(branch.withColumn("ask", F.lit("Which words open the turns?")), persona)
            g = grading.grade_probes(probes, said, ["conv_id"]).join(said, "conv_id", "left").select((F.col("conv_id") % 4).alias("episode"), F.lit(persona).alias("persona"), "probe_id", "recall", grading.hallucinated(F.col("answer"), F.lit("recall")).alias("hallucinated"))
            made = g if made is None else made.unionByName(g)
        return made

    target, control = _branches(spark, sf_dir)
    return grading.suite_a(graded(target), graded(control))


def suite_matrix(spark, sf_dir):
    """Two ways to clean a region before it is digested, as shipped and with head and tail alone, beside forgetting it: recall by episode and persona, and how much smaller the context is."""
    nodes = _nodes(spark, sf_dir)
    spans = surface.keep_right_range(nodes, 2)
    placed = materialise(nodes.join(spans, "session_id", "left").select(F.col("session_id").alias("conv_id"), "pos", "role", "text", F.coalesce(F.col("pos").between(F.col("start_pos"), F.col("end_pos")), F.lit(False)).alias("inside")))
    region = lines.region_lines(lines.as_blocks(placed.filter("inside").withColumnRenamed("pos", "turn"))).withColumnRenamed("conv_id", "doc_id")
    ways = {"default": [stage0.Dedup()], "legacy": [stage0.Dedup(), stage0.Ends(*TRIM[1:]), stage0.Trim(TRIM[0])]}
    cleaned = [stage0.run_steps(region, steps).select("doc_id", F.lit(k).alias("chunk"), "line_no", "line") for k, steps in enumerate(ways.values())]
    digest = digests.persona_perfect(cleaned[0].unionByName(cleaned[1]))
    condensed = digest.select(F.col("doc_id").alias("conv_id"), F.element_at(F.array(*map(F.lit, ways)), F.col("chunk") + 1).alias("variant"), F.lit(1).cast("long").alias("pos"), F.lit("user").alias("role"), digests.checkpoint(F.col("digest")).alias("text"))
    shown = F.when(F.col("inside"), F.array(F.lit("whole"))).otherwise(F.array(*map(F.lit, [*ways, "control", "whole"])))
    rows = placed.select("conv_id", F.explode(shown).alias("variant"), "pos", "role", "text").unionByName(condensed)
    contexts = lines.surface_text(rows.withColumn("key", F.struct("conv_id", "variant")), "key", "pos").select("key.conv_id", "key.variant", F.col("surface").alias("text"))
    first = F.lower(F.element_at(F.split("text", " "), 1))
    probes = placed.groupBy("conv_id").agg(F.array_sort(F.collect_set(first)).alias("need")).select("conv_id", (F.col("conv_id") % 4).alias("episode"), F.lit("Which words open the turns?").alias("ask"), "need")
    return grading.suite_matrix(contexts, probes, list(ways), "control", "whole")


def request_sizes(spark, sf_dir):
    """For every chunk of every document the tokens that its request and its answer may take, and whether both are within the window of its route; and how many chunks its document has."""
    window = F.element_at(F.array(*map(F.lit, WINDOWS)), F.col("route") + 1)
    asked = _chunks(spark, sf_dir, WINDOWS).withColumn("window", window.cast("long")).withColumns({"input_tokens": F.col("tokens") + budget.PROMPT_OVERHEAD, "output_tokens": budget.output_budget(F.col("window"))})
    n = _chunks(spark, sf_dir, WINDOWS).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    return asked.join(n, "doc_id").select("doc_id", "chunk", "window", "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens") <= F.col("window")).alias("within"), "chunks", (F.col("chunks") > 1).cast("int").alias("merge_calls"))


def suite_report(spark, sf_dir):
    """The suite's means as the lines of a table."""
    return grading.report(suite_means(spark, sf_dir), ["episode", "mean_recall"])


def suite_table(spark, sf_dir):
    """The suite's means as a table with header, its columns aligned."""
    means = suite_means(spark, sf_dir).withColumn("recall", F.format_string("%.3f", "mean_recall"))
    return grading.aligned_table(means, ["episode", "recall"], ["episode"])


def suite_json(spark, sf_dir):
    return grading.report_json(suite_means(spark, sf_dir), ["episode", "mean_recall"])


def hallucination(spark, sf_dir):
    m = F.col("conv_id") % 6
    said = F.when(m == 0, " We rejected it and also chose it.").when(m == 1, " OLDNAME is still valid.").when(m == 2, " It was rejected; we decided so.").when(m == 3, " OLDNAME is gone.").otherwise("")
    flag = grading.hallucinated(F.concat("text", said), F.when(F.col("turn") % 2 == 0, "decision").otherwise("fact"), F.array(F.lit("oldname")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", flag.alias("hallucinated"))


def snapshot_cap(spark, sf_dir):
    capped = text.cap_snapshot(F.col("text"), 200)
    return table(spark, sf_dir, "documents").select("doc_id", text.length16(capped).alias("chars"), F.sha2(capped, 256).alias("snapshot_sha256"))


def text_previews(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(t).alias("fingerprint"), text.preview(t).alias("preview"))


def anchor_block(spark, sf_dir):
    """An anchor for every conversation: hash of its surface, the tagged JSON, and the answer with how to recover it."""
    conv = lines.surface_text(table(spark, sf_dir, "conversations"))
    ident = F.concat(F.lit(ANCHOR), text.base36(text.fnv1a(F.col("surface"))))
    block = digests.anchor_block(F.struct(F.col("id"), F.col("conv_id").alias("sessionId")))
    answer = digests.with_recovery(F.lit("  a summary \n"), F.col("block"), RECOVERY)
    return conv.withColumn("id", ident).withColumn("block", block).select("conv_id", "id", "block", answer.alias("answer"))


def summary_decision(spark, sf_dir):
    """The own answer or the host's, where the own one is missing, blank or too long, for every document."""
    n = F.col("doc_id") % 5
    own = F.when(n == 0, F.lit(None)).when(n == 1, " \n ").when(n == 2, F.repeat(F.lit("long "), 400)).otherwise("short")
    return table(spark, sf_dir, "documents").select("doc_id", digests.decide(own, F.lit("host"), F.col("text")).alias("chosen"))


def framed_shrinks(spark, sf_dir):
    """Whether the perfect digest of each conversation, framed, is smaller than what it shadows."""
    nodes = _nodes(spark, sf_dir).groupBy("session_id").agg(F.sum("tokens").alias("shadowed"))
    rows = region_lines(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("chunk"), "line_no", "line")
    made = digests.persona_perfect(rows).select(F.col("doc_id").alias("session_id"), digests.nonempty(F.col("digest")).alias("digest"))
    return nodes.join(made, "session_id").select("session_id", digests.framed_shrinks(F.col("digest"), F.col("shadowed")).alias("shrinks"))


def call_outcomes(spark, sf_dir):
    """Status and error of a call for every event, by finish, text and image."""
    n = F.col("event_id")
    finish = F.element_at(F.array(*map(F.lit, ("stop", "error", "aborted", "max-tokens"))), (n % 4 + 1).cast("int"))
    found = digests.outcome(finish, F.when(n % 3 > 0, "text").otherwise(" "), n % 7 == 0)
    return table(spark, sf_dir, "events").select("event_id", found["status"].alias("status"), found["error"].alias("error"))


def instructions(spark, sf_dir):
    """The instruction of every chunk: prompt, cap and suffix; and how many messages a call has."""
    capped = digest_caps(spark, sf_dir)
    made = digests.chunk_messages(capped.withColumn("text", F.lit("excerpt")), digests.instruction("Condense the excerpt.", "Keep names.", F.when(F.col("chunk") > 0, F.col("cap_tokens"))))
    return made.select("doc_id", "chunk", F.size("messages").alias("messages"), F.col("messages")[0]["text"].alias("first"), F.col("messages")[1]["text"].alias("last"))


def synthetic_stream(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(digests.synthetic_stream(F.col("text"))).alias("at", "r"))
    return conv.select("conv_id", "turn", "at", "r.type", "r.text", "r.reason")


def duplicate_routes(spark, sf_dir):
    return pool.duplicate_keys(_attempts(spark, sf_dir).select(F.concat_ws("-", "job", "model").alias("key")))


QUERIES = {
    f.__name__: f
    for f in (
        region_lines, block_lines, replayed_region, replayed_blocks, message_prices, request_tokens, region_chars, history_text, purpose_requests, triggers, targets, replay_input, filler_lines,
        unknown_keys, output_tokens, retry_delays, dedup_lines, purge_noise, skip_blank_blocks, head_middle_tail, ast_skeleton, log_runs, log_condense_balanced, log_condense_head,
        log_condense_tail, stage0_full, exact_document_tokens, region_tokens, context_size, budget_table, chunk_slices, chunk_slices_pool, digest_caps, split_halves, persona_perfect, persona_leak,
        persona_forgetful, merge_material, compaction_graded, compression_ratio, framed_shrinks, summary_decision, call_outcomes, instructions, synthetic_stream, tool_balance, retention_range,
        pressure_decision, pressure_rounds, validate_region, surface_after_replace, surface_streamed, surface_nested, keep_right, control_branch, surface_stability, span_stability, committed, compacted_log, entry_state,
        derive_span, pool_validation, route_capacity, merge_holdable, merge_plan, route_pick, route_deal, chunk_routes, pool_reset, local_quarantine, cooldowns_cleared, earliest_expiry,
        attempts_summary, calls_by_route, collapse_error, combined_parts, recorded_once, cooldown_upsert, run_record, runlog_recent, runlog_capped, runlog_read_back, chunk_attribution,
        grep_retrieval, retrieval_recall, probe_recall, faithfulness, suite_means, suite_a, suite_matrix, request_sizes, suite_report, suite_table, suite_json, hallucination, snapshot_cap, text_previews, anchor_block, duplicate_routes,
    )
}
