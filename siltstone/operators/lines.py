"""Messages and documents as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import pieces
from siltstone.functions.text import TokenCost, chars4, length16, split_lines


def renumber(df: DataFrame, key: str, *order: str) -> DataFrame:
    """line_no from 0 in the given order; one exchange a document key, shared by all line operators."""
    return df.withColumn("line_no", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def document_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) of each document."""
    return docs.select(key, F.posexplode(split_lines(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def block_lines(block: Column) -> Column:
    """Lines of one content block: text, reasoning, tool-call, image, file, or its JSON."""
    kind, name = block["type"], block["attachment_name"]
    named = F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit(": "), name))
    return (
        F.when(kind.isin("text", "reasoning"), split_lines(block["text"]))
        .when(kind == "tool-call", F.concat(F.array(F.concat(F.lit("[tool-call "), F.coalesce(block["name"], F.lit("")), F.lit("]"))), split_lines(block["arguments"])))
        .when(kind == "image", F.array(F.concat(F.lit("[image"), named, F.when(block["offloaded"], F.lit(" (offloaded)")).otherwise(""), F.lit("]"))))
        .when(kind == "file", F.array(F.concat(F.lit("[file"), named, F.lit("]"))))
        .otherwise(F.concat(F.array(F.concat(F.lit("[block "), F.coalesce(kind, F.lit("")), F.lit("]"))), split_lines(block["raw_json"])))
    )


def region_lines(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """(key, line_no, line): each message's role header and the lines of its blocks, in turn order."""
    lines = F.concat(F.array(F.concat(F.lit("["), F.col(role), F.lit("]"))), F.flatten(F.transform(F.col(content), block_lines)))
    each = messages.select(key, F.col(turn).alias("_turn"), F.posexplode(lines).alias("_at", "line"))
    return renumber(each, key, "_turn", "_at").select(key, "line_no", "line")


def as_blocks(messages: DataFrame, text: str = "text") -> DataFrame:
    """A content column for plain-text messages: one text block a message."""
    null = F.lit(None).cast("string")
    block = F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), null.alias("name"), null.alias("arguments"), null.alias("attachment_name"), F.lit(None).cast("boolean").alias("offloaded"), null.alias("raw_json"))
    return messages.withColumn("content", F.array(block))


def replayed_text(content: Column) -> Column:
    """One replayed message's text: its blocks joined by newlines, a tool call as name and arguments on one line, any other block as its JSON."""
    block = lambda b: F.when(b["type"].isin("text", "reasoning"), F.coalesce(b["text"], F.lit(""))).when(b["type"] == "tool-call", F.concat(F.coalesce(b["name"], F.lit("")), F.lit(" "), F.coalesce(b["arguments"], F.lit("")))).otherwise(F.coalesce(b["raw_json"], F.lit("")))
    return F.array_join(F.transform(content, block), "\n")


def replayed_region(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, line_no, line) of a replayed request: one user message that holds all others as text, without a trailing condensing instruction.

    text: a string column, or an array of blocks, which replayed_text() flattens. A null role is ``message``.
    """
    if messages.schema[text].dataType.typeName() == "array":
        messages = messages.withColumn(text, replayed_text(F.col(text)))
    last = F.col(turn) == F.max(turn).over(Window.partitionBy(key))
    asks = F.col(text).rlike("(?i)compaction engine|condense the conversation|structured checkpoint")
    kept = messages.withColumn("_drop", last & (F.coalesce(role, F.lit("")) == "user") & F.coalesce(asks, F.lit(False))).filter("not _drop")
    lines = F.concat(F.array(F.concat(F.lit("["), F.coalesce(role, F.lit("message")), F.lit("]"))), split_lines(F.col(text)))
    each = kept.select(key, F.col(turn).alias("_turn"), F.posexplode(lines).alias("_at", "line"))
    # the first line of all is the header of the message that holds the others; a window tells which row brings it, so no second pass is needed
    first = F.row_number().over(Window.partitionBy(key).orderBy("_turn", "_at"))
    numbered = each.withColumn("_n", first)
    both = numbered.select(key, F.explode(F.when(F.col("_n") == 1, F.array(F.struct(F.lit(0).cast("long").alias("line_no"), F.lit("[user]").alias("line")), F.struct(F.lit(1).cast("long").alias("line_no"), F.col("line")))).otherwise(F.array(F.struct(F.col("_n").cast("long").alias("line_no"), F.col("line"))))).alias("l"))
    return both.select(key, "l.line_no", "l.line")


def surface_text(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, surface): the visible context as one text a conversation, which is a row and so must fit in one."""
    row = F.struct(F.col(turn).alias("t"), F.concat(F.lit("["), F.col(role), F.lit("] "), F.coalesce(text, F.lit(""))).alias("s"))
    return messages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["s"]), "\n").alias("surface"))


def message_tokens(content: Column, cost: TokenCost = chars4) -> Column:
    """A message's price: 4, and for each block 4 and its tokens (text; a call's name and arguments; other blocks a quarter of their JSON). Null content is 4.

    With a cost that is no plain expression, exact_message_tokens() prices exploded blocks instead: such functions cannot be called inside arrays.
    """
    block = lambda b: F.when(b["type"].isin("text", "reasoning", "tool-call"), cost(block_text(b))).otherwise(chars4(F.coalesce(b["raw_json"], F.lit(""))))
    return F.coalesce(F.aggregate(content, F.lit(4).cast("long"), lambda acc, b: acc + 4 + block(b)), F.lit(4))


def exact_message_tokens(messages: DataFrame, keys: list[str], content: str, vocabulary: bytes) -> DataFrame:
    """(keys, tokens): as message_tokens(), texts and calls at their exact price by a vocabulary (pieces.vocabulary()). Messages that share their keys are added up but for the first 4."""
    each = messages.select(*keys, F.explode_outer(content).alias("b"))
    spoken = F.col("b.type").isin("text", "reasoning", "tool-call")
    rows = each.select(*keys, F.when(spoken, block_text(F.col("b"))).alias("text"), F.when(F.col("b").isNull(), 0).when(spoken, 4).otherwise(chars4(F.coalesce("b.raw_json", F.lit(""))) + 4).alias("rest"))
    rest = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.sum("rest") + 4).alias("_rest"))
    found = pieces.exact_tokens(rows, keys, "text", vocabulary).join(rest, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return found.select(*keys, (F.col("tokens") + F.col("_rest")).cast("long").alias("tokens"))


def text_tokens(text: Column, cost: TokenCost = chars4) -> Column:
    """The price of a message whose content is one string: its tokens and 4."""
    return F.when(text.isNull(), F.lit(4)).otherwise(cost(text) + 4).cast("long")


def block_text(block: Column) -> Column:
    """What of a block is priced: its text, or a call's name and arguments."""
    return F.when(block["type"] == "tool-call", F.concat(F.coalesce(block["name"], F.lit("")), F.coalesce(block["arguments"], F.lit("")))).otherwise(F.coalesce(block["text"], F.lit("")))


def blocks_to_text(content: Column) -> Column:
    """A summary's text: each text block, and nothing for any other, joined by newlines."""
    return F.array_join(F.transform(content, lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).otherwise(F.lit(""))), "\n")


def request_tokens(messages: DataFrame, key: str = "conv_id", content: str = "content", cost: TokenCost = chars4) -> DataFrame:
    """(key, tokens): all blocks' texts and 4 for the request."""
    each = messages.select(key, F.explode_outer(content).alias("b")).select(key, F.when(F.col("b.text").isNull(), F.lit(0)).otherwise(cost(F.col("b.text"))).alias("t"))
    return each.groupBy(key).agg((F.sum("t") + 4).cast("long").alias("tokens"))


def region_chars(messages: DataFrame, key: str = "conv_id", content: str = "content") -> DataFrame:
    """(key, chars): length of all contents as JSON, in UTF-16 code units."""
    return messages.groupBy(key).agg(F.sum(length16(F.to_json(content))).alias("chars"))


def history_text(events: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """(key, history): every event with a text as a line ``type: text``, in order; one row a session, which must fit in it."""
    row = F.struct(F.col(order).alias("o"), F.concat("type", F.lit(": "), "text").alias("s"))
    return events.filter("text is not null").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["s"]), "\n").alias("history"))


def purpose(requests: DataFrame, wanted: str = "compaction") -> DataFrame:
    """Requests made for a purpose."""
    return requests.filter(F.col("purpose") == wanted)


def replay_input(heads: DataFrame, messages: DataFrame, regions: DataFrame) -> DataFrame:
    """(session_id, at, role, text[, tools]): each session's system head (at 0) and the messages of its region. regions: session_id, seq. A head may bring ``tools``, which stay on its row."""
    inside = messages.join(regions, ["session_id", "seq"], "left_semi")
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("seq")).cast("long")
    tools = ["tools"] if "tools" in heads.columns else []
    head = heads.select("session_id", F.lit(0).cast("long").alias("at"), F.lit("system").alias("role"), "text", *tools)
    rest = [F.lit(None).cast(heads.schema["tools"].dataType).alias("tools")] if tools else []
    return head.unionByName(inside.select("session_id", at.alias("at"), "role", "text", *rest))


def trigger(label: Column) -> Column:
    """What set a compaction off: manual, pressure or context-overflow; auto where nothing says."""
    return F.when(label.isin("manual", "pressure", "context-overflow"), label).otherwise(F.lit("auto"))


def target(header: Column, options: Column) -> Column:
    """(provider, model) of the request header, else of the agent's options; null unless both parts are there and not empty."""
    sound = lambda c: (F.coalesce(c["provider"], F.lit("")) != "") & (F.coalesce(c["model"], F.lit("")) != "")
    part = lambda c: F.struct(c["provider"].alias("provider"), c["model"].alias("model"))
    return F.when(sound(header), part(header)).when(sound(options), part(options))


def filler(spark, count: int, topic: str) -> DataFrame:
    """(line_no, line): numbered filler lines."""
    return spark.range(count).select(F.col("id").alias("line_no"), F.format_string(f"[filler %d] {topic}: routine output line %d", F.col("id") + 1, F.col("id") + 1).alias("line"))
