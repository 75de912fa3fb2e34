"""Sessions: the visible surface, retention, tool pairing, locks and pressure. All per session, in event order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialise

MOST_JUMPS = 62
THRESHOLD_RATIO = 0.8
RETAIN_RATIO = 0.16
HEADROOM = 65_536
#: Nodes of a session that are sorted together.
BLOCK_NODES = 8192


def _w(order: str = "pos"):
    return Window.partitionBy("session_id").orderBy(order)


def surface_fold(events: DataFrame) -> DataFrame:
    """(session_id, pos, seq): visible nodes in order.

    events: session_id, seq, op (append, replace or null), covers (array of seqs that a replace shadows). A node goes with the first later replacement that covers it; a
    replacement takes the place of the first node that it covers, and may be covered itself. So nodes form trees, whose roots are visible, and a root's place is the least seq of
    its tree. Roots are found by pointer jumping: rounds of a join by (session, seq), as many as the logarithm of the deepest nesting. Null covers cover nothing.
    """
    nodes = materialise(events.filter("op is not null").select("session_id", "seq", "covers"))
    covered = nodes.select("session_id", F.col("seq").alias("by"), F.explode("covers").alias("seq")).filter("seq < by").groupBy("session_id", "seq").agg(F.min("by").alias("up"))
    links = nodes.select("session_id", "seq").join(covered, ["session_id", "seq"], "left").select("session_id", "seq", F.coalesce("up", "seq").alias("up"))
    for _ in range(MOST_JUMPS):
        links = materialise(links)
        above = links.select("session_id", F.col("seq").alias("up"), F.col("up").alias("_next"))
        jumped = links.filter("up <> seq").join(above, ["session_id", "up"]).filter("_next <> up")
        if jumped.isEmpty():
            break
        links = links.join(above, ["session_id", "up"]).select("session_id", "seq", F.col("_next").alias("up"))
    else:
        raise RuntimeError(f"replacements are nested more than 2**{MOST_JUMPS} deep")
    places = links.groupBy("session_id", F.col("up").alias("seq")).agg(F.min("seq").alias("place"))
    return places.select("session_id", (F.row_number().over(_w("place")) - 1).cast("long").alias("pos"), "seq")


def running(nodes: DataFrame, sums: dict[str, tuple[Column, str]], *, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """nodes (session_id, pos, ...) with sums over each session, by name: of a value and a reach, ``before`` a node, ``from`` it on, or ``whole``.

    A session is cut into blocks of positions. Blocks' totals are added up over the session, a row a block, and joined to their nodes; inside a block a window does the rest. So no task
    sorts or holds a whole session, and the nodes are exchanged once. Null values count as nothing, null ids are one session.
    """
    block = F.floor(F.col("pos") / block_nodes).cast("long")
    rows = nodes.withColumns({"_block": block, **{f"_v_{k}": v for k, (v, _) in sums.items()}})
    totals = rows.groupBy(F.col("session_id").alias("_session"), F.col("_block").alias("_at")).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    order = Window.partitionBy("_session").orderBy("_at")
    reach = {"before": order.rowsBetween(Window.unboundedPreceding, -1), "from": order.rowsBetween(1, Window.unboundedFollowing), "whole": Window.partitionBy("_session")}
    entering = totals.select("_session", "_at", *[F.coalesce(F.sum(f"_t_{k}").over(reach[r]), F.lit(0)).alias(f"_e_{k}") for k, (_, r) in sums.items()])
    joined = rows.join(entering.hint("shuffle_hash"), F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("_block") == F.col("_at")))
    inside = Window.partitionBy("session_id", "_block").orderBy("pos")
    near = {"before": inside.rowsBetween(Window.unboundedPreceding, -1), "from": inside.rowsBetween(0, Window.unboundedFollowing)}
    local = {k: F.col(f"_e_{k}") + (F.coalesce(F.sum(f"_v_{k}").over(near[r]), F.lit(0)) if r in near else F.lit(0)) for k, (_, r) in sums.items()}
    return joined.select(*nodes.columns, *[v.alias(k) for k, v in local.items()])


def tool_balance(nodes: DataFrame, *, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """nodes (session_id, pos, delta) with balanced_before and balanced_after: every call has its result at that border."""
    open_calls = running(nodes, {"_open": (F.col("delta"), "before")}, block_nodes=block_nodes)
    return open_calls.withColumns({"balanced_before": F.col("_open") == 0, "balanced_after": F.col("_open") + F.col("delta") == 0}).drop("_open")


def retention_range(nodes: DataFrame, retain: int, *, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(session_id, start_pos, end_pos): what may be compacted so that the last nodes with ``retain`` tokens stay; sessions without a range are left out.

    nodes: session_id, pos from 0, tokens (not negative), delta, is_system. The cut moves left to a border where tool calls are paired: it is the last such border from which on there are
    enough tokens, so each task looks for its own last one, and a session's is the largest of those.
    """
    marked = running(nodes, {"_open": (F.col("delta"), "before"), "_suffix": (F.col("tokens"), "from")}, block_nodes=block_nodes)
    border = (F.col("_open") == 0) & (F.col("_suffix") >= retain) & (F.col("pos") > 0)
    start = F.max(F.when((F.col("pos") == 0) & F.col("is_system"), 1).otherwise(0)).cast("long")
    found = marked.groupBy("session_id").agg(start.alias("start_pos"), F.max(F.when(border, F.col("pos"))).alias("_to"))
    return found.filter("_to > start_pos").select("session_id", "start_pos", (F.col("_to") - 1).alias("end_pos"))


def validate_region(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(session_id, start_seq, end_seq, error): the first thing wrong with each span, null if nothing is. nodes: session_id, pos, seq, delta."""
    sides = tool_balance(nodes).select("session_id", "pos", "seq", "balanced_before", "balanced_after")
    a = sides.select("session_id", F.col("seq").alias("start_seq"), F.col("pos").alias("_a"), F.col("balanced_before").alias("_before"))
    b = sides.select("session_id", F.col("seq").alias("end_seq"), F.col("pos").alias("_b"), F.col("balanced_after").alias("_after"))
    found = spans.join(a, ["session_id", "start_seq"], "left").join(b, ["session_id", "end_seq"], "left")
    error = F.when(F.col("_a").isNull(), "start not on surface").when(F.col("_b").isNull(), "end not on surface").when(F.col("_a") > F.col("_b"), "start after end")
    error = error.when(~F.col("_before"), "start not balanced").when(~F.col("_after"), "end not balanced")
    return found.select("session_id", "start_seq", "end_seq", error.alias("error"))


def pressure_decision(nodes: DataFrame, window: int, reserved: int = 0, *, threshold: float = THRESHOLD_RATIO, retain: float = RETAIN_RATIO, headroom: int = HEADROOM) -> DataFrame:
    """(session_id, total_tokens, threshold_tokens, retain_tokens, compact): one round of the pressure policy."""
    messages = window - reserved
    limit = int(min(window * threshold, messages - headroom))
    possible = messages > 0 and messages - headroom > 0
    totals = nodes.groupBy("session_id").agg(F.sum("tokens").alias("total_tokens"))
    return totals.withColumns({"threshold_tokens": F.lit(limit).cast("long"), "retain_tokens": F.lit(int(messages * retain)).cast("long"), "compact": (F.col("total_tokens") >= limit) & F.lit(possible)})


def replace_span(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """nodes (session_id, pos, seq, tokens, delta, is_system) with each session's span as one node. spans: session_id, start_pos, end_pos, and the new node's seq and tokens."""
    s = spans.select("session_id", "start_pos", "end_pos", F.col("seq").alias("_seq"), F.col("tokens").alias("_tokens"))
    joined = nodes.join(s, "session_id", "left")
    inside = F.coalesce((F.col("pos") >= F.col("start_pos")) & (F.col("pos") <= F.col("end_pos")), F.lit(False))
    first = inside & (F.col("pos") == F.col("start_pos"))
    made = {"seq": F.when(first, F.col("_seq")).otherwise(F.col("seq")), "tokens": F.when(first, F.col("_tokens")).otherwise(F.col("tokens")), "delta": F.when(first, F.lit(0)).otherwise(F.col("delta")), "is_system": F.col("is_system") & ~first}
    kept = joined.filter(~inside | first).withColumns(made)
    return kept.withColumn("pos", (F.row_number().over(_w()) - 1).cast("long")).select("session_id", "pos", "seq", "tokens", "delta", "is_system")


def pressure_rounds(nodes: DataFrame, compact: Callable[[DataFrame, DataFrame], DataFrame], window: int, reserved: int = 0, *, retries: int = 1, overflow: bool = False, **policy) -> DataFrame:
    """(session_id, rounds, total_tokens, status): at most retries + 1 rounds of the policy for every session at once.

    A session at or over the threshold whose retention leaves a range has it compacted: ``compact(nodes, ranges)`` gives the nodes after it. status: below (nothing to do), done, above
    (still over the threshold when the rounds ran out: an error), stuck (over it, but no range is left: nothing more can be done). overflow: one round for all, nothing retained.
    """
    retain = 0 if overflow else int((window - reserved) * policy.get("retain", RETAIN_RATIO))
    state = materialise(nodes)
    tally = materialise(state.select("session_id").distinct().select("session_id", F.lit(0).alias("rounds"), F.lit(False).alias("stuck")))
    for _ in range(1 if overflow else retries + 1):
        now = pressure_decision(state, window, reserved, **policy).filter(F.lit(True) if overflow else F.col("compact")).select("session_id")
        ranges = materialise(retention_range(state.join(now, "session_id", "left_semi"), retain))
        stuck = now.join(ranges, "session_id", "left_anti").withColumn("_stuck", F.lit(True))
        tally = materialise(tally.join(ranges.select("session_id", F.lit(1).alias("_one")), "session_id", "left").join(stuck, "session_id", "left").select("session_id", (F.col("rounds") + F.coalesce("_one", F.lit(0))).alias("rounds"), (F.col("stuck") | F.coalesce("_stuck", F.lit(False))).alias("stuck")))
        if ranges.isEmpty():
            break
        state = materialise(compact(state, ranges))
    last = pressure_decision(state, window, reserved, **policy).select("session_id", "total_tokens", "compact")
    status = F.when(F.col("rounds") == 0, F.when(F.col("stuck"), "stuck").otherwise("below")).when(~F.col("compact") | F.lit(overflow), "done").when(F.col("stuck"), "stuck").otherwise("above")
    return tally.join(last, "session_id").select("session_id", "rounds", "total_tokens", status.alias("status"))


def entry_state(events: DataFrame) -> DataFrame:
    """(session_id, open_turn, open_start, last_seed, busy): the open turn, the unmatched compaction start and whether it still holds the lock."""
    kind = F.col("type")
    latest = lambda *kinds: F.max_by(F.struct("type", "seq", "turn"), F.when(kind.isin(*kinds), F.col("seq")))
    state = events.groupBy("session_id").agg(latest("turn/start", "turn/end").alias("t"), latest("compaction/start", "compaction/end").alias("c"), F.max(F.when(kind == "session/end-seed", F.col("seq"))).alias("last_seed"))
    start = F.when(F.col("c.type") == "compaction/start", F.col("c.seq"))
    busy = start.isNotNull() & ~F.coalesce(F.col("last_seed") > start, F.lit(False))
    return state.select("session_id", F.when(F.col("t.type") == "turn/start", F.col("t.turn")).alias("open_turn"), start.alias("open_start"), "last_seed", busy.alias("busy"))


def derive_span(surface: DataFrame, replay: DataFrame) -> DataFrame:
    """(session_id, start_seq, end_seq) of the surface span whose fingerprints equal the replayed ones, from position 0 or 1 on.

    surface: session_id, pos, seq, print; replay: session_id, pos from 0, print. The smaller offset that matches wins; the matched nodes' own seqs are returned.
    """
    sizes = replay.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    tries = replay.select("session_id", F.col("print").alias("_print"), F.col("pos").alias("_at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("offset"))
    tries = tries.withColumn("pos", F.col("_at") + F.col("offset")).join(surface, ["session_id", "pos"]).filter("_print = print")
    full = tries.groupBy("session_id", "offset").agg(F.count(F.lit(1)).alias("hits"), F.min_by("seq", "pos").alias("start_seq"), F.max_by("seq", "pos").alias("end_seq"))
    best = full.join(sizes, "session_id").filter("hits = n").groupBy("session_id").agg(F.min_by(F.struct("start_seq", "end_seq"), "offset").alias("s"))
    return best.select("session_id", "s.start_seq", "s.end_seq")


def commit(events: DataFrame, regions: DataFrame) -> DataFrame:
    """The events that land each region's checkpoint, after the session's last: a start, the summary, the replacing user message, an end.

    events: session_id, seq; regions: session_id, covers (array of shadowed seqs, in order), summary, error. A region with an error lands only its start and an
    end that carries the error. The message names the start, the summary and what it shadows as its sources.
    """
    last = events.groupBy("session_id").agg(F.max("seq").alias("_last"))
    r = regions.join(last, "session_id")
    null, none = F.lit(None).cast("string"), F.lit(None).cast("array<bigint>")
    at = lambda k: F.col("_last") + k
    row = lambda k, kind, op, covers, sources, text: F.struct(at(k).alias("seq"), F.lit(kind).alias("type"), op.alias("op"), covers.alias("covers"), sources.alias("source_seqs"), text.alias("text"))
    sources = F.concat(F.array(at(1), at(2)), F.col("covers"))
    good = F.array(row(1, "compaction/start", null, none, none, null), row(2, "compaction/summary", null, none, F.col("covers"), F.col("summary")), row(3, "user/message", F.lit("replace"), F.col("covers"), sources, F.col("summary")), row(4, "compaction/end", null, none, none, null))
    bad = F.array(row(1, "compaction/start", null, none, none, null), row(2, "compaction/end", null, none, none, F.col("error")))
    return r.select("session_id", F.explode(F.when(F.col("error").isNull(), good).otherwise(bad)).alias("e")).select("session_id", "e.*")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """(session_id, stable): whether a session's nodes have the same seqs and prices in the same order. Both: session_id, pos, seq, tokens. Nodes are compared one by one, by a join on the position."""
    both = before.select("session_id", "pos", F.struct("seq", "tokens").alias("b")).join(after.select("session_id", "pos", F.struct("seq", "tokens").alias("a")), ["session_id", "pos"], "full")
    return both.groupBy("session_id").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("stable"))


def span_stable(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, start_seq, end_seq, error): whether a span is still the target that it was, else what changed.

    spans: session_id, start_seq, end_seq, seqs (what it shadowed, in order), tokens (their price). nodes: session_id, pos, seq, tokens, delta as they are now.
    """
    sound = validate_region(nodes, spans.select("session_id", "start_seq", "end_seq"))
    ends = nodes.select("session_id", F.col("seq").alias("start_seq"), F.col("pos").alias("_a"))
    stops = nodes.select("session_id", F.col("seq").alias("end_seq"), F.col("pos").alias("_b"))
    placed = spans.join(ends, ["session_id", "start_seq"], "left").join(stops, ["session_id", "end_seq"], "left")
    keys = ["session_id", "start_seq", "end_seq"]
    wanted = spans.select(*keys, F.posexplode("seqs").alias("at", "seq"))
    there = placed.select(*keys, "_a", "_b").join(nodes.select("session_id", "pos", "seq", "tokens"), "session_id").filter("pos between _a and _b").select(*keys, (F.col("pos") - F.col("_a")).cast("int").alias("at"), F.col("seq").alias("now"), "tokens")
    same = wanted.join(there, [*keys, "at"], "full").groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("seq") == F.col("now"), F.lit(False))).alias("same"), F.sum("tokens").alias("price"))
    joined = spans.select(*keys, "tokens").join(sound, keys).join(same, keys, "left")
    error = F.when(F.col("error").isNotNull(), "no longer a valid target").when(~F.coalesce("same", F.lit(False)), "changed").when(F.col("price") != F.col("tokens"), "rewritten")
    return joined.select(*keys, error.alias("error"))


def read_back(records: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, compaction_id, at, seq, text): the original events that run records refer to, in order. records: ref (sessionId, seqs, compactionId); events: session_id, seq, text."""
    wanted = records.select(F.col("ref.sessionId").alias("session_id"), F.col("ref.compactionId").alias("compaction_id"), F.posexplode("ref.seqs").alias("at", "seq"))
    typed = wanted.withColumn("session_id", F.col("session_id").cast(events.schema["session_id"].dataType))
    return typed.join(events.select("session_id", "seq", "text"), ["session_id", "seq"]).select("session_id", "compaction_id", "at", "seq", "text")


def keep_right_range(nodes: DataFrame, keep: int) -> DataFrame:
    """(session_id, start_pos, end_pos): all but the first node and the last ``keep``, the cut moved left to a border where calls are paired."""
    sides = running(nodes, {"_open": (F.col("delta"), "before"), "_n": (F.lit(1), "whole")})
    cut = F.greatest(F.lit(1), F.least(F.col("_n") - keep, F.col("_n") - 1))
    best = sides.filter((F.col("pos") <= cut) & (F.col("pos") > 1) & (F.col("_open") == 0)).groupBy("session_id").agg(F.max("pos").alias("_to"))
    return best.select("session_id", F.lit(1).cast("long").alias("start_pos"), (F.col("_to") - 1).alias("end_pos"))


def delete_range(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """The control branch: nodes without those of their session's span."""
    joined = nodes.join(spans, "session_id", "left")
    gone = F.coalesce((F.col("pos") >= F.col("start_pos")) & (F.col("pos") <= F.col("end_pos")), F.lit(False))
    return joined.filter(~gone).drop("start_pos", "end_pos")
