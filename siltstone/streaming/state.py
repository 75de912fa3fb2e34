"""Stateful behaviour on Structured Streaming: cooldowns, pressure, surface and overflow retries per key, by event time that the rows bring.

State is kept by processors with value and map state and timers, in RocksDB, which these functions choose for the session if it has another store; queries that run or restart keep
the store that their checkpoint names. Sessions end: where a time column is named, a session's state goes once the watermark has passed its last row by ``idle``. A row that
comes later still begins it anew. No row is dropped for being late. Without a time column nothing tells that a session has ended, and state stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from siltstone.session import ship

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long a session may be silent, and how late rows may come before that is judged.
IDLE, DELAY = 3_600_000, "10 minutes"
_AT = "_at"


#: Rows of a stream that a partition of its state should get at least.
PARTITION_ROWS = 50_000


@contextmanager
def partitioned(spark: SparkSession, rows: int) -> Iterator[int]:
    """Streams that start in this block deal their state over as many partitions as ``rows`` fill, at least one for each core and at most the session's number. A partition of state costs a second
    or so in each micro-batch, however few rows it gets, and a stream keeps the number with which it started."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    count = min(int(before), max(spark.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS)))
    spark.conf.set(name, str(count))
    try:
        yield count
    finally:
        spark.conf.set(name, before)


def _like(rows: DataFrame, column: str) -> str:
    """A column of rows as DDL: ids are of whatever type they come in."""
    return f"{column} {rows.schema[column].dataType.simpleString()}"


def _timed(rows: DataFrame, columns: list[str], time: str | None, delay: str) -> DataFrame:
    """The columns, and the time in milliseconds, without rows whose seq is null. The watermark is drawn from the time, which then goes: what is left carries no watermark, so late rows stay."""
    at = F.unix_millis(time) if time else F.lit(None).cast("long")
    timed = (rows.withWatermark(time, delay) if time else rows).select(*columns, at.alias(_AT))
    return timed.filter("seq is not null") if "seq" in columns else timed


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, out: str, timed: bool, initial: DataFrame | None = None) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    if "RocksDB" not in spark.conf.get(STORE):
        spark.conf.set(STORE, ROCKS)
    start = None if initial is None else initial.groupBy(key)
    return rows.groupBy(key).transformWithState(processor, f"{_like(rows, key)}, {out}", "Update", "EventTime" if timed else "None", start)


class _Cooldowns(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until long")

    def _move(self, until: int, now: int) -> bool:
        before = self.until.get()
        if until <= max(now, before[0] if before else 0):
            return False
        if before:
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(until)
        self.until.update((until,))
        return True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until = max((int(r["at_ms"] + r["hours"] * 3_600_000) for r in rows), default=0)
        if self._move(until, timerValues.getCurrentWatermarkInMs()):
            yield Row(key=key[0], cooldown_until=until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = self.until.get()
        if until and until[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
            yield Row(key=key[0], cooldown_until=None)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._move(int(initialState["cooldown_until"]), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def cooldown_stream(failures: DataFrame, initial: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """(key, cooldown_until) whenever a failure moves a route's cooldown, and with null once it is over. failures: key, at_ms long, hours double.

    The clock is the rows' own: a cooldown is over when the latest row, less the delay, has passed it, whatever the wall clock says; then its state goes. A late failure counts while its
    cooldown lasts. A failure without time or hours cools nothing. initial: a table of cooldowns (key, cooldown_until) to
    begin with, the longest of each key counting; nulls are none.
    """
    rows = failures.withColumn(_AT, F.timestamp_millis("at_ms")).withWatermark(_AT, delay).select("key", "at_ms", "hours").filter("at_ms is not null and hours is not null")
    if initial is not None:
        initial = initial.filter("cooldown_until is not null").groupBy("key").agg(F.max("cooldown_until").alias("cooldown_until"))
    return _run(rows, "key", _Cooldowns(), "cooldown_until long", True, initial)


class _Session(StatefulProcessor):
    """What sessions have in common: they end ``idle`` milliseconds after their last row, where rows have a time."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle, self.end = handle, handle.getValueState("end", "at long")
        self.states = [self.end, *self.declare(handle)]

    def _stays(self, times: list[int | None]) -> None:
        latest = max((t for t in times if t is not None), default=None)
        if latest is None:
            return
        before = self.end.get()
        if before and latest + self.idle <= before[0]:
            return
        if before:
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(latest + self.idle)
        self.end.update((latest + self.idle,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        self._stays([r[_AT] for r in rows])
        yield from self.step(key[0], rows)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = self.end.get()
        if end and end[0] <= expiredTimerInfo.getExpiryTimeInMs():
            for s in self.states:
                s.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Pressure(_Session):
    def __init__(self, idle: int, threshold: int, retained: int):
        super().__init__(idle)
        self.threshold, self.retained = threshold, retained

    def declare(self, handle) -> list:
        self.total = handle.getValueState("total", "total long")
        return [self.total]

    def step(self, session, rows: list[Row]) -> Iterator[Row]:
        before = self.total.get()
        total = (before[0] if before else 0) + sum(r["tokens"] or 0 for r in rows)
        full = total >= self.threshold
        self.total.update((min(total, self.retained) if full else total,))
        if full:
            yield Row(session_id=session, total_tokens=total)


def pressure_stream(nodes: DataFrame, threshold: int, retained: int = 0, *, time: str | None = None, idle: int = IDLE, delay: str = DELAY) -> DataFrame:
    """(session_id, total_tokens) whenever a session's running total reaches the threshold; the total goes on from what a compaction retains. nodes: session_id, tokens (null: none)."""
    rows = _timed(nodes, ["session_id", "tokens"], time, delay)
    return _run(rows, "session_id", _Pressure(idle, threshold, retained), "total_tokens long", time is not None)


#: Seqs whose nodes lie in one entry of a session's state.
BLOCK = 32


class _Nodes:
    """A session's nodes as one call sees them: each block of BLOCK seqs is read at most once, and written at the end if it changed. A node: tokens, place (null: not seen yet), and the replacement
    that it went with (null: none), which may be known before the node itself. fresh: the session has no state, so nothing is read."""

    def __init__(self, blocks, covers, fresh: bool):
        self.blocks, self.covers, self.fresh = blocks, covers, fresh
        self.seen, self.changed, self.covered = {}, set(), {}

    def _block(self, seq: int) -> dict[int, tuple]:
        number = seq // BLOCK
        if number not in self.seen:
            found = None if self.fresh else self.blocks.getValue((number,))
            self.seen[number] = {n[0]: tuple(n[1:]) for n in found[0]} if found else {}
        return self.seen[number]

    def _get(self, seq: int) -> tuple:
        return self._block(seq).get(seq, (None, None, None))

    def _put(self, seq: int, value: tuple) -> None:
        self._block(seq)[seq] = value
        self.changed.add(seq // BLOCK)

    def node(self, seq: int) -> tuple[int, int] | None:
        """(tokens, place), if the node has come."""
        tokens, place, _ = self._get(seq)
        return None if place is None else (tokens, place)

    def up(self, seq: int) -> int | None:
        return self._get(seq)[2]

    def place(self, seq: int) -> int | None:
        """Where the node is seen; none if it is not there or covered."""
        _, place, up = self._get(seq)
        return place if up is None else None

    def put(self, seq: int, tokens: int, place: int) -> None:
        self._put(seq, (tokens, place, self.up(seq)))

    def cover(self, seq: int, up: int) -> None:
        tokens, place, _ = self._get(seq)
        self._put(seq, (tokens, place, up))

    def covers_of(self, seq: int) -> list[int]:
        if seq not in self.covered:
            found = None if self.fresh else self.covers.getValue((seq,))
            self.covered[seq] = list(found[0]) if found else []
        return self.covered[seq]

    def set_covers(self, seq: int, covers: list[int]) -> None:
        self.covered[seq] = covers
        if covers:
            self.covers.updateValue((seq,), (covers,))

    def flush(self) -> None:
        for number in sorted(self.changed):
            self.blocks.updateValue((number,), ([(seq, *value) for seq, value in sorted(self.seen[number].items())],))


class _Surface(_Session):
    """Nodes by blocks of seqs, and apart from them what each replacement covers, which may be long and is read only where places change."""

    def __init__(self, idle: int, whole: bool):
        super().__init__(idle)
        self.whole = whole

    def declare(self, handle) -> list:
        self.blocks = handle.getMapState("blocks", "block long", "nodes array<struct<seq: long, tokens: long, place: long, up: long>>")
        self.covers = handle.getMapState("covers", "seq long", "covers array<long>")
        self.total = handle.getValueState("total", "total long")
        return [self.blocks, self.covers, self.total]

    def step(self, session, rows: list[Row]) -> Iterator[Row]:
        before = self.total.get()
        nodes, touched = _Nodes(self.blocks, self.covers, before is None), {}
        total = before[0] if before else 0

        def touch(seq: int) -> None:
            if seq not in touched:
                touched[seq] = nodes.place(seq)

        def place(seq: int, covers: list[int]) -> int:
            found = (nodes.node(c) for c in covers if nodes.up(c) == seq)
            return min((n[1] for n in found if n), default=seq)

        def refresh(seq: int) -> None:
            """Places from a replacement upward, as far as they change."""
            while True:
                tokens, old = nodes.node(seq)
                new = min(seq, place(seq, nodes.covers_of(seq)))
                if new == old:
                    return
                touch(seq)
                nodes.put(seq, tokens, new)
                seq = nodes.up(seq)
                if seq is None:
                    return

        for r in sorted(rows, key=lambda r: r["seq"]):
            seq = int(r["seq"])
            if r["op"] is None or nodes.node(seq):
                continue
            touch(seq)
            covers = sorted({int(c) for c in r["covers"] or [] if c is not None and c < seq}) if r["op"] == "replace" else []
            robbed = set()
            for c in covers:
                up = nodes.up(c)
                if up is not None and up <= seq:
                    continue
                touch(c)
                if up is not None:
                    robbed.add(up)
                elif nodes.node(c):
                    total -= nodes.node(c)[0]
                nodes.cover(c, seq)
            nodes.set_covers(seq, covers)
            nodes.put(seq, int(r["tokens"] or 0), min(seq, place(seq, covers)))
            up = nodes.up(seq)
            if up is None:
                total += nodes.node(seq)[0]
            else:
                robbed.add(up)
            for up in sorted(robbed):
                refresh(up)
        nodes.flush()
        if before is None or total != before[0]:
            self.total.update((total,))
        if self.whole:
            shown = sorted((n[2], n[0]) for _, v in self.blocks.iterator() for n in v[0] if n[2] is not None and n[3] is None)
            yield Row(session_id=session, nodes=[s for _, s in shown], total_tokens=total)
            return
        for seq, old in sorted(touched.items()):
            now = nodes.place(seq)
            if now != old:
                yield Row(session_id=session, seq=seq, visible=now is not None, place=now, tokens=nodes.node(seq)[0], total_tokens=total)


def surface_changes(events: DataFrame, *, time: str | None = None, idle: int = IDLE, delay: str = DELAY) -> DataFrame:
    """(session_id, seq, visible, place, tokens, total_tokens): the nodes that came to a session's surface, left it (place null) or changed their place in a micro-batch; visible nodes in
    order of place are the surface, total_tokens its tokens after the micro-batch.

    events: session_id, seq, op (append, replace or null), covers (array), tokens (null: none). The result is `operators.surface.surface_fold`'s at any split of the events and in any order of
    their coming: a node goes with the first replacement (by seq) that covers it, even where another that came earlier had taken it. An event reads and writes the blocks (of 32 seqs) that hold
    what it covers, and one that comes late also those of the replacements above it. An event whose seq was seen is a repetition and is dropped. State holds covered nodes too, until the session ends.
    """
    rows = _timed(events, ["session_id", "seq", "op", "covers", "tokens"], time, delay)
    return _run(rows, "session_id", _Surface(idle, False), "seq long, visible boolean, place long, tokens long, total_tokens long", time is not None)


def surface_stream(events: DataFrame, *, time: str | None = None, idle: int = IDLE, delay: str = DELAY) -> DataFrame:
    """(session_id, nodes, total_tokens): a session's whole visible surface after each micro-batch that brings events of it, which it must read as a whole; `surface_changes` need not.

    Events and what becomes of late and repeated ones are as there.
    """
    rows = _timed(events, ["session_id", "seq", "op", "covers", "tokens"], time, delay)
    return _run(rows, "session_id", _Surface(idle, True), "nodes array<long>, total_tokens long", time is not None)


class _Overflows(_Session):
    def __init__(self, idle: int, most: int):
        super().__init__(idle)
        self.most = most

    def declare(self, handle) -> list:
        self.count = handle.getValueState("count", "retries int")
        return [self.count]

    def step(self, session, rows: list[Row]) -> Iterator[Row]:
        before = self.count.get()
        count = before[0] if before else 0
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["type"] in ("idle", "assistant/message"):
                count = 0
            elif r["type"] == "overflow":
                yield Row(session_id=session, seq=int(r["seq"]), retry=count < self.most)
                count += int(count < self.most)
        self.count.update((count,))


def overflow_stream(events: DataFrame, most: int = 1, *, time: str | None = None, idle: int = IDLE, delay: str = DELAY) -> DataFrame:
    """(session_id, seq, retry): for every overflow of a session's context whether it is compacted and tried again: ``most`` times, counted anew after the agent was idle or an
    assistant's message came. events: session_id, seq, type (overflow, idle, assistant/message or any other)."""
    rows = _timed(events, ["session_id", "seq", "type"], time, delay)
    return _run(rows, "session_id", _Overflows(idle, most), "seq long, retry boolean", time is not None)


def surface_tokens(nodes: DataFrame, delay: str = "10 minutes", span: str = "5 minutes") -> DataFrame:
    """Tokens by session and window of event time, late rows dropped beyond the delay. nodes: session_id, ts, tokens."""
    return nodes.withWatermark("ts", delay).groupBy(F.window("ts", span), "session_id").agg(F.sum("tokens").alias("tokens"))
