"""Streams against plain folds: any split and order of events, sessions that end, cooldowns that pass, state to begin with."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from siltstone.operators import surface
from siltstone.streaming.state import cooldown_stream, overflow_stream, pressure_stream, surface_changes, surface_stream
from tests.test_goldens import _stream

EVENT = "session_id string, seq long, op string, covers array<long>, tokens long"


def _events(rng, sessions=6, length=25):
    events = []
    for k in range(sessions):
        for seq in range(length):
            if seq and rng.random() < 0.45:
                covers = [rng.choice([None, *range(seq + 3)]) for _ in range(rng.randint(0, 4))]
                events.append((f"s{k}", seq, "replace", rng.choice([covers, covers, None]), rng.randint(1, 9)))
            else:
                events.append((f"s{k}", seq, rng.choice(["append", "append", None]), None, rng.choice([None, *range(9)])))
    return events


def _fold(spark, events):
    out = {}
    for r in sorted(surface.surface_fold(spark.createDataFrame(events, EVENT)).collect(), key=lambda r: (r.session_id, r.pos)):
        out.setdefault(r.session_id, []).append(r.seq)
    return out


def test_changes_are_the_fold_at_any_split_and_order(spark, tmp_path):
    rng = random.Random(5)
    events = _events(rng)
    want = _fold(spark, events)
    cost = {(e[0], e[1]): e[4] or 0 for e in events}
    for name, mixed in (("in_order", False), ("mixed", True)):
        order = sorted(events, key=lambda e: (e[1], e[0]))
        if mixed:
            rng.shuffle(order)
        parts = [order[:40], [*order[40:70], *order[:20]], order[70:]]  # some come again
        rows, _ = _stream(spark, tmp_path, name, parts, EVENT, surface_changes)
        shown, total = {}, {}
        for r in rows:
            shown.setdefault(r.session_id, {})[r.seq] = r.place if r.visible else None
            total[r.session_id] = r.total_tokens
        got = {s: [q for _, q in sorted((p, q) for q, p in nodes.items() if p is not None)] for s, nodes in shown.items()}
        assert got == want
        assert total == {s: sum(cost[s, q] for q in seqs) for s, seqs in want.items()}
    last = {r.session_id: r for r in _stream(spark, tmp_path, "whole", parts, EVENT, surface_stream)[0]}
    assert {s: list(r.nodes) for s, r in last.items()} == want


def test_a_change_names_only_what_changed(spark, tmp_path):
    first = [("s", k, "append", None, 1) for k in range(50)]
    rows, counts = _stream(spark, tmp_path, "few", [first, [("s", 50, "replace", [3, 4], 7)], [("s", 50, "replace", [9], 7), (None, None, "append", None, 1)]], EVENT, surface_changes)
    assert counts == [50, 53, 53]
    assert [tuple(r) for r in sorted(rows[50:], key=lambda r: r.seq)] == [("s", 3, False, None, 1, 55), ("s", 4, False, None, 1, 55), ("s", 50, True, 3, 7, 55)]


def _state(spark, tmp_path, name, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(str(tmp_path / name / "ck"))


def test_a_sessions_nodes_lie_in_blocks(spark, tmp_path):
    """Fifty nodes, one of them covered before it comes, are two entries of state; only replacements have covers of their own."""
    first = [("s", 60, "replace", [3, 4], 7), *[("s", k, "append", None, 1) for k in range(50) if k != 4]]
    rows, _ = _stream(spark, tmp_path, "blocks", [first, [("s", 4, "append", None, 1)]], EVENT, surface_changes)
    assert {r.seq for r in rows if r.visible} == {*range(50), 60} - {3, 4} and {r.total_tokens for r in rows} == {55}
    assert _state(spark, tmp_path, "blocks", "blocks").count() == 2
    assert _state(spark, tmp_path, "blocks", "covers").count() == 1


def test_small_streams_have_few_partitions_of_state(spark, sf):
    from pathlib import Path

    from siltstone.plans.queries import surface_streamed
    from siltstone.session import shared_dir

    folder, before = Path(shared_dir(spark).removeprefix("file://")), spark.conf.get("spark.sql.shuffle.partitions")
    known = set(folder.glob("siltstone-stream-*"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        surface_streamed(spark, sf)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    (made,) = set(folder.glob("siltstone-stream-*")) - known
    assert len([p for p in (made / "state/state/0").iterdir() if p.name.isdigit()]) == spark.sparkContext.defaultParallelism


def test_state_of_ended_sessions_goes(spark, tmp_path):
    """Ten sessions an hour for ten hours: only those of the last hour leave state behind."""
    batches = [[(f"s{h}-{k}", 1 + i, "overflow", 60, f"2026-01-01 {h:02d}:{i:02d}:00") for k in range(10) for i in range(2)] for h in range(10)]
    schema = "session_id string, seq long, type string, tokens long, ts string"
    timed = dict(time="at", idle=600_000, delay="1 minute")
    rows, _ = _stream(spark, tmp_path, "ending", batches, schema, lambda df: overflow_stream(df.withColumn("at", F.to_timestamp("ts")), **timed))
    assert len(rows) == 200 and sum(r.retry for r in rows) == 100
    assert {r.key[0][:3] for r in _state(spark, tmp_path, "ending", "count").select("key").collect()} == {"s9-"}
    rows, _ = _stream(spark, tmp_path, "full", [*batches[:3], batches[0]], schema, lambda df: pressure_stream(df.withColumn("at", F.to_timestamp("ts")), 150, **timed))
    assert rows == []  # an ended session begins anew, and its late rows are not dropped: 120 and 120 tokens
    rows, _ = _stream(spark, tmp_path, "kept", [*batches[:3], batches[0]], schema, lambda df: pressure_stream(df.withColumn("at", F.to_timestamp("ts")), 150, 10))
    assert {r.session_id[:2] for r in rows} == {"s0"} and {r.total_tokens for r in rows} == {240}


def test_cooldowns_pass_by_the_rows_clock(spark, tmp_path):
    hour = 3_600_000
    initial = spark.createDataFrame([("old", 5 * hour), ("old", hour), ("none", None)], "key string, cooldown_until long")
    batches = [[("a", 0, 1.0), ("b", 0, 8.0)], [("b", 2 * hour, 1.0), ("c", None, 1.0)], [("a", hour // 2, 0.25), ("a", 0, 4.0)], [("c", 6 * hour, 1.0)]]
    rows, _ = _stream(spark, tmp_path, "cooling", batches, "key string, at_ms long, hours double", lambda df: cooldown_stream(df, initial))
    assert sorted((r.key, r.cooldown_until) for r in rows if r.cooldown_until) == [("a", hour), ("a", 4 * hour), ("b", 8 * hour), ("c", 7 * hour)]
    assert sorted(r.key for r in rows if r.cooldown_until is None) == ["a", "a", "old"]  # b and c still cool down
    assert sorted(r.key[0] for r in _state(spark, tmp_path, "cooling", "until").select("key").collect()) == ["b", "c"]
