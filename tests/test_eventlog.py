"""The event log: appends of several writers, crashes at each step; and long sessions in blocks."""

from __future__ import annotations

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import surface
from siltstone.sinks.eventlog import EVENT, EventLog


def said(spark, *rows):
    return spark.createDataFrame([(s, q, "user/message", "append", None, None, t) for s, q, t in rows], EVENT.format(key="string"))


def seen(log, version=None):
    return sorted((r.session_id, r.seq, r.text, r.batch) for r in log.read(version).collect())


def test_two_writers_lose_nothing(spark):
    """A second writer commits while the first one has read and staged: the first tries again over what it now reads."""
    folder = "file://" + tempfile.mkdtemp()
    one, two = EventLog(spark, folder, "string"), EventLog(spark, folder, "string")
    assert one.version() == -1 and one.read().count() == 0
    one.append(lambda _: said(spark, ("s1", 0, "first")))
    asked = []

    def make(events):
        asked.append(events.count())
        if len(asked) == 1:
            two.append(lambda e: said(spark, ("s1", e.agg(F.max("seq")).first()[0] + 1, "other")))
        return said(spark, ("s1", events.agg(F.max("seq")).first()[0] + 1, "mine"))

    assert one.append(make) == 2 and asked == [1, 2]
    assert seen(one) == seen(two) == [("s1", 0, "first", 0), ("s1", 1, "other", 1), ("s1", 2, "mine", 2)]
    assert seen(one, 0) == [("s1", 0, "first", 0)]
    assert one.clean() == 1 and one.clean() == 0 and len(seen(two)) == 3


def test_a_number_is_claimed_once(spark):
    log = EventLog(spark, "file://" + tempfile.mkdtemp(), "string")
    a, b = log.stage(said(spark, ("s", 0, "a"))), log.stage(said(spark, ("s", 0, "b")))
    assert log.claim(0, a) and not log.claim(0, b) and [r[2] for r in seen(log)] == ["a"]


@pytest.mark.parametrize("step", ["make", "stage", "claim", "_link"])
def test_a_crash_leaves_a_readable_log(spark, monkeypatch, step):
    log = EventLog(spark, "file://" + tempfile.mkdtemp(), "string")
    log.append(lambda _: said(spark, ("s", 0, "kept")))

    def fail(*_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        if step == "make":
            log.append(fail)
        else:
            with monkeypatch.context() as m:
                m.setattr(log, step, fail)
                log.append(lambda _: said(spark, ("s", 1, "lost")))
    assert [r[2] for r in seen(log)] == ["kept"]
    assert log.append(lambda e: said(spark, ("s", 1, "next"))) == 1 and [r[2] for r in seen(log)] == ["kept", "next"]


def test_a_checkpoint_lands_whole(spark):
    """Start, summary, replacement and end come in one append, and the surface follows."""
    log = EventLog(spark, "file://" + tempfile.mkdtemp(), "string")
    log.append(lambda _: said(spark, *[("s", k, f"turn {k}") for k in range(5)]))
    regions = spark.createDataFrame([("s", [1, 2], "in short", None)], "session_id string, covers array<long>, summary string, error string")
    log.append(lambda e: surface.commit(e.select("session_id", "seq"), regions))
    kinds = [r.type for r in log.read().filter("batch = 1").orderBy("seq").collect()]
    assert kinds == ["compaction/start", "compaction/summary", "user/message", "compaction/end"]
    assert [r.seq for r in surface.surface_fold(log.read()).orderBy("pos").collect()] == [0, 7, 3, 4]
    assert [r.seq for r in surface.surface_fold(log.read(0)).orderBy("pos").collect()] == [0, 1, 2, 3, 4]


def plain_range(tokens, delta, system, retain):
    cut, held = 0, 0
    for k in range(len(tokens) - 1, -1, -1):
        held += tokens[k]
        if held >= retain:
            cut = k
            break
    first = int(system)
    for k in range(cut, first, -1):
        if sum(delta[:k]) == 0:
            return first, k - 1
    return None


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_long_sessions_in_blocks(spark, block):
    rng = random.Random(block)
    sessions = {}
    for s in [*range(30), None]:
        n, calls, delta = rng.randint(1, 40), 0, []
        for _ in range(n):
            d = rng.choice([0, 0, 1, -1] if calls else [0, 0, 1])
            calls += d
            delta.append(d)
        sessions[s] = ([rng.randint(0, 9) for _ in range(n)], delta, rng.random() < 0.4)
    rows = [(s, k, t, d, system and k == 0) for s, (tokens, delta, system) in sessions.items() for k, (t, d) in enumerate(zip(tokens, delta, strict=True))]
    df = spark.createDataFrame(rows, "session_id long, pos long, tokens long, delta int, is_system boolean").repartition(5).cache()
    for retain in (0, 1, 15, 60):
        got = {r.session_id: (r.start_pos, r.end_pos) for r in surface.retention_range(df, retain, block_nodes=block).collect()}
        assert got == {s: x for s, (t, d, y) in sessions.items() if (x := plain_range(t, d, y, retain))}
    for r in surface.tool_balance(df, block_nodes=block).collect():
        delta = sessions[r.session_id][1]
        assert (r.balanced_before, r.balanced_after) == (sum(delta[: r.pos]) == 0, sum(delta[: r.pos + 1]) == 0)


def test_a_session_of_a_million_nodes(spark):
    n = 1_000_000
    k = F.col("id")
    df = spark.range(n).select(F.lit("s").alias("session_id"), k.alias("pos"), (k % 10).alias("tokens"), F.when(k % 100 == 5, 1).when(k % 100 == 95, -1).otherwise(0).alias("delta"), (k == 0).alias("is_system"))
    found = surface.retention_range(df, 2_000_000)
    at = np.arange(n)
    suffix = np.cumsum((at % 10)[::-1])[::-1]
    sound = (suffix >= 2_000_000) & ((at % 100 <= 5) | (at % 100 > 95)) & (at > 1)
    assert [tuple(r) for r in found.collect()] == [("s", 1, int(at[sound].max()) - 1)]
    # nodes are dealt by session and block, and by session only after they were summed up
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block" in x or "_at" in x or "_session" in x for x in plan.split("\n") if "Window " in x)
