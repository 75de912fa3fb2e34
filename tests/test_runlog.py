"""The run log under several writers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest


@pytest.fixture()
def runlog(spark):
    from siltstone.sinks import runlog  # its schema needs a session

    return runlog


def _records(runlog, spark, ids):
    return runlog.format_records(spark.createDataFrame([(k,) for k in ids], "at long")).coalesce(1)


def _at(spark, path, limit=1000):
    from siltstone.sources.runlog import read_records, recent

    return [r.at for r in recent(read_records(spark, path), limit).collect()]


def test_writers_at_a_time_lose_nothing(spark, tmp_path, runlog):
    path = f"file://{tmp_path}/log"

    def write(w):
        return [runlog.append_records(_records(runlog, spark, [100 * w + 2 * k, 100 * w + 2 * k + 1]), path, f"-w{w}") for k in range(4)]

    with ThreadPoolExecutor(4) as pool:
        writers = [pool.submit(write, w) for w in range(3)]
        capped = pool.submit(lambda: [runlog.cap_log(spark, path, 1000) for _ in range(3)])
        names = [n for w in writers for n in w.result()]
        capped.result()
    assert len({n[6:18] for n in names}) == 12
    got = _at(spark, path)
    assert sorted(got) == [100 * w + k for w in range(3) for k in range(8)]
    for w in range(3):  # a writer's own records stay in its order
        assert [a for a in got if a // 100 == w] == list(range(100 * w + 7, 100 * w - 1, -1))


@pytest.mark.parametrize("noticed_by", ["writer", "cap"])
def test_a_base_does_not_hide_what_it_does_not_hold(spark, tmp_path, runlog, monkeypatch, noticed_by):
    """A writer claims a number; before its rows show, another appends behind it and the log is capped."""
    path = f"file://{tmp_path}/log"
    runlog.append_records(_records(runlog, spark, [1, 2]), path)
    claim, calls = runlog._claim, []

    def slow(s, p, number):
        took = claim(s, p, number)
        calls.append(number)
        if noticed_by == "writer" and len(calls) == 1:
            runlog.append_records(_records(runlog, spark, [5]), path)
            runlog.cap_log(spark, path, 2)
        return took

    monkeypatch.setattr(runlog, "_claim", slow)
    if noticed_by == "writer":
        runlog.append_records(_records(runlog, spark, [3, 4]), path)
    else:
        aside, shown, real = tmp_path / "log" / "_aside", tmp_path / "log" / "batch=000000000001", runlog.newest

        def late(*args):
            aside.rename(shown)
            return real(*args)

        runlog.append_records(_records(runlog, spark, [3, 4]), path)
        shown.rename(aside)
        runlog.append_records(_records(runlog, spark, [5]), path)
        monkeypatch.setattr(runlog, "newest", late)
        runlog.cap_log(spark, path, 2)
    assert calls == [1, 2, 3]
    assert _at(spark, path) == [4, 3, 5, 2]
    assert len(runlog.batches(spark, path)) == 2
