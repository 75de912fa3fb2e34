"""Scheduling rounds, configuration, transactions and the smaller session operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone import config
from siltstone.operators import lines, pool, surface
from siltstone.operators.chain import Route, run_chain, with_retry
from siltstone.session import materialise, release, scratch, shared_dir

TASKS = "task string, text string, tokens long, preferred_key string"


def script(fails=(), rejects=(), small=None):
    """A summarizer that fails on some routes, turns down some pairs, and else upper-cases."""

    def call(work):
        pair = F.concat_ws(":", "task", "key")
        status = F.when(F.col("key").isin(list(fails) or ["-"]), "fail").when(pair.isin(list(rejects) or ["-"]), "reject").otherwise("ok")
        return work.select("task", "key", status.alias("status"), F.upper("text").alias("digest"), F.lit(None).cast("string").alias("error"))

    return call


def results(found):
    return {r.task: (r.status, r.digest, r.parts, list(r.models)) for r in found.collect()}


def test_preferred_then_retry_then_next_tier(spark):
    tasks = spark.createDataFrame([("t", "a", 10, "b"), ("u", "b", 10, None)], TASKS)
    pool = [Route("a", 0, 0), Route("b", 0, 1), Route("c", 1, 0)]
    found, _ = run_chain(tasks, pool, script())
    assert results(found) == {"t": ("ok", "A", 1, ["b"]), "u": ("ok", "B", 1, ["a"])}
    found, routes = run_chain(tasks, pool, script(fails=["a", "b"]), now=5)
    assert {k: v[3] for k, v in results(found).items()} == {"t": ["c"], "u": ["c"]}
    assert {r.key: r.cooled_until for r in routes} == {"a": 3_600_005, "b": 3_600_005, "c": 0}


def test_rejection_cools_nothing(spark):
    tasks = spark.createDataFrame([("t", "a", 10, None)], TASKS)
    found, routes = run_chain(tasks, [Route("a", 0, 0), Route("b", 0, 1)], script(rejects=["t:a"]))
    assert results(found)["t"][3] == ["b"] and all(r.cooled_until == 0 for r in routes)


def test_retry_is_halved_for_small_routes(spark):
    text = "\n".join(f"line {k}" for k in range(8))
    tasks = spark.createDataFrame([("t", text, 6000, "large")], TASKS)
    found, _ = run_chain(tasks, [Route("large", 0, 0, 20_000), Route("small", 0, 1, 5_000)], script(fails=["large"]))
    status, digest, parts, models = results(found)["t"]
    assert (status, parts, models) == ("ok", 2, ["small"]) and digest.replace("\n\n", "\n") == text.upper()


def test_fallback_or_failure(spark):
    tasks = spark.createDataFrame([("t", "a", 10, None), ("u", "b", 10, None)], TASKS)
    found, _ = run_chain(tasks, [Route("a", 0, 0)], script(fails=["a"]), fallback=script())
    assert results(found) == {"t": ("fallback", "A", 0, []), "u": ("fallback", "B", 0, [])}
    found, _ = run_chain(tasks, [Route("a", 0, 0), Route("b", 1, 0)], script(fails=["a", "b"]))
    assert {v[0] for v in results(found).values()} == {"failed"}
    assert {r.error for r in found.collect()} == {"no healthy route is left in any tier and there is no fallback; attempts: a x1 (last: failed); b x1 (last: failed)"}
    assert run_chain(tasks.limit(0), [Route("a", 0, 0)], script())[0].count() == 0
    assert {v[0] for v in results(run_chain(tasks, [], script())[0]).values()} == {"failed"}


def test_a_pool_that_is_all_cooled_is_reset_once(spark):
    tasks = spark.createDataFrame([("t", "a", 10, None)], TASKS)
    found, routes = run_chain(tasks, [Route("a", 0, 0, cooled_until=9), Route("b", 1, 0, cooled_until=99)], script(fails=["a"]), now=8)
    assert results(found)["t"][3] == ["b"] and {r.key: r.cooled_until for r in routes} == {"a": 3_600_008, "b": 0}


def test_siblings_share_a_round_by_their_slots(spark):
    tasks = spark.createDataFrame([(f"t{k}", "a", 10, None) for k in range(300)], TASKS)
    found, _ = run_chain(tasks, [Route("a", 0, 0, max_concurrent=2), Route("b", 0, 1), Route("c", 1, 0)], script())
    used = [v[3][0] for v in results(found).values()]
    assert 150 < used.count("a") < 250 and 50 < used.count("b") < 150 and not used.count("c")


def test_busy_routes_are_waited_for(spark):
    tasks = spark.createDataFrame([("t", 10, None, False, True), ("u", 10, "b", False, True), ("r", 9000, None, True, True), ("w", 9000, None, False, True)], "task string, tokens long, preferred_key string, is_retry boolean, splittable boolean")
    routes = spark.createDataFrame([("a", 0, 0, 2000, 100, True, False), ("b", 0, 1, 2000, 100, True, False), ("c", 1, 0, 90_000, 100, True, True)], "key string, tier_idx int, pos int, window long, max_tokens long, healthy boolean, free boolean")
    got = {r.task: (r.key, r.tier_idx, r.split, r.waits) for r in pool.pick_routes(tasks, routes).collect()}
    assert got == {"t": (None, 0, False, True), "u": (None, 0, False, True), "r": (None, 0, True, False), "w": ("c", 1, False, False)}
    opened = pool.pick_routes(tasks, routes.withColumn("free", F.col("key") != "a"))
    assert {r.task: r.key for r in opened.collect()}["t"] == "b"
    plan = opened._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_cancelled_calls_cool_nothing_and_are_not_made_again(spark):
    tasks = spark.createDataFrame([("t", "a", 10, None), ("u", "b", 10, None)], TASKS)

    def call(work):
        return work.select("task", "key", F.when(F.col("task") == "t", "aborted").otherwise("ok").alias("status"), F.upper("text").alias("digest"), F.lit(None).cast("string").alias("error"))

    found, routes = run_chain(tasks, [Route("a", 0, 0), Route("b", 0, 1)], call, fallback=script())
    assert {k: v[:2] for k, v in results(found).items()} == {"t": ("aborted", None), "u": ("ok", "B")} and not any(r.cooled_until for r in routes)


def test_empty_digests_are_failures(spark):
    tasks = spark.createDataFrame([("t", "", 10, "a")], TASKS)
    found, routes = run_chain(tasks, [Route("a", 0, 0)], script())
    assert results(found)["t"][0] == "failed" and "a digest was empty" in found.first().error and routes[0].cooled_until > 0


def test_calls_that_do_not_answer_are_failures(spark):
    tasks = spark.createDataFrame([("t", "a", 10, "a"), ("u", "b", 10, "a")], TASKS)

    def silent(work):
        return script()(work).filter("not (task = 't' and key = 'a')")

    found, routes = run_chain(tasks, [Route("a", 0, 0), Route("b", 0, 1)], silent, now=5)
    got = {r.task: (r.status, list(r.models), [(a.model, a.error) for a in r.attempts]) for r in found.collect()}
    assert got == {"t": ("ok", ["b"], [("a", "no answer"), ("b", None)]), "u": ("ok", ["a"], [("a", None)])} and routes[0].cooled_until > 5


def test_stores_keep_cooldowns_and_may_fail(spark):
    tasks = spark.createDataFrame([("t", "a", 10, "a")], TASKS)
    kept = {}
    run_chain(tasks, [Route("a", 0, 0), Route("b", 0, 1)], script(fails=["a"]), now=5, store=kept.__setitem__)
    assert kept == {"a": 3_600_005}

    def broken(key, until):
        raise OSError(key)

    found, routes = run_chain(tasks, [Route("a", 0, 0), Route("b", 0, 1)], script(fails=["a"]), now=5, store=broken)
    assert results(found)["t"][3] == ["b"] and routes[0].cooled_until == 3_600_005


def test_providers_are_asked_again_before_a_failure_counts(spark):
    tasks = spark.createDataFrame([("t", "a", 10, "a"), ("u", "b", 10, "a")], TASKS)
    seen = []

    def flaky(work):
        seen.append(work.count())
        code = F.when(F.col("task") == "t", "RATE").otherwise("AUTH")
        return work.select("task", "key", F.lit("fail" if len(seen) < 3 else "ok").alias("status"), F.upper("text").alias("digest"), code.alias("error"))

    work = tasks.select("task", F.lit("a").alias("key"), "text")
    got = {r.task: r.status for r in with_retry(flaky, ("RATE",), 2)(work).collect()}
    assert got == {"t": "ok", "u": "fail"} and seen == [2, 1, 1]
    seen.clear()
    assert {r.status for r in with_retry(flaky, None, 5)(work).collect()} == {"ok"} and seen == [2, 2, 2]


def test_fallback_keeps_what_a_root_has(spark):
    text = "\n".join(f"line {k}" for k in range(8))
    tasks = spark.createDataFrame([("t", text, 6000, "large")], TASKS)
    found, _ = run_chain(tasks, [Route("large", 0, 0, 20_000), Route("small", 0, 1, 5_000)], script(fails=["large"], rejects=["t/2-2:small"]), fallback=script())
    status, digest, parts, _ = results(found)["t"]
    assert (status, parts) == ("fallback", 1) and digest == "\n".join(text.upper().split("\n")[:4]) + "\n\n" + text.upper()


def test_config():
    tiers = [{"name": "a", "models": [{"provider": "p", "model": "m"}]}]
    made = config.load({"tiers": tiers, "mergeTiers": 1, "preprocessing": {"headMiddleTail": {}, "logCondense": {"mode": "tail"}}})
    assert made.tiers[0].models[0].key == "p/m" and made.preprocessing.log_mode == "tail" and made.deprecated == ("mergeTiers", "preprocessing.headMiddleTail")
    for bad in ({}, {"tiers": []}, {"tiers": tiers, "x": 1}, {"tiers": tiers * 2}, {"tiers": tiers, "chunkRatio": 0}, {"tiers": tiers, "chunkOverlapRatio": 1}, {"tiers": tiers, "preprocessing": {"dedup": 1}}, {"tiers": [{"name": "a", "models": [{"provider": "p", "model": "m", "cooldownHours": 0}]}]}):
        with pytest.raises(config.ConfigError):
            config.load(bad)


def test_config_writes_are_fenced(tmp_path):
    path, tiers = str(tmp_path / "c.json"), [{"name": "a", "models": [{"provider": "p", "model": "m"}]}]
    first = config.save(path, {"tiers": tiers}, None)
    second = config.save(path, {"tiers": tiers, "chunkRatio": 0.5}, first)
    for expected, value in ((None, {"tiers": tiers}), (first, {"tiers": tiers})):
        with pytest.raises(config.Conflict):
            config.save(path, value, expected)
    with pytest.raises(config.ConfigError):
        config.save(path, {"tiers": []}, second)
    assert config.read(path)["chunkRatio"] == 0.5 and config.revision({"b": 1, "a": "é"}) == config.revision({"a": "é", "b": 1})
    now, error = config.reload(path, config.load({"tiers": tiers}))
    assert now.chunk_ratio == 0.5 and error is None
    (tmp_path / "c.json").write_text("{")
    assert config.reload(path, now)[0] is now and config.reload(path, now)[1]
    assert config.log_path("x") == "x" and config.log_path("", "/h") == "/h/storages/runs"


def test_commit_folds_to_the_replacement(spark):
    events = spark.createDataFrame([(1, k) for k in range(5)], "session_id long, seq long")
    regions = spark.createDataFrame([(1, [1, 2], "S", None)], "session_id long, covers array<long>, summary string, error string")
    landed = surface.commit(events, regions)
    assert [r.type for r in landed.orderBy("seq").collect()] == ["compaction/start", "compaction/summary", "user/message", "compaction/end"]
    old = events.select("session_id", "seq", F.lit("append").alias("op"), F.lit(None).cast("array<bigint>").alias("covers"))
    assert [r.seq for r in surface.surface_fold(old.unionByName(landed.select(*old.columns))).orderBy("pos").collect()] == [0, 7, 3, 4]
    failed = surface.commit(events, regions.withColumn("error", F.lit("no")))
    assert [(r.type, r.text) for r in failed.orderBy("seq").collect()] == [("compaction/start", None), ("compaction/end", "no")]


def test_ranges_control_and_stability(spark):
    nodes = spark.createDataFrame([(1, k, k + 10, 5, d) for k, d in enumerate([0, 0, 1, -1, 0])], "session_id long, pos long, seq long, tokens long, delta int")
    span = surface.keep_right_range(nodes, 2)
    assert [(r.start_pos, r.end_pos) for r in span.collect()] == [(1, 1)]
    assert [r.pos for r in surface.delete_range(nodes, span).orderBy("pos").collect()] == [0, 2, 3, 4]
    assert surface.unchanged(nodes, nodes).first().stable and not surface.unchanged(nodes, nodes.filter("pos > 0")).first().stable


def test_small_line_operators(spark):
    messages = lines.as_blocks(spark.createDataFrame([(1, 0, "user", "12345678")], "conv_id long, turn long, role string, text string"))
    assert messages.select(lines.message_tokens(F.col("content"))).first()[0] == 10
    assert lines.region_chars(messages).first().chars > 8 and lines.filler(spark, 3, "x").count() == 3
    events = spark.createDataFrame([(1, 1, "b", "two"), (1, 0, "a", "one"), (1, 2, "c", None)], "session_id long, seq long, type string, text string")
    assert lines.history_text(events).first().history == "a: one\nb: two"
    heads = spark.createDataFrame([(1, "sys")], "session_id long, text string")
    got = lines.replay_input(heads, events.withColumn("role", F.lit("user")), spark.createDataFrame([(1, 1)], "session_id long, seq long")).orderBy("at").collect()
    assert [(r.at, r.text) for r in got] == [(0, "sys"), (1, "two")]


def test_release_removes_what_was_written(spark):
    import os

    release(spark)
    folder = shared_dir(spark).removeprefix("file://")
    before = len(os.listdir(folder)) if os.path.isdir(folder) else 0
    assert materialise(spark.range(3)).count() == 3 and len(os.listdir(folder)) == before + 1
    assert release(spark) == 1 and len(os.listdir(folder)) == before and release(spark) == 0
    with scratch(spark) as outer:
        materialise(spark.range(1))
        with scratch(spark) as inner:
            materialise(spark.range(2))
            kept = materialise(spark.range(3))
            path = inner.keep()
        assert kept.count() == 3 and len(os.listdir(folder)) == before + 2
        outer.remove(path)
    assert len(os.listdir(folder)) == before and release(spark) == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session())
