"""Small goldens and properties of single operators."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions import budget, text
from siltstone.operators import chunks, digests, grading, lines, pool, stage0, surface

ESC = "\x1b"


def doc(spark, rows, key=1):
    return spark.createDataFrame([(key, k, x) for k, x in enumerate(rows)], "doc_id long, line_no long, line string")


def out(df):
    return [r.line for r in df.orderBy("doc_id", "line_no").collect()]


def test_dedup(spark):
    assert out(stage0.dedup_lines(doc(spark, list("aabbbca")))) == list("abca")


def test_purge(spark):
    rows = [f"{ESC}[31merror{ESC}[0m text", "    ^^^^", "-" * 16, "-" * 15, "keep this", "a" * 20]
    assert out(stage0.purge_noise(doc(spark, rows))) == ["error text", "-" * 15, "keep this", "a" * 20]


@pytest.mark.parametrize(("rows", "want"), [(["a", *[""] * 5, "b"], ["a", "", "b"]), (["a", "", "b"], ["a", "b"]), (["a", "", "", "b"], ["a", "b"]), (["a", "", " ", " "], ["a"]), ([""] * 4, [""]), ([""], [])])
def test_blanks(spark, rows, want):
    assert out(stage0.skip_blank_blocks(doc(spark, rows))) == want


def test_head_middle_tail(spark):
    rows = [f"line-{k}" for k in range(20)]
    got = out(stage0.head_middle_tail(doc(spark, rows), 100, 40, 40))
    assert got[0] == "line-0" and got[-1] == "line-19" and any("condensed" in x for x in got) and len(got) < 20
    assert out(stage0.head_middle_tail(doc(spark, ["short", "doc"]))) == ["short", "doc"]


def test_skeleton(spark):
    rows = ["```py", "def f():", "    if cond:", "            a", "            b", "            c", "```", "            outside", "```", "            open to the end"]
    want = ["```py", "def f():", "    if cond:", "[condensed: 3 lines removed]", "```", "            outside", "```", "[condensed: 1 lines removed]"]
    assert out(stage0.ast_skeleton(doc(spark, rows))) == want


def test_log_condense(spark):
    rows = [f"INFO  2026-01-01 10:00:0{k} step {k}" for k in range(8)]
    assert out(stage0.log_condense(doc(spark, rows), "balanced", 4)) == [*rows[:2], "[condensed: 4 lines removed]", *rows[-2:]]
    assert out(stage0.log_condense(doc(spark, rows), "head", 3)) == [*rows[:3], "[condensed: 5 lines removed]"]
    assert out(stage0.log_condense(doc(spark, rows), "tail", 3)) == ["[condensed: 5 lines removed]", *rows[-3:]]
    assert out(stage0.log_condense(doc(spark, rows), "balanced", 0)) == ["[condensed: 8 lines removed]"]
    assert stage0.log_runs(doc(spark, ["INFO text", "no timestamp", "WARN another"])).count() == 0
    assert stage0.log_runs(doc(spark, rows[:3])).count() == 0


def test_empty_documents_pass_through(spark):
    empty = spark.createDataFrame([], "doc_id long, line_no long, line string")
    assert stage0.run_stage0(empty, skeleton_depth=2).count() == 0
    assert chunks.chunk_lines(empty, [(10, 1)]).count() == 0


def naive_chunks(cost, good, tokens, overlap):
    """The walk as one reads it: lines while they fit, back to a good end, back over the overlap."""
    made, start, n = [], 0, len(cost)
    while start < n:
        end, used = start, 0
        while end < n and (end == start or used + cost[end] <= tokens):
            used, end = used + cost[end], end + 1
        after = end
        if end < n:
            end = next((c for c in range(end, max(start + 1, end - 12) - 1, -1) if good[c - 1]), end)
            after, acc = end, 0
            while after > start and acc < overlap:
                after -= 1
                acc += cost[after]
            if overlap <= 0 or after <= start:
                after = end
        made.append((start, end))
        start = after
    return made


def test_chunks_equal_the_walk(spark):
    rng = random.Random(5)
    docs, want = [], {}
    for d in range(40):
        rows = ["x" * rng.randint(0, 60) + rng.choice(["", ".", "a", "b"]) for _ in range(rng.randint(1, 60))]
        docs += [(d, k, x) for k, x in enumerate(rows)]
        want[d] = naive_chunks([-(-len(x) // 4) + 1 for x in rows], [x.strip() == "" or x.strip()[-1] in ".?!:;,}])\"'`" for x in rows], 50, 9)
    got = chunks.chunk_lines(spark.createDataFrame(docs, "doc_id long, line_no long, line string"), [(50, 9)]).orderBy("doc_id", "chunk").collect()
    by = {d: [(r.line_start, r.line_end) for r in got if r.doc_id == d] for d in want}
    assert by == want
    assert all(r.core_start == p.core_end for p, r in zip(got, got[1:]) if p.doc_id == r.doc_id)


def test_oversize_line(spark):
    assert chunks.chunk_lines(doc(spark, ["x" * 1000, "short"]), [(5, 1)]).count() == 2


def test_caps_stay_within_the_merge(spark):
    rows = chunks.chunk_lines(doc(spark, ["word " * 30] * 200), [(100, 20)])
    capped = chunks.digest_caps(rows, 300)
    assert capped.agg(F.sum("cap_tokens")).first()[0] <= 300
    halves = chunks.split_halves(doc(spark, ["word " * 30] * 200), capped)
    assert halves.groupBy("chunk").agg(F.sum("tokens").alias("t")).join(rows, "chunk").filter("t > tokens").count() == 0


def test_budget(spark):
    w = F.col("w")
    got = spark.createDataFrame([(128000,), (1,)], "w long").select(budget.output_budget(w), budget.usable_input(w), budget.chunk_budget(w)).collect()
    assert [tuple(r) for r in got] == [(19200, 107776, 86220), (0, 1, 1)]
    assert budget.py_chunk(128000) == 86220


def test_texts(spark):
    row = spark.createDataFrame([("a\r\nb\rc\n", "x" * 200, ["outer", "outer", "inner  cause"])], "a string, b string, c array<string>")
    got = row.select(text.split_lines(F.col("a")), text.cap_snapshot(F.col("b"), 100), text.describe_error(F.col("c")), text.length16(F.lit("😀")), text.fingerprint(F.lit("x"))).first()
    assert got[0] == ["a", "b", "c", ""] and got[1] == "x" * 80 + "\n…[elided 100 chars]…\n" + "x" * 20
    assert got[2] == "outer: inner cause" and got[3] == 2 and len(got[4]) == 12


def test_fnv(spark):
    def plain(s):
        h = 2166136261
        for k in range(0, len(raw := s.encode("utf-16-be", "surrogatepass")), 2):
            h = ((h ^ (raw[k] << 8 | raw[k + 1])) * 16777619) & 0xFFFFFFFF
        return h

    texts = ["a", "", "é日本", "😀 x" * 50, *("xyz" * k for k in range(60)), "lone \ud800 half", "long" * 3000, "longer" * 3000]
    got = spark.createDataFrame([(t,) for t in texts if "\ud800" not in t], "s string").select(text.fnv1a(F.col("s")).alias("h"))
    assert [r.h for r in got.collect()] == [plain(t) for t in texts if "\ud800" not in t] and plain("a") == 0xE40C292C
    assert text.fnv_hashes(texts) == [plain(t) for t in texts]
    assert text.fnv_hashes([None]) == [plain("")] and text.fnv_hashes([]) == []


@pytest.mark.parametrize("count", [1, 40])
def test_fnv_takes_time_in_proportion(count):
    """Four times the text takes less than eight times the time, alone or beside others; 200,000 characters a fraction of a second."""

    def seconds(n):
        best = 9.0
        for _ in range(3):
            at = time.perf_counter()
            text.fnv_hashes(["word " * (n // 5)] * count)
            best = min(best, time.perf_counter() - at)
        return best

    assert seconds(200_000) < 8 * seconds(50_000) and seconds(200_000) < 1.5


def test_cuts_are_in_code_units(spark):
    """300 emoji are 600 units: cuts count units, and half a pair at a cut is a replacement character."""
    row = spark.createDataFrame([("😀" * 300, "x" + "😀" * 300, "short")], "a string, b string, c string")
    got = row.select(text.cap_snapshot(F.col("a"), 200).alias("a"), text.cap_snapshot(F.col("b"), 200).alias("b"), text.preview(F.col("a")).alias("p"), text.preview(F.col("b")).alias("q"), text.cap_snapshot(F.col("c"), 200).alias("c"), text.cut(F.col("a"), 600).alias("w"), text.cap_snapshot(F.col("a"), 201).alias("o")).first()
    assert got.a == "😀" * 80 + "\n…[elided 400 chars]…\n" + "😀" * 20 and got.c == "short" and got.w == "😀" * 300
    assert got.b == "x" + "😀" * 79 + "\ufffd" + "\n…[elided 401 chars]…\n" + "😀" * 20
    assert got.p == "😀" * 39 + "\ufffd…" and got.q == "x" + "😀" * 39 + "…"
    assert got.o == "😀" * 80 + "\n…[elided 399 chars]…\n" + "\ufffd" + "😀" * 20


def test_costs_by_a_vocabulary(spark, tmp_path):
    import gzip

    import public_tokenizers
    from tokenizers import Tokenizer

    from siltstone.functions.tokens import counter

    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = tmp_path / "v.json.gz"
    packed.write_bytes(gzip.compress(open(path, "rb").read()))
    texts = ["", None, "one two  three", "日本 😀 don't", "x" * 500, "<|endoftext|>"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, line_no long, line string")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = [len(tok.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    for at in (path, f"file://{packed}"):
        assert [r.n for r in df.orderBy("line_no").select(counter(spark, at)(F.col("line")).alias("n")).collect()] == want
    cost = counter(spark, path)
    got = chunks.chunk_lines(df.filter("line is not null"), [(40, 0)], cost).agg(F.sum("core_tokens")).first()[0]
    assert got == sum(n + 1 for n, t in zip(want, texts, strict=True) if t is not None)
    assert df.select(F.sum(lines.text_tokens(F.col("line"), cost))).first()[0] == sum(want) + 4 * len(texts)
    with pytest.raises(Exception, match="(?i)exist|path"):
        counter(spark, str(tmp_path / "none.json"))


def test_needles_are_counted_by_line(spark):
    texts = ["one two\nTWO two\nthree", None, "", "two\n\ntwo", "aaa"]
    needles = ["two", "TWO", "one two", "three\n", "aa", "zzz", "", None, "two", "é"]
    rows = [x for t in texts if t is not None for x in t.lower().split("\n")]
    want = {n: sum(n.lower() in x for x in rows) for n in needles if n is not None}
    df, ns = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    for block in (1 << 20, 4):
        got = grading.grep_counts(df, ns, block_chars=block).collect()
        assert {r.needle: r.hits for r in got} == want and len(got) == len(want)
    assert "NestedLoop" not in grading.grep_counts(df, ns)._jdf.queryExecution().toString()
    assert grading.grep_counts(df, ns.limit(0)).count() == 0 and {r.hits for r in grading.grep_counts(df.limit(0), ns).collect()} == {0}


def test_plans_have_no_fan_out(spark):
    rows = doc(spark, ["word " * 30] * 50)
    made = chunks.chunk_lines(rows, [(100, 20)])
    for df in (chunks.chunk_text(rows, made), chunks.split_halves(rows, chunks.digest_caps(made, 300))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Cross" not in plan and "_block" in plan[plan.index("Join") :].split("\n")[0]
    whole = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("line_no"), F.lit("x").alias("line"))
    spans = spark.createDataFrame([(1, 0, 0, 3000), (1, 1, 31, 33), (1, 2, 64, 64 + 32), (1, 3, 2999, 3000)], "doc_id long, chunk int, line_start long, line_end long")
    got = {r.chunk: (r.lo, r.hi, r.n) for r in chunks.chunk_text(whole, spans).groupBy("chunk").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: (0, 2999, 3000), 1: (31, 32, 2), 2: (64, 95, 32), 3: (2999, 2999, 1)}


def test_blocks(spark):
    block = "struct<type:string,text:string,name:string,arguments:string,attachment_name:string,offloaded:boolean,raw_json:string>"
    rows = [(1, 0, "user", [("text", "a\nb", None, None, None, None, None)]), (1, 1, "assistant", [("tool-call", None, "read", '{"path":"x"}', None, None, None), ("image", None, None, None, "d.jpg", True, None), ("file", None, None, None, None, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{block}>")
    got = [r.line for r in lines.region_lines(df).orderBy("line_no").collect()]
    assert got == ["[user]", "a", "b", "[assistant]", "[tool-call read]", '{"path":"x"}', "[image: d.jpg (offloaded)]", "[file]"]


def test_surface_fold_nested(spark):
    events = [(1, k, "append", None) for k in range(5)] + [(1, 5, "replace", [1, 2]), (1, 6, "replace", [5, 3]), (1, 7, None, None), (1, 8, "append", None)]
    df = spark.createDataFrame(events, "session_id long, seq long, op string, covers array<long>")
    assert [r.seq for r in surface.surface_fold(df).orderBy("pos").collect()] == [0, 6, 4, 8]


def test_retention(spark):
    nodes = [(1, 0, 0, 5, 0, True), (1, 1, 1, 5, 1, False), (1, 2, 2, 5, -1, False), (1, 3, 3, 5, 0, False)]
    df = spark.createDataFrame(nodes, "session_id long, pos long, seq long, tokens long, delta int, is_system boolean")
    assert [(r.start_pos, r.end_pos) for r in surface.retention_range(df, 0).collect()] == [(1, 2)]
    assert surface.retention_range(df, 10).count() == 0  # the cut would part a call from its result, and nothing is left before it


def test_pool(spark):
    schema = "key string, tier_idx int, pos int, window long, max_tokens long, healthy boolean"
    routes = spark.createDataFrame([("a", 0, 0, 2000, 100, True), ("b", 0, 1, 4000, 100, True), ("c", 1, 0, 90000, 100, True)], schema)
    tasks = spark.createDataFrame([("small", 100, "b", False, True), ("plain", 100, None, False, True), ("retry", 100, None, True, True), ("big", 50000, None, False, True), ("split", 50000, None, True, True), ("none", 10**9, None, False, False)], "task string, tokens long, preferred_key string, is_retry boolean, splittable boolean")
    got = {r.task: (r.key, r.split) for r in pool.pick_routes(tasks, routes).collect()}
    assert got == {"small": ("b", False), "plain": ("a", False), "retry": ("b", False), "big": ("c", False), "split": (None, True), "none": (None, False)}


def test_health_boundary(spark):
    routes = spark.createDataFrame([("a",)], "key string")
    cool = spark.createDataFrame([("a", 2000)], "key string, cooldown_until long")
    assert [pool.with_health(routes, cool, now).first().healthy for now in (1999, 2000)] == [False, True]


def test_grader(spark):
    probes = spark.createDataFrame([(1, "p", ["alpha", "beta"]), (1, "q", [])], "k long, probe_id string, need array<string>")
    answers = spark.createDataFrame([(1, "only ALPHA here")], "k long, answer string")
    alone = spark.createDataFrame([(2, "p", ["alpha"])], "k long, probe_id string, need array<string>")
    lost = grading.grade_probes(alone, answers, ["k"]).first()
    assert (lost.matched, lost.required, lost.recall, lost.missing) == (0, 1, 0.0, ["alpha"])
    got = {r.probe_id: r for r in grading.grade_probes(probes, answers, ["k"]).collect()}
    assert got["p"].recall == 0.5 and got["p"].missing == ["beta"] and got["q"].recall is None
    said = spark.createDataFrame([("we rejected it and also chose it",), ("fine",), (None,)], "a string")
    assert [r[0] for r in said.select(grading.hallucinated(F.col("a"), F.lit("fact"))).collect()] == [True, False, False]


def test_framing(spark):
    got = spark.range(1).select(digests.checkpoint(F.lit("S")).alias("c"), digests.anchor_block(F.struct(F.lit("x").alias("id"))).alias("a"), digests.percent(F.lit(0.256)).alias("p")).first()
    assert got.c.endswith("<compacted-summary>\nS\n</compacted-summary>") and json.loads(got.a.split("\n")[1]) == {"id": "x"} and got.p == "25.6%"


def _runs(spark, ids):
    from siltstone.sinks.runlog import format_records

    return format_records(spark.createDataFrame([(k, "p", "m", k == 3, ["bad"]) for k in ids], "at long, provider string, model string, failed boolean, errors array<string>"))


def test_run_log_is_read_as_it_was_written(spark, tmp_path):
    from siltstone.sinks.runlog import append_records, cap_log
    from siltstone.sources.runlog import batches, read_records, recent

    path = f"file://{tmp_path}/log"
    assert read_records(spark, path).count() == 0
    for ids in ([5, 1], [3, 4], [2]):  # the clock goes back and forth
        append_records(_runs(spark, ids).coalesce(1), path)
    whole = tmp_path / "log" / "batch=000000000001" / "part-99999.json"
    whole.write_text('\n{"at": \nnot json\n{"at": 9}\n')
    half = tmp_path / "log" / "batch=000000000009"
    half.mkdir()
    (half / "part-00000.json").write_text('{"at": 77}\n')  # its writer did not finish
    assert [r.at for r in recent(read_records(spark, path), 4).collect()] == [2, 9, 4, 3]
    cap_log(spark, path, 3)
    assert len(batches(spark, path)) == 1 and [r.at for r in recent(read_records(spark, path), 9).collect()] == [2, 9, 4]
    append_records(_runs(spark, [3]), path)
    left = recent(read_records(spark, path), 9).collect()
    assert [r.at for r in left] == [3, 2, 9, 4] and left[0].route == "error" and left[0].error == "bad"
    (tmp_path / "one.jsonl").write_text("".join(f'{{"at": {k}}}\n' for k in (3, 1, 2)))
    assert [r.at for r in recent(read_records(spark, f"file://{tmp_path}/one.jsonl"), 2).collect()] == [2, 1]


def test_the_newest_records_open_the_newest_batches(spark, tmp_path):
    from siltstone.sinks.runlog import append_records, cap_log, format_records
    from siltstone.sources.runlog import newest

    path = f"file://{tmp_path}/log"
    for k in range(12):
        append_records(format_records(spark.createDataFrame([(10 * k + j,) for j in range(5)], "at long")).coalesce(1), path)
    for limit, opened in ((3, 1), (5, 1), (6, 2), (11, 4), (60, 12), (100, 12)):
        found = newest(spark, path, limit)
        assert [r["at"] for r in found.collect()] == [10 * k + j for k in range(11, -1, -1) for j in range(4, -1, -1)][:limit]
        assert len({f.split("/batch=")[1][:12] for f in found.inputFiles()}) == opened
    cap_log(spark, path, 7)
    assert [r["at"] for r in newest(spark, path, 50).collect()] == [114, 113, 112, 111, 110, 104, 103]
    assert newest(spark, f"file://{tmp_path}/none", 5).count() == 0


def test_capped_log_stream(spark, tmp_path):
    from siltstone.sinks.runlog import runlog_sink
    from siltstone.sources.runlog import read_records, recent

    path = f"file://{tmp_path}/log"
    write = runlog_sink(path, 4)
    for epoch, ids in enumerate(([1, 2, 3], [4, 5], [4, 5])):
        write(_runs(spark, ids), min(epoch, 1))  # the second micro-batch is tried again
    assert [r.at for r in recent(read_records(spark, path), 9).collect()] == [5, 4, 3, 2]


def test_cooldown_stream(spark, tmp_path):
    from siltstone.streaming.state import cooldown_stream, pressure_stream

    rows = spark.createDataFrame([("a", 1000, 1.0), ("a", 500, 1.0), ("b", 0, 0.5)], "key string, at_ms long, hours double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = cooldown_stream(stream).writeStream.format("memory").queryName("cool").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.key, r.cooldown_until) for r in spark.table("cool").collect()} == {("a", 3_601_000), ("b", 1_800_000)}
    nodes = spark.createDataFrame([(1, 60), (1, 50), (2, 10)], "session_id long, tokens long")
    nodes.write.parquet(str(tmp_path / "nodes"))
    stream = spark.readStream.schema(nodes.schema).parquet(str(tmp_path / "nodes"))
    q = pressure_stream(stream, 100).writeStream.format("memory").queryName("press").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.session_id, r.total_tokens) for r in spark.table("press").collect()] == [(1, 110)]


def _stream(spark, tmp_path, name, batches, schema, make):
    """The rows that a streaming query puts out over micro-batches that come as files, one at a time."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"in-{k}"))
    (folder / "live").mkdir()
    query = make(spark.readStream.schema(schema).parquet(str(folder / "live"))).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(folder / "ck")).start()
    out = []
    for k in range(len(batches)):
        for f in (folder / f"in-{k}").glob("*.parquet"):
            f.rename(folder / "live" / f"{k}-{f.name}")
        query.processAllAvailable()
        out.append(spark.table(name).count())
    query.stop()
    return spark.table(name).collect(), out


def test_surface_stream_is_the_fold(spark, tmp_path):
    from siltstone.streaming.state import surface_stream

    events = [(1, k, "append", None, 10) for k in range(5)] + [(1, 5, "replace", [1, 2], 7), (1, 6, None, None, 0), (1, 7, "replace", [5, 3], 4), (1, 8, "append", None, 1), (2, 0, "append", None, 3)]
    schema = "session_id long, seq long, op string, covers array<long>, tokens long"
    rows, _ = _stream(spark, tmp_path, "folded", [events[:6], events[4:9], events[9:]], schema, surface_stream)
    want = [r.seq for r in surface.surface_fold(spark.createDataFrame(events[:9], schema)).orderBy("pos").collect()]
    last = [r for r in rows if r.session_id == 1][-1]
    assert last.nodes == want == [0, 7, 4, 8] and last.total_tokens == 25
    assert [(r.nodes, r.total_tokens) for r in rows if r.session_id == 2] == [([0], 3)]


def test_streams_take_ids_of_any_type(spark, tmp_path):
    from siltstone.streaming.state import overflow_stream, pressure_stream, surface_stream

    rows, _ = _stream(spark, tmp_path, "named_pressure", [[("s1", 110)], [("s2", 60)]], "session_id string, tokens long", lambda df: pressure_stream(df, 100))
    assert [tuple(r) for r in rows] == [("s1", 110)]
    rows, _ = _stream(spark, tmp_path, "named_overflow", [[("s1", 1, "overflow")]], "session_id string, seq long, type string", overflow_stream)
    assert [tuple(r) for r in rows] == [("s1", 1, True)]
    rows, _ = _stream(spark, tmp_path, "named_surface", [[("s1", 1, "append", None, 5)]], "session_id string, seq long, op string, covers array<long>, tokens long", surface_stream)
    assert [(r.session_id, list(r.nodes), r.total_tokens) for r in rows] == [("s1", [1], 5)]


def test_overflow_stream_counts_retries(spark, tmp_path):
    from siltstone.streaming.state import overflow_stream

    first = [(1, 0, "overflow"), (1, 1, "overflow"), (2, 0, "overflow")]
    second = [(1, 2, "assistant/message"), (1, 3, "overflow"), (2, 1, "overflow"), (2, 2, "idle"), (2, 3, "other"), (2, 4, "overflow")]
    rows, _ = _stream(spark, tmp_path, "overflows", [first, second], "session_id long, seq long, type string", overflow_stream)
    assert {(r.session_id, r.seq): r.retry for r in rows} == {(1, 0): True, (1, 1): False, (2, 0): True, (1, 3): True, (2, 1): False, (2, 4): True}


def test_pressure_goes_on_from_what_is_retained(spark, tmp_path):
    from siltstone.streaming.state import pressure_stream, surface_tokens

    rows, _ = _stream(spark, tmp_path, "pressure", [[(1, 110)], [(1, 60)], [(1, 15)]], "session_id long, tokens long", lambda df: pressure_stream(df, 100, 30))
    assert [r.total_tokens for r in rows] == [110, 105]
    times = spark.createDataFrame([(1, "2026-01-01 00:00:01", 5), (1, "2026-01-01 00:04:59", 6), (1, "2026-01-01 00:05:00", 7)], "session_id long, ts string, tokens long").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.tokens for r in surface_tokens(times).collect()) == [7, 11]


def test_nested_replacements_and_odd_covers(spark):
    """Pointer jumping against a plain fold, with covers that name what is gone, later or not there."""
    rng = random.Random(11)
    events, want = [], {}
    for session in range(12):
        acc = []
        for seq in range(40):
            covers = None
            if seq and rng.random() < 0.4:
                covers = [rng.randrange(seq + 3) for _ in range(rng.randint(0, 4))]
                gone = [p for p, s in acc if s in covers and s < seq]
                acc = [(p, s) for p, s in acc if s not in covers]
                acc.append((min(gone, default=seq), seq))
            else:
                acc.append((seq, seq))
            events.append((session, seq, "append" if covers is None else "replace", covers))
        want[session] = [s for _, s in sorted(acc)]
    df = spark.createDataFrame(events, "session_id long, seq long, op string, covers array<long>")
    got = surface.surface_fold(df).orderBy("session_id", "pos").collect()
    assert {k: [r.seq for r in got if r.session_id == k] for k in want} == want


def test_outcomes_and_guards(spark):
    with pytest.raises(Exception, match="empty"):
        spark.range(1).select(digests.nonempty(F.lit(""))).collect()
    assert spark.range(1).select(digests.nonempty(F.lit(" "))).first()[0] == " "
    with pytest.raises(Exception, match="empty"):
        spark.range(1).select(digests.nonempty(F.lit(" "), blank_too=True)).collect()


def test_merging_goes_over_the_numbered_material(spark):
    """A line that equals a digest's head inside a digest is a line like others; headers stay."""
    rows = [(1, 0, "SUMMARY:\na\nSUMMARY:\nb"), (1, 1, "SUMMARY:\nb\n\nc"), (2, 0, "SUMMARY:\nalone")]
    got = {r.doc_id: (r.merge_levels, r.summary) for r in digests.merged(spark.createDataFrame(rows, "doc_id long, chunk int, digest string")).collect()}
    assert got == {1: (1, "SUMMARY:\n--- digest 1 ---\nSUMMARY:\na\nb\n--- digest 2 ---\nc"), 2: (0, "SUMMARY:\nalone")}


def test_report_table_and_json(spark):
    rows = spark.createDataFrame([("b", 1, None), ("a long name", 22, 0.5)], "variant string, calls int, recall double")
    table = grading.aligned_table(rows, ["variant", "calls", "recall"], ["variant"]).orderBy("part", "variant").collect()
    assert [r.line for r in table] == ["variant      calls  recall", "-----------  -----  ------", "a long name  22     0.5   ", "b            1            "]
    assert sorted(r.line for r in grading.report_json(rows, ["calls", "recall"]).collect()) == ['{"calls":1,"recall":null}', '{"calls":22,"recall":0.5}']
    assert [r.line for r in grading.aligned_table(rows.limit(0), ["calls"], ["variant"]).orderBy("part").collect()] == ["calls", "-----"]
