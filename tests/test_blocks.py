"""Long documents in blocks: the same results as in one piece."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunks, digests, scans, stage0
from siltstone.plans import queries


def plain_chunks(cost, good, budgets):
    """One document's chunks by a plain walk, line by line."""
    n, start, core, out = len(cost), 0, 0, []
    while start < n:
        budget, overlap = budgets[len(out) % len(budgets)]
        end, used = start, 0
        while end < n and (end == start or used + cost[end] <= budget):
            used += cost[end]
            end += 1
        after = end
        if end < n:
            cut = next((e for e in range(end, max(start + 1, end - chunks.ALIGN_LINES) - 1, -1) if good[e - 1]), end)
            back, held = cut, 0
            while overlap > 0 and back > start and held < overlap:
                back -= 1
                held += cost[back]
            end, after = cut, (back if start < back and overlap > 0 else cut)
        out.append((len(out), len(out) % len(budgets), start, end, core, end, sum(cost[start:end]), sum(cost[core:end])))
        start, core = after, end
    return out


def lines_of(rng, n):
    return [rng.choice(["", "word", "a sentence ends here.", "x" * rng.randint(0, 40), "more, and"]) for _ in range(n)]


def priced(rows):
    cost = [-(-len(x) // 4) + 1 for x in rows]
    good = [not x.strip() or x[-1] in ".?!:;,}])\"'`" for x in rows]
    return cost, good


@pytest.mark.parametrize(("budgets", "block"), [([(5, 1)], 5), ([(9, 2), (13, 0), (7, 6)], 13), ([(30, 9)], 30), ([(30, 9), (20, 4)], 4096), ([(1, 0)], 1), ([(1, 0)], 2)])
def test_chunks_in_blocks_are_the_walk(spark, budgets, block):
    rng = random.Random(block)
    docs = {k: lines_of(rng, rng.choice([1, 2, 3, 7, 40, 150])) for k in range(25)} | {None: lines_of(rng, 60)}
    df = spark.createDataFrame([(d, k, x) for d, rows in docs.items() for k, x in enumerate(rows)], "doc_id long, line_no long, line string").repartition(5)
    got = chunks.chunk_lines(df, budgets, block_lines=block).collect()
    for d, rows in docs.items():
        assert sorted(tuple(r)[1:] for r in got if r.doc_id == d) == plain_chunks(*priced(rows), budgets)


def test_a_million_lines(spark):
    """One document in blocks of 8192 lines: the walk's chunks, and no row that holds more than two blocks."""
    n, budgets = 1_000_000, [(6000, 700), (8000, 100)]
    df = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 7 == 3, F.lit("it ends.")).otherwise(F.repeat(F.lit("y"), (F.col("id") * 31 % 57).cast("int"))).alias("line"))
    got = chunks.chunk_lines(df, budgets, block_lines=8192)
    made = sorted(tuple(r)[1:] for r in got.collect())
    k = np.arange(n)
    size = np.where(k % 7 == 3, 8, k * 31 % 57)
    sums, ends = np.concatenate([[0], np.cumsum(-(-size // 4) + 1)]), (size == 0) | (k % 7 == 3)
    at = core = 0
    for r in made:
        budget, overlap = budgets[r[1]]
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + budget, side="right")) - 1)
        after = end
        if end < n:
            low = max(at + 1, end - chunks.ALIGN_LINES)
            found = np.flatnonzero(ends[low - 1 : end])
            end = low + int(found[-1]) if len(found) else end
            after = max(at, int(np.searchsorted(sums, sums[end] - overlap, side="right")) - 1)
            after = after if after > at else end
        assert r[2:] == (at, end, core, end, sums[end] - sums[at], sums[end] - sums[core])
        at, core = (n, end) if end >= n else (after, end)
    assert at == n and [r[0] for r in made] == list(range(len(made)))
    rows = got._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in rows.lower() and "collect_list" not in rows  # the gathered rows are a written table


def test_gathered_rows_are_bounded(spark, monkeypatch):
    seen = []
    real = chunks.materialise
    monkeypatch.setattr(chunks, "materialise", lambda df: seen.append(real(df)) or seen[-1])
    df = spark.range(5000).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), F.lit("a line.").alias("line"))
    assert chunks.chunk_lines(df, [(60, 7)], block_lines=64).count() > 100
    assert seen[0].agg(F.max(F.size("cost"))).first()[0] == 128
    tables = [t for t in seen if "jumps" in t.columns]
    assert tables and max(t.agg(F.max(F.octet_length("jumps"))).first()[0] for t in tables) == 4 * 64 * 8


ESC = "\x1b"


def plain_steps(rows, **kind):
    """The clean-up of one document by plain loops: a dict of results by operator."""
    import re

    marker = "[condensed: {} lines removed]".format
    dedup = [x for k, x in enumerate(rows) if not k or x != rows[k - 1]]
    stripped = [re.sub(r"\x1b(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])", "", x) for x in rows]
    purge = [x for x in stripped if not re.fullmatch(r"\s*[\^~]{4,}\s*", x) and not re.fullmatch(r"\s*([^\w\s])\1{15,}\s*", x)]

    def blanks(rows):
        out, run = [], 0
        for x in rows:
            run = 0 if x.strip() else run + 1
            if x.strip() or run == 3:
                out.append(x if x.strip() else "")
        while len(out) > 1 and out[-1] == "":
            out.pop()
        return out

    def skeleton(rows, most=2):
        out, inside, run = [], False, 0
        for x in [*rows, None]:
            bare = x is not None and re.fullmatch(r"```\s*", x)
            deep = x is not None and inside and not bare and (len(lead := re.match(r"[ \t]*", x)[0]) + 3 * lead.count("\t")) // 4 > most
            if deep:
                run += 1
                continue
            if run:
                out.append(marker(run))
                run = 0
            if x is None:
                break
            out.append(x)
            if bare:
                inside = not inside
            elif re.fullmatch(r"```[^\s`]*\s*", x):
                inside = True
        return out

    log = lambda x: bool(re.match(r"\S+\s+\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d", x) or re.search(r"\b(INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL)\b", x))

    def runs(rows):
        out, at = [], 0
        for k in range(len(rows) + 1):
            if k == len(rows) or not log(rows[k]):
                if k - at >= 4:
                    out.append((at, k))
                at = k + 1
        return out

    def logs(rows, mode, most):
        head = {"balanced": -(-most // 2), "head": most, "tail": 0}[mode]
        out, at = [], 0
        for a, b in runs(rows):
            if b - a > most:
                out += [*rows[at : a + head], marker(b - a - most), *rows[b - (most - head) : b]]
                at = b
        return out + rows[at:]

    def ends(rows, threshold, head, tail):
        size = [len(x) + 1 for x in rows]
        a = max(1, sum(sum(size[: k + 1]) <= head for k in range(len(rows))))
        b = max(1, sum(sum(size[k:]) <= tail for k in range(len(rows))))
        gone = len(rows) - a - b
        return rows if sum(size) <= threshold or gone <= 0 else [*rows[:a], marker(gone), *rows[len(rows) - b :]]

    whole = logs(skeleton(blanks([re.sub(r"\x1b(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])", "", x) for x in dedup])), "balanced", 3)
    return {"dedup": dedup, "purge": purge, "blanks": blanks(rows), "skeleton": skeleton(rows), "runs": runs(rows), "logs": logs(rows, "balanced", 5), "head": logs(rows, "head", 2), "tail": logs(rows, "tail", 2), "none": logs(rows, "balanced", 0), "ends": ends(rows, 120, 50, 40), "whole": whole}


POOL = ["", " ", "\t", "word", "word", f"{ESC}[31mred{ESC}[0m", "```py", "```", "``` ", "    one", "            deep", "\t\t\tdeep", "                deeper", "INFO a", "svc 2026-01-01 10:00:00 x", "WARN b", "last line of text."]


def noisy_docs(seed, n=40):
    """Documents in which runs of every kind are long enough to cross blocks."""
    rng = random.Random(seed)
    docs = {}
    for k in range(n):
        rows = []
        for _ in range(rng.randint(1, 14)):
            few = rng.sample(POOL, rng.choice([1, 1, 2, 4]))
            rows += [rng.choice(few) for _ in range(rng.choice([1, 2, 3, 5, 9]))]
        docs[k] = rows
    return docs | {n: ["", "", "", ""], n + 1: [""], n + 2: ["", ""], n + 3: ["x"] * 30, n + 4: ["```py", *["            d"] * 20]}


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_clean_up_in_blocks_is_the_plain_loop(spark, block):
    docs = noisy_docs(block)
    df = spark.createDataFrame([(d, k, x) for d, rows in docs.items() for k, x in enumerate(rows)], "doc_id long, line_no long, line string").repartition(5).cache()
    made = {
        "dedup": stage0.dedup_lines(df, block_lines=block), "purge": stage0.purge_noise(df, block_lines=block), "blanks": stage0.skip_blank_blocks(df, block_lines=block), "skeleton": stage0.ast_skeleton(df, block_lines=block),
        "logs": stage0.log_condense(df, "balanced", 5, block_lines=block), "head": stage0.log_condense(df, "head", 2, block_lines=block), "tail": stage0.log_condense(df, "tail", 2, block_lines=block), "none": stage0.log_condense(df, "balanced", 0, block_lines=block),
        "ends": stage0.head_middle_tail(df, 120, 50, 40, block_lines=block), "whole": stage0.run_stage0(df, skeleton_depth=2, log_lines=3, block_lines=block),
    }
    want = {d: plain_steps(rows) for d, rows in docs.items()}
    for name, found in made.items():
        got = {d: [] for d in docs}
        for r in found.orderBy("doc_id", "line_no").collect():
            assert r.line_no == len(got[r.doc_id]), (name, r)
            got[r.doc_id].append(r.line)
        for d in docs:
            assert got[d] == want[d][name], (name, block, docs[d])
    runs = {(r.doc_id, r.run_start, r.run_end) for r in stage0.log_runs(df, block_lines=block).collect()}
    assert runs == {(d, *r) for d in docs for r in want[d]["runs"]}


def test_blocks_bound_what_a_row_holds(spark, monkeypatch):
    seen = []
    real = scans.materialise
    monkeypatch.setattr(scans, "materialise", lambda df: seen.append(real(df)) or seen[-1])
    df = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 50 < 20, "INFO a").otherwise(F.lit("text")).alias("line"))
    got = stage0.run_stage0(df, dedup=False, log_lines=4, block_lines=256)
    assert got.count() == 400 * 35 and got.agg(F.max("line_no")).first()[0] == 400 * 35 - 1
    assert seen[0].agg(F.max(F.size("line"))).first()[0] == 256
    assert all(t.count() <= 79 for t in seen)


def test_own_transforms_take_the_chains_place(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(["a", "a", "", "b"])], "doc_id long, line_no long, line string")
    upper = lambda d: d.withColumn("line", F.upper("line"))
    assert [r.line for r in stage0.run_stage0(df, transforms=[stage0.dedup_lines, upper]).orderBy("line_no").collect()] == ["A", "", "B"]
    assert stage0.run_stage0(df, transforms=[]).count() == 4


@pytest.mark.parametrize("block", [1, 3, 50])
def test_whole_documents_are_cut_where_they_lie(spark, block):
    docs = noisy_docs(block)
    whole = spark.createDataFrame(list(docs.items()), "doc_id long, lines array<string>")
    rows = whole.select("doc_id", F.posexplode("lines").alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
    made = [sorted(map(tuple, f(df, block_lines=block).collect())) for f in (lambda d, **k: stage0.run_stage0(d, skeleton_depth=2, log_lines=3, **k), stage0.log_runs, lambda d, **k: stage0.head_middle_tail(d, 120, 50, 40, **k)) for df in (whole, rows)]
    assert made[0] == made[1] and made[2] == made[3] and made[4] == made[5]


def exchanges(df):
    df.collect()
    return str(df._jdf.queryExecution().executedPlan()).split("Initial Plan")[0].count("Exchange hashpartitioning")


@pytest.mark.parametrize("block", [40, 4096])
def test_chunk_texts_are_the_lines_of_the_chunks(spark, block):
    docs = {k: v * 3 for k, v in noisy_docs(block).items()}
    rows = spark.createDataFrame([(d, k, x) for d, v in docs.items() for k, x in enumerate(v)], "doc_id long, line_no long, line string").repartition(5).cache()
    budgets = [(30, 8), (40, 3)]
    apart = chunks.chunk_text(rows, chunks.chunk_lines(rows, budgets, block_lines=block))
    whole = chunks.chunk_texts(rows, budgets, block_lines=block)
    want = {}
    for r in apart.orderBy("doc_id", "chunk", "line_no").collect():
        want.setdefault((r.doc_id, r.chunk), []).append(r.line)
    assert {(r.doc_id, r.chunk): r.lines for r in whole.collect()} == want
    for persona in (digests.persona_perfect, digests.persona_leak, digests.persona_forgetful):
        assert sorted(map(tuple, persona(apart).collect())) == sorted(map(tuple, persona(whole).collect()))
    plain = spark.range(99).select(F.lit(1).alias("doc_id"), F.lit(0).alias("chunk"), F.col("id").alias("line_no"), F.lit("x").alias("line"))
    assert exchanges(digests.persona_perfect(plain)) == 1


def test_noise_is_numbered_over_rows_that_share_an_id(spark, tmp_path):
    rows = [(1, "a\nb"), (1, "c"), (2, "d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.noisy(spark, str(tmp_path))
    assert got.columns == ["doc_id", "line_no", "line"]
    numbers = sorted(r.line_no for r in got.filter("doc_id = 1").collect())
    assert numbers == list(range(len(numbers)))
    spark.createDataFrame(rows[1:], "doc_id long, text string").write.parquet(f"{tmp_path}/other/documents.parquet")
    assert exchanges(queries.noisy(spark, f"{tmp_path}/other")) == 0
