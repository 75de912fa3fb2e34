"""Model-sized overlapping chunks of line documents.

A chunk starts where the one before says. Blocks of lines are cut by binary searches over prefix sums in an Arrow-batched function; where a document has several, tables that say
how each one is left, for any line where it may be entered, are composed by doubling. Everything before and after is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import budget
from siltstone.functions.text import TokenCost, boundary, chars4, line_cost
from siltstone.session import materialise, ship

ALIGN_LINES = 12
SPLIT_DEPTH = 4
#: Lines of a document that meet chunks together.
BLOCK_LINES = 32
#: Lines of a document that are sliced together.
SLICE_LINES = 4096

SLICES = "doc_id {key}, chunk int, route int, line_start long, line_end long, core_start long, core_end long, tokens long, core_tokens long"


def next_starts(sums: np.ndarray, good: np.ndarray, tokens: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, next start) of the chunk from every line at once: sums has a leading 0, good[i] tells whether line i is a place to cut after."""
    n = len(good)
    start = np.arange(n)
    end = np.maximum(start + 1, np.searchsorted(sums, sums[:-1] + tokens, side="right") - 1)
    place = np.maximum.accumulate(np.where(good, np.arange(1, n + 1), 0)) if n else start  # the last good cut up to each line
    cut = place[np.minimum(end, n) - 1]
    aligned = np.where(cut >= np.maximum(start + 1, end - ALIGN_LINES), cut, end)
    after = aligned
    if overlap > 0:
        back = np.searchsorted(sums, sums[np.minimum(aligned, n)] - overlap, side="right") - 1
        back = np.maximum(start, np.minimum(aligned, back))
        after = np.where(back > start, back, aligned)
    whole = end >= n
    return np.where(whole, n, aligned), np.where(whole, n, after)


class Block:
    """A block of a document's lines with the lines after it that its chunks may reach, and the chunks from each of its lines on every route."""

    def __init__(self, first: int, own: int, cost: np.ndarray, good: np.ndarray, budgets: list[tuple[int, int]]):
        self.first, self.own = first, own
        self.sums = np.concatenate([[0], np.cumsum(cost)])
        self.steps = [next_starts(self.sums, good, *b) for b in budgets]

    def jumps(self) -> np.ndarray:
        """(4, routes, own lines): for each entry line and route the line where the block is left, the route then, the chunks begun until then, and the end of the last one.

        Found by pointer doubling inside the block.
        """
        routes, own = len(self.steps), self.own
        end = np.stack([e[:own] for e, _ in self.steps])
        line = np.stack([a[:own] for _, a in self.steps])
        route = np.repeat((np.arange(routes) + 1) % routes, own).reshape(routes, own)
        count = np.ones_like(line)
        while (inside := line < own).any():
            r, k = route[inside], line[inside]
            moved = line[r, k], route[r, k], count[inside] + count[r, k], end[r, k]
            line[inside], route[inside], count[inside], end[inside] = moved
        return np.stack([line + self.first, route, count, end + self.first])

    def chunks(self, entry: int, core: int, number: int) -> Iterator[tuple]:
        """The chunks that begin in the block when it is entered at a line, with a core that begins at ``core``, as the document's chunk ``number``."""
        at, core = entry - self.first, core - self.first
        while at < self.own:
            route = number % len(self.steps)
            end, after = (int(x[at]) for x in self.steps[route])
            yield (number, route, at + self.first, end + self.first, core + self.first, end + self.first, int(self.sums[end] - self.sums[at]), int(self.sums[end] - self.sums[core]))
            at, core, number = after, end, number + 1


def _compose(first: np.ndarray, second: np.ndarray, start: int, own: int) -> np.ndarray:
    """The jumps over two stretches of blocks; second begins at line ``start`` and has ``own`` entry lines. Jumps that leave the document stay."""
    line, route, count, end = first
    out = first.copy()
    inside = line < start + own
    r, k = route[inside], line[inside] - start
    out[0][inside], out[1][inside], out[2][inside], out[3][inside] = second[0][r, k], second[1][r, k], count[inside] + second[2][r, k], second[3][r, k]
    return out


def chunk_lines(lines: DataFrame, budgets: list[tuple[int, int]], cost: TokenCost = chars4, *, block_lines: int = SLICE_LINES) -> DataFrame:
    """doc_id, chunk, route, line_start, line_end, core_start, core_end, tokens, core_tokens (half open, from 0).

    budgets: (chunk tokens, overlap tokens) of the routes that take turns; chunk k goes to route k modulo their number. Cores tile the document. Lines are numbered from 0 without
    gaps. A line costs a token at least, so a chunk has no more lines than its budget has tokens.

    A number and a flag a line are gathered a block; a block has block_lines lines, or the largest budget if that is more, and so reaches into the next block at most, whose
    numbers it holds too. Of documents with several blocks, each one maps its entry lines to where it is left (a jump table); tables are composed by doubling, so the entries of
    2**k blocks are known after k rounds; then each block cuts its own chunks. No row and no task holds a whole document. Null ids are one document.
    """
    return _cut(lines, budgets, cost, block_lines)


def chunk_texts(lines: DataFrame, budgets: list[tuple[int, int]], cost: TokenCost = chars4, *, block_lines: int = SLICE_LINES) -> DataFrame:
    """(doc_id, chunk, lines): the lines of every chunk in order, overlaps included, as chunk_text() of chunk_lines() has them a row each. They are cut where a block is sliced, so lines move once, when blocks are gathered."""
    return _cut(lines, budgets, cost, block_lines, True).select("doc_id", "chunk", "lines")


def _cut(lines: DataFrame, budgets: list[tuple[int, int]], cost: TokenCost, block_lines: int, texts: bool = False) -> DataFrame:
    ship(lines.sparkSession)
    size = max(block_lines, *(t for t, _ in budgets))
    kind = lines.schema["doc_id"].dataType
    held = ["line"] * texts
    priced = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), line_cost(F.col("line"), cost).alias("cost"), boundary(F.col("line")).alias("good"), *held)
    block = F.expr(f"line_no div {size}")
    # a block's numbers, and a copy for the block before, which reaches into it
    dealt = priced.withColumn("block", F.explode(F.when(block > 0, F.array(block, block - 1)).otherwise(F.array(block))))
    rows = dealt.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("line_no", "cost", "good", *held))).alias("rows"))
    rows = materialise(rows.select("doc_id", "block", F.col("rows.cost").alias("cost"), F.col("rows.good").alias("good"), *[F.col("rows.line").alias("texts")] * texts))
    last = rows.agg(F.max("block")).first()[0] or 0
    columns = ["doc_id", "block", "cost", "good", "line", "number", "core", *["texts"] * texts]
    first = rows.withColumns({c: F.lit(0).cast("long") for c in ("line", "number", "core")}).select(*columns)
    if last:
        # every document's first block is entered at its first line; only the other blocks of long ones have to be told
        others = rows.filter("block > 0")
        long = others.select(F.col("doc_id").alias("_long")).distinct()
        numbers = rows.drop("texts")
        entries = _entries(materialise(numbers.join(long, numbers["doc_id"].eqNullSafe(long["_long"]), "left_semi")), budgets, size, kind, int(last))
        others = others.join(entries, others["doc_id"].eqNullSafe(entries["_doc"]) & (others["block"] == entries["_block"]))
        rows = first.filter("block = 0").unionByName(others.select(*columns))
    else:
        rows = first
    schema = T.StructType.fromDDL(SLICES.format(key=kind.simpleString()) + ", lines array<string>" * texts)

    def run(it):
        import pyarrow as pa

        for batch in it:
            source, out = [], []
            for k in range(batch.num_rows):
                held = _block(batch, k, size, budgets)
                line, number, core = (batch.column(c)[k].as_py() for c in (4, 5, 6))
                found = list(held.chunks(line, core, number))
                source += [k] * len(found)
                out += found
            columns = list(zip(*out, strict=True)) or [()] * 8
            more = [_ranges(batch.column(7), source, [x[2] - batch.column(1)[k].as_py() * size for k, x in zip(source, out, strict=True)], [x[3] - x[2] for x in out])] if texts else []
            arrays = [batch.column(0).take(pa.array(source, pa.int64())), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:]), *more]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def _ranges(lists, source: list[int], begin: list[int], count: list[int]):
    """Lists of ``count`` elements from place ``begin`` of the lists at ``source``."""
    import pyarrow as pa

    count = np.array(count, dtype=np.int64)
    ends = np.cumsum(count)
    at = lists.offsets.to_numpy()[np.array(source, dtype=np.int64)] + np.array(begin, dtype=np.int64)
    place = np.arange(int(count.sum())) + np.repeat(at - (ends - count), count)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), lists.values.take(pa.array(place)))


def _block(batch, k: int, size: int, budgets: list[tuple[int, int]]) -> Block:
    """Row k of (doc_id, block, cost, good, ...)."""
    number = batch.column(1)[k].as_py()
    cost, good = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3))
    return Block(number * size, min(size, len(cost)), cost, good, budgets)


def _entries(rows: DataFrame, budgets: list[tuple[int, int]], size: int, kind: T.DataType, last: int) -> DataFrame:
    """(_doc, _block, line, number, core): where each block is entered, as which chunk of the document, and where that chunk's core begins; blocks that no chunk begins in are left out.

    Round k composes each block's table with that of the block 2**k further, so tables of one block's size move log2(blocks) times.
    """
    routes = len(budgets)
    table = T.StructType([T.StructField("_doc", kind), T.StructField("_block", T.LongType()), T.StructField("jumps", T.BinaryType())])
    entry = T.StructType([T.StructField("_doc", kind), *[T.StructField(c, T.LongType()) for c in ("_block", "line", "number", "core")]])

    def own(it):
        import pyarrow as pa

        for batch in it:
            jumps = [_block(batch, k, size, budgets).jumps().astype("<i8").tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(jumps, pa.binary())], names=table.names)

    def array(raw) -> np.ndarray:
        return np.frombuffer(raw, dtype="<i8").reshape(4, routes, -1)

    def pairs(it):
        import pyarrow as pa

        for batch in it:
            at, a, b = batch.column(3).to_pylist(), batch.column(2), batch.column(4)
            out = [x.as_py() if far is None else _compose(array(x.as_py()), array(y.as_py()), far * size, array(y.as_py()).shape[2]).tobytes() for far, x, y in zip(at, a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=table.names)

    def enter(step):
        def run(it):
            import pyarrow as pa

            for batch in it:
                found = []
                for k, (block, line, number, core, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                    jumps = array(raw)
                    at = line - block * size
                    if at < jumps.shape[2]:
                        line, _, count, core = (int(x) for x in jumps[:, number % routes, at])
                        found.append((k, block + step, line, number + count, core))
                columns = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], names=entry.names)

        return run

    tables = materialise(rows.mapInArrow(own, table))
    known = rows.filter("block = 0").select(F.col("doc_id").alias("_doc"), F.col("block").alias("_block"), *[F.lit(0).cast("long").alias(c) for c in ("line", "number", "core")])
    step = 1
    while step <= last:
        known = materialise(known)
        same = known.select(F.col("_doc").alias("_d"), F.col("_block").alias("_b"), "line", "number", "core")
        far = same.join(tables, F.col("_d").eqNullSafe(F.col("_doc")) & (F.col("_b") == F.col("_block"))).select("_doc", "_block", "line", "number", "core", "jumps")
        ends = rows.select(F.col("doc_id").alias("_e"), F.col("block").alias("_to"))
        found = far.mapInArrow(enter(step), entry)
        found = found.join(ends, F.col("_doc").eqNullSafe(F.col("_e")) & (F.col("_block") == F.col("_to")), "left_semi")
        known = known.unionByName(found)
        if 2 * step <= last:
            # a table that the document's end cuts off has no partner and stays
            other = tables.select(F.col("_doc").alias("_d"), F.col("_block").alias("_far"), F.col("jumps").alias("more"))
            paired = tables.join(other, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_block") + step == F.col("_far")), "left")
            tables = materialise(paired.select("_doc", "_block", "jumps", "_far", "more").mapInArrow(pairs, table))
        step *= 2
    return materialise(known)


def budgets_of(windows: list[int], ratio: float = budget.CHUNK_RATIO, overlap: float = budget.OVERLAP_RATIO) -> list[tuple[int, int]]:
    return [(budget.py_chunk(w, ratio), int(budget.py_chunk(w, ratio) * overlap)) for w in windows]


def digest_caps(chunks: DataFrame, usable: int) -> DataFrame:
    """chunks with cap_tokens: shares of the merge input in proportion to the cores, one at least, rescaled if they exceed it."""
    whole = Window.partitionBy("doc_id")
    share = F.greatest(F.lit(1), F.floor(F.lit(usable) * F.col("core_tokens") / F.greatest(F.lit(1), F.sum("core_tokens").over(whole)))).cast("long")
    total = F.sum("_cap").over(whole)
    scaled = F.when(total > usable, F.greatest(F.lit(1), F.floor(F.col("_cap") * (F.lit(usable) / total)))).otherwise(F.col("_cap"))
    return chunks.withColumn("_cap", share).withColumn("cap_tokens", scaled.cast("long")).drop("_cap")


def _inside(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines with the columns of every chunk that they are in. Both are joined by document and block of lines, so a line meets only chunks that touch its block, however long the document is."""
    block = lambda c: F.floor(c / BLOCK_LINES).cast("long")
    touched = chunks.withColumn("_block", F.explode(F.sequence(block(F.col("line_start")), block(F.col("line_end") - 1))))
    met = lines.withColumn("_block", block(F.col("line_no"))).join(touched, ["doc_id", "_block"])
    return met.filter((F.col("line_no") >= F.col("line_start")) & (F.col("line_no") < F.col("line_end"))).drop("_block")


def chunk_text(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk, line_no, line): the lines of every chunk, overlaps included."""
    return _inside(lines, chunks.select("doc_id", "chunk", "line_start", "line_end")).select("doc_id", "chunk", "line_no", "line")


def split_halves(lines: DataFrame, chunks: DataFrame, cost: TokenCost = chars4) -> DataFrame:
    """(doc_id, chunk, half, line_start, line_end, tokens, cap_tokens): chunks in two by lines, tokens and cap by line cost; those that cannot shrink are left out."""
    mid = F.greatest(F.lit(1), F.floor((F.col("line_end") - F.col("line_start")) / 2)).cast("long")
    whole = chunks.filter(F.col("line_end") - F.col("line_start") >= 2).withColumn("_mid", F.col("line_start") + mid)
    keys = ["doc_id", "chunk", "line_start", "line_end", "_mid", "tokens", "cap_tokens"]
    priced = lines.select("doc_id", "line_no", line_cost(F.col("line"), cost).alias("_cost"))
    first = F.col("line_no") < F.col("_mid")
    sums = _inside(priced, whole.select(*keys)).groupBy(*keys).agg(F.sum(F.when(first, F.col("_cost")).otherwise(0)).alias("_a"), F.sum(F.when(first, 0).otherwise(F.col("_cost"))).alias("_b"))
    measure = F.greatest(F.lit(1), F.col("_a") + F.col("_b"))
    half = lambda no, a, b, s: F.struct(F.lit(no).alias("half"), a.alias("s"), b.alias("e"), F.floor(F.col("tokens") * s / measure).cast("long").alias("t"), F.greatest(F.lit(1), F.floor(F.col("cap_tokens") * s / measure)).cast("long").alias("c"))
    halves = F.array(half(1, F.col("line_start"), F.col("_mid"), F.col("_a")), half(2, F.col("_mid"), F.col("line_end"), F.col("_b")))
    sound = ~F.exists("h", lambda x: (x["t"] < 1) | (x["t"] >= F.col("tokens")))
    return sums.withColumn("h", halves).filter(sound).select("doc_id", "chunk", F.explode("h").alias("h")).select("doc_id", "chunk", "h.half", F.col("h.s").alias("line_start"), F.col("h.e").alias("line_end"), F.col("h.t").alias("tokens"), F.col("h.c").alias("cap_tokens"))
