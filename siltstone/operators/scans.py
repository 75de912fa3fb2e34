"""Line documents in blocks, and steps over them that need to know what lies left and right of a block.

A document's lines are gathered a block, a bounded number of them a row, so no task holds a whole document. A step looks at all lines of an Arrow batch of blocks
at once. What it must know of other blocks (how long the run is that goes on into this one, whether more follows, how many lines there are before) comes from
summaries: each block's is a few numbers, which windows over a document's blocks combine into what enters each block from either side. So a chain of
steps is a round over summaries each, and one pass that writes the lines. Where no document has more than one block, nothing enters any, and the rounds are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import materialise, ship

BLOCK_LINES = 4096
#: Where a line comes from, if not from the text.
MARKER, EMPTY = -1, -2
#: Set where a line equals the one before it.
SAME = 1
#: What enters a block, by kind of scan: the summary's fields, and the names of what enters, which are 0 where there is nothing.
RUNS = (("n", "lead", "trail"), ("offset", "before", "after", "prior", "more", "total"))
PARITY = (("last", "toggles"), ("state",))


def sums(*fields: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """A scan that adds up fields: of each what lies before the block, what lies behind it, and the whole."""
    return fields, tuple(f"{f}_{side}" for f in fields for side in ("before", "behind", "all"))


@dataclass
class Lines:
    """The lines of several blocks, one after the other: block of each, its place in the block's text (or what it is instead), marker's count, flags, depth, size."""

    blocks: int
    seg: np.ndarray
    src: np.ndarray
    mark: np.ndarray
    flag: np.ndarray
    depth: np.ndarray
    size: np.ndarray

    def __post_init__(self):
        self.n = np.bincount(self.seg, minlength=self.blocks)
        self.end = np.cumsum(self.n)
        self.start = self.end - self.n
        self.at = np.arange(len(self.seg))

    def has(self, bit: int) -> np.ndarray:
        return (self.flag & bit) != 0

    def keep(self, which: np.ndarray) -> Lines:
        return Lines(self.blocks, *(x[which] for x in (self.seg, self.src, self.mark, self.flag, self.depth, self.size)))

    def put(self, which: np.ndarray, src: int, mark: np.ndarray | int = 0, flag: int = 0, size: np.ndarray | int = 1) -> Lines:
        """These lines become markers or empty ones."""
        out = [x.copy() for x in (self.src, self.mark, self.flag, self.depth, self.size)]
        for x, v in zip(out, (src, mark, flag, 0, size), strict=True):
            x[which] = v[which] if isinstance(v, np.ndarray) else v
        return replace(self, src=out[0], mark=out[1], flag=out[2], depth=out[3], size=out[4])

    def latest(self, which: np.ndarray) -> np.ndarray:
        """For each line the last one up to it in its block that is in ``which``, else -1."""
        found = np.maximum.accumulate(np.where(which, self.at, -1)) if len(self.at) else self.at
        return np.where(found >= self.start[self.seg], found, -1)

    def coming(self, which: np.ndarray) -> np.ndarray:
        """For each line the first one from it on in its block that is in ``which``, else the block's end."""
        none = len(self.at)
        found = np.minimum.accumulate(np.where(which, self.at, none)[::-1])[::-1] if none else self.at
        return np.minimum(found, self.end[self.seg])

    def sum_in_block(self, values: np.ndarray) -> np.ndarray:
        """Sums of values up to each line, itself included, from its block's start."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[1:] - total[self.start[self.seg]]

    def per_block(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.seg, weights=values, minlength=self.blocks).astype(np.int64)

    def edges(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A block's lines, and how many at its start and at its end are in ``which``: the summary of a scan over runs."""
        other = np.flatnonzero(~which)
        first, last = self.end.copy(), self.start - 1
        first[self.seg[other][::-1]] = other[::-1]
        last[self.seg[other]] = other
        return self.n, first - self.start, self.end - 1 - last

    def place_in_run(self, which: np.ndarray, c: Entering) -> tuple[np.ndarray, np.ndarray]:
        """For lines in ``which``: their place in their run, from 1, and the run's size, over block borders."""
        before = self.latest(~which)
        at = np.where(before >= 0, self.at - before, self.at - self.start[self.seg] + 1 + c.of(self, "before"))
        stop = self.coming(~which)
        return at, at - 1 + stop - self.at + np.where(stop == self.end[self.seg], c.of(self, "after"), 0)


class Entering:
    """What enters the blocks of a batch, by name."""

    def __init__(self, values: dict[str, np.ndarray], prefix: str):
        self.values, self.prefix = values, prefix

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[f"{self.prefix}{name}"]

    def of(self, x: Lines, name: str) -> np.ndarray:
        """Of each line's block."""
        return self[name][x.seg]


class Step:
    """One operator over lines. scan: the kind of scan that it needs, or None; summary(): a block's fields for it; apply(): the lines that it leaves."""

    scan: tuple[Sequence[str], Sequence[str]] | None = None

    def summary(self, x: Lines) -> Sequence[np.ndarray]:
        raise NotImplementedError

    def apply(self, x: Lines, c: Entering) -> Lines:
        return x


class Number(Step):
    """Counts lines, so that each block knows how many there are before it."""

    scan = sums("n")

    def summary(self, x: Lines) -> Sequence[np.ndarray]:
        return (x.n,)


Told = Callable[[Column], tuple[Column, Column, Column]]


def _row(line: Column, seen: Column, told: Told) -> list[Column]:
    flag, depth, size = told(seen)
    return [line.alias("line"), flag.cast("int").alias("flag"), depth.cast("int").alias("depth"), size.cast("long").alias("size")]


def gather(df: DataFrame, seen: Callable[[Column], Column], told: Told, block_lines: int) -> DataFrame:
    """(doc_id, block, line, flag, depth, size, alone): arrays of a block's lines in order, from (doc_id, line_no, line); written once. seen: what is looked at of a line; told: flag, depth and size of that. alone: known to be a whole document."""
    row = F.struct(F.col("line_no"), *_row(F.col("line"), seen(F.col("line")), told))
    rows = df.select("doc_id", F.floor(F.col("line_no") / block_lines).cast("long").alias("block"), row.alias("r"))
    return _written(rows.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list("r")).alias("r"), F.lit(False).alias("alone")))


def cut(df: DataFrame, seen: Callable[[Column], Column], told: Told, block_lines: int) -> DataFrame:
    """As gather(), from (doc_id, lines): a document's lines, one row an id. Nothing moves."""
    last = F.greatest(F.lit(0), F.size("lines") - 1)
    blocks = df.select("doc_id", "lines", F.explode(F.sequence(F.lit(0), F.floor(last / block_lines).cast("int"))).alias("block"))
    # a document of one block is taken as it is
    part = F.when(F.size("lines") <= block_lines, F.col("lines")).otherwise(F.slice("lines", F.col("block") * block_lines + 1, block_lines))
    parts = blocks.select("doc_id", F.col("block").cast("long").alias("block"), part.alias("part"), (F.size("lines") <= block_lines).alias("alone"))
    both = F.transform("part", lambda x: F.struct(x.alias("line"), seen(x).alias("seen")))
    return _written(parts.select("doc_id", "block", F.transform(both, lambda x: F.struct(*_row(x["line"], x["seen"], told))).alias("r"), "alone"))


def _written(rows: DataFrame) -> DataFrame:
    same = lambda x, k: x["flag"] + F.when((k > 0) & (x["line"] == F.get("r", k - 1)["line"]), SAME).otherwise(0)
    return materialise(rows.select("doc_id", "block", F.col("r.line").alias("line"), F.transform("r", same).alias("flag"), F.col("r.depth").alias("depth"), F.col("r.size").alias("size"), "alone"))


def _entering(summary: DataFrame, kind: tuple, prefix: str) -> DataFrame:
    """(_doc, _block, and what enters it), from (doc_id, block, fields)."""
    fields, names = kind
    order = Window.partitionBy("doc_id").orderBy("block")
    left, right, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("doc_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    if kind is RUNS:
        s = summary.withColumns({"g": zero(F.sum("n").over(left)), "t": F.sum("n").over(whole)})
        broken = F.col("lead") < F.col("n")
        s = s.withColumns({"stop": F.max(F.when(broken, F.col("g") + F.col("n") - F.col("trail"))).over(left), "go": F.min(F.when(broken, F.col("g") + F.col("lead"))).over(right)})
        values = [F.col("g"), F.col("g") - zero(F.col("stop")), F.coalesce("go", "t") - F.col("g") - F.col("n"), F.col("stop").isNotNull().cast("long"), F.col("go").isNotNull().cast("long"), F.col("t")]
    elif kind is PARITY:
        # toggles counts on; a block that ends in a known state says what to add from there on
        s = summary.withColumn("p", F.sum("toggles").over(order))
        s = s.withColumn("base", F.when(F.col("last") >= 0, F.col("last") - F.col("p")))
        values = [F.pmod(zero(F.last("base", ignorenulls=True).over(left)) + zero(F.sum("toggles").over(left)), F.lit(2))]
        s = s.withColumn("state", values[0])
        values = [F.col("state")]
    else:
        s = summary
        values = [zero(F.sum(f).over(w)) for f in fields for w in (left, right, whole)]
    return s.select(F.col("doc_id").alias("_doc"), F.col("block").alias("_block"), *[v.cast("long").alias(f"{prefix}{n}") for v, n in zip(values, names, strict=True)])


def _joined(blocks: DataFrame, entering: DataFrame) -> DataFrame:
    return blocks.join(entering.hint("shuffle_hash"), blocks["doc_id"].eqNullSafe(entering["_doc"]) & (blocks["block"] == entering["_block"])).drop("_doc", "_block")


def _lines(batch: pa.RecordBatch) -> Lines:
    flag, depth, size = (batch.column(batch.schema.get_field_index(c)) for c in ("flag", "depth", "size"))
    n = flag.value_lengths().to_numpy(zero_copy_only=False)
    seg = np.repeat(np.arange(len(n)), n)
    src = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    return Lines(len(n), seg, src, np.zeros(len(seg), dtype=np.int64), *(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (flag, depth, size)))


def _known(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names) if name[0] == "s" and ":" in name}


def _applied(x: Lines, steps: Sequence[Step], known: dict[str, np.ndarray]) -> Lines:
    if "s:same" in known:
        first = x.start[x.n > 0]
        x = replace(x, flag=x.flag.copy())
        x.flag[first] |= np.where(known["s:same"][x.n > 0] > 0, SAME, 0)
    for k, step in enumerate(steps):
        x = step.apply(x, Entering(known, f"s{k}:"))
    return x


def prepare(blocks: DataFrame, steps: Sequence[Step], same: bool) -> DataFrame:
    """blocks with what enters each for every step, a round over summaries for each step that asks; same: also whether a block's first line equals the last one before it."""
    ship(blocks.sparkSession)
    names = ["s:same"] * same + [f"s{k}:{n}" for k, s in enumerate(steps) if s.scan for n in s.scan[1]]
    # blocks that are whole documents: nothing enters, and finish() fills in totals
    entered = lambda df: df.withColumns({n: F.lit(0).cast("long") for n in names} | {"s:alone": F.lit(1).cast("long")}).drop("alone")
    if not (blocks.agg(F.max("block")).first()[0] or 0):
        return entered(blocks)
    whole, blocks = entered(blocks.filter("alone")), blocks.filter("not alone").drop("alone")
    kind = blocks.schema["doc_id"].dataType
    known = blocks.select("doc_id", "block")
    if same:
        ends = blocks.select("doc_id", "block", F.get("line", F.lit(0)).alias("a"), F.element_at("line", -1).alias("b"))
        before = F.lag("b").over(Window.partitionBy("doc_id").orderBy("block"))
        known = ends.select("doc_id", "block", F.coalesce(before == F.col("a"), F.lit(False)).cast("long").alias("s:same"))
    known = materialise(known)
    narrow = blocks.select("doc_id", "block", "flag", "depth", "size")
    for k, step in enumerate(steps):
        if not step.scan:
            continue
        schema = T.StructType([T.StructField("doc_id", kind), T.StructField("block", T.LongType()), *[T.StructField(f, T.LongType()) for f in step.scan[0]]])

        def summarise(it: Iterator[pa.RecordBatch], k=k, step=step, schema=schema) -> Iterator[pa.RecordBatch]:
            for batch in it:
                found = step.summary(_applied(_lines(batch), steps[:k], _known(batch)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.asarray(v, dtype=np.int64)) for v in found)], names=schema.names)

        entering = known.withColumnsRenamed({"doc_id": "_doc", "block": "_block"})
        summary = materialise(_joined(narrow, entering).mapInArrow(summarise, schema))
        known = materialise(_joined(known, _entering(summary, step.scan, f"s{k}:")))
    found = _joined(blocks, known.withColumnsRenamed({"doc_id": "_doc", "block": "_block"})).withColumn("s:alone", F.lit(0).cast("long"))
    return found.unionByName(whole)


def _totals(x: Lines, steps: Sequence[Step], known: dict[str, np.ndarray]) -> Lines:
    """As _applied(), with the totals of blocks that are whole documents."""
    alone = known["s:alone"] > 0
    if not alone.any():
        return _applied(x, steps, known)
    x = _applied(x, [], known)
    for k, step in enumerate(steps):
        if step.scan and step.scan is not PARITY:
            found = dict(zip(step.scan[0], step.summary(x), strict=True))
            for f, v in found.items():
                name = f"s{k}:total" if step.scan is RUNS and f == "n" else f"s{k}:{f}_all"
                known[name] = np.where(alone, np.asarray(v, dtype=np.int64), known.get(name, 0))
        x = step.apply(x, Entering(known, f"s{k}:"))
    return x


def finish(prepared: DataFrame, steps: Sequence[Step], rows: Callable[[pa.RecordBatch, Lines, dict[str, np.ndarray]], list[pa.Array]], schema: T.StructType) -> DataFrame:
    """What rows() makes of each batch's blocks and the lines that the steps leave."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            known = _known(batch)
            yield pa.RecordBatch.from_arrays(rows(batch, _totals(_lines(batch), steps, known), known), names=schema.names)

    return prepared.mapInArrow(run, schema)


def lines_out(prepared: DataFrame, steps: Sequence[Step], marker: Callable[[np.ndarray], list[str]]) -> DataFrame:
    """(doc_id, line_no, line): the lines that the steps leave, numbered from 0; the last step counts them."""
    kind, last = prepared.schema["doc_id"].dataType, len(steps) - 1
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType())])

    def rows(batch: pa.RecordBatch, x: Lines, known: dict[str, np.ndarray]) -> list[pa.Array]:
        text = batch.column(batch.schema.get_field_index("line"))
        n = text.value_lengths().to_numpy(zero_copy_only=False)
        values, first = text.flatten(), (np.cumsum(n) - n)[x.seg]
        marked = np.flatnonzero(x.src == MARKER)
        own = pa.array([*marker(x.mark[marked]), ""], type=values.type)
        place = np.where(x.src >= 0, first + x.src, len(values) + len(own) - 1)
        place[marked] = len(values) + np.arange(len(marked))
        number = x.at - x.start[x.seg] + known[f"s{last}:n_before"][x.seg]
        return [batch.column(0).take(pa.array(x.seg)), pa.array(number.astype(np.int64)), pa.concat_arrays([values, own]).take(pa.array(place))]

    return finish(prepared, steps, rows, schema)
