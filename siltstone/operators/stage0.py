"""Deterministic clean-up of line documents: each operator maps (doc_id, line_no, line) to the same columns, renumbered.

Operators are steps over blocks of lines (``scans``), so a document may be longer than a task should hold, and a chain of operators moves the lines once. What a line is (blank, noise,
a fence, a log line, how deep) is told by column expressions when the blocks are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import SPACE, blank, length16
from siltstone.operators import scans
from siltstone.operators.scans import BLOCK_LINES, EMPTY, MARKER, SAME, Entering, Lines, Step

# Fixed patterns: they say what noise, rules, fences, stamps and levels are. White space is spelt out, as engines differ in what they take for it.
ANSI = "\\x1B(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])"
CURSOR = f"\\A[{SPACE}]*[\\^~]{{4,}}[{SPACE}]*\\z"
RULE = f"\\A[{SPACE}]*([^{SPACE}a-zA-Z0-9_])\\1{{15,}}[{SPACE}]*\\z"
FENCE = f"\\A```[^{SPACE}`]*[{SPACE}]*\\z"
BARE = f"\\A```[{SPACE}]*\\z"
STAMP = f"\\A[^{SPACE}]+[{SPACE}]+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}"
LEVELS = ("INFO", "WARN", "WARNING", "ERROR", "DEBUG", "TRACE", "FATAL")
LEVEL = f"(?<![a-zA-Z0-9_])(?:{'|'.join(LEVELS)})(?![a-zA-Z0-9_])"
BLANK_RUN = 3
LOG_RUN = 4
ESCAPE = "\x1b"
#: What lines are, besides SAME.
NOISE, BLANK, CLOSES, OPENS, LOG, DEEP, HEAD, TAIL = (1 << k for k in range(1, 9))


def marker(removed: Column) -> Column:
    return F.concat(F.lit("[condensed: "), removed.cast("string"), F.lit(" lines removed]"))


def markers(removed: np.ndarray) -> list[str]:
    """As marker(), for lines that steps make."""
    return [f"[condensed: {n} lines removed]" for n in removed.tolist()]


def _marker_size(removed: np.ndarray) -> np.ndarray:
    return np.char.str_len(np.array(markers(removed), dtype=str)) + 1 if len(removed) else removed


class Dedup(Step):
    """Without lines that equal the line before. It stands first, as it compares what was gathered."""

    def apply(self, x: Lines, c: Entering) -> Lines:
        return x.keep(~x.has(SAME))


class Purge(Step):
    """Without cursor lines and rules; escapes are stripped from what is left."""

    def apply(self, x: Lines, c: Entering) -> Lines:
        return x.keep(~x.has(NOISE))


class Blanks(Step):
    scan = scans.RUNS

    def summary(self, x: Lines) -> Sequence[np.ndarray]:
        return x.edges(x.has(BLANK))

    def apply(self, x: Lines, c: Entering) -> Lines:
        empty = x.has(BLANK)
        place, _ = x.place_in_run(empty, c)
        more = (x.coming(~empty) < x.end[x.seg]) | (c.of(x, "more") > 0)
        some = (x.per_block(~empty) > 0) | (c["prior"] > 0) | (c["more"] > 0)
        third = empty & (place == BLANK_RUN) & (more | ~some[x.seg])
        return x.put(third, EMPTY, flag=BLANK).keep(~empty | third)


class Fences(Step):
    """Marks lines inside fences that are deeper than max_depth."""

    scan = scans.PARITY

    def __init__(self, max_depth: int):
        self.max_depth = max_depth

    def summary(self, x: Lines) -> Sequence[np.ndarray]:
        bare, opener = x.has(CLOSES), x.has(OPENS)
        last = np.full(x.blocks, -1)
        toggles = x.per_block(bare)
        at = np.flatnonzero(opener)
        last[x.seg[at]] = at
        after = toggles - np.where(last >= 0, x.sum_in_block(bare)[last] if len(x.at) else 0, 0)
        return np.where(last >= 0, (1 + after) % 2, -1), toggles

    def apply(self, x: Lines, c: Entering) -> Lines:
        bare = x.has(CLOSES)
        upto = x.sum_in_block(bare)
        # the opener before a line, itself not included
        opener = np.concatenate([[-1], x.latest(x.has(OPENS))[:-1]]) if len(x.at) else x.at
        opener = np.where(opener >= x.start[x.seg], opener, -1)
        past = upto - bare
        inside = np.where(opener >= 0, 1 + past - upto[opener], c.of(x, "state") + past) % 2 == 1
        deep = inside & ~bare & (x.depth > self.max_depth)
        return Lines(x.blocks, x.seg, x.src, x.mark, x.flag & ~DEEP | np.where(deep, DEEP, 0), x.depth, x.size)


class Collapse(Step):
    """A run of deep lines becomes a marker where it begins."""

    scan = scans.RUNS

    def summary(self, x: Lines) -> Sequence[np.ndarray]:
        return x.edges(x.has(DEEP))

    def apply(self, x: Lines, c: Entering) -> Lines:
        deep = x.has(DEEP)
        place, size = x.place_in_run(deep, c)
        first = deep & (place == 1)
        return x.put(first, MARKER, mark=size, size=_spread(first, size)).keep(~deep | first)


def _spread(which: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """The markers' sizes, at their lines."""
    out = np.zeros(len(which), dtype=np.int64)
    out[which] = _marker_size(removed[which])
    return out


class Logs(Step):
    """Runs of log lines longer than max_lines keep their head, tail or both around a marker."""

    scan = scans.RUNS

    def __init__(self, mode: str = "balanced", max_lines: int = 200):
        self.head = {"balanced": -(-max_lines // 2), "head": max_lines, "tail": 0}[mode]
        self.most = max_lines

    def summary(self, x: Lines) -> Sequence[np.ndarray]:
        return x.edges(x.has(LOG))

    def apply(self, x: Lines, c: Entering) -> Lines:
        log = x.has(LOG)
        place, size = x.place_in_run(log, c)
        cut = log & (size >= LOG_RUN) & (size > self.most)
        marked = cut & (place == self.head + 1)
        kept = ~cut | marked | (place <= self.head) | (place > size - (self.most - self.head))
        return x.put(marked, MARKER, mark=size - self.most, size=_spread(marked, size - self.most)).keep(kept)


class Ends(Step):
    """Marks the whole lines of a document's head and tail, one at least of each."""

    scan = scans.sums("n", "size")

    def __init__(self, head: int, tail: int):
        self.head, self.tail = head, tail

    def summary(self, x: Lines) -> Sequence[np.ndarray]:
        return x.n, x.per_block(x.size)

    def apply(self, x: Lines, c: Entering) -> Lines:
        upto = x.sum_in_block(x.size)
        own = x.per_block(x.size)[x.seg]
        up, down = c.of(x, "size_before") + upto, c.of(x, "size_behind") + own - upto + x.size
        at = c.of(x, "n_before") + x.at - x.start[x.seg]
        head, tail = (up <= self.head) | (at == 0), (down <= self.tail) | (at == c.of(x, "n_all") - 1)
        return Lines(x.blocks, x.seg, x.src, x.mark, x.flag & ~(HEAD | TAIL) | np.where(head, HEAD, 0) | np.where(tail, TAIL, 0), x.depth, x.size)


class Trim(Step):
    """Documents above the threshold keep the marked head and tail around a marker."""

    scan = scans.sums("head", "tail", "n", "size")

    def __init__(self, threshold: int):
        self.threshold = threshold

    def summary(self, x: Lines) -> Sequence[np.ndarray]:
        return x.per_block(x.has(HEAD)), x.per_block(x.has(TAIL)), x.n, x.per_block(x.size)

    def apply(self, x: Lines, c: Entering) -> Lines:
        head, tail, n = (c.of(x, f"{f}_all") for f in ("head", "tail", "n"))
        gone = n - tail - head
        active = (c.of(x, "size_all") > self.threshold) & (gone > 0)
        at = c.of(x, "n_before") + x.at - x.start[x.seg]
        marked = active & (at == head)
        return x.put(marked, MARKER, mark=gone, size=_spread(marked, gone)).keep(~active | (at <= head) | (at >= n - tail))


def _prepared(df: DataFrame, steps: Sequence[Step], block_lines: int) -> DataFrame:
    """The lines in blocks with what each is; df has (doc_id, line_no, line), or (doc_id, lines): whole documents' lines in order, whose ids differ."""
    asks = lambda *kinds: any(isinstance(s, kinds) for s in steps)
    gather = scans.cut if "lines" in df.columns else scans.gather
    seen = _stripped if asks(Purge) else lambda line: line
    return scans.prepare(gather(df, seen, lambda line: _told(line, asks), block_lines), steps, asks(Dedup))


def _told(line: Column, asks: Callable[..., bool]) -> tuple[Column, Column, Column]:
    """(flag, depth, size) of a line, without escapes if they go. Only what a step asks for is looked at, and patterns are tried where a line's fixed signs are found."""
    bit = lambda which, value: F.when(which, value).otherwise(0)
    when = lambda sign, pattern: F.when(sign, pattern).otherwise(F.lit(False))
    flag, depth, size = F.lit(0), F.lit(0), F.lit(0)
    plain = (line == "") | reduce(or_, [(line >= a) & (line < b) for a, b in ("a{", "A[", "0:")])
    ticks = line.startswith("```")
    if asks(Purge):
        flag = flag + bit(when(~plain, line.rlike(CURSOR) | line.rlike(RULE)), NOISE)
    if asks(Blanks):
        flag = flag + bit(blank(line), BLANK)
    if asks(Fences):
        flag = flag + F.when(ticks, bit(line.rlike(BARE), CLOSES) + bit(line.rlike(FENCE) & ~line.rlike(BARE), OPENS)).otherwise(0)
        depth = F.when(line.startswith(" ") | line.startswith("\t"), indentation_depth(line)).otherwise(0)
    if asks(Logs):
        level = reduce(or_, [line.contains(x) for x in LEVELS if x != "WARNING"])
        flag = flag + F.when(when(line.contains(":"), line.rlike(STAMP)), LOG).when(when(level, line.rlike(LEVEL)), LOG).otherwise(0)
    if asks(Ends):
        size = length16(line) + 1
    return flag, depth, size


def _stripped(line: Column) -> Column:
    """Without terminal escapes, which few lines have."""
    return F.when(line.contains(ESCAPE), F.regexp_replace(line, ANSI, "")).otherwise(line)


def run_steps(df: DataFrame, steps: Sequence[Step], block_lines: int = BLOCK_LINES) -> DataFrame:
    """(doc_id, line_no, line): what the steps leave of each document, numbered from 0. Line numbers give the order; gaps in them do no harm, ties do not occur.
    Documents that are at hand whole, one row an id, may come as (doc_id, lines): they are cut into blocks where they are, so no line moves.

    Null ids are one document. An empty table gives an empty result. The blocks, and summaries where a document has several, are written in the shared folder.
    """
    steps = [*steps, scans.Number()]
    out = scans.lines_out(_prepared(df, steps, block_lines), steps, markers)
    return out.withColumn("line", _stripped(F.col("line"))) if any(isinstance(s, Purge) for s in steps) else out


def dedup_lines(df: DataFrame, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Without lines that equal the line before."""
    return run_steps(df, [Dedup()], block_lines)


def purge_noise(df: DataFrame, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Terminal escapes stripped; cursor lines and rules of sixteen or more like signs dropped."""
    return run_steps(df, [Purge()], block_lines)


def skip_blank_blocks(df: DataFrame, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """A run of three or more blank lines becomes one empty line, a shorter run goes; no empty line at the end."""
    return run_steps(df, [Blanks()], block_lines)


def head_middle_tail(df: DataFrame, threshold: int = 8192, head: int = 4096, tail: int = 1024, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Documents above the threshold keep whole lines of head and tail, one at least of each, around a marker."""
    return run_steps(df, [Ends(head, tail), Trim(threshold)], block_lines)


def indentation_depth(line: Column) -> Column:
    lead = F.regexp_extract(line, "\\A[ \\t]*", 0)
    return F.floor((F.length(lead) + 3 * F.length(F.regexp_replace(lead, " ", ""))) / 4)


def ast_skeleton(df: DataFrame, max_depth: int = 2, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Inside fences, each run of lines deeper than max_depth becomes a marker."""
    return run_steps(df, [Fences(max_depth), Collapse()], block_lines)


def log_runs(df: DataFrame, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(doc_id, run_start, run_end): runs of four or more log lines, half open, counted from the document's first line."""
    steps = [Logs()]
    prepared = _prepared(df, steps, block_lines)
    schema = T.StructType([T.StructField("doc_id", prepared.schema["doc_id"].dataType), T.StructField("run_start", T.LongType()), T.StructField("run_end", T.LongType())])

    def rows(batch: pa.RecordBatch, x: Lines, known: dict[str, np.ndarray]) -> list[pa.Array]:
        c = Entering(known, "s0:")
        log = x.has(LOG)
        place, size = x.place_in_run(log, c)
        begins = np.flatnonzero(log & (place == 1) & (size >= LOG_RUN))
        start = (c.of(x, "offset") + x.at - x.start[x.seg])[begins]
        return [batch.column(0).take(pa.array(x.seg[begins])), pa.array(start), pa.array(start + size[begins])]

    return scans.finish(prepared, [_Only(steps[0])], rows, schema)


class _Only(Step):
    """What enters for a step, without its effect."""

    def __init__(self, step: Step):
        self.scan, self.summary = step.scan, step.summary


def log_condense(df: DataFrame, mode: str = "balanced", max_lines: int = 200, *, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Runs longer than max_lines keep their head, tail or both around a marker."""
    return run_steps(df, [Logs(mode, max_lines)], block_lines)


def run_stage0(df: DataFrame, *, dedup: bool = True, purge: bool = True, skeleton_depth: int | None = None, log_mode: str = "balanced", log_lines: int = 200, transforms: Sequence[Callable[[DataFrame], DataFrame]] | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """The clean-up chain, in its fixed order; ``transforms`` (each a function of line documents), if given, take its place."""
    if transforms is not None:
        for f in transforms:
            df = df.transform(f)
        return df
    skeleton = [] if skeleton_depth is None else [Fences(skeleton_depth), Collapse()]
    return run_steps(df, [*[Dedup()] * dedup, *[Purge()] * purge, Blanks(), *skeleton, Logs(log_mode, log_lines)], block_lines)
