"""Exact top-k inner products by distributed histogram selection.

Query blocks, a bounded group of them at a time, meet candidate blocks cell by cell where the candidates lie. Each round scores everything and counts, for each query, the scores in equal bins of the
range that still holds its kth best score; a cell reports only bins that can matter (from its own kth best upwards). Summed over cells, the counts name
the bin of the kth score, which the next round divides, until bins are single scores. The last pass keeps scores above the kth value, and
of those equal to it the k smallest ids a cell: ties need no more. Rows are told apart by a number of their own, given when they are written, so
rows that share an id are rows like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrowmap import map_rows, plain
from siltstone.session import Ledger, materialise, scratch

K = 20
SCALE = 64
EVERY = 20
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16_384
LEAST_BLOCK = 512
#: Bytes of a block's vectors, whatever their length.
BLOCK_BYTES = 8 << 20
#: Bytes of the query blocks that are sent out together, and the most files of candidates.
GROUP_BYTES, MOST_FILES = 32 << 20, 4096
BINS = 8  # bits
_STEP = 256


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id long, v array<long>): floor(scale * x); without null ids, null vectors and null or non-finite components."""
    x = F.col(vec_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def _block_of(count: int) -> Column:
    """A block by a hash of a row's number; its size is bounded in expectation by the count of blocks."""
    return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """(dim, name, ids, rows, vs): the rows of a block together."""
    packed = rows.groupBy("dim", name).agg(F.array_sort(F.collect_list(F.struct("vec_id", "row", "v"))).alias("all"))
    return packed.select("dim", name, F.col("all.vec_id").alias("ids"), F.col("all.row").alias("rows"), F.flatten(F.col("all.v")).alias("vs"))


def _rows(batch) -> Iterator[dict]:
    """The batch's cells, vectors as numpy without a copy."""
    lists = {c: batch.column(c) for c in ("q_vs", "c_vs")}
    rest = [c for c in batch.schema.names if c not in lists]
    for k in range(batch.num_rows):
        yield {c: batch.column(c)[k].as_py() for c in rest} | {c: x[k].values.to_numpy(zero_copy_only=False) for c, x in lists.items()}


def _matrix(values, n: int, exact: bool) -> np.ndarray:
    return np.asarray(values, dtype=np.float64 if exact else np.int64).reshape(n, -1)


def _scores(row: dict, exact: bool):
    """Integer scores of a cell in steps of queries: (first query, scores); own rows get the least integer."""
    q, c = _matrix(row["q_vs"], len(row["q_ids"]), exact), _matrix(row["c_vs"], len(row["c_ids"]), exact).T
    ids = np.asarray(row["c_ids"])
    own = {x: k for k, x in enumerate(row["c_rows"])}
    for k in range(0, len(q), _STEP):
        s = (q[k : k + _STEP] @ c).astype(np.int64)
        at = [(j, own[x]) for j, x in enumerate(row["q_rows"][k : k + _STEP]) if x in own]
        if at:
            s[tuple(np.array(at).T)] = np.iinfo(np.int64).min
        yield k, s, ids


def _lows(row: dict) -> np.ndarray:
    """The lower ends of the ranges of a cell's queries, in the order of its rows."""
    low = {x["query"]: x["low"] for x in row["s"]}
    return np.array([low[x] for x in row["q_rows"]], dtype=np.int64)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = K, every: int = EVERY, scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k best other rows (all, if fewer), ties to the smaller id.

    Null vectors, ones that hold null or non-finite components and rows without an id take no part. Rows that share an id, or repeat whole, each stand for
    themselves, as queries (each has k rows in the result) and as candidates of all but themselves. Only vectors of one length are compared. Only id and
    vector are read, so other columns may have any name. An empty table gives an empty result. Scores beyond 64 bits raise. A block has at most so many rows, and so many bytes, in expectation.
    Query blocks are taken in groups of at most ``group_bytes`` (a block at least), one after the other, so what the driver sends at once does not grow with the vectors; results are written in the shared folder.
    """
    rows = materialise(quantised(vectors, id_col, vec_col, scale).withColumn("row", F.monotonically_increasing_id()))
    square = F.aggregate(F.transform("v", lambda c: c.cast("double") * c), F.lit(0.0), lambda a, b: a + b)
    n, n_q, norm, longest = rows.agg(F.count(F.lit(1)), F.sum((F.col("vec_id") % every == 0).cast("long")), F.max(square), F.max(F.size("v"))).first()
    most = max(1, block_bytes // (8 * max(1, int(longest or 0))))  # rows of the longest vectors that a block holds
    norm = float(norm or 0)
    if norm >= 2.0**62:
        raise OverflowError("scores may exceed 64 bits")
    exact = norm < 2.0**52
    high = int(norm) + 2  # |score| is at most the largest squared norm
    # few vectors still make a cell for every core
    query_block, candidate_block = min(query_block, most), min(candidate_block, most, max(LEAST_BLOCK, -(-int(n) // (2 * vectors.sparkSession.sparkContext.defaultParallelism))))
    q_blocks, c_blocks = max(1, -(-int(n_q or 0) // query_block)), max(1, -(-int(n) // candidate_block))
    files = min(c_blocks, MOST_FILES)
    dealt = rows.withColumns({"dim": F.size("v"), "c_block": _block_of(c_blocks)}).repartition(files, "dim", "c_block")  # so many files, as many tasks may share the cells
    candidates = materialise(_packed(dealt, "c_block").withColumnsRenamed({"ids": "c_ids", "rows": "c_rows", "vs": "c_vs"}))
    queries = materialise(_packed(rows.filter(F.col("vec_id") % every == 0).withColumns({"dim": F.size("v"), "q_block": _block_of(q_blocks)}), "q_block").withColumnsRenamed({"ids": "q_ids", "rows": "q_rows", "vs": "q_vs"}))
    groups = _groups(queries, group_bytes)
    out = Ledger(vectors.sparkSession, "query_id long, rank int, vec_id long, score long")
    for first, last in groups:
        with scratch(vectors.sparkSession):
            out.add(_select(candidates, queries.filter(F.col("q_block").between(first, last)), k, high, exact))
    return out.read()


def _groups(queries: DataFrame, most: int) -> list[tuple[int, int]]:
    """First and last query block of each group: so many bytes of vectors, ids and ranges, a block at least. The driver learns a number a block."""
    size = F.sum(8 * F.size("q_vs") + 40 * F.size("q_ids")).alias("n")
    out, held = [], 0
    for b, n in sorted(tuple(r) for r in queries.groupBy("q_block").agg(size).collect()):
        if not out or held + n > most:
            out.append((b, b))
            held = 0
        out[-1] = (out[-1][0], b)
        held += n
    return out


def _select(candidates: DataFrame, queries: DataFrame, k: int, high: int, exact: bool) -> DataFrame:
    """The k best rows of the queries of one group, whose blocks are sent to wherever candidates lie; candidates do not move."""
    start = queries.select("dim", "q_block", F.explode("q_rows").alias("query")).select("dim", "q_block", "query", F.lit(-high).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    width = 1 << max(0, (2 * high).bit_length() - BINS)
    state = materialise(start)
    counted = T.StructType([plain("query", T.LongType()), plain("bin", T.LongType()), plain("n", T.LongType())])
    needed = ["q_ids", "q_rows", "q_vs", "c_ids", "c_rows", "c_vs", "s"]
    span = 0  # of the range that is divided; at first all there is

    def with_state(state: DataFrame) -> DataFrame:
        packed = state.groupBy("dim", "q_block").agg(F.array_sort(F.collect_list(F.struct("query", "low", "need"))).alias("s"))
        asked = queries.join(packed.hint("merge"), ["dim", "q_block"])
        return candidates.join(F.broadcast(asked), "dim")  # bounded by the group's bytes

    while True:

        def count(batch, width=width, span=span):
            for row in _rows(batch):
                lows = _lows(row)
                query, bins, ns = [], [], []
                for at, s, _ in _scores(row, exact):
                    for j, line in enumerate(s):
                        low = int(lows[at + j])
                        line = line[(line >= low) & (line < low + span)] if span else line[line >= low]
                        if not len(line):
                            continue
                        if len(line) > k:  # no bin below this cell's own kth best can hold the kth of all
                            line = line[line >= low + (int(np.partition(line, len(line) - k)[len(line) - k]) - low) // width * width]
                        found, n = np.unique((line - low) // width, return_counts=True)
                        query += [row["q_rows"][at + j]] * len(found)
                        bins += found.tolist()
                        ns += n.tolist()
                yield {"query": query, "bin": bins, "n": ns}

        hist = map_rows(with_state(state).select(*needed), count, counted).groupBy("query", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin"))) - F.col("n")
        joined = state.join(hist.withColumn("above", above).hint("merge"), "query", "left")
        # the bin of the kth score; a query with fewer scores keeps its lowest bin
        best = F.max(F.struct((F.col("above") < F.col("need")).alias("ok"), (-F.col("bin")).alias("down"), F.col("above"))).alias("b")
        state = joined.groupBy("dim", "q_block", "query", "low", "need").agg(best)
        state = materialise(state.select("dim", "q_block", "query", (F.col("low") + F.when(F.col("b.ok"), -F.col("b.down")).otherwise(0) * width).alias("low"), (F.col("need") - F.when(F.col("b.ok"), F.col("b.above")).otherwise(0)).alias("need")))
        if width == 1:
            break
        span, width = width, max(1, width >> BINS)

    kept = T.StructType([plain("query", T.LongType()), plain("query_id", T.LongType()), plain("vec_id", T.LongType()), plain("score", T.LongType())])

    def keep(batch):
        least = np.iinfo(np.int64).min
        for row in _rows(batch):
            query, asked, ids, scores, lows = [], [], [], [], _lows(row)
            for at, s, cid in _scores(row, exact):
                for j, line in enumerate(s):
                    low = lows[at + j]
                    more = np.flatnonzero(line > low)
                    ties = np.flatnonzero((line == low) & (line > least))
                    ties = ties[np.argsort(cid[ties], kind="stable")][:k]
                    at_all = np.concatenate([more, ties])
                    query += [row["q_rows"][at + j]] * len(at_all)
                    asked += [row["q_ids"][at + j]] * len(at_all)
                    ids += cid[at_all].tolist()
                    scores += line[at_all].tolist()
            yield {"query": query, "query_id": asked, "vec_id": ids, "score": scores}

    found = map_rows(with_state(state).select(*needed), keep, kept)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.r <> q.r AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {K}
"""
