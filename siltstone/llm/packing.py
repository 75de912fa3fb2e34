"""Best-fit packing by patterns: non-negative least squares over a length histogram, then best fit for the rest.

Only the histogram of piece lengths (at most ``capacity`` bins, whatever the corpus) reaches the driver. There, patterns of
up to three lengths that fill a sequence exactly are enumerated over the lengths that occur, repeat counts are fitted
to the histogram by non-negative least squares (coordinate descent, until it settles), rounded so that no length is used more often than it
occurs, and what is left is packed by best fit over counts of like lengths: decreasing into the fullest sequence, or a sequence at a time with the
set of lengths that leaves least room, of any number of pieces, whichever takes fewer sequences. Where either takes fewer without the patterns, that
is the plan. Each piece then finds its place by its rank among the pieces of its length: ranks come from counts by (length, hash bucket), so no length's pieces meet in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import bpe
from siltstone.llm.arrowmap import map_rows, plain, text_of
from siltstone.session import materialise

CAPACITY = 1024
END_ID = 2
BUCKET_ROWS = 100_000
LEAST_BUCKETS = 256
#: Coordinate descent has settled when a pass makes the squared residual smaller by less than this share.
SETTLED = 1e-3


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """(n, 3) of ascending lengths, 0 meaning none, that sum to the capacity: one, two or three documents."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths[(lengths > 0) & (lengths <= capacity)]] = True
    found = np.flatnonzero(have)
    rows = [np.array([[0, 0, capacity]])] if have[capacity] else []
    two = found[(found * 2 <= capacity)]
    two = two[have[capacity - two]]
    rows.append(np.stack([np.zeros_like(two), two, capacity - two], axis=1))
    for a in found[found * 3 <= capacity]:
        b = found[(found >= a) & (found * 2 <= capacity - a)]
        b = b[have[capacity - a - b]]
        rows.append(np.stack([np.full_like(b, a), b, capacity - a - b], axis=1))
    return np.concatenate(rows).astype(np.int64) if rows else np.zeros((0, 3), dtype=np.int64)


def fit(pats: np.ndarray, hist: np.ndarray, settled: float = SETTLED) -> np.ndarray:
    """Non-negative repeat counts x that bring the patterns' lengths near the histogram, by coordinate descent until the residual settles."""
    rest = hist.astype(float).tolist()
    x = [0.0] * len(pats)
    cols = []
    for a, b, c in pats.tolist():
        uses: dict[int, int] = {}
        for length in (a, b, c):
            if length:
                uses[length] = uses.get(length, 0) + 1
        cols.append((tuple(uses.items()), float(sum(n * n for n in uses.values()))))
    order = range(len(cols) - 1, -1, -1)
    before = float("inf")
    while cols:
        for j in order:
            uses, norm = cols[j]
            step = sum(rest[length] * n for length, n in uses) / norm
            new = x[j] + step
            if new < 0:
                new, step = 0.0, -x[j]
            if step:
                x[j] = new
                for length, n in uses:
                    rest[length] -= n * step
        now = sum(v * v for v in rest)
        if now < 1 or now > before * (1 - settled):
            break
        before = now
    return np.array(x)


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, repeats)]: sequences that use each length exactly as often as the histogram has it."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in hist.items():
        counts[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        out.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    pats = patterns(np.flatnonzero(counts), capacity)
    x = fit(pats, counts)
    left, fitted = counts.tolist(), []
    for j in sorted(np.flatnonzero(x >= 0.5).tolist(), key=lambda j: (-x[j], j)):
        lengths = [v for v in pats[j].tolist() if v]
        n = min(round(x[j]), *(left[v] // lengths.count(v) for v in lengths))
        if n > 0:
            fitted.append((tuple(lengths), n))
            for v in lengths:
                left[v] -= n
    plans = [fitted + rest(left, capacity) for rest in (tight, residual)]
    plans += [rest(counts.tolist(), capacity) for rest in (tight, residual)]
    return out + min(plans, key=lambda p: sum(n for _, n in p))


def tight(left: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences one kind at a time: the largest length that is left with the lengths, as often as they occur, that leave least room; of several such sets the one with the largest lengths.

    A kind is repeated until one of its lengths is used up, so there are no more kinds than lengths.
    """
    left, out = list(left), []
    for first in range(capacity, 0, -1):
        while left[first]:
            left[first] -= 1
            room = capacity - first
            have = [(v, min(left[v], room // v)) for v in range(1, min(first, room) + 1) if left[v]]
            # the sums that the lengths so far can make, as bits
            sums, mask = [1], (2 << room) - 1
            for v, most in have:
                now, copies = sums[-1], 1
                while most > 0:
                    take = min(copies, most)
                    now |= now << (v * take) & mask
                    most, copies = most - take, 2 * copies
                sums.append(now)
            target, uses = sums[-1].bit_length() - 1, {first: 1}
            for k in range(len(have) - 1, -1, -1):
                v, most = have[k]
                take = min(most, target // v)
                while not sums[k] >> (target - take * v) & 1:
                    take -= 1
                if take:
                    uses[v] = uses.get(v, 0) + take
                    target -= take * v
            left[first] += 1
            n = min(left[v] // k for v, k in uses.items())
            for v, k in uses.items():
                left[v] -= n * k
            out.append((tuple(v for v, k in sorted(uses.items(), reverse=True) for _ in range(k)), n))
    return out


def residual(left: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, of the lengths that are left, by counts of like bins."""
    bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n, room = left[length], length
        while n > 0:
            while room <= capacity and not bins[room]:
                room += 1
            if room > capacity:
                per = capacity // length
                for each, k in ((per, n // per), (n % per, 1)):
                    if each and k:
                        key = (length,) * each
                        bins[capacity - each * length][key] = bins[capacity - each * length].get(key, 0) + k
                n = 0
                continue
            key, have = next(iter(bins[room].items()))
            take = min(n, have)
            if take == have:
                del bins[room][key]
            else:
                bins[room][key] = have - take
            bins[room - length][(*key, length)] = bins[room - length].get((*key, length), 0) + take
            n -= take
            if room - length >= length:
                room = length
    return [(key, n) for group in bins for key, n in group.items()]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, lo, hi, base, offset): the pieces of a length with rank in [lo, hi) go to sequence base + rank - lo."""
    out, used, base = [], {}, 0
    for lengths, n in found:
        offset = 0
        for v in lengths:
            lo = used.get(v, 0)
            out.append((v, lo, lo + n, base, offset))
            used[v] = lo + n
            offset += v
        base += n
    return out


def pack(pieces: DataFrame, id_cols: list[str], length_col: str = "length", *, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most ``capacity`` tokens, gapless from 0.

    Rows that repeat are pieces of their own. Null lengths, zero and negative ones take no part (both columns null); a length over
    the capacity raises. Columns of pieces named sequence_id or offset are replaced; all others, whatever their names, stay as they are. Ties: pieces of a
    length are placed in the order of a hash bucket and id_cols. An empty table gives an empty result. pieces is read twice: pass a written table.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    # all of a row but its length and ids travels in one struct, so no column of pieces can clash with those made here
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn("length", F.col(f"row.`{length_col}`").cast("long"))
    sized = rows.filter(F.col("length") > 0)
    hist = {int(r[0]): int(r[1]) for r in sized.groupBy("length").agg(F.count(F.lit(1))).limit(capacity + 1).collect()}
    if any(v > capacity for v in hist):
        raise ValueError(f"a piece is longer than {capacity}")
    buckets = max(LEAST_BUCKETS, sum(hist.values()) // bucket_rows)
    ids = [F.col(f"row.`{c}`") for c in id_cols]
    keyed = sized.withColumn("bucket", F.pmod(F.xxhash64(*ids), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*ids)) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).select("row", "length", (F.col("rank") + F.col("before")).alias("rank"))
    places = spark.createDataFrame(slots(plan(hist, capacity)), "of long, lo long, hi long, base long, offset long")
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    own = [F.col(f"row.`{c}`").alias(c) for c in names]
    out = found.select(*own, (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
    rest = rows.filter(F.col("length").isNull() | (F.col("length") <= 0)).select(*own, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return out.unionByName(rest)


def cut(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, longer ones cut.

    The first piece of a longer text takes what full pieces leave; very long texts are cut into as many pieces as they need. Null and empty texts give the
    end id alone. Rows that repeat, also in their id, are each cut; null ids stay null. Only id and text are read, so other columns may have any name. An empty table
    gives an empty result. Files that are not plain byte-level BPE are encoded by their own library.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    fields = [plain(id_col, docs.schema[id_col].dataType), plain("piece", T.IntegerType()), plain("start", T.LongType()), plain("length", T.LongType()), plain("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [plain("ids", T.ArrayType(T.IntegerType()))] * keep_ids)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def raw_ids(texts):
        try:
            encoder = bpe.from_json(path)
            return [encoder.encode(t) for t in texts]
        except ValueError:
            return [np.asarray(x, dtype="<u4").tobytes() for group in bpe.batches(texts) for x in bpe.library(path)(group)]

    def run(batch):
        source, piece, start, length, crc, ids = [], [], [], [], [], []
        for k, raw in enumerate(raw_ids(batch.column(1).to_pylist())):
            raw += end
            n = len(raw) // 4
            at = [0, *range(n % capacity or capacity, n, capacity), n]
            for j, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                body = raw[4 * a : 4 * b]
                source.append(k)
                piece.append(j)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(body))
                if keep_ids:
                    ids.append(np.frombuffer(body, dtype="<u4").tolist())
        out = {id_col: batch.column(0).take(source) if source else batch.column(0).slice(0, 0), "piece": piece, "start": start, "length": length, "ids_crc32": crc}
        yield out | ({"ids": ids} if keep_ids else {})

    return map_rows(docs.select(F.col(id_col), text_of(text_col).alias("text")), run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Cut documents and pack the pieces, with sequence_id and offset; odd rows as in cut() and pack(). The pieces are written once in the shared folder, as they are read twice."""
    pieces = materialise(cut(docs, path, id_col, text_col, capacity=capacity, end_id=end_id, keep_ids=keep_ids))
    return pack(pieces, [id_col, "piece", "ids_crc32"], capacity=capacity)
