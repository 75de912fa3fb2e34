"""Embedding whitening by a compensated covariance.

Vectors become integers; the fit list is each distinct one once. Sums are exact. Centred outer products are summed in double-double: every
product and sum keeps its rounding error (error-free transformations), high and low parts stay apart in each task, and tasks' parts are
merged as such, first by slot, then by stretch of the matrix, so no group and no driver holds more than the matrix and a few hundred stretches. The covariance is
solved by divide and conquer (``eigen``). Three passes over the fit list (sums, covariance, the whitened vectors' covariance) and one over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import eigen
from siltstone.llm.arrowmap import map_rows, plain
from siltstone.session import materialise, ship

SCALE = 256
COMPONENTS = 4
SLAB = 1024
STRETCH = 16_384
SLOTS = 256
_SPLIT = float(2**27 + 1)
_MASK = (1 << 32) - 1


def two_sum(a, b):
    """a + b as a double and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a):
    t = a * _SPLIT
    high = t - (t - a)
    return high, a - high


def two_product(a, b):
    """a * b as a double and its rounding error."""
    p = a * b
    ah, al = _halves(a)
    bh, bl = _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(high, low, h, l):  # noqa: E741
    """The sum of two double-doubles."""
    s, e = two_sum(high, h)
    e = e + (low + l)
    high = s + e
    return high, e - (high - s)


def fold(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of double-double rows, by halves."""
    while len(high) > 1:
        half = len(high) // 2
        h, l = add(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])  # noqa: E741
        if len(high) % 2:
            h[0], l[0] = add(h[0], l[0], high[-1], low[-1])
        high, low = h, l
    return high[0], low[0]


def products(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper triangle, row after row, of the sum of outer products of double-double rows."""
    d = high.shape[1]
    sums = [fold(*_outer(high, low, i)) for i in range(d)]
    return np.concatenate([s[0] for s in sums]), np.concatenate([s[1] for s in sums])


def _outer(high: np.ndarray, low: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    a, rest = high[:, i : i + 1], high[:, i:]
    p, e = two_product(a, rest)
    return p, e + (a * low[:, i:] + low[:, i : i + 1] * rest)


def quotient(high: np.ndarray, low: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """A double-double over a number that is a double."""
    q = high / n
    p, e = two_product(q, np.full_like(q, n))
    r = ((high - p) - e + low) / n
    h = q + r
    return h, r - (h - q)


@dataclass(frozen=True)
class Whitening:
    """Fitted on n distinct vectors of one length. mean: as double-double, in total the exact sums over n to twice a double's precision."""

    n: int
    sums: tuple[int, ...]
    mean: tuple[np.ndarray, np.ndarray]
    values: np.ndarray
    vectors: np.ndarray
    rank: int
    error: float | None = None

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, l = two_sum(x.astype(np.float64), -self.mean[0])  # noqa: E741
        l = l - self.mean[1]  # noqa: E741
        s = h + l
        return s, l - (s - h)

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """(rows, components) of those with a spread; the others are not a number."""
        h, l = self.centred(x)  # noqa: E741
        scale = np.full(components, np.nan)
        scale[: min(components, self.rank)] = 1 / np.sqrt(self.values[: min(components, self.rank)])
        w = self.vectors[:, :components]
        return (h @ w + l @ w) * scale[: w.shape[1]]

    def explained(self, component: int) -> float | None:
        total = float(self.values.sum())
        return max(float(self.values[component]), 0.0) / total if total > 0 else None


def quantised(vectors: DataFrame, vec_col: str, scale: int = SCALE) -> DataFrame:
    """The rows of vectors that are sound, with x: floor(scale * component) as long."""
    c = F.col(vec_col).cast("array<double>")
    sound = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(2.0**62 / scale)))
    return vectors.filter(sound).withColumn("x", F.transform(c, lambda v: F.floor(v * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _merged(parts: DataFrame, merge: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """parts (slot, stretch, body), rows of numbers: merged within slots, then within stretches; the stretches in order."""
    schema = parts.schema

    def one(table: pa.Table) -> pa.Table:
        body = merge(np.stack([np.frombuffer(x, dtype=np.float64) for x in table.column("body").to_pylist()]))
        row = {"slot": [table.column("slot")[0].as_py()], "stretch": [table.column("stretch")[0].as_py()], "body": [body.tobytes()]}
        return pa.table(row, schema=pa.schema([("slot", pa.int32()), ("stretch", pa.int32()), ("body", pa.binary())]))

    by_slot = parts.groupBy("slot", "stretch").applyInArrow(one, schema)
    rows = by_slot.groupBy("stretch").applyInArrow(one, schema).collect()
    return np.concatenate([np.frombuffer(r["body"], dtype=np.float64) for r in sorted(rows, key=lambda r: r["stretch"])]) if rows else np.zeros(0)


def _merge_pairs(rows: np.ndarray) -> np.ndarray:
    """Rows that hold high parts, then low parts."""
    half = rows.shape[1] // 2
    return np.concatenate(fold(rows[:, :half], rows[:, half:]))


_PARTS = T.StructType([plain("slot", T.IntegerType()), plain("stretch", T.IntegerType()), plain("body", T.BinaryType())])


def _rows_of(parts: list[np.ndarray]) -> pa.RecordBatch:
    slot = TaskContext.get().partitionId() % SLOTS
    return pa.RecordBatch.from_arrays([pa.array([slot] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slot", "stretch", "body"])


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """(rows, sums of each dimension, largest size of an entry) of fit's x."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * d + 2, dtype=np.int64)
        for batch in it:
            x = _matrix(batch.column(0), d)
            total = _carry(np.stack([total, np.concatenate([[len(x), int(np.abs(x).max(initial=0))], (x >> 32).sum(axis=0), (x & _MASK).sum(axis=0)])]))
        if total[0]:
            yield _rows_of([total.view(np.float64)])

    found = _merged(fit.select("x").mapInArrow(run, _PARTS), lambda rows: _carry(rows.view(np.int64)).view(np.float64)).view(np.int64)
    if not len(found):
        return 0, [0] * d, 0
    return int(found[0]), [(int(h) << 32) + int(l) for h, l in zip(found[2 : 2 + d], found[2 + d :], strict=True)], int(found[1])


def _carry(rows: np.ndarray) -> np.ndarray:
    """Rows of (count, largest, upper 32 bits' sums, lower 32 bits' sums) added up, low sums below 2**32."""
    d = (rows.shape[1] - 2) // 2
    out = rows.sum(axis=0)
    out[1] = rows[:, 1].max()
    out[2 : 2 + d] += out[2 + d :] >> 32
    out[2 + d :] &= _MASK
    return out


def covariance(fit: DataFrame, centred: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], d: int, width: int, n: int) -> np.ndarray:
    """The covariance (width x width, divisor n) of what centred() makes of fit's x (length d), accumulated in double-double."""
    size = width * (width + 1) // 2
    cuts = [(a, min(a + STRETCH, size)) for a in range(0, size, STRETCH)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(size), np.zeros(size)
        for batch in it:
            x = _matrix(batch.column(0), d)
            for k in range(0, len(x), SLAB):
                high, low = add(high, low, *products(*centred(x[k : k + SLAB])))
        yield _rows_of([np.concatenate([high[a:b], low[a:b]]) for a, b in cuts])

    found = _merged(fit.select("x").mapInArrow(run, _PARTS), _merge_pairs)
    out, at, place = np.zeros((width, width)), 0, np.triu_indices(width)
    flat = np.zeros(size)
    for a, b in cuts:
        h, l = found[at : at + b - a], found[at + b - a : at + 2 * (b - a)]  # noqa: E741
        flat[a:b], at = quotient(h, l, float(n))[0], at + 2 * (b - a)
    out[place] = flat
    return np.maximum(out, out.T) if width < 2 else out + np.triu(out, 1).T


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """A whitening of the vectors x of length d, each of which stands once in distinct."""
    n, sums, _ = exact_sums(distinct, d)
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    high, low = two_sum(np.array(whole, dtype=np.float64), rest)
    # what the rounded remainder lacks
    lacks = [Decimal(s - w * n) / Decimal(n) - Decimal(float(r)) for s, w, r in zip(sums, whole, rest, strict=True)]
    model = Whitening(n, tuple(sums), (high, low + np.array([float(x) for x in lacks])), np.zeros(d), np.eye(d), 0)
    values, vectors = eigen.symmetric(covariance(distinct, model.centred, d, d, n))
    rank = int((values > d * eigen.EPS * max(values[0], 0.0)).sum())
    model = Whitening(n, model.sums, model.mean, values, vectors[:, :components], rank)
    k = min(components, rank)
    if not k:
        return model
    # centred vectors have no mean, and so do their projections
    spread = covariance(distinct, lambda x: ((y := model.whitened(x, k)), np.zeros_like(y)), d, k, n)
    return Whitening(n, model.sums, model.mean, values, model.vectors, rank, float(np.abs(spread - np.eye(k)).max()))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The sum over dimensions of (n * x - sum)**2, exactly."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most * most * len(sums) < 2**63:
        off = n * x - np.array(sums, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - np.array(sums, dtype=object)
    return (off * off).sum(axis=1).tolist()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation decimal(38, 0), whitened, explained, identity_error): a row for each sound row and component, by falling eigenvalue.

    Null vectors and ones that hold null, non-finite or huge entries (2**62 / scale and more) take no part. Rows that repeat, or share an id, each have their rows;
    vectors that repeat count once in the fit; null ids stay null. Vectors of one length are fitted together and apart from those of other lengths; empty ones have no
    component and so no row, shorter ones than ``components`` as many as they have entries. A component without spread (one distinct vector, or
    entries that depend on others) has null in whitened; explained is null where no component has spread, and so is identity_error. A deviation of
    over 38 digits is null. Of equal eigenvalues any basis may come. Only id and vector are read, so other columns may have any name. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "v", scale).select("id", "x")
    distinct = materialise(rows.select("x").filter(F.size("x") > 0).groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("d", F.size("x")))
    fits = {d: fit(distinct.filter(F.col("d") == d), d, components) for d in sorted(r["d"] for r in distinct.select("d").distinct().collect())}
    kind = vectors.schema[id_col].dataType
    schema = T.StructType([plain(id_col, kind), plain("component", T.IntegerType()), plain("n", T.LongType()), plain("deviation", T.DecimalType(38, 0)), plain("whitened", T.DoubleType()), plain("explained", T.DoubleType()), plain("identity_error", T.DoubleType())])
    known = spark.sparkContext.broadcast(fits)
    limit = 10**38

    def per_batch(batch: pa.RecordBatch) -> Iterator[dict]:
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            if not d:
                continue
            at = np.flatnonzero(sizes == d)
            own, model = batch.take(pa.array(at)), known.value[int(d)]
            x = _matrix(own.column(1), int(d))
            k = min(components, int(d))
            off = deviations(x, model.n, model.sums)
            dev = pa.array([v if abs(v) < 2**63 else None for v in off], pa.int64()).cast(pa.decimal128(38, 0)) if max(off) < 2**63 else pa.array([Decimal(v) if v < limit else None for v in off], pa.decimal128(38, 0))
            y = model.whitened(x, k)
            each = np.repeat(np.arange(len(at)), k)
            flat = pa.array(y.reshape(-1), mask=np.isnan(y.reshape(-1)))
            yield {id_col: own.column(0).take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), "n": pa.array(np.full(len(each), model.n)), "deviation": dev.take(pa.array(each)), "whitened": flat, "explained": pa.array([model.explained(c) for c in range(k)] * len(at), pa.float64()), "identity_error": pa.array([model.error] * len(each), pa.float64())}

    return map_rows(rows, per_batch, schema)
