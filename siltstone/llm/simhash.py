"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where more than half of a text's shingle hashes have it. For radius r, every bit position gets a non-zero
vector of r + 1 bits; each of the 2**(r+1) - 1 non-zero vectors v gives a mask of the positions whose vector has an odd inner product
with v. Any r differing positions leave some v orthogonal to all of them, so every pair within the radius agrees under some mask: no link
is lost. Distinct fingerprints are dealt into buckets by (mask, masked bits). A bucket of moderate size gives a spanning forest of its links, not
its pairs. A larger one is dealt again: its free bits fall into r + 1 groups, and r differing bits leave one group alone, so every pair within the radius agrees
on mask and bits of some group. What is still large goes another exact way: each fingerprint names the points within one and within two flips of its free bits; all
that name a point within two flips link with one that names it within one flip, if any does (1 + 2 = 3).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrowmap import map_rows, plain, text_of
from siltstone.llm.components import connected_components
from siltstone.session import materialise

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 4096
_STEP = 1 << 16


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks, as unsigned 64-bit numbers: 2**(radius+1) - 1 of about 34 bits each."""
    span = (1 << (radius + 1)) - 1
    position = [k % span + 1 for k in range(BITS)]
    return [sum(1 << k for k, m in enumerate(position) if (m & v).bit_count() % 2) for v in range(1, span + 1)]


def refined(mask: int, radius: int = RADIUS) -> list[int]:
    """The mask with each of the r + 1 groups of its free bits."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    return [mask | sum(1 << k for k in free[g :: radius + 1]) for g in range(radius + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned; zero if it has no word."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space divides
    if not words:
        return 0
    n = len(words) - width + 1
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    starts, ends = (end - size)[:n].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), dtype="<u8", count=n)
    total = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, _STEP):
        total += np.unpackbits(hashes[k : k + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id_col, fp long): one row per input row; null and empty texts have fingerprint zero."""
    schema = T.StructType([plain(id_col, docs.schema[id_col].dataType), plain("fp", T.LongType())])

    def run(batch):
        yield {id_col: batch.column(0), "fp": [signed(fingerprint(t, width, seed)) for t in batch.column(1).to_pylist()]}

    return map_rows(docs.select(F.col(id_col), text_of(text_col).alias("text")), run, schema)


def forest(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, least member) for the components of fps under the radius; about len(fps)**2 steps, bounded by the bucket's size."""
    left = np.unique(np.array(fps, dtype=np.int64))
    out = []
    while len(left) > 1:
        root, found, front = int(left[0]), [], left[:1]
        left = left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for x in front:
                near |= np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            front, left = left[near], left[~near]
            found.append(front)
        out += [(int(x), root) for group in found for x in group]
    return out


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) whose components are those of all links within the radius."""
    if radius != 3:
        raise ValueError("the way for large buckets is for radius 3")
    edge = T.StructType([plain("a", T.LongType()), plain("b", T.LongType())])

    def run(batch):
        pairs = [p for fs in batch.column(0).to_pylist() for p in forest(fs, radius)]
        yield {"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}

    def dealt(rows: DataFrame, found: list[int]) -> tuple[DataFrame, DataFrame | None]:
        """The edges of buckets of moderate size, and what is in larger ones (mask_no, fp, mask), if anything. rows: fp, tables (array of mask numbers)."""
        known = F.array(*[F.lit(signed(m)) for m in found])
        keyed = rows.select("fp", F.explode("tables").alias("mask_no")).withColumn("mask", F.element_at(known, F.col("mask_no") + 1)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counts = materialise(keyed.groupBy("mask_no", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        shared = keyed.join(counts, ["mask_no", "key"])
        gathered = shared.filter(F.col("n") <= bucket).groupBy("mask_no", "key").agg(F.collect_list("fp").alias("fps"))
        near = map_rows(gathered.select("fps"), run, edge)
        if counts.filter(F.col("n") > bucket).isEmpty():
            return near, None
        return near, shared.filter(F.col("n") > bucket).select("mask_no", "fp", "mask")

    first = masks(radius)
    near, more = dealt(fps.select("fp", F.sequence(F.lit(0), F.lit(len(first) - 1)).alias("tables")), first)
    if more is None:
        return near
    parts = radius + 1
    again = materialise(more).select("fp", F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda g: F.col("mask_no") * parts + g).alias("tables"))
    closer, most = dealt(again, [m for x in first for m in refined(x, radius)])
    near = near.unionByName(closer)
    return near if most is None else near.unionByName(_large(most))


def _large(shared: DataFrame) -> DataFrame:
    """Edges in large buckets through points within one and two flips; linear in the bucket, dealt by point."""
    bits = F.array(*[F.lit(signed(1 << k)) for k in range(BITS)])
    free = shared.select("mask_no", "fp", F.filter(bits, lambda x: x.bitwiseAND(F.col("mask")) == 0).alias("free"))
    ones = free.select("mask_no", "fp", "free", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.col("free"))).alias("one"))
    # flips of two bits: the second one above the first in the list's order; a first flip of 0 gives radius 0 and 1
    rest = F.when(F.col("one") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.concat(F.array(F.lit(0).cast("long")), F.expr("slice(free, array_position(free, one) + 1, 64)")))
    points = ones.select("mask_no", "fp", "one", F.explode(rest).alias("two")).select("mask_no", "fp", F.col("fp").bitwiseXOR(F.col("one")).bitwiseXOR(F.col("two")).alias("point"), (F.col("two") == 0).alias("close"))
    named = materialise(points)
    middle = materialise(named.filter("close").groupBy("mask_no", "point").agg(F.min("fp").alias("b")))
    return named.join(middle, ["mask_no", "point"]).select(F.col("fp").alias("a"), "b").filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = RADIUS, width: int = SHINGLE, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """(id_col, fp long, component_id): one row per input row; component_id is the smallest id reachable over links.

    Equal fingerprints are linked. Null and empty texts have fingerprint zero and are linked like any other. Very long texts are hashed whole, in steps that bound memory. Null
    ids never name a component unless it has no other; ties cannot be, as ids are compared whole. Rows that repeat, also in their id, stay. Only id and text are read, so other columns may
    have any name. An empty table gives an empty result.
    """
    found = materialise(fingerprints(docs, id_col, text_col, width=width, seed=seed))
    distinct = materialise(found.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = materialise(connected_components(links(distinct.select("fp"), radius, bucket)))
    named = materialise(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    best = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")))
    component = materialise(named.join(best, "root").select("fp", "component_id"))
    return found.join(component, "fp").select(id_col, "fp", "component_id")
