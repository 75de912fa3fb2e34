"""Small helpers for Arrow-batched row functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import ship


def text_of(name: str) -> Column:
    """The text, null being empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def windows(text: Column, chars: int, count: int = 5) -> Column:
    """A text of at most ``chars`` characters as it is; of a longer one ``count`` windows of like length from its first character to its last, a line each, about ``chars`` in all."""
    size, width = F.length(text), chars // count
    at = [F.floor((size - width) * k / (count - 1)).cast("int") + 1 for k in range(count)]
    return F.when(size <= chars, text).otherwise(F.concat_ws("\n", *[F.substring(text, k, F.lit(width)) for k in at]))


def sampled(rows: DataFrame, keys: list[str], count: int, *, size: str | None = None, most: int | None = None) -> DataFrame:
    """At most ``count`` rows, the same ones at every run, spread by a hash of the keys: those under a threshold that leaves about twice as many, then the first in order of hash and keys.

    Rows come whole. With ``most``, the text column ``size`` has at most so many bytes in all: rows are taken in that order until the next one would pass it. A pass finds the size of the table,
    one the hashes, with lengths where they matter, and one the rows. That pass knows the last hash taken, so no row beyond it leaves its task, and rows that repeat leave it once, with their number:
    neither long rows nor many copies bring the driver more than the result. keys should hold all columns that matter.
    """
    total = rows.count()
    place = F.xxhash64(*keys)
    if total > 4 * count:
        rows = rows.filter(place <= F.lit(int(-(2**63) + 2**64 * (2 * count / total))).cast("long"))
    length = F.lit(0) if most is None else F.octet_length(size)
    found = rows.groupBy(place.alias("_place"), length.cast("long").alias("_n")).agg(F.count(F.lit(1)).alias("_copies")).orderBy("_place", "_n").limit(count).collect()
    places, lengths, copies = (np.array([r[c] for r in found], dtype=np.int64) for c in ("_place", "_n", "_copies"))
    ends = np.cumsum(copies)
    fits = np.cumsum(np.repeat(lengths, np.clip(count - (ends - copies), 0, copies))) <= (most or 0)
    count = int(fits.argmin()) if len(fits) and not fits.all() else len(fits)
    if not count:
        return rows.limit(0)
    last = int(places[np.searchsorted(ends, count)])
    left = count - int(copies[places < last].sum())  # of the rows with the last hash
    columns, (many, copy) = [F.col(f"`{c}`") for c in rows.columns], fresh(rows, "copies", "copy")
    each = rows.filter(place <= F.lit(last).cast("long")).groupBy(*columns).agg(F.count(F.lit(1)).alias(many))
    taken = F.when(place == F.lit(last).cast("long"), F.least(F.col(many), F.lit(left).cast("long"))).otherwise(F.col(many))
    return each.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), taken))).orderBy(place, *keys).limit(count).select(*columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """mapInArrow with dictionaries of columns: per_batch yields {column: values}, whose order is the schema's. Batches are bounded in bytes as well as rows."""
    ship(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(it):
        for batch in it:
            for cols in per_batch(batch):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type, from_pandas=False) for x, f in ((cols[f.name], f) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def plain(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
