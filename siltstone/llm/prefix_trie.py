"""A trie of conversations' shared beginnings, for what a prefix cache would save.

A conversation is the array of its turns' digests (128 bits of SHA-256 over role and text), joined to one binary key. Keys are range-sorted over the cluster, ties by
id, so every node of the trie is an interval of neighbours. Each task sweeps its sorted stretch once: the longest common prefix of two neighbours says
which intervals end, a stack holds those that are open. Nodes that begin and end inside a stretch are finished there. The paths of its first and last rows
stay open and leave fragments; where two stretches meet, the common prefix of their neighbouring rows says which fragments are one node. Fragments are a
few rows a stretch, stitched with windows by depth; what they have below them is added up along their path. Texts never move: only digests and sizes do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrowmap import arrow_schema, map_rows, plain, text_of
from siltstone.session import materialise, ship

DIGEST = 16
GROUP, MOST_SHARED = 5, 9
ENDS_CHUNK = 1 << 16
_FLUSH = 8192

NODE, LOOSE, FRAGMENT, ENDS, BOUND = range(5)
_LONG = ["depth", "conv_id", "parent_conv_id", "n", "kids", "leaves", "saved", "size", "seq"]
SWEPT = T.StructType([plain("kind", T.IntegerType()), plain("p", T.IntegerType()), plain("side", T.IntegerType()), *[plain(c, T.LongType()) for c in _LONG], plain("ends", T.StringType()), plain("body", T.BinaryType()), plain("last", T.BinaryType())])


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns as (digest, size in bytes of the text), by turn number, null first, ties by digest; ids as long, null ones take no part."""
    role, text = text_of(role_col), text_of(text_col)
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(turn_col).alias("at"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    # a group's conversations meet in one task, so what follows needs no exchange of its own
    rows = rows.withColumn("group", F.col("id") - F.col("id") % GROUP).repartition("group")
    return rows.groupBy("group", "id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """(id, turns): the first h turns of the group's first conversation (none if absent), then the own ones after the first h; h by the id's CRC."""
    all_of = seqs.groupBy("group").agg(F.collect_list(F.struct("id", "turns")).alias("all"))
    first = F.filter("all", lambda c: c["id"] == F.col("group"))
    rows = all_of.select(F.when(F.size(first) > 0, F.get(first, F.lit(0))["turns"]).alias("head"), F.explode("all").alias("own"))
    h = (F.crc32(F.col("own.id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    turns = F.col("own.turns")
    head = F.when(F.col("head").isNull(), F.slice(turns, 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    return rows.select(F.col("own.id").alias("id"), F.concat(head, F.slice(turns, h + 1, F.greatest(F.size(turns) - h, F.lit(0)))).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """How many turns two keys have in common at their start."""
    if a == b:
        return len(a) // DIGEST
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * DIGEST : mid * DIGEST] == b[lo * DIGEST : mid * DIGEST]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Open:
    """A node on the stack: its members so far, and its children that have ended."""

    __slots__ = ("below", "ends", "kids", "leaves", "left", "low", "n", "saved", "size")

    def __init__(self, size: int, left: bool):
        self.size, self.left, self.n, self.low, self.kids, self.leaves, self.saved = size, left, 0, None, 0, 0, 0
        self.ends: list[int] = []
        self.below: list[tuple] = []

    def take(self, n: int, low: int) -> None:
        self.n += n
        if self.low is None or low < self.low:
            self.low = low


def sweep(rows: Iterator[tuple[bytes, int, list[int]]], p: int) -> Iterator[tuple]:
    """Rows of SWEPT from a stretch's (key, id, sizes) in order: nodes, those whose parent is a fragment, fragments, pieces of their ids, and the stretch's bounds."""
    stack: list[Open] = []
    first = last = None

    def fragment(e: Open, side: int, depth: int) -> Iterator[tuple]:
        yield (FRAGMENT, p, side, depth, e.low, None, e.n, e.kids, e.leaves, e.saved, e.size, None, None, None, None)
        for node in e.below:
            yield (LOOSE, p, side, node[0], node[1], None, *node[2:6], None, None, node[6], None, None)
        for k in range(0, len(e.ends), ENDS_CHUNK):
            yield (ENDS, p, side, depth, *[None] * 7, k, None, ",".join(map(str, e.ends[k : k + ENDS_CHUNK])).encode(), None)

    def close() -> Iterator[tuple]:
        depth, e = len(stack) - 1, stack.pop()
        up = stack[-1]
        up.take(e.n, e.low)
        if e.left:
            yield from fragment(e, 0, depth)
            return
        for node in e.below:
            yield (NODE, p, None, node[0], node[1], e.low, *node[2:6], None, None, node[6], None, None)
        leaves, saved = e.leaves or 1, e.saved + (e.n - 1) * e.size
        up.kids += 1
        up.leaves += leaves
        up.saved += saved
        node = (depth, e.low, e.n, e.kids, leaves, saved, hashlib.sha256(",".join(map(str, e.ends)).encode()).hexdigest())
        if up.left:
            yield (LOOSE, p, 0, depth, e.low, None, *node[2:6], None, None, node[6], None, None)
        else:
            up.below.append(node)

    for key, name, sizes in rows:
        k = len(key) // DIGEST
        if first is None:
            first = key
            stack.append(Open(0, True))
            common = 0
        else:
            common = shared(last, key)
        while len(stack) > common + 1:
            yield from close()
        for d in range(common, k):
            stack.append(Open(sizes[d], last is None))
        stack[-1].take(1, name)
        stack[-1].ends.append(name)
        last = key
    if first is None:
        return
    span = sum(e.left for e in stack) - 1
    for depth in range(len(stack) - 1, -1, -1):
        e = stack.pop()
        if stack:
            stack[-1].take(e.n, e.low)
        yield from fragment(e, 0 if e.left else 1, depth)
    yield (BOUND, p, None, span, *[None] * 9, first, last)


def _stretches(keyed: DataFrame, partitions: int) -> DataFrame:
    """The keys (key, id, sizes) sorted over ``partitions`` ranges and swept."""
    ship(keyed.sparkSession)
    names = [f.name for f in SWEPT]
    arrow = arrow_schema(SWEPT)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = []

        def rows():
            for batch in it:
                number[:] = [batch.column(3)[0].as_py()] if batch.num_rows else number
                sizes = batch.column(2)
                for k, (key, name) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    yield key, name, sizes[k].as_py()

        source = rows()
        head = next(source, None)
        if head is None:
            return

        def again():
            yield head
            yield from source

        held: list[tuple] = []
        for out in sweep(again(), number[0]):
            held.append(out)
            if len(held) >= _FLUSH:
                yield _batch(held, names, arrow)
                held = []
        yield _batch(held, names, arrow)

    dealt = keyed.repartitionByRange(partitions, "key", "id").sortWithinPartitions("key", "id")
    return dealt.select("key", "id", "sizes", F.spark_partition_id().alias("p")).mapInArrow(run, SWEPT)


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _reach(bounds: DataFrame) -> DataFrame:
    """(p, reach, span): how many turns a stretch's first row shares with the last row before it, none of any (-1) for the first stretch. A row a stretch, so one window."""
    before = bounds.select("p", F.col("depth").alias("span"), F.col("body").alias("first"), F.lag("last").over(Window.orderBy("p")).alias("before"))

    def per_batch(batch):
        yield {"p": batch.column(0), "span": batch.column(1), "reach": [-1 if b is None else shared(b, a) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]}

    return map_rows(before, per_batch, T.StructType([plain("p", T.IntegerType()), plain("span", T.LongType()), plain("reach", T.LongType())]))


def _ends(pieces: DataFrame, partitions: int) -> DataFrame:
    """(depth, island, ends): the hash of each stitched node's ids, read piece by piece in order."""
    schema = T.StructType([plain("depth", T.LongType()), plain("island", T.LongType()), plain("ends", T.StringType())])

    def run(it):
        at = state = None
        for batch in it:
            done = []
            for depth, island, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at == (depth, island):
                    state.update(b",")
                else:
                    if at:
                        done.append((*at, state.hexdigest()))
                    at, state = (depth, island), hashlib.sha256()
                state.update(body)
            yield _batch(done, schema.names, arrow_schema(schema))
        if at:
            yield _batch([(*at, state.hexdigest())], schema.names, arrow_schema(schema))

    dealt = pieces.repartition(partitions, "depth", "island").sortWithinPartitions("depth", "island", "p", "side", "seq")
    return dealt.select("depth", "island", "body").mapInArrow(run, schema)


def trie(seqs: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a node, from seqs (id long, turns (digest, size)).

    Each id stands once and has a non-null array of turns, which may be empty. A node is named by its smallest member and depth. An empty table gives no node; else the root
    is there. A sequence's digests, 24 bytes a turn, must fit in a row; nothing else grows with one.
    """
    spark = seqs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    keyed = materialise(seqs.select(key.alias("key"), "id", F.transform("turns", lambda t: t["size"]).alias("sizes")))
    swept = materialise(_stretches(keyed, partitions))

    own = ["p", "side", "depth"]
    cut = swept.filter(F.col("kind") == FRAGMENT).join(_reach(swept.filter(F.col("kind") == BOUND).select("p", "depth", "body", "last")), "p")
    starts = (F.col("side") == 1) | (F.col("depth") > F.col("reach"))
    island = F.sum(F.col("starts").cast("long")).over(Window.partitionBy("depth").orderBy("p", "side"))
    cut = materialise(cut.withColumn("starts", starts).select(*own, "conv_id", "n", "kids", "leaves", "saved", "size", "span", "starts", island.alias("island")))
    # a started fragment's parent: on the same path, or where the two paths part
    side = F.when((F.col("side") == 1) & (F.col("depth") - 1 > F.col("span")), 1).otherwise(0)
    asked = cut.filter("starts and depth > 0").select("p", side.alias("side"), (F.col("depth") - 1).alias("depth"), F.col("island").alias("child"))
    links = asked.join(cut.select(*own, "island"), own).select(F.col("depth"), "island", "child")
    whole = cut.groupBy("depth", "island").agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("kids").alias("kids"), F.max("size").alias("size"))
    whole = whole.join(links.groupBy("depth", "island").agg(F.count("child").alias("more")), ["depth", "island"], "left")
    whole = materialise(whole.select("depth", "island", "conv_id", "n", "size", (F.col("kids") + F.coalesce("more", F.lit(0))).alias("kids")))
    # what a node adds itself stands at its first fragment; then sums from the deep end of each path
    extra = whole.select("depth", "island", (F.col("kids") == 0).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("size")).alias("gain"))
    paths = cut.join(extra, ["depth", "island"])
    first = F.col("starts").cast("long")
    paths = paths.select(*own, "island", "span", (F.col("leaves") + first * F.col("leaf")).alias("leaves"), (F.col("saved") + first * F.col("gain")).alias("saved"))
    down, right = Window.partitionBy("p", "side").orderBy(F.desc("depth")), Window.partitionBy("p")
    both = (F.col("side") == 0) & (F.col("depth") <= F.col("span"))
    total = [(F.sum(c).over(down) + F.when(both, F.coalesce(F.sum(F.when(F.col("side") == 1, F.col(c))).over(right), F.lit(0))).otherwise(0)).alias(c) for c in ("leaves", "saved")]
    total = paths.select("depth", "island", *total).groupBy("depth", "island").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    ends = _ends(swept.filter(F.col("kind") == ENDS).select(*own, "seq", "body").join(cut.select(*own, "island"), own), partitions)

    named = whole.select("depth", "island", "conv_id")
    parents = links.join(named, ["depth", "island"]).select((F.col("depth") + 1).alias("depth"), F.col("child").alias("island"), F.col("conv_id").alias("parent_conv_id"))
    stitched = whole.join(total, ["depth", "island"]).join(parents, ["depth", "island"], "left").join(ends, ["depth", "island"], "left")
    stitched = stitched.withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())))
    loose = swept.filter(F.col("kind") == LOOSE).withColumn("depth", F.col("depth") - 1).drop("parent_conv_id")
    above = cut.join(named.withColumnRenamed("conv_id", "parent_conv_id"), ["depth", "island"]).select(*own, "parent_conv_id")
    loose = loose.join(above, own).withColumn("depth", F.col("depth") + 1)
    columns = ["conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    return swept.filter(F.col("kind") == NODE).select(*columns).unionByName(loose.select(*columns)).unionByName(stitched.select(*columns))


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, partitions: int | None = None) -> DataFrame:
    """The trie of rebuilt conversations.

    Null roles and texts are empty ones; rows without an id take no part; a null turn comes first; turns that repeat, or share a number, each count, in the order of their digests. Very long texts
    count by digest and size. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    return trie(rebuilt(sequences(conversations, id_col, turn_col, role_col, text_col)), partitions=partitions)


_STEP = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT), xor(c, b))"
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, ''))::BIGINT AS size
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS l, list(size ORDER BY turn NULLS FIRST, k) AS s FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {_STEP}, 4294967295::BIGINT), 4294967295::BIGINT) % {MOST_SHARED} AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.l, [])[1:h], h.l[h + 1:]) AS l, list_concat(coalesce(b.s, [])[1:h], h.s[h + 1:]) AS s
      FROM h LEFT JOIN o AS b ON b.conv_id = h.conv_id - h.conv_id % {GROUP}),
p AS (SELECT conv_id, d, l[1:d] AS k, CASE WHEN d > 0 THEN s[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, max(size) AS size FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (k)),
sub AS (SELECT k[1:e] AS k, sum((kids = 0)::BIGINT) AS leaves, sum((n - 1) * size) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY 1),
ends AS (SELECT l AS k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM r GROUP BY l)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n AS n_convs, m.kids AS n_children, sub.leaves::BIGINT AS n_leaves, sub.saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM m JOIN sub USING (k) LEFT JOIN ends USING (k) LEFT JOIN m AS u ON m.d > 0 AND u.k = m.k[1:m.d - 1]
"""
