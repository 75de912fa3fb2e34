"""Token ids in files: fixed-width bit packing, with block offsets for random access.

A folder of shards, part-00000 first, holds the documents in ascending order of their id. A shard is, each part ending in a line feed:

    head    MAGIC, then width (bits an id) and ids a block, unsigned 32-bit
    block   ids a block times width bits, id k at bit k * width, low bit first; the last block may be shorter; as many as needed
    index   an Arrow stream of one table (id, first, n): the shard's documents and where their ids are; its metadata has the blocks' offsets in the file
    tail    the index's offset in the file, the shard's ids and its documents, unsigned 64-bit, then MAGIC

All numbers are little-endian. The width is the least that holds every id of the vocabulary, so ids k to k + n lie in known blocks and those alone are
unpacked, by numpy for all ids at once. Spark's own text writer puts the parts into files and commits them, so any file system that Spark writes will do and
a lost executor costs a shard; its binary reader reads them back.

The texts are range-partitioned by id once, as texts, and encoded on the way into the shard; how many shards there are follows their bytes.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import bpe
from siltstone.llm.arrowmap import arrow_schema, map_rows, plain, text_of
from siltstone.session import register, shared_dir, ship

#: The fixed values of the format.
MAGIC = b"SILTIDS1"
HEAD, TAIL, BREAK = struct.Struct("<8sII"), struct.Struct("<QQQ8s"), b"\n"

END_ID = 0
BLOCK_IDS = 1 << 15
SHARD_BYTES = 32 << 20
CHARS_AN_ID = 3
PREFIX_GROUP = 4096


def width_of(vocabulary: int) -> int:
    """The least bits that hold the ids below ``vocabulary``; 1 at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids in ``width`` bits each, the last byte filled up with zeros. Raises ValueError for an id that needs more."""
    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    return np.packbits((ids[:, None] >> np.arange(width, dtype=np.uint32) & 1).astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(raw, width: int, first: int, n: int) -> np.ndarray:
    """ids first to first + n of a packed block, from the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{width // 8}", count=n, offset=first * width // 8).astype(np.uint32)
    start = first * width
    held = np.frombuffer(raw, dtype=np.uint8)[start >> 3 : (start + n * width + 7) >> 3]
    bits = np.arange(n, dtype=np.int64) * width + (start & 7)
    at, padded = bits >> 3, np.concatenate([held, np.zeros(5, dtype=np.uint8)]).astype(np.uint64)
    word = padded[at]
    for k in range(1, 5):
        word |= padded[at + k] << np.uint64(8 * k)
    return (word >> (bits & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Shard:
    """One shard over any buffer: bytes, or a numpy memmap of a file, of which only what is asked for is then read."""

    def __init__(self, raw):
        self.raw = memoryview(raw).cast("B")
        magic, self.width, self.block_ids = HEAD.unpack(self.raw[: HEAD.size])
        at, self.n_ids, self.n_docs, end = TAIL.unpack(self.raw[-TAIL.size - len(BREAK) : -len(BREAK)])
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a whole shard of token ids")
        with pa.ipc.open_stream(self.raw[at : -TAIL.size - 2 * len(BREAK)]) as reader:
            self.index = reader.read_all().combine_chunks()
        self.offsets = np.array(json.loads(self.index.schema.metadata[b"blocks"]), dtype=np.int64)
        self.first, self.n = (self.index.column(c).to_numpy() for c in ("first", "n"))

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from the shard's id ``first`` on; reads the blocks that hold them and no others."""
        if first < 0 or n < 0 or first + n > self.n_ids:
            raise IndexError(f"the shard has {self.n_ids} ids")
        out, size = [], self.block_ids
        for block in range(first // size, -(-(first + n) // size)):
            lo, hi = max(first - block * size, 0), min(first + n - block * size, size)
            have = min(size, self.n_ids - block * size)
            at = int(self.offsets[block])
            out.append(unpack(self.raw[at : at + (have * self.width + 7) // 8], self.width, lo, hi - lo))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's document k."""
        return self.ids(int(self.first[k]), int(self.n[k]))


def _shard(docs: Iterator[tuple[pa.Array, list[bytes]]], kind: pa.DataType, width: int, block_ids: int) -> Iterator[bytes]:
    """The parts of a shard from (document ids, their token ids as unsigned 32-bit bytes); nothing for no documents. Holds one block, and the index."""
    keys, n, held, offsets, at, total = [], [], [], [], 0, 0

    def part(raw: bytes) -> bytes:
        nonlocal at
        at += len(raw) + len(BREAK)
        return raw

    waiting = 0
    for names, raws in docs:
        if not keys and len(names):
            yield part(HEAD.pack(MAGIC, width, block_ids))
        keys.append(names)
        for raw in raws:
            ids = np.frombuffer(raw, dtype="<u4")
            n.append(len(ids))
            held.append(ids)
            waiting += len(ids)
            if waiting >= block_ids:
                whole = np.concatenate(held)
                for k in range(0, len(whole) - block_ids + 1, block_ids):
                    offsets.append(at)
                    yield part(pack(whole[k : k + block_ids], width))
                held = [whole[len(whole) // block_ids * block_ids :]]
                waiting = len(held[0])
    if not keys:
        return
    if waiting:
        offsets.append(at)
        yield part(pack(np.concatenate(held), width))
    counts = np.array(n, dtype=np.int64)
    total = int(counts.sum())
    schema = pa.schema([("id", kind), ("first", pa.int64()), ("n", pa.int64())], metadata={"blocks": json.dumps(offsets)})
    sink, place = pa.BufferOutputStream(), at
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.table([pa.chunked_array(keys, type=kind), pa.array(np.cumsum(counts) - counts), pa.array(counts)], schema=schema))
    yield part(sink.getvalue().to_pybytes())
    yield part(TAIL.pack(place, total, len(counts), MAGIC))


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID, block_ids: int = BLOCK_IDS, shard_bytes: int = SHARD_BYTES) -> str:
    """Encode documents and write their ids, each document's with the end id, as shards in ascending order of id_col; returns the folder.

    Null ids come first; rows that share an id follow the hash of their text, so that any number of them spreads over shards. Null and empty texts are
    the end id alone. A very long text lies in one shard, whose size it then sets. Other columns are not read, whatever their names. An empty table writes a folder without shards. Special
    strings in texts become their ids, as the library does by default. An existing folder is replaced.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    ship(spark)
    width = width_of(max(bpe.vocabulary(path), end_id + 1))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-chars * width // (8 * CHARS_AN_ID * shard_bytes)))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = rows.select("id", "text", order[1].alias("h"), order[2].alias("k"))
    dealt = dealt.repartitionByRange(int(shards), order[0], "h", "k").sortWithinPartitions(order[0], "h", "k").select("id", "text")
    kind = arrow_schema(T.StructType([rows.schema["id"]])).field(0).type
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(it):
        def encoded():
            for batch in it:
                at = 0
                for group in bpe.batches(batch.column(1).to_pylist()):
                    yield batch.column(0).slice(at, len(group)).cast(kind), [x + end for x in bpe.raw_ids(path, group)]
                    at += len(group)

        for raw in _shard(encoded(), kind, width, block_ids):
            yield pa.RecordBatch.from_arrays([pa.array([raw], type=pa.binary())], names=["part"])

    parts = dealt.mapInArrow(run, T.StructType([plain("part", T.BinaryType())]))
    # the cast keeps the bytes as they are, and the text writer writes bytes
    parts.select(F.col("part").cast("string")).write.mode("overwrite").option("lineSep", BREAK.decode()).option("compression", "none").option("maxRecordsPerFile", 0).text(folder)
    return folder


def read(spark: SparkSession, folder: str, id_type: T.DataType, id_col: str = "doc_id", *, keep_ids: bool = False) -> DataFrame:
    """(id_col, shard, start, n_tokens, ids_crc32[, ids]): a row a document, unpacked from the files; start counts the ids of all documents before it.

    A document is one row however long. A folder without shards gives an empty table. id_type is the type of the ids that were written.
    """
    fields = [plain(id_col, id_type), plain("shard", T.IntegerType()), plain("first", T.LongType()), plain("n_tokens", T.LongType()), plain("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [plain("ids", T.ArrayType(T.IntegerType()))] * keep_ids)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).filter("length > 0")
    files = files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("shard"), "content")

    def per_batch(batch):
        for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = Shard(content.as_buffer())
            for lo in range(0, shard.n_docs, PREFIX_GROUP):
                at = range(lo, min(lo + PREFIX_GROUP, shard.n_docs))
                crc, ids = [], []
                for k in at:
                    found = shard.document(k)
                    crc.append(zlib.crc32(found.astype("<u4").tobytes()))
                    if keep_ids:
                        ids.append(found.astype(np.int32))
                own = shard.index.slice(lo, len(at)).combine_chunks()
                out = {id_col: own.column("id").chunk(0), "shard": [number] * len(at), "first": own.column("first").chunk(0), "n_tokens": own.column("n").chunk(0), "ids_crc32": crc}
                yield out | ({"ids": ids} if keep_ids else {})

    found = map_rows(files, per_batch, schema)
    size = TAIL.size + len(BREAK)
    tails = files.select("shard", F.expr(f"substring(content, -{size}, {size})").alias("tail"))
    totals = map_rows(tails, lambda batch: iter([{"shard": batch.column(0), "n": ids_in(batch.column(1).to_pylist())}]), T.StructType([plain("shard", T.IntegerType()), plain("n", T.LongType())]))
    places = _before(totals).select(F.col("shard").alias("_shard"), F.col("before").alias("_before"))
    found = found.join(places, F.col("shard") == F.col("_shard"))
    return found.select(id_col, "shard", (F.col("_before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def ids_in(tails: list[bytes]) -> list[int]:
    """How many ids the shards with these tails have."""
    return [TAIL.unpack(x[: TAIL.size])[1] for x in tails]


def _before(totals: DataFrame) -> DataFrame:
    """(shard, before): the ids of the shards before each; sums of groups of shards first, so that no task sees them all."""
    group = totals.withColumn("g", F.expr(f"shard div {PREFIX_GROUP}"))
    sums = group.groupBy("g").agg(F.sum("n").alias("s"))
    sums = sums.select("g", (F.sum("s").over(Window.orderBy("g")) - F.col("s")).alias("b"))
    inside = F.sum("n").over(Window.partitionBy("g").orderBy("shard")) - F.col("n")
    return group.withColumn("inside", inside).join(sums, "g").select("shard", (F.col("b") + F.col("inside")).alias("before"))


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write documents to a folder of the shared one and read them back: (id_col, shard, start, n_tokens, ids_crc32). Odd rows as in write()."""
    spark = docs.sparkSession
    folder = register(spark, f"{shared_dir(spark)}/siltstone-ids-{uuid.uuid4().hex}")
    return read(spark, write(docs, folder, path, id_col, text_col, **options), docs.schema[id_col].dataType, id_col)
