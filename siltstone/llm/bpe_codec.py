"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into overlapping chunks that are pre-tokenised each for itself. A scan that starts amid a text may begin out of step, but
the split pattern looks only forward: from the first boundary that two scans share, they agree. The text is cut there, at boundaries after a
character that is not white space, where what follows cannot change what comes before; the pieces between cuts are encoded on their own
and joined in order. Where an overlap has no shared boundary (one word is longer than it, say), the scan that is in step reads on, by
doubling steps, until it shares one with a later chunk. So a text takes time in proportion to its length.

A text longer than a section (many chunks) is dealt to several tasks, section by section. Sections overlap and are stitched by the same rule: only
the boundaries inside their overlaps are compared. A text in which two sections share no boundary is gathered and cut in one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import bpe
from siltstone.llm.arrowmap import map_rows, plain, text_of

CHUNK = 512
OVERLAP = 64
SECTION = 65_536
SEAM = 4_096


def _starts(text: str, low: int, high: int) -> list[int]:
    """Where the pre-tokens of text[low:high] start, and high, in the text's own places. Where engines may differ, only starts that every engine sees: at a space before what is none."""
    body = text[low:high]
    if bpe.odd(body):
        return [low, *(low + k for k in range(1, len(body) - 1) if body[k] == " " and not body[k + 1].isspace() and not body[k - 1].isspace()), high]
    return list(accumulate(map(len, bpe.pretokens(body)), initial=low))


def _cuttable(text: str, starts: list[int], low: int, high: int) -> list[int]:
    """The starts in [low, high) that follow a character which is not white space; not a scan's end nor its last start, as a contraction may be cut in two there."""
    return [x for x in starts[bisect_left(starts, low) : min(bisect_left(starts, high), len(starts) - 2)] if x and not text[x - 1].isspace()]


def cuts(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where the text is cut: places at which every chunk's scan is in step with that of the whole text. Few chunks' scans are held at a time."""
    n = len(text)
    count = max(1, -(-(n - overlap) // chunk))
    scan = lru_cache(maxsize=4)(lambda k: _starts(text, k * chunk, min(n, (k + 1) * chunk + overlap)))
    out: list[int] = []
    live, since, k = scan(0), 0, 1  # the scan that is in step, from where on it is, and the next chunk
    while k < count:
        at = k * chunk
        heads = set(_cuttable(text, scan(k), at, at + overlap))
        found = next((x for x in _cuttable(text, live, at, at + overlap) if x in heads), None)
        if found is None:
            found, k = _read_on(text, max([since, *live[-3:-2]]), scan, count, k, chunk)
            if found is None:
                break
        out.append(found)
        live, since, k = scan(k), found, k + 1
    return out


def _read_on(text: str, begin: int, scan: Callable[[int], list[int]], count: int, k: int, chunk: int) -> tuple[int | None, int]:
    """(place, chunk) of the first boundary from chunk k on that a scan from begin, a true boundary, shares with a chunk's own; (None, k) at the text's end."""
    n, step = len(text), 2 * chunk
    while True:
        end = min(n, begin + step)
        more = _starts(text, begin, end)
        for x in _cuttable(text, more, max(k * chunk, begin + 1), end):
            j = min(x // chunk, count - 1)
            other = scan(j)
            at = bisect_left(other, x)
            if at < len(other) - 2 and other[at] == x:
                return x, j
        if end == n:
            return None, k
        begin, step = max([begin, *more[-3:-2]]), 2 * step


def pieces(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text as pieces that are encoded independently."""
    at = [0, *cuts(text, chunk, overlap), len(text)]
    return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _keyed(df: DataFrame, per_row: Callable[[dict], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """mapInArrow that yields a batch a row, so that long texts do not add up."""

    def run(batch):
        names = batch.schema.names
        for k in range(batch.num_rows):
            made = list(per_row({c: batch.column(c)[k].as_py() for c in names}))
            if made:
                yield {f.name: [m[f.name] for m in made] for f in schema.fields}

    return map_rows(df, run, schema)


def sections(docs: DataFrame, keys: list[str], text: str, section: int = SECTION, seam: int = SEAM) -> DataFrame:
    """keys, part, parts, body: overlapping sections of each text, part k starting at k * section characters; each text is walked once."""
    schema = T.StructType([*(docs.schema[c] for c in keys), plain("part", T.IntegerType()), plain("parts", T.IntegerType()), plain("body", T.StringType())])

    def cut(row):
        t = row[text]
        parts = max(1, -(-(len(t) - seam) // section))
        for k in range(parts):
            yield {c: row[c] for c in keys} | {"part": k, "parts": parts, "body": t[k * section : (k + 1) * section + seam]}

    return _keyed(docs.select(*keys, text), cut, schema)


def section_pieces(docs: DataFrame, keys: list[str], text: str, *, chunk: int = CHUNK, overlap: int = OVERLAP, section: int = SECTION, seam: int = SEAM) -> DataFrame:
    """keys, part, pieces: each text's pieces by section, found in parallel; keys must be unique."""
    dealt = sections(docs, keys, text, section, seam).repartition(*keys, "part")
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*dealt.schema.fields, plain("at", ints), plain("head", ints), plain("tail", ints)])

    def scan(row):
        body = row["body"]
        at = cuts(body, chunk, overlap)
        rest = _starts(body, max((x for x in at if x < section), default=0), len(body))
        head = _cuttable(body, _starts(body, 0, min(len(body), 2 * seam)), 1, seam) if row["part"] else []
        tail = [x - section for x in _cuttable(body, rest, section, len(body))] if row["part"] < row["parts"] - 1 else []
        yield row | {"at": at, "head": head, "tail": tail}

    w = Window.partitionBy(*keys).orderBy("part")
    first = F.array_min(F.array_intersect(F.lag("tail").over(w), F.col("head")))
    stitched = _keyed(dealt, scan, schema).withColumn("begin", F.when(F.col("part") == 0, F.lit(0)).otherwise(first))
    lost = F.max(F.when(F.col("begin").isNull(), 1).otherwise(0)).over(Window.partitionBy(*keys)) == 1
    stop = F.when(F.col("part") == F.col("parts") - 1, F.length("body")).otherwise(F.lead("begin").over(w) + section)
    stitched = stitched.withColumns({"stop": stop, "lost": lost}).drop("head", "tail")
    gone = stitched.filter("lost").select(*keys, F.struct("part", F.when(F.col("part") < F.col("parts") - 1, F.substring("body", 1, section)).otherwise(F.col("body")).alias("body")).alias("p"))
    whole = gone.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["body"]), "").alias("body"))
    out = T.StructType([*(docs.schema[c] for c in keys), plain("part", T.IntegerType()), plain("pieces", T.ArrayType(T.StringType()))])

    def inside(row):
        at = [row["begin"], *(x for x in row["at"] if row["begin"] < x < row["stop"]), row["stop"]]
        yield {c: row[c] for c in keys} | {"part": row["part"], "pieces": [row["body"][a:b] for a, b in zip(at[:-1], at[1:], strict=True)]}

    def again(row):
        yield {c: row[c] for c in keys} | {"part": 0, "pieces": pieces(row["body"], chunk, overlap)}

    return _keyed(stitched.filter("not lost"), inside, out).unionByName(_keyed(whole, again, out))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, chunk: int = CHUNK, overlap: int = OVERLAP, section: int = SECTION, seam: int = SEAM, finish=None, out: T.StructType | None = None) -> DataFrame:
    """(id_col, ids array<int>, n_pieces), one row per input row; ``finish(encoder, raw ids)`` -> dict replaces ``ids`` by the columns ``out``.

    Every text goes through chunks and pieces; texts longer than a section go through several tasks, and of those, rows that repeat in id and
    text are encoded once and repeated again at the end. Null and empty texts have no ids and one empty piece. Null ids stay null. Other columns
    are not read, whatever their names. An empty table gives an empty result.
    """
    if not 0 < overlap <= chunk or not 0 < seam <= section:
        raise ValueError("an overlap is at most as long as what overlaps")
    path = path or public_tokenizers.path(bpe.RANKS)
    kind = docs.schema[id_col].dataType
    out = out or T.StructType([plain("ids", T.ArrayType(T.IntegerType()))])
    finish = finish or (lambda encoder, raw: {"ids": np.frombuffer(raw, dtype="<u4").tolist()})
    count = plain("n_pieces", T.LongType())
    schema = T.StructType([plain(id_col, kind), *out.fields, count])
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    long = F.length("text") > section + seam

    def one_section(batch):
        encoder = bpe.from_ranks(path)
        done = []
        for t in batch.column(1).to_pylist():
            found = pieces(t, chunk, overlap)
            done.append(finish(encoder, b"".join(map(encoder.plain, found))) | {"n_pieces": len(found)})
        yield {id_col: batch.column(0)} | {f.name: [d[f.name] for d in done] for f in [*out.fields, count]}

    keys = ["_id", "_sha", "_n"]
    keyed = rows.filter(long).groupBy(F.col(id_col).alias("_id"), F.sha2("text", 256).alias("_sha")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("_n"))
    cut = section_pieces(keyed, keys, "text", chunk=chunk, overlap=overlap, section=section, seam=seam)
    raw_schema = T.StructType([*(keyed.schema[c] for c in keys), plain("part", T.IntegerType()), plain("raw", T.BinaryType()), count])

    def piecewise(row):
        encoder = bpe.from_ranks(path)
        yield {c: row[c] for c in (*keys, "part")} | {"raw": b"".join(map(encoder.plain, row["pieces"])), "n_pieces": len(row["pieces"])}

    def joined(row):
        yield {id_col: row["_id"], "_n": row["_n"]} | finish(bpe.from_ranks(path), b"".join(row["raws"])) | {"n_pieces": row["n_pieces"]}

    done = _keyed(cut, piecewise, raw_schema)
    gathered = done.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "raw"))), lambda x: x["raw"]).alias("raws"), F.sum("n_pieces").alias("n_pieces"))
    full = _keyed(gathered, joined, T.StructType([*schema.fields, plain("_n", T.LongType())]))
    again = full.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*schema.names)
    return map_rows(rows.filter(~long), one_section, schema).unionByName(again)


def decode(ids: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, raw binary): the bytes of the tokens, joined. Null ids give no bytes; an id outside the file raises."""
    path = path or public_tokenizers.path(bpe.RANKS)
    schema = T.StructType([plain(id_col, ids.schema[id_col].dataType), plain("raw", T.BinaryType())])

    def run(batch):
        encoder = bpe.from_ranks(path)
        yield {id_col: batch.column(0), "raw": [encoder.decode(x or []) for x in batch.column(1).to_pylist()]}

    return map_rows(ids.select(id_col, F.col(ids_col).alias("_ids")), run, schema)


def round_trip(encoder: bpe.ByteBPE, raw: bytes) -> dict:
    """Digests of a text's ids and of the bytes that they decode to."""
    ids = np.frombuffer(raw, dtype="<u4").tolist()
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(encoder.names.__getitem__, ids)).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(encoder.decode(ids)).hexdigest()}


DIGEST = T.StructType([plain("n_tokens", T.LongType()), plain("ids_sha256", T.StringType()), plain("decoded_sha256", T.StringType())])
