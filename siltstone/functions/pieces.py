"""Exact token counts by a byte-level vocabulary: pieces of texts, each distinct one priced once.

Texts are split into pieces by column expressions. Pieces are counted by text, the distinct ones form a table that is dealt out by a hash and priced there by merging, and prices are joined back. So the
merging grows with the vocabulary that texts use, not with the texts. Nothing stands behind this but the vocabulary's own list of merges.
"""

from __future__ import annotations

import gzip
import heapq
import json
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import SPACE
from siltstone.session import materialise, ship

# Fixed patterns: numbers first, then runs of Han and kana, then words. White space is spelt out, as engines differ in what they take for it.
HAN = "\\u4e00-\\u9fa5\\u3040-\\u309f\\u30a0-\\u30ff"
WORD = f"[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~][A-Za-z]+|[^\\r\\n\\p{{L}}\\p{{P}}\\p{{S}}]?[\\p{{L}}\\p{{M}}]+| ?[\\p{{P}}\\p{{S}}]+[\\r\\n]*|[{SPACE}]*[\\r\\n]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces up to this many units are merged by looking for the best pair anew; longer ones by a heap.
SHORT = 24


def _apart(part: Column, pattern: str) -> Column:
    """The matches of a pattern and what lies between them, in order."""
    return F.regexp_extract_all(part, F.lit(f"{pattern}|(?s:(?:(?!{pattern}).)+)"), F.lit(0))


def pieces(text: Column) -> Column:
    """A text's pieces, which tile it: numbers of up to three digits, Han and kana runs, words, signs and white space, each split only inside what the ones before left. Null and empty texts have none."""
    inside = lambda parts, own, pattern: F.flatten(F.transform(parts, lambda p: F.when(p.rlike(f"\\A(?:{own})"), F.array(p)).otherwise(_apart(p, pattern))))
    numbers = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(_apart(text, "\\p{N}{1,3}"))
    han = inside(numbers, "\\p{N}", f"[{HAN}]+")
    return inside(han, f"\\p{{N}}|[{HAN}]", f"(?:{WORD})")


class Merges:
    """A byte-level vocabulary's merges: pairs of symbols, and the order in which they are made."""

    def __init__(self, pairs: list[tuple[str, str]]):
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = (b for b in range(256) if b not in set(printable))
        self.unit = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.rank = {pair: k for k, pair in enumerate(pairs)}

    def count(self, piece: str) -> int:
        """How many symbols are left of a piece when the best pair has been merged as long as there is one: the least rank, of equal ones the leftmost."""
        parts = [self.unit[b] for b in piece.encode("utf-8", "replace")]
        return len(self._few(parts) if len(parts) <= SHORT else self._many(parts))

    def _few(self, parts: list[str]) -> list[str]:
        none = len(self.rank)
        while len(parts) > 1:
            best, at = min((self.rank.get(pair, none), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if best == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _many(self, parts: list[str]) -> list[str]:
        """The same in n log n: places form a chain, and a pair in the heap counts only while both its places still hold what it was made of."""
        held: dict[int, str] = dict(enumerate(parts))
        after = {k: k + 1 for k in range(len(parts) - 1)}
        before = {b: a for a, b in after.items()}
        waiting: list[tuple[int, int, str, str]] = []

        def offer(at: int | None) -> None:
            if at is not None and at in after:
                pair = held[at], held[after[at]]
                if pair in self.rank:
                    heapq.heappush(waiting, (self.rank[pair], at, *pair))

        for at in range(len(parts) - 1):
            offer(at)
        while waiting:
            _, at, left, right = heapq.heappop(waiting)
            gone = after.get(at)
            if gone is None or held.get(at) != left or held[gone] != right:
                continue
            held[at] = left + right
            del held[gone]
            far = after.pop(gone, None)
            if far is None:
                del after[at]
            else:
                after[at], before[far] = far, at
            offer(before.get(at))
            offer(at)
        return list(held.values())


@lru_cache(maxsize=2)
def _merges(content: bytes) -> Merges:
    """From a tokenizer's JSON, plain or compressed, once per worker."""
    model = json.loads(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)["model"]
    return Merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])


def vocabulary(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file's content, from any store that Spark reads. A missing or broken file raises; there is no estimate in its stead."""
    found = spark.read.format("binaryFile").load(path).select("content").first()
    if found is None:
        raise FileNotFoundError(path)
    _merges(bytes(found[0]))
    return bytes(found[0])


def prices(found: DataFrame, content: bytes) -> DataFrame:
    """(piece, tokens): the price of each distinct piece of found. The vocabulary is broadcast: some megabytes, whatever the data."""
    spark = found.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(content)

    def run(it):
        import pyarrow as pa

        for batch in it:
            merges = _merges(shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(merges.count, batch.column(0).to_pylist()), pa.int64())], names=["piece", "tokens"])

    return found.select("piece").distinct().mapInArrow(run, T.StructType.fromDDL("piece string, tokens long"))


def _counted(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, piece, n): how often each row's text holds a piece, counted where the row is; a text without pieces is one row without a piece."""
    ship(rows.sparkSession)
    found = rows.select(*keys, pieces(F.col(text)).alias("_pieces"))
    schema = T.StructType([*found.schema.fields[: len(keys)], T.StructField("piece", T.StringType()), T.StructField("n", T.LongType())])

    def run(it):
        import pyarrow as pa

        for batch in it:
            source, piece, n = [], [], []
            for k, held in enumerate(batch.column(len(keys)).to_pylist()):
                counts = Counter(held) or {None: 0}
                source += [k] * len(counts)
                piece += counts.keys()
                n += counts.values()
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(keys))), pa.array(piece, pa.string()), pa.array(n, pa.int64())], names=schema.names)

    return found.mapInArrow(run, schema)


def exact_tokens(rows: DataFrame, keys: list[str], text: str, content: bytes) -> DataFrame:
    """(keys, pieces, tokens): the exact tokens of each row's text. Rows that share their keys are added up; null keys are a key like any other; null and empty texts cost nothing.

    Pieces are counted by row before they move, and both sides of the join are written tables, so adaptive execution can split a piece that most texts hold.
    """
    each = materialise(_counted(rows, keys, text))
    priced = materialise(prices(each.filter("piece is not null"), content))
    found = each.join(priced, "piece", "left")
    return found.groupBy(*keys).agg(F.sum("n").alias("pieces"), F.coalesce(F.sum(F.col("n") * F.col("tokens")), F.lit(0)).alias("tokens"))
