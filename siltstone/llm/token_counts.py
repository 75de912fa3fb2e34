"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of frequent pre-tokens and their token counts, broadcast to the workers. It is made on the driver from a bounded
sample of rows and has at most ``table_size`` entries, whatever the corpus. Tier two is each worker's bounded cache, filled with what tier one lacks by
encoding it. One pass over the texts counts them; neither texts nor pre-tokens move. The table decides only how often the encoder is asked: counts
are exact whatever it holds, for all of every text.
"""

from __future__ import annotations

from collections import Counter

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import bpe
from siltstone.llm.arrowmap import map_rows, plain, sampled, text_of, windows

TABLE_SIZE = 1 << 15
SAMPLE = 4_000
SAMPLE_CHARS = 20_000
CACHE_SIZE = 1 << 18
CACHED_CHARS = 64
LIMIT = 512


def frequent_pretokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, table_size: int = TABLE_SIZE, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``table_size`` pre-tokens with their counts, most frequent first (ties: the smaller), of at most ``rows`` texts by a hash of the row; of a text over ``chars`` characters windows over all of it count."""
    found = sampled(docs.select(F.col(id_col).alias("_id"), windows(text_of(text_col), chars).alias("_text")), ["_id", "_text"], rows)
    counts: Counter = Counter()
    for r in found.select("_text").collect():
        if not bpe.odd(r["_text"]):
            counts.update(bpe.pretokens(r["_text"]))
    return sorted(((w, n) for w, n in counts.items() if len(w) <= CACHED_CHARS), key=lambda x: (-x[1], x[0]))[:table_size]


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, limit: int = LIMIT, table_size: int = TABLE_SIZE, rows: int = SAMPLE) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit), one row per input row.

    Null and empty texts have no bytes and no tokens. Rows that repeat, also in their id, are each counted; null
    ids stay null; other columns are not read, whatever their names. An empty table gives an empty result.
    Files that are not plain byte-level BPE are counted by their own library, text by text.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = T.StructType([plain(id_col, docs.schema[id_col].dataType), plain("n_bytes", T.LongType()), plain("n_tokens", T.LongType()), plain("over_limit", T.BooleanType())])
    load = bpe.from_json if path.endswith(".json") else bpe.from_ranks
    try:
        encoder = load(path) if path.endswith((".json", ".tiktoken")) else None
    except ValueError:
        encoder = None
    table = encoder.lengths([w for w, _ in frequent_pretokens(docs, id_col, text_col, table_size=table_size, rows=rows)]) if encoder else {}
    known, fast = docs.sparkSession.sparkContext.broadcast(table), encoder is not None
    seen: dict[str, int] = {}

    def per_batch(batch):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        if fast:
            counts = [n for group in bpe.batches(texts) for n in lookup(load(path), known.value, seen, group)]
        else:
            counts = [len(x) for group in bpe.batches(texts) for x in bpe.library(path)(group)]
        yield {id_col: ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    return map_rows(docs.select(F.col(id_col), text_of(text_col).alias("text")), per_batch, schema)


def lookup(encoder: bpe.ByteBPE, known: dict[str, int], seen: dict[str, int], texts: list[str]) -> list[int]:
    """Token counts: a pre-token's by tier one, else by the worker's cache ``seen``, which takes up what is encoded; odd() texts by the library.

    ``seen`` starts as a copy of tier one, so that one probe asks both.
    """
    if not seen or len(seen) > CACHE_SIZE + len(known):
        seen.clear()
        seen.update(known)
    cut = [encoder.parts(t) for t in texts]
    parts = [[None if bpe.odd(x) else bpe.pretokens(x) for x in p[::2]] for p in cut]
    found = [[w and list(map(seen.get, w)) for w in p] for p in parts]
    missed = {x for p, f in zip(parts, found, strict=True) for w, n in zip(p, f, strict=True) if n and None in n for x, y in zip(w, n, strict=True) if y is None}
    fresh = encoder.lengths(missed)
    seen.update((w, n) for w, n in fresh.items() if len(w) <= CACHED_CHARS)

    def count(text: str, pre: list[str] | None, lengths: list[int | None]) -> int:
        if pre is None:
            return len(encoder.plain(text)) // 4
        return sum(n or fresh[w] for w, n in zip(pre, lengths, strict=True)) if None in lengths else sum(lengths)

    return [len(c) // 2 + sum(map(count, c[::2], p, f)) for c, p, f in zip(cut, parts, found, strict=True)]
