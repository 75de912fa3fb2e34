"""Exact token counts against a plain split and a plain merge."""

from __future__ import annotations

import json
import random
from functools import lru_cache

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from siltstone.catalogue import QUERIES
from siltstone.functions import pieces
from siltstone.operators import lines

PATH = public_tokenizers.path("byte_bpe_50k.json")
STEPS = [regex.compile(p) for p in (r"\p{N}{1,3}", r"[一-龥぀-ゟ゠-ヿ]+", r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~][A-Za-z]+|[^\r\n\p{L}\p{P}\p{S}]?[\p{L}\p{M}]+| ?[\p{P}\p{S}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+""")]


def plain_split(text):
    parts = [text] if text else []
    for step in STEPS:
        out = []
        for part in parts:
            at = 0
            for m in step.finditer(part):
                out += [part[at : m.start()], m[0]]
                at = m.end()
            out.append(part[at:])
        parts = [p for p in out if p]
    return parts


@lru_cache(maxsize=1)
def plain_ranks():
    with open(PATH, encoding="utf-8") as f:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.load(f)["model"]["merges"]]
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unit = {b: chr(b) for b in keep}
    for b in range(256):
        if b not in unit:
            unit[b] = chr(256 + len(unit) - len(keep))
    return unit, {p: k for k, p in enumerate(pairs)}


@lru_cache(maxsize=None)
def plain_count(piece):
    unit, rank = plain_ranks()
    parts = [unit[b] for b in piece.encode()]
    while True:
        found = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]
        if not found:
            return len(parts)
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


ODD = ["", " ", "a  b", "  12345  67", "it's 3.5%  ok\r\n\r\n next", "日本語のテキスト、with words", "x" * 300, "!!!wow ??\n", "\t\ttab  nbsp　wide", "café naïve", "écombining", "a\u0000b\u0001\u0002c", "😀 😀x", "<|endoftext|> #tag @me", "trailing   ", "12日3本45"]


def drawn(seed, n):
    rng = random.Random(seed)
    units = ["a", "the", " ", "  ", "\n", "\r\n", "7", "2024", "日", "カ", ".", "'s", "é", "\t", "-", "Word", "😀", "́", " "]
    return ["".join(rng.choice(units) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_pieces_are_the_plain_split(spark):
    texts = ODD + drawn(1, 200)
    got = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", pieces.pieces(F.col("t")).alias("p")).collect()
    for r in got:
        assert list(r.p) == plain_split(texts[r.k]), repr(texts[r.k])


def test_merging(spark):
    merges = pieces._merges(pieces.vocabulary(spark, PATH))
    rng = random.Random(2)
    for piece in [*drawn(3, 60), *("".join(rng.choice("theab ") for _ in range(n)) for n in (1, 2, 23, 24, 25, 80, 400))]:
        parts = [merges.unit[b] for b in piece.encode()]
        assert merges._few(list(parts)) == merges._many(list(parts)) and merges.count(piece) == plain_count(piece)
    assert merges.count("ab" * 100_000) > 0  # n log n


def test_exact_tokens(spark):
    texts = [*ODD, None, *drawn(4, 60)]
    rows = [(k % 50, t) for k, t in enumerate(texts)] + [(None, "null key"), (None, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.pieces, r.tokens) for r in pieces.exact_tokens(df, ["doc_id"], "text", pieces.vocabulary(spark, PATH)).collect()}
    want = {}
    for k, t in rows:
        found = plain_split(t or "")
        a, b = want.get(k, (0, 0))
        want[k] = (a + len(found), b + sum(map(plain_count, found)))
    assert got == want
    assert pieces.exact_tokens(df.limit(0), ["doc_id"], "text", pieces.vocabulary(spark, PATH)).count() == 0
    with pytest.raises(Exception, match="(?i)exist|path"):
        pieces.vocabulary(spark, "/nowhere/none.json")


def test_exact_prices_of_messages(spark):
    block = "struct<type:string,text:string,name:string,arguments:string,attachment_name:string,offloaded:boolean,raw_json:string>"
    rows = [(1, 0, [("text", "Hello there, world", None, None, None, None, None), ("chart", None, None, None, None, None, '{"x":12345}')]), (1, 1, [("tool-call", None, "read", '{"path":"x"}', None, None, None)]), (2, 0, None), (None, 0, [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, content array<{block}>")
    got = {(r.conv_id, r.turn): r.tokens for r in lines.exact_message_tokens(df, ["conv_id", "turn"], "content", pieces.vocabulary(spark, PATH)).collect()}
    count = lambda t: sum(map(plain_count, plain_split(t)))
    assert got == {(1, 0): 4 + 4 + count("Hello there, world") + 4 + 3, (1, 1): 8 + count('read{"path":"x"}'), (2, 0): 4, (None, 0): 4}


def test_query_exact_document_tokens(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["exact_document_tokens"](spark, sf).collect()
    want = {d: plain_split(t) for d, t in docs.items()}
    assert {r.doc_id: (r.pieces, r.tokens) for r in got} == {d: (len(p), sum(map(plain_count, p))) for d, p in want.items()}


def test_each_piece_is_priced_once(spark):
    seen = []
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same words for number "), (F.col("id") % 5).cast("string")).alias("text"))
    found = pieces.prices(df.select(F.explode(pieces.pieces(F.col("text"))).alias("piece")), pieces.vocabulary(spark, PATH))
    seen = [r.piece for r in found.collect()]
    assert len(seen) == len(set(seen)) == 5 + 6


def test_pieces_are_counted_where_their_row_is(spark):
    rows = spark.createDataFrame([(1, "a a b"), (1, "a"), (None, ""), (2, None)], "k long, t string")
    found = pieces._counted(rows, ["k"], "t")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", 1), (1, " a", 1), (1, " b", 1), (1, "a", 1), (None, None, 0), (2, None, 0)], key=str)
