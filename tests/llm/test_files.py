"""Ids in bit-packed files against the library and plain arrays."""

from __future__ import annotations

import random
import tempfile
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from siltstone.llm import bpe, queries, token_files


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.data())
def test_unpacking_inverts_packing(width, ids, data):
    ids = np.array([x & ((1 << width) - 1) for x in ids], dtype=np.uint32)
    raw = token_files.pack(ids, width)
    assert len(raw) == (len(ids) * width + 7) // 8
    first = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - first))
    assert token_files.unpack(raw, width, first, n).tolist() == ids[first : first + n].tolist()


def test_widths():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 32_000, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 15, 16, 16, 17]
    with pytest.raises(ValueError, match="bits"):
        token_files.pack(np.array([8]), 3)
    assert [bpe.vocabulary(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model")] == [50_257, 50_256, 49_408, 32_000]


def shards(folder):
    return sorted(p for p in Path(folder.removeprefix("file://")).glob("part-*") if p.stat().st_size)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_documents_come_back(spark, name):
    path = public_tokenizers.path(name)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "the", "of", "x", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", None, "long words " * 9000]
    rows = [(k * 3 % 83, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, n int")
    folder = tempfile.mkdtemp()
    token_files.write(df, folder, path, block_ids=8 * 16, shard_bytes=2000)
    back = token_files.read(spark, folder, T.LongType(), keep_ids=True).collect()
    lib, at = bpe.library(path), 0
    by = {r.doc_id: r for r in back}
    assert len(back) == len(rows)
    for d, t in sorted((d, t) for d, t, *_ in rows):
        ids = [*lib([t or ""])[0], 0]
        r = by[d]
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    # random access over a mapped file, across blocks
    found = shards(folder)
    assert len(found) > 3
    for p in found:
        shard = token_files.Shard(np.memmap(p, dtype=np.uint8, mode="r"))
        assert shard.width == token_files.width_of(bpe.vocabulary(path)) and shard.n_docs == len(shard.index)
        every = np.concatenate([shard.document(k) for k in range(shard.n_docs)])
        assert len(every) == shard.n_ids and shard.ids(0, shard.n_ids).tolist() == every.tolist()
        for _ in range(20):
            a = rng.randint(0, shard.n_ids)
            n = rng.randint(0, shard.n_ids - a)
            assert shard.ids(a, n).tolist() == every[a : a + n].tolist()
        with pytest.raises(IndexError):
            shard.ids(1, shard.n_ids)


def test_odd_rows(spark):
    rows = [(None, "b c"), (None, None), (2, "a"), (2, "a"), (2, "z"), (-5, ""), (1, "a <|endoftext|> b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_files.round_trip(df).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -5, 1, 2, 2, 2]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert got[2].n_tokens == 1 and got[3].n_tokens == 5
    assert token_files.round_trip(df.limit(0)).count() == 0
    named = token_files.round_trip(df.select(F.concat(F.lit("d"), "doc_id").alias("name"), "text"), None, "name")
    assert sorted((r.name or "") for r in named.collect()) == ["", "", "d-5", "d1", "d2", "d2", "d2"]


def test_one_id_for_many_rows_spreads(spark):
    df = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("same words").alias("text"))
    got = token_files.round_trip(df, shard_bytes=1000).groupBy("shard").count().collect()
    assert len(got) > 4 and max(r["count"] for r in got) < 1000


def test_broken_files_are_refused(spark):
    with pytest.raises(ValueError, match="shard"):
        token_files.Shard(b"x" * 100)


def test_query_op11(spark, sf):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sorted((r.doc_id, r.text or "") for r in queries.table(spark, sf, "documents").collect())
    got = {r.doc_id: r for r in queries.op11_token_files(spark, sf).collect()}
    assert set(got) == {d for d, _ in docs}
    at = 0
    for d, t in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
