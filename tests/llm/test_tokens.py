"""Encoding, counting and packing against the public libraries."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import bpe, bpe_codec, packing, queries, token_counts

ODD = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "\n\n x", "don't we'll", "x" * 5000, "é日本 漢字　z  q", "1234 5678", "<|endoftext|>", "a <|endoftext|> b", "!!?? ...", "\t\ttab  \r\n", "😀 😀😀", "!\U00033479\U00033479's \U00033479 a\u0558b ", "it's we're 'tis 'r", "word " * 3000, "ab" * 40_000, None]


def library():
    ranks = bpe.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).encoding._mergeable_ranks
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", " ", "  ", "\n", ".", ",", "é", "9", "'s", "Z", " ", "-", "日", "\U00033479", "\x1c", "\u0558", "'re"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(n)]


def test_encoder_is_the_library():
    enc, lib = bpe.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), library()
    texts = [t for t in ODD if t is not None] + random_texts(300)
    for raw, t in zip(map(enc.plain, texts), texts, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == lib.encode_ordinary(t)
        assert enc.decode(np.frombuffer(raw, "<u4").tolist()) == t.encode()


def test_json_encoder_is_the_library():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for t in ODD if t is not None] + random_texts(100)
    got = map(bpe.from_json(public_tokenizers.path("byte_bpe_50k.json")).encode, texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("chunk", "overlap"), [(8, 5), (20, 20), (64, 16), (512, 128)])
def test_pieces_are_encoded_as_the_whole(chunk, overlap):
    enc = bpe.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [t for t in ODD if t is not None] + random_texts(300, 5) + ["a'" * 900, "'re" * 700, "!'re " * 500, "ab" * 4000 + " c d. e" * 50 + "q" * 3000 + "'re", "日" * 5000, "word, " * 900]
    several = 0
    for t in texts:
        found = bpe_codec.pieces(t, chunk, overlap)
        several += len(found) > 1
        assert "".join(found) == t and b"".join(map(enc.plain, found)) == enc.plain(t)
    assert several > (100 if chunk < 64 else 4)
    # a text with boundaries everywhere is cut in every overlap
    assert chunk < 64 or len(bpe_codec.pieces("a b " * 500, chunk, overlap)) >= (2000 - overlap) // chunk


@pytest.mark.parametrize(("chunk", "overlap", "section", "seam"), [(20, 7, 60, 20), (64, 32, 300, 64), (512, 128, 65_536, 4_096)])
def test_chunks_stitch_to_the_whole(spark, chunk, overlap, section, seam):
    texts = [*ODD, *random_texts(60, 8), "x" * 300 + " y" * 100, " " * 500, "z" * 70 + " ", "It's one, two; three. " * 5000]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(3, texts[3], 0), (None, "a  b " * 50, 0), (None, "a  b " * 50, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    lib = library()
    want = sorted(((d, lib.encode_ordinary(t or "")) for d, t, _ in rows), key=repr)
    encoded = bpe_codec.encode(df, chunk=chunk, overlap=overlap, section=section, seam=seam)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=repr) == want
    back = bpe_codec.decode(encoded)
    assert sorted((bytes(r.raw) for r in back.collect())) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe_codec.encode(df.limit(0), chunk=chunk, overlap=overlap, section=section, seam=seam).count() == 0


def test_time_follows_the_length():
    text = "It's one, two; three of them. " * 100_000

    def seconds(n):
        best = 9.0
        for _ in range(3):
            at = time.perf_counter()
            bpe_codec.pieces(text[:n])
            best = min(best, time.perf_counter() - at)
        return best

    assert seconds(3_000_000) < 8 * seconds(750_000)
    assert len(bpe_codec.pieces("x" * 3_000_000)) == 1  # one word: read on by doubling steps


def test_query_op3(spark, sf):
    lib = library()
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op3_bpe_codec(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = lib.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    # most documents have several chunks, and the stitched pieces are about as many
    chunks = sum(max(1, -(-(len(t) - bpe_codec.OVERLAP) // bpe_codec.CHUNK)) for t in docs.values())
    assert sum(r.n_pieces > 1 for r in got) > 0.7 * len(got) and sum(r.n_pieces for r in got) > 0.9 * chunks


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_every_kind_of_file(spark, name):
    texts = [*ODD, *random_texts(20), "w" * 600]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "a b", "x"), (1, " ", "x")], "doc_id long, text string, n_tokens string")
    path = public_tokenizers.path(name)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, path).collect()), key=repr)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    elif name.endswith(".json"):
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        count = lambda t: len(bpe.from_ranks(path).encoding.encode_ordinary(t))
    rows = [(k, t or "") for k, t in enumerate(texts)] + [(None, "a b"), (1, " ")]
    assert got == sorted(((k, len(t.encode()), count(t), count(t) > 512) for k, t in rows), key=repr)
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_tier_one_holds_pretokens(spark):
    df = spark.createDataFrame([(k, "x common rare%d, common" % k, 0) for k in range(500)], "doc_id long, text string, _text int").repartition(7)
    assert token_counts.frequent_pretokens(df, table_size=3) == [(" common", 1000), (" rare", 500), (",", 500)]
    few = token_counts.frequent_pretokens(df, rows=100)
    assert dict(few)[" common"] == 200 and few == token_counts.frequent_pretokens(df.repartition(3), rows=100)


def test_counts_are_one_pass_without_exchange(spark, sf):
    plan = queries.op8_token_counts(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_the_tables_do_not_change_counts():
    enc = bpe.from_json(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for t in ODD if t is not None] + random_texts(50, 4)
    want = [len(enc.encode(t)) // 4 for t in texts]
    words = sorted({w for t in texts for w in bpe.pretokens(t)})
    for known in ({}, enc.lengths(words[::2]), enc.lengths(words)):
        seen = {}
        assert token_counts.lookup(enc, known, seen, texts) == want == token_counts.lookup(enc, known, seen, texts)


def test_query_op8(spark, sf):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    want = {d: (len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 512) for d, t in docs.items()}
    got = queries.op8_token_counts(spark, sf).collect()
    assert len(got) == len(docs) and {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == want


def sound(rows, capacity=1024):
    """rows: (length, sequence, offset); gapless sequences within the capacity."""
    by = defaultdict(list)
    for length, sequence, offset in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("kind", ["mixed", "one length", "short", "long", "ties"])
def test_plan_uses_every_piece_once(kind):
    rng = random.Random(5)
    lengths = {"mixed": [rng.randint(1, 1024) for _ in range(5000)], "one length": [300] * 1000, "short": [rng.randint(1, 9) for _ in range(3000)], "long": [rng.randint(700, 1024) for _ in range(500)], "ties": [512, 256, 768, 1] * 300}[kind]
    hist = {v: lengths.count(v) for v in set(lengths)}
    found = packing.plan(hist)
    used = defaultdict(int)
    for parts, n in found:
        assert sum(parts) <= 1024 and n > 0
        for v in parts:
            used[v] += n
    assert dict(used) == hist
    sequences = sum(n for _, n in found)
    bound = -(-sum(lengths) // 1024)
    assert sequences <= {"one length": 334, "long": 500}.get(kind, bound * 1.02 + 3)


@pytest.mark.parametrize(("low", "high", "count", "over"), [(1, 1024, 200_000, 0.002), (100, 700, 200_000, 0.0005), (1, 341, 200_000, 0.0001), (1, 100, 50_000, 0.0001), (200, 341, 200_000, 0.07), (300, 600, 100_000, 0.045)])
def test_plan_is_never_worse_than_best_fit(low, high, count, over):
    """Near the bound, and no more sequences than packing everything by either best fit."""
    lengths = np.random.default_rng(7).integers(low, high + 1, count)
    counts = np.bincount(lengths, minlength=1025).tolist()
    made = packing.plan({v: n for v, n in enumerate(counts) if n})
    used = np.zeros(1025, dtype=np.int64)
    for parts, n in made:
        assert sum(parts) <= 1024
        np.add.at(used, list(parts), n)
    assert used.tolist() == counts
    took = lambda p: sum(n for _, n in p)
    assert took(made) <= min(took(packing.residual(counts, 1024)), took(packing.tight(counts, 1024)), -(-int(lengths.sum()) // 1024) * (1 + over))


def test_pack_odd_rows(spark):
    rows = [(1, 5, "a"), (1, 5, "a"), (2, 1024, "b"), (3, 1000, None), (4, 24, "c"), (None, 7, "c"), (5, None, "d"), (6, 0, "e")]
    df = spark.createDataFrame(rows, "doc_id long, length int, sequence_id string")
    got = packing.pack(df, ["doc_id"]).collect()
    assert len(got) == len(rows) and sound([(r.length, r.sequence_id, r.offset) for r in got if r.length]) == 3
    assert all(r.sequence_id is None for r in got if not r.length)
    assert packing.pack(df.limit(0), ["doc_id"]).count() == 0
    other = spark.createDataFrame([(k, 400, "lo", 1, 2, "x", 3, 4, 5) for k in range(5)], "doc_id long, length int, lo string, _before int, rank int, row string, bucket int, base int, `a.b` int")
    kept = packing.pack(other, ["doc_id"])
    assert kept.columns == [*other.columns, "sequence_id", "offset"] and sound([(r.length, r.sequence_id, r.offset) for r in kept.collect()]) == 3
    assert sorted(kept.select("doc_id", "length", "lo", "_before", "rank", "row", "bucket", "base", "`a.b`").collect()) == sorted(other.collect())
    with pytest.raises(ValueError, match="longer"):
        packing.pack(spark.createDataFrame([(1, 1025)], "doc_id long, length int"), ["doc_id"])


def test_query_op7(spark, sf):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op7_packing(spark, sf).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d, t in docs.items():
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 1024 or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = sound([(r.length, r.sequence_id, r.offset) for r in got])
    assert set(by) == set(docs) and sequences <= -(-sum(r.length for r in got) // 1024) + 1


def test_ids_come_along(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in packing.pack_documents(df, keep_ids=True).collect()}
    assert got[2] == [2] and got[1][-1] == 2 and len(got[1]) == 4
    assert packing.cut(df.filter(F.lit(False))).count() == 0
