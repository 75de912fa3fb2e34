"""Exact and near duplicates against brute force; components; odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import components, exact_dedup, queries, simhash

ODD = [(1, "a b  c", "x"), (2, "a b\t\nc", None), (2, "a b c", "x"), (2, "a b c", "x"), (None, "a b c", None), (3, None, None), (4, "", "y"), (5, "   ", "y"), (6, "é" * 50_000, "z"), (None, "alone", "z")]
ODD_SCHEMA = "doc_id long, text string, keep_id string"


def brute_fingerprint(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    total = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * total[b] > len(shingles))


def brute_components(prints):
    """{position: smallest position reachable} over links of at most three bits."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(k) for k in range(len(prints))]


def test_exact_odd_rows(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == len(ODD)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    sha = lambda t: hashlib.sha256(norm(t).encode()).hexdigest()
    for r in got:
        same = [i for i, t, _ in ODD if sha(t) == r.text_sha256]
        known = [i for i in same if i is not None]
        assert (r.keep_id, r.group_size) == (min(known) if known else None, len(same))
    groups = {sha(t) for _, t, _ in ODD}
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(groups)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_tells_collisions_apart(spark):
    rng = random.Random(3)
    rows = [(k, f"text {rng.randint(0, 12)}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact_dedup.exact_dedup(df, hash_of=lambda t: F.substring(F.md5(t), 1, 1))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(map(tuple, exact_dedup.exact_dedup(df).select(columns).collect()))
    assert sorted(map(tuple, weak.select(columns).collect())) == want


def test_covering_masks_cover():
    rng = random.Random(1)
    masks = simhash.masks()
    assert len(masks) == 15 and all(28 <= m.bit_count() <= 36 for m in masks)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(flips & m == 0 for m in masks)


def test_refined_masks_cover_what_a_mask_covers():
    rng = random.Random(7)
    for m in simhash.masks():
        free = [k for k in range(64) if not m >> k & 1]
        finer = simhash.refined(m)
        assert len(finer) == 4 and all(x & m == m and x.bit_count() >= m.bit_count() + 6 for x in finer)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(free, 3))
            assert any(flips & x == 0 for x in finer)


def test_fingerprint_is_the_brute_one():
    rng = random.Random(2)
    for t in ["", "   ", "One", "Two Words", "ÄB Äb äb x", *(" ".join(rng.choice("ab cd EF gh é".split()) for _ in range(rng.randint(1, 300))) for _ in range(30))]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_fingerprint_of_a_very_long_text():
    rng = random.Random(8)
    text = "  ".join(f"W{rng.randrange(5000)}" for _ in range(70_000))  # more shingles than one step sums
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint("x" * 3_000_000) == brute_fingerprint("x" * 3_000_000)


def planted(n, seed=4):
    """Fingerprints in chains and clouds, with the rest apart."""
    rng = random.Random(seed)
    out = []
    for _ in range(n // 10):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 15)):
            out.append(x)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
    return out


@pytest.mark.parametrize("bucket", [4096, 20, 2])
def test_links_lose_none(spark, bucket):
    rng = random.Random(5)
    x = rng.getrandbits(64)
    hot = [x ^ sum(1 << b for b in rng.sample(range(0, 64, 3), rng.randint(0, 6))) for _ in range(150)]  # one large bucket under several masks
    prints = sorted({*planted(300), *hot})
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    edges = simhash.links(df, bucket=bucket)
    assert edges.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 3).count() == 0 or bucket > 2
    by = {r.node: r.root for r in components.connected_components(edges).collect()}
    roots = brute_components(prints)
    want, got = {}, {}
    for k, x in enumerate(prints):
        want.setdefault(roots[k], set()).add(x)
        got.setdefault(by.get(simhash.signed(x), simhash.signed(x)), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_a_hot_bucket_writes_little(spark):
    """Thousands of fingerprints that agree on all bits of some mask: dealt again they fall apart."""
    rng = random.Random(12)
    mask = simhash.masks()[0]
    free = [k for k in range(64) if not mask >> k & 1]
    prints = sorted({sum(1 << b for b in rng.sample(free, rng.randint(0, len(free)))) for _ in range(3000)})
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    by = {r.node: r.root for r in components.connected_components(simhash.links(df, bucket=100)).collect()}
    roots = brute_components(prints)
    want, got = {}, {}
    for k, x in enumerate(prints):
        want.setdefault(roots[k], set()).add(x)
        got.setdefault(by.get(simhash.signed(x), simhash.signed(x)), set()).add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_near_duplicates_odd_rows(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(200)]
    rows = [(k, " ".join(base[:-1] + [f"end{k}"]), "c") for k in range(10, 40)] + [(None, " ".join(base), "c"), (7, None, "c"), (8, "", "c"), (9, " ", "c"), (50, "short", "c"), (50, "short", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(df).collect()
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    roots = brute_components(prints)
    least = {r: min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None) for r in set(roots)}
    want = sorted(((d, simhash.signed(p), least[r]) for (d, _, _), p, r in zip(rows, prints, roots)), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query_op2_is_brute_force(spark, sf):
    docs = queries.table(spark, sf, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_fingerprint(r.text) for r in docs]
    roots = brute_components(prints)
    want = {r.doc_id: (f"{p:016x}", docs[k].doc_id) for r, p, k in zip(docs, prints, roots)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, sf).collect()}
    assert got == want


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 220)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(150)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(df.limit(0)).count() == 0
