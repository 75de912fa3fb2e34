"""URL filters, license scans and top-k against oracles, brute force and odd rows."""

from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import license_scan, queries, topk, url_filter


def rows_of(df, columns):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found.fetchall()), key=repr)
    assert rows_of(df, names) == want


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/7?x=1", "http://example.com/en/8", "http://badexample.com/en/1", "https://example.net/de/8#y", "http://x.net/de/9", "http://h.org/es", "http://h.org/es/", "a://b://c/d", "http://host:80?q", "http://é.ÀB.de/ß#f", "\nhttp://n.com/en/\n"]
    want = [("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/7", "example.com/en/7"), ("example.com", "/en/8", "com/en/"), ("badexample.com", "/en/1", "com/en/"), ("example.net", "/de/8", "example.net/de/8"), ("x.net", "/de/9", "net/de/"), ("h.org", "/es", None), ("h.org", "/es/", "org/es/"), ("b:", "//c/d", None), ("host:80", "", None), ("é.Àb.de", "/ß", None), ("n.com", "/en/\n", "com/en/")]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(None, urls[3], "x", "y"), (0, None, "x", "y")], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = url_filter.judge(pages, none)
    by = {r.page_id: r for r in got.filter("page_id > 0").collect()}
    assert [(by[k].host, by[k].path, by[k].rule) for k in range(1, len(urls))] == want[1:]
    assert got.count() == len(urls) + 2 and by[1].verdict == "allow" and by[4].verdict == "block" and by[3].verdict == "allow"
    assert url_filter.judge(pages.limit(0), none).count() == 0


def brute_reputation(rows):
    """{site: (n, rate, lower)} by plain sums, and the bound by summing the posterior's density over a fine grid. rows: (suffix, domain, site, bad or None)."""

    def total(keep):
        found = [bad for s, d, h, bad in rows if bad is not None and keep(s, d, h)]
        return len(found), sum(found)

    def strength(members):
        room = sum(n - 1 for n, _, _ in members if n >= 2)
        excess = sum((k - n * m) ** 2 / (n * m * (1 - m)) - 1 for n, k, m in members if n >= 2)
        return 10.0 if not room else 10_000.0 if excess <= 0 else min(10_000.0, max(1.0, room / excess - 1))

    sites = sorted({(s, d, h) for s, d, h, _ in rows})
    above, pair = total(lambda *x: True), lambda top, own: (top[0] - own[0], top[1] - own[1])
    of_suffix = {s: total(lambda a, b, c, s=s: a == s) for s, _, _ in sites}
    of_domain = {d: total(lambda a, b, c, d=d: b == d) for _, d, _ in sites}
    of_site = {h: total(lambda a, b, c, h=h: c == h) for _, _, h in sites}
    m_suffix = {s: (pair(above, x)[1] + 0.5) / (pair(above, x)[0] + 1) for s, x in of_suffix.items()}
    s1 = strength([(*of_suffix[s], m) for s, m in m_suffix.items()])
    m_domain = {d: (m_suffix[s] * s1 + pair(of_suffix[s], of_domain[d])[1]) / (s1 + pair(of_suffix[s], of_domain[d])[0]) for s, d, _ in sites}
    s2 = strength([(*of_domain[d], m) for d, m in m_domain.items()])
    m_site = {h: (m_domain[d] * s2 + pair(of_domain[d], of_site[h])[1]) / (s2 + pair(of_domain[d], of_site[h])[0]) for _, d, h in sites}
    s3 = strength([(*of_site[h], m) for h, m in m_site.items()])
    out = {}
    u = np.linspace(-60, 60, 400_001)  # log odds
    for h, m in m_site.items():
        n, k = of_site[h]
        a, b = m * s3 + k, (1 - m) * s3 + n - k
        log = -a * np.logaddexp(0, -u) - b * np.logaddexp(0, u)
        mass = np.cumsum(np.exp(log - log.max()))
        out[h] = (n, a / (a + b), float(1 / (1 + np.exp(-u[np.searchsorted(mass, 0.05 * mass[-1])]))))
    return out


def test_reputation_blocks_and_allows_as_brute_force(spark):
    rng = random.Random(4)
    pages, outcomes, rows = [], [], []
    plan = [("com", "spam.com", 8, 30, 0.96), ("com", "fine.com", 8, 30, 0.03), ("net", "mixed.net", 10, 25, 0.5), ("co.uk", "shop.co.uk", 5, 20, 0.1), ("org", "lone.org", 1, 6, 1.0), ("10.0.0.1", "10.0.0.1", 1, 40, 1.0), ("zz", "worst.zz", 1, 60, 1.0)]
    for suffix, domain, hosts, each, rate in plan:
        for h in range(hosts):
            host = domain if hosts == 1 else f"h{h}.{domain}"
            for _ in range(each if h else each * 5):
                bad = int(rng.random() < rate)
                pages.append((len(pages), f"http://{host.title() if len(pages) % 2 else host}{':80' if len(pages) % 3 == 0 else ''}/x"))
                outcomes.append((len(outcomes), bad))
                rows.append((suffix, domain, host, bad))
    for suffix, domain, host in [("com", "spam.com", "new.spam.com"), ("com", "fine.com", "new.fine.com"), ("net", "unseen.net", "a.unseen.net"), ("xyz", "other.xyz", "b.other.xyz"), ("co.uk", "co.uk", "co.uk")]:
        pages.append((len(pages), f"http://{host}/"))
        rows.append((suffix, domain, host, None))
    pages += [(None, None), (len(pages), "http://:80/"), (len(pages) + 1, "/relative")]
    outcomes += [(len(pages) - 2, 1), (len(pages) - 1, 1), (None, 1), (3, None)]
    outcomes = [o for o in outcomes if o != (3, None)]
    df, out = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")
    got = url_filter.judge(df, out, rules=()).collect()
    assert len(got) == len(pages)
    want = brute_reputation(rows)
    by = {re.sub(r":\d*$", "", r.host): r for r in got}
    for h, (n, rate, lower) in want.items():
        assert by[h].bad_rate == pytest.approx(rate) and by[h].lower == pytest.approx(lower, abs=2e-4), h
        assert by[h].verdict == ("block" if lower > 0.5 else "allow")
    assert all(by[f"h{k}.spam.com"].verdict == "block" and by[f"h{k}.fine.com"].verdict == "allow" for k in range(8))
    assert by["new.spam.com"].verdict == "block" and by["new.fine.com"].verdict == by["b.other.xyz"].verdict == by["co.uk"].verdict == "allow"
    assert by["worst.zz"].verdict == by["10.0.0.1"].verdict == "block"
    assert all((r.bad_rate, r.lower, r.verdict) == (None, None, "allow") for r in got if r.host in ("", ":80"))  # no site, no reputation
    none = url_filter.judge(df, out.limit(0), rules=()).collect()
    assert {(r.verdict, r.bad_rate, r.lower) for r in none} == {("allow", None, None)}


def test_op1_oracle_blocks_as_the_query(spark, tmp_path):
    """On tables in which the method has something to block, the registered query and its SQL agree."""
    rng = random.Random(9)
    pages, labels = [], []
    for k in range(3000):
        d = rng.randrange(12)
        pages.append((k, f"http://h{rng.randrange(3)}.d{d}.{'co.uk' if d % 4 == 0 else 'com'}/p{k}", ""))
        if rng.random() < 0.7:
            labels.append((k, int(rng.random() > (0.93 if d in (0, 1, 5) else 0.1)), 0))
    pages += [(3000, None, ""), (3001, "http://new.d0.co.uk/", ""), (3002, "ftp://user@h1.d1.com:21/x", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = rows_of(queries.op1_url_filter(spark, str(tmp_path)), columns)
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({url_filter.oracle()})").fetchall(), key=repr)
    assert got == want
    blocked = {r[1].split(".")[1] for r in got if r[4] == "block" and r[1] and r[3] is None}
    assert blocked == {"d0", "d1", "d5"} and any(r[0] == 3001 and r[4] == "block" for r in got)


def test_license_places_and_odd_rows(spark):
    texts = [None, "", "!!!", "CC BY", "cc by, CC-BY; cc\nby", "cc bye", "The General  Public--License and ALL RIGHTS reserved.", "general public é license", "all rights", "x " * 5000 + "all rights reserved", "cc by " * 2000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(3, "CC BY", "x"), (None, "cc by", "x")], "doc_id long, text string, words string")
    got = license_scan.scan(df).collect()
    assert len(got) == len(texts) + 2 and sum(r.doc_id == 3 for r in got) == 2

    def brute(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        at = [(k, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))

    for r in got:
        text = "cc by" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_notices_with_small_changes(spark):
    gpl = next(t for t in license_scan.NOTICES if t.label == "gpl-program").text.split(" ")
    rows = [(1, " ".join(gpl)), (2, " ".join([*gpl[:12], "really", *gpl[12:]])), (3, " ".join(gpl[:12] + gpl[13:])), (4, " ".join(gpl[:10])), (5, " ".join(reversed(gpl))), (6, "Before. " + " ".join(gpl).title() + "! After " + " ".join(gpl))]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("gpl-program" in got[k].labels.split(",") for k in (1, 2, 3, 6)) and all("gpl-program" not in got[k].labels for k in (4, 5))
    assert got[1].score == 1.0 and sum(s.label == "gpl-program" for s in got[6].spans) == 2


def brute_top(vectors, k):
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, mine) in enumerate(sound):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(mine, v)), c) for other, (c, v) in enumerate(sound) if other != at and len(v) == len(mine))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("blocks", "k"), [((1024, 16_384), 20), ((7, 13), 20), ((3, 40), 3)])
def test_top_k_with_ties_and_odd_rows(spark, blocks, k):
    rng = random.Random(8)
    hot = [rng.gauss(0, 0.1) for _ in range(8)]
    vectors = [(i, hot if rng.random() < 0.4 else [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    vectors += [(500, None), (520, [None] * 8), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, hot), (580, [0.0] * 3), (581, [1.0] * 3), (600, [1e4] * 8), (620, []), (7, [0.9] * 8), (40, [0.1] * 8), (40, [0.1] * 8), (41, hot), (41, hot)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, rank int")
    got = topk.top_k(df, k=k, query_block=blocks[0], candidate_block=blocks[1])
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(vectors, k)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in vectors], pa.int64()), "embedding": pa.array([v for _, v in vectors], pa.list_(pa.float64()))}))
    if k == topk.K:
        assert sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({topk.ORACLE})").fetchall()) == brute_top(vectors, k)
    assert topk.top_k(df.limit(0)).count() == 0


def test_blocks_of_long_vectors_are_bounded_in_bytes(spark, monkeypatch):
    seen = []
    real = topk.materialise
    monkeypatch.setattr(topk, "materialise", lambda df: seen.append(real(df)) or seen[-1])
    rng = random.Random(9)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(256)]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, k=3, every=10, block_bytes=64 * 1024).collect()
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    for q in range(0, 400, 10):
        want = sorted(((-int(x[q] @ x[c]), c) for c in range(400) if c != q))[:3]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(c, -s) for s, c in want]
    packed = [t for t in seen if {"c_vs", "q_vs"} & set(t.columns)]
    sizes = [t.agg(F.max(F.size(next(c for c in t.columns if c.endswith("_vs"))))).first()[0] * 8 for t in packed]
    assert len(sizes) == 2 and max(sizes) < 3 * 64 * 1024 < 400 * 256 * 8 / 2


def test_top_k_of_few_and_of_large_numbers(spark):
    vectors = [(0, [3.0e6, 1.0]), (1, [2.5e6, 7.0]), (2, [-3.0e6, 2.0]), (20, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(vectors, 20)
    with pytest.raises(OverflowError):
        topk.top_k(spark.createDataFrame([(0, [1e12]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_many_templates_are_joined_through_an_exchange(spark):
    rows = [(1, "CC BY and all rights reserved"), (2, None), (2, None), (None, ""), (3, license_scan.NOTICES[5].text + " x " + license_scan.NOTICES[0].text), (4, "cc by " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = license_scan.scan(df), license_scan.scan(df, broadcast_grams=5)
    assert "BroadcastHashJoin" in one._jdf.queryExecution().toString() and "BroadcastHashJoin" not in other._jdf.queryExecution().toString()
    assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect())) and one.count() == len(rows)


def test_top_k_sends_a_bounded_group_of_queries_at_a_time(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(400)], "vec_id long, embedding array<double>")
    whole = topk.top_k(df, every=2)
    parts = topk.top_k(df, every=2, query_block=16, candidate_block=50, group_bytes=4096)
    assert parts.inputFiles() and len({f.split("round=")[1].split("/")[0] for f in parts.inputFiles()}) >= 4
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and whole.count() == 200 * 20
