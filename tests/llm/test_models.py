"""The classifiers: held-out accuracy, exactness of their arithmetic, odd rows; and the pipeline against its parts."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import exact_dedup, langid, quality, queries
from tests.llm.test_dedup import brute_components, brute_fingerprint

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def net(spark):
    return quality.fit(queries.table(spark, LARGER, "documents"), queries.table(spark, LARGER, "labels"))


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(queries.table(spark, LARGER, "documents"))


def test_quality_is_right_on_held_out_rows(spark, net):
    docs, labels = queries.table(spark, LARGER, "documents"), queries.table(spark, LARGER, "labels")
    got = quality.score(docs, net).filter("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    good = [r.predicted == 1 for r in got if r.quality == 1]
    bad = [r.predicted == 0 for r in got if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.8


def test_quality_odd_rows(spark, net):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a", "x"), (3, "a", "x"), (None, "é", "x"), (4, "word and " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality.score(df, net).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and not any(r.held_out for r in got if r.doc_id is None)
    assert quality.score(df.limit(0), net).count() == 0


def test_quality_covers_the_whole_text(net):
    """Steps of the scan leave no seam: the pooled responses are those of all positions at once."""
    rng = random.Random(2)
    x = quality._bytes("".join(rng.choice("abc !.") for _ in range(100_000)))
    n = len(x) - quality.WIDTH + 1
    whole = sum(net.filters[j][x[j : j + n]] for j in range(quality.WIDTH))
    blocks = np.maximum(whole.reshape(-1, quality.BLOCK, whole.shape[1]).max(axis=1) + net.bias, 0)
    assert np.allclose(quality._blocks(net, x), blocks, atol=1e-5)


def test_quality_gradient():
    rng = np.random.default_rng(1)
    net = quality.Net(rng.normal(0, 0.3, (quality.WIDTH, 256, 3)), np.full(3, 0.1), rng.normal(0, 1, 6), 0.2)
    x, y = quality._bytes("some text, with 99 bytes " * 5), 1.0
    g = {"filters": np.zeros_like(net.filters), "bias": np.zeros(3), "top": np.zeros(6), "offset": np.zeros(1)}
    quality._gradient(net, x, y, g)

    def loss(net):
        c = quality._chunks(quality._blocks(net, x))
        z = float(np.concatenate([c.max(axis=0), c.mean(axis=0)]) @ net.top) + net.offset
        return float(np.log1p(np.exp(-z)))

    for j, b, f in [(0, ord("e"), 0), (2, ord(" "), 1), (4, ord("t"), 2)]:
        w = net.filters.copy()
        w[j, b, f] += 1e-6
        assert (loss(quality.Net(w, net.bias, net.top, net.offset)) - loss(net)) / 1e-6 == pytest.approx(g["filters"][j, b, f], abs=1e-4)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, none)).first().score == 1.0
    ones = spark.createDataFrame([(1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, ones)).first().score == 0.0


def test_languages_are_right_on_held_out_rows(spark, model):
    got = langid.predict(queries.table(spark, LARGER, "documents"), model).filter("held_out").join(queries.table(spark, LARGER, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_languages_odd_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 ... ½ _", "x"), (4, "the and of", "x"), (4, "the and of", "x"), (None, "le la des", "x"), (5, "the and of with " * 50_000, "x"), (6, "日本語", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = langid.predict(df, model).collect()
    assert len(got) == 8 and [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert all(r.lang_pred in model.languages and 0 < r.score <= 1 for r in got if r.doc_id in (None, 4, 5, 6))
    assert langid.predict(df.limit(0), model).count() == 0
    none = langid.fit(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_models_learn_from_long_texts_alone(spark):
    """All labelled texts are longer than the sample's bound, and what tells them apart is not at their start."""
    rng = random.Random(6)
    kinds = {1: "good clear words about stones and rivers".split(), 0: "zzxq qqzx xxqz zqxz".split()}
    rows, labels = [], []
    for k in range(60):
        y = k % 2
        text = "same " * 1000 + " ".join(rng.choice(kinds[y]) for _ in range(9_000))
        assert len(text) > 40_000
        rows.append((k, text, "xx" if y else "yy"))
        labels.append((k, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    texts, ys = quality.sample(docs, marked)
    assert len(texts) == 60 and sum(ys) == 30 and set(texts) == {r[1] for r in rows}  # whole
    some, _ = quality.sample(docs, marked, most=sum(map(len, texts[:20])) + 5)
    assert some == texts[:20] and quality.sample(docs, marked, most=9) == ([], [])
    found = {r.doc_id: r.predicted for r in quality.score(docs, quality.fit(docs, marked)).collect()}
    assert np.mean([found[k] == y for k, y in labels]) > 0.9
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert np.mean([found[k] == lang for k, _, lang in rows]) > 0.9


def test_long_runs_count_whole(model):
    """Runs of letters without spaces: all of a run is words, and its language is not that of its first letters."""
    en, de = "thethatwiththisfromandofhave", "derdienichtsichmitauchundeineswird"
    run = en[:40] + de * 100
    assert "".join(langid.words(run)) == run and max(map(len, langid.words(run))) <= langid.WORD
    assert [len(w) for w in langid.words("a" * 41 + " " + "b" * 40)] == [20, 21, 40]
    labeller = langid.Labeller(model)
    assert labeller.label([run])[0][0] == labeller.label([de * 100])[0][0] == "de" and labeller.label([en * 100])[0][0] == "en"
    half = [x for _, x in labeller.spans(en * 60 + de * 50)]
    assert half[0] == "en" and half[-1] == "de" and abs(half.count("de") / len(half) - 0.5) < 0.2
    tail = langid.features("x" * 50 + "schaft", {})
    assert langid._GRAMS["aft$"] in tail


def test_posteriors_are_exact():
    """Forward-backward, in one piece and in segments, against a sum over all label sequences."""
    rng = np.random.default_rng(3)
    m = langid.Model(["a", "b", "c"], np.zeros((0, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3), {})
    sizes = np.array([1, 5, 7, 2])
    starts = np.cumsum(sizes) - sizes
    e = rng.random((sizes.sum(), 3)) + 0.05
    want = np.zeros_like(e)
    for s, n in zip(starts, sizes, strict=True):
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(m.start[path[0]]) * np.prod([e[s + t, k] for t, k in enumerate(path)]) * np.prod([np.exp(m.transitions[a, b]) for a, b in itertools.pairwise(path)])
            for t, k in enumerate(path):
                want[s + t, k] += p
    want /= want.sum(axis=1, keepdims=True)
    for segment in (2, 3, 100):
        assert np.allclose(langid.posteriors(m, e.copy(), starts, sizes, segment), want)


def test_switches_are_followed(model):
    text = "the and of with that this from " * 3 + "der die und nicht sich mit auch ein " * 3
    labels = [x for _, x in langid.Labeller(model).spans(text)]
    assert labels[0] == "en" and labels[-1] == "de" and sum(a != b for a, b in itertools.pairwise(labels)) <= 3


@pytest.fixture
def fitted_once(monkeypatch):
    """The stages fit their models anew each time; here each is fitted once and remembered."""
    for module in (quality, langid):
        kept, fit = [], module.fit
        monkeypatch.setattr(module, "fit", lambda *a, kept=kept, fit=fit, **k: kept[0] if kept else kept.append(fit(*a, **k)) or kept[0])


def brute_quality(net, text):
    """The probability by plain loops over every position of the text."""
    raw = list(text.encode())
    positions = max(1, len(raw) - quality.WIDTH + 1)
    positions += -positions % quality.BLOCK
    raw += [0] * (positions + quality.WIDTH - 1 - len(raw))
    f = net.filters.shape[2]
    response = [[sum(float(net.filters[j][raw[p + j]][k]) for j in range(quality.WIDTH)) + float(net.bias[k]) for k in range(f)] for p in range(positions)]
    size = 2 * quality.BLOCK
    starts = range(0, max(1, positions - quality.BLOCK), quality.BLOCK)
    chunks = [[max(0.0, *(row[k] for row in response[p : p + size])) for k in range(f)] for p in starts]
    pooled = [max(c[k] for c in chunks) for k in range(f)] + [sum(c[k] for c in chunks) / len(chunks) for k in range(f)]
    return 1 / (1 + math.exp(-(sum(a * float(w) for a, w in zip(pooled, net.top, strict=True)) + net.offset)))


def plain_quality(net, text):
    """As brute_quality(), over whole arrays: one row a position, chunks as slices."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    positions = max(1, len(raw) - quality.WIDTH + 1)
    positions += -positions % quality.BLOCK
    raw = np.concatenate([raw, np.zeros(positions + quality.WIDTH - 1 - len(raw), dtype=np.uint8)])
    response = sum(net.filters[j].astype(float)[raw[j : j + positions]] for j in range(quality.WIDTH)) + net.bias.astype(float)
    size = 2 * quality.BLOCK
    chunks = np.array([np.maximum(response[p : p + size].max(axis=0), 0) for p in range(0, max(1, positions - quality.BLOCK), quality.BLOCK)])
    pooled = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])
    return 1 / (1 + math.exp(-(float(pooled @ net.top) + net.offset)))


def brute_language(model, text):
    """(language, share) by plain forward-backward over the whole text."""
    runs = re.findall(r"[^\W\d_]+", (text or "").lower())
    found = []
    for r in runs:
        n = -(-len(r) // 40)
        found += [r[len(r) * k // n : len(r) * (k + 1) // n] for k in range(n)]
    found = [w for w in found if any(map(str.isalpha, w))]
    if not found:
        return "und", 0.0, 0.0, 0
    n = len(model.languages)
    emit = []
    for w in found:
        m = f"^{w}$"
        grams = {m[:4], m[-4:], *(m[k : k + 2] for k in range(len(m) - 1)), *(m[k : k + 3] for k in range(len(m) - 2))}
        at = [zlib.crc32(g.encode()) % langid.FEATURES for g in grams] + ([model.lexicon[w]] if w in model.lexicon else [])
        z = [sum(model.weights[i][k] for i in at) for k in range(n)]
        emit.append([math.exp(max(-30.0, x - max(z))) for x in z])
    norm = lambda v: [x / sum(v) for x in v]
    t = np.exp(model.transitions)
    forward = [norm([math.exp(model.start[k]) * emit[0][k] for k in range(n)])]
    for e in emit[1:]:
        forward.append(norm([sum(forward[-1][j] * t[j][k] for j in range(n)) * e[k] for k in range(n)]))
    backward = [[1.0] * n]
    for e in emit[:0:-1]:
        backward.append(norm([sum(t[k][j] * e[j] * backward[-1][j] for j in range(n)) for k in range(n)]))
    each = [norm([f * b for f, b in zip(x, y, strict=True)]) for x, y in zip(forward, reversed(backward), strict=True)]
    share = np.mean(each, axis=0)
    return model.languages[int(share.argmax())], float(share.max()), sum(map(max, each)) / len(each), len(each)


def test_query_op5(spark, sf):
    """The registered query: every document, scores as plain loops have them, labels of held-out rows without influence."""
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    got = {r.doc_id: r for r in queries.op5_quality(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts) and all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for d, r in got.items())
    net = quality.fit(docs, labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality"))))
    for d, t in texts.items():
        assert got[d].score == pytest.approx(plain_quality(net, t or ""), abs=1e-4)
    for d in sorted(texts, key=lambda d: len(texts[d] or ""))[::24]:
        assert got[d].score == pytest.approx(brute_quality(net, texts[d] or ""), abs=1e-4)


def test_query_op10(spark, sf):
    """The registered query: every document, shares as plain forward-backward has them, languages of held-out rows without influence."""
    docs = queries.table(spark, sf, "documents")
    got = {r.doc_id: r for r in queries.op10_langid(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts) and all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    model = langid.fit(docs.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang"))))
    assert "zz" not in model.languages
    for d in sorted(texts, key=lambda d: len(texts[d] or ""))[::12]:
        lang, share, _, _ = brute_language(model, texts[d])
        assert got[d].lang_pred == lang and got[d].score == pytest.approx(share, abs=1e-6)


def test_samples_are_the_same_at_every_run(spark, monkeypatch):
    rows = [(k % 40, f"text {k}", "en" if k % 3 else "fr") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] * 2, "doc_id long, quality int")
    one, other = quality.sample(docs.repartition(5), labels, rows=30), quality.sample(docs.repartition(3, "text"), labels.repartition(4), rows=30)
    assert one == other and len(one[0]) == 30
    monkeypatch.setattr(langid, "train", lambda texts, langs: (texts, langs))
    a, b = langid.fit(docs.repartition(5), rows=50), langid.fit(docs.repartition(3, "text"), rows=50)
    assert a == b and len(a[0]) == 50


def test_pipeline_is_its_parts(spark, sf, fitted_once):
    """The whole pipeline and each stage's output against readings of the rules that share no code with the operators but the two fitted models."""
    tables = {name: queries.table(spark, sf, name) for name in ("documents", "labels")}
    docs = tables["documents"]
    given = {r.doc_id: r.text or "" for r in docs.collect()}
    net, model = quality.fit(docs, tables["labels"]), langid.fit(docs)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {d: t for d, t in given.items() if plain_quality(net, t) >= 0.7}
    assert kept["quality_classifier"] == want and 0 < len(want) < len(given)
    placed = lambda found: found[0] != "und" and (found[2] * found[3] + 6) / (found[3] + 6) >= 0.7
    want = {d: t for d, t in want.items() if placed(brute_language(model, t))}
    assert kept["language_id"] == want
    firsts = {}
    for d in sorted(want):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", want[d]), d)
    want = {d: want[d] for d in firsts.values()}
    assert kept["exact_dedup"] == want
    ids = sorted(want)
    roots = brute_components([brute_fingerprint(want[d]) for d in ids])
    want = {d: want[d] for k, d in enumerate(ids) if roots[k] == k}
    assert kept["simhash_near_dedup"] == want
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for rows in (corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), corpus_pipeline.run(spark, sf).collect()):
        by, sizes = defaultdict(list), defaultdict(int)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
            sizes[r.doc_id] += r.length
        assert sizes == {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
        for parts in by.values():
            assert sum(n for _, n in parts) <= 1024 and [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]


def test_near_copies_go_by_row(spark, sf):
    """Null and repeated ids: one row of each group stays, and what has the same id in another group is decided for itself."""
    rng = random.Random(3)
    a, b, c = (" ".join(f"{x}{rng.randrange(99)}" for _ in range(60)) for x in "abc")
    rows = [(None, a), (None, a.upper()), (None, a + "\n"), (1, b), (None, b.upper()), (2, b.title()), (2, c), (2, c.upper()), (None, None), (None, ""), (7, c + " "), (5, a.title()), (5, a.title())]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").lower().strip()) for r in kept.collect()), key=repr)
    assert got == sorted([(5, a), (1, b), (2, c), (None, "")], key=repr)
    without = corpus_pipeline.drop_near_copies(spark, docs.filter("doc_id is null"), sf).collect()
    assert sorted((r.text or "").lower().strip() for r in without) == sorted([a, b, ""])


def test_pipeline_stages_take_odd_rows(spark, sf, fitted_once):
    """Null, empty, repeated and clashing: every stage keeps all columns as they are."""
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "of the and that this with from", "en", "s", 1), (3, "of the and that this with from", "en", "s", 1), (3, "of the and that this is other", "en", "s", 1), (None, "of the and with that", None, None, None)]
    clashing = ["_keep", "_found", "_sha", "_n", "_row", "_text_sha", "_k", "_id", "score", "row"]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clashing])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert got.columns == docs.columns
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got.collect() for c in clashing)
            assert sorted(map(repr, got.select(*plain.columns).collect())) == sorted(map(repr, stage(spark, plain, sf).collect()))
        got.collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = corpus_pipeline.drop_copies(spark, docs, sf).collect()
    want = sorted(r.text_sha256 for r in exact_dedup.exact_dedup(docs).collect() if r.kept)
    assert len(kept) == len(want) == 4


def test_mixed_texts_are_kept(spark, sf):
    """A clean text in three languages by turns stays, though none has half of its words; what no language knows goes."""
    parts = ["the and of with that this from have", "der die und nicht sich mit auch ein", "le la des et une dans pour que"]
    rng = random.Random(1)
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(60))
    foreign = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem " * 3
    rows = [(1, " ".join(parts * 9)), (2, "12 34 -- .."), (3, None), (4, letters), (5, foreign), (6, "съешь же ещё этих мягких французских булок " * 5), (7, "De."), (8, parts[0])]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.keep_language(spark, docs, LARGER).collect()] == [1, 7, 8]
