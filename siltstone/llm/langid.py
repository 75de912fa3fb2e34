"""Language identification by a linear-chain conditional random field over words.

A word is a run of letters; a run of more than WORD letters, as scripts without spaces have, is that many words of nearly equal length.
Each word has affix, character n-gram and lexicon features (hashed); their weights give its emission for each language, and learned
transitions tie neighbouring words, so switches inside a text are followed. Forward-backward gives each word's posterior; a
text's language is the one with the largest share of posterior, which is its score. The model is fitted on the driver on a bounded sample,
on runs of words from different texts spliced together. Long texts are cut into segments whose transfer matrices carry the exact
messages across, so time and memory follow the words, not the longest text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrowmap import map_rows, plain, sampled
from siltstone.llm.bpe import batches
from siltstone.session import ship

FEATURES = 1 << 15
LEXICON = 4_000
#: The rows that are learned from: so many, and so many bytes of text in all, at most.
SAMPLE, SAMPLE_BYTES = 2_000, 32 << 20
LENGTH = 64
STEPS = 350
SEGMENT = 256
WORD = 40
CACHE_WORDS = 1 << 18
KNOWN_GRAMS = 1 << 17
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Sorted languages; weights (FEATURES + lexicon, L); transitions (L, L) and start (L) as logarithms; the lexicon."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]


def _pieces(run: str) -> list[str]:
    """The run in as few pieces as WORD allows, of lengths that differ by one at most."""
    n = -(-len(run) // WORD)
    return [run[len(run) * k // n : len(run) * (k + 1) // n] for k in range(n)]


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased, long ones in consecutive pieces of at most WORD letters; pieces without any letter are no words."""
    found = _WORD.findall(text.lower())
    if max(map(len, found), default=0) > WORD:
        found = list(chain.from_iterable(map(_pieces, found)))
    return found if all(map(str.isalpha, found)) else [w for w in found if any(map(str.isalpha, w))]


class _Grams(dict):
    """Feature numbers of character n-grams; the first KNOWN_GRAMS that come are remembered."""

    def __missing__(self, gram: str) -> int:
        number = zlib.crc32(gram.encode("utf-8", "surrogatepass")) % FEATURES
        if len(self) < KNOWN_GRAMS:
            self[gram] = number
        return number


_GRAMS = _Grams()


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Feature numbers of a word: n-grams of two and three characters with its ends marked, affixes of up to three (the ends' n-grams and the outer four), and its place in the lexicon."""
    w = f"^{word}$"
    found = {w[:4], w[-4:]}
    found.update([w[k : k + 2] for k in range(len(w) - 1)], [w[k : k + 3] for k in range(len(w) - 2)])
    out = [_GRAMS[x] for x in found]
    if word in lexicon:
        out.append(lexicon[word])
    return out


def _flat(found: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    each = [features(w, lexicon) for w in found]
    size = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
    return np.fromiter(chain.from_iterable(each), dtype=np.int64, count=int(size.sum())), np.concatenate([[0], np.cumsum(size)[:-1]])


def train(texts: list[str], langs: list[str], *, seed: int = 11, steps: int = STEPS, batch: int = 64, rate: float = 0.1) -> Model:
    """Fit by ``steps`` of Adagrad on the likelihood of runs of words, drawn from anywhere in the texts and spliced together, however many texts there are."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), {})
    rng = np.random.default_rng(seed)
    numbers: dict[str, int] = {}
    by: dict[int, list[np.ndarray]] = {}
    counts: Counter = Counter()
    for t, lang in zip(texts, langs, strict=True):
        found = words(t)
        if found:
            counts.update(found)
            by.setdefault(languages.index(lang), []).append(np.array([numbers.setdefault(w, len(numbers)) for w in found], dtype=np.int32))
    n = len(languages)
    lexicon = {w: FEATURES + k for k, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])}
    model = Model(languages, np.zeros((FEATURES + len(lexicon), n)), np.zeros((n, n)), np.zeros(n), lexicon)
    if not by or n == 1:
        return model
    known, drawn, vocabulary = sorted(by), {}, list(numbers)
    sums = {k: np.full_like(getattr(model, k), 1e-2) for k in ("weights", "transitions", "start")}
    for _ in range(steps):
        x, y = np.zeros((batch, LENGTH), dtype=np.int64), np.zeros((batch, LENGTH), dtype=np.int64)
        for b in range(batch):
            at = 0
            while at < LENGTH:
                lang = known[int(rng.integers(0, len(known)))]
                d = by[lang][int(rng.integers(0, len(by[lang])))]
                run = min(LENGTH - at, int(rng.integers(4, 48)), len(d))
                k = int(rng.integers(0, len(d) - run + 1))
                x[b, at : at + run] = d[k : k + run]
                y[b, at : at + run] = lang
                at += run
        used, inverse = np.unique(x, return_inverse=True)
        each = [drawn.get(w) if w in drawn else drawn.setdefault(w, np.array(features(vocabulary[w], lexicon), dtype=np.int64)) for w in used.tolist()]
        size = np.array([len(f) for f in each])
        feats = np.concatenate(each)
        emission = np.add.reduceat(model.weights[feats], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
        e = np.exp(emission - emission.max(axis=1, keepdims=True))[inverse.reshape(x.shape)]
        g_e, g_t, g_s = _gradient(model, e, y)
        per_word = np.zeros((len(used), n))
        np.add.at(per_word, inverse.ravel(), g_e.reshape(-1, n))
        spread = np.repeat(per_word, size, axis=0)
        g_w = np.stack([np.bincount(feats, weights=spread[:, k], minlength=len(model.weights)) for k in range(n)], axis=1)
        for k, g in (("weights", g_w), ("transitions", g_t), ("start", g_s)):
            g = g / batch
            sums[k] += g * g
            setattr(model, k, getattr(model, k) - rate * g / np.sqrt(sums[k]))
    return model


def _gradient(model: Model, e: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected less observed counts: by word, by transition, by start."""
    b, length, n = e.shape
    a, s = np.exp(model.transitions), np.exp(model.start)
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    alpha[:, 0] = s * e[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        v = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = v / v.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        v = (e[:, t + 1] * beta[:, t + 1]) @ a.T
        beta[:, t] = v / v.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (e * beta)[:, 1:, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    g_t = pair.sum(axis=(0, 1))
    np.add.at(g_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    one = np.eye(n)[y]
    return post - one, g_t, (post - one)[:, 0].sum(axis=0)


def posteriors(model: Model, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Word posteriors by forward-backward; e (words, L): emissions of texts that begin at starts and have sizes >= 1 words."""
    a, s = np.exp(model.transitions), np.exp(model.start)
    per = -(-sizes // segment)
    doc = np.repeat(np.arange(len(sizes)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin, length = starts[doc] + k * segment, np.minimum(segment, sizes[doc] - k * segment)
    order = np.argsort(-length, kind="stable")
    begin, length, k_of, place = begin[order], length[order], k[order], np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))  # where segment i of the texts' order stands
    n = e.shape[1]
    active = np.searchsorted(-length, -np.arange(1, segment + 1), side="right")  # segments with more than t words

    def steps():
        return range(int(length[0]))

    enter, leave = np.zeros((len(begin), n)), np.ones((len(begin), n))
    many = np.flatnonzero(per > 1)
    if len(many):
        later = np.flatnonzero(k_of > 0)
        p = np.broadcast_to(np.eye(n), (len(later), n, n)).copy()
        count = np.searchsorted(-length[later], -np.arange(1, segment + 1), side="right")
        for t in range(int(length[later[0]])):
            c = count[t]
            v = (p[:c] @ a) * e[begin[later[:c]] + t][:, None, :]
            p[:c] = v / v.max(axis=(1, 2), keepdims=True)
        row = {int(x): j for j, x in enumerate(later)}
        firsts = place[(np.cumsum(per) - per)[many]]
        v = s * e[begin[firsts]]
        for t in range(1, segment):
            v = (v @ a) * e[begin[firsts] + t]
            v /= v.sum(axis=1, keepdims=True)
        offset = np.cumsum(per) - per
        for j, d in enumerate(many):
            at = [int(x) for x in place[offset[d] : offset[d] + per[d]]]
            x = v[j]
            for q in at[1:]:
                enter[q] = x
                x = x @ p[row[q]]
                x /= x.sum()
            x = np.ones(n)
            for q, before in zip(at[:0:-1], at[-2::-1], strict=True):
                x = p[row[q]] @ x
                x /= x.sum()
                leave[before] = x
    out = np.empty_like(e)
    v = np.empty((len(begin), n))
    fresh = k_of == 0
    for t in steps():
        c = active[t]
        at = begin[:c] + t
        w = np.where(fresh[:c, None], s, enter[:c] @ a) if t == 0 else v[:c] @ a
        w = w * e[at]
        v[:c] = w / w.sum(axis=1, keepdims=True)
        out[at] = v[:c]
    b = leave.copy()
    for t in reversed(steps()):
        c = active[t]
        at = begin[:c] + t
        w = out[at] * b[:c]
        out[at] = w / w.sum(axis=1, keepdims=True)
        w = (e[at] * b[:c]) @ a.T
        b[:c] = w / w.sum(axis=1, keepdims=True)
    return out


class Labeller:
    """A model with a bounded cache of words' emissions."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}
        self.table = np.zeros((CACHE_WORDS, len(model.languages)))

    def emissions(self, groups: list[list[str]]) -> np.ndarray:
        need = set(chain.from_iterable(groups)).difference(self.cache)
        if len(self.cache) + len(need) > len(self.table):
            self.cache.clear()
            need = set(chain.from_iterable(groups))
            if len(need) > len(self.table):
                self.table = np.zeros((len(need), self.table.shape[1]))
        if need:
            fresh = list(need)
            flat, starts = _flat(fresh, self.model.lexicon)
            z = np.add.reduceat(self.model.weights[flat], starts, axis=0)
            at = len(self.cache)
            self.table[at : at + len(fresh)] = np.exp(np.clip(z - z.max(axis=1, keepdims=True), -30, 0))
            self.cache.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        get = self.cache.__getitem__
        total = sum(map(len, groups))
        return self.table[np.fromiter(map(get, chain.from_iterable(groups)), dtype=np.int64, count=total)]

    def label(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """(language, score, sureness, words) of each text; und with score 0 without a letter, or if no language was learned. Sureness: the mean over the words of the largest posterior, whichever language has it."""
        out: list[tuple[str, float, float, int]] = [(UNKNOWN, 0.0, 0.0, 0)] * len(texts)
        at = 0
        for group in batches("" if t is None else t for t in texts):
            found = [words(t) for t in group]
            here = [k for k, w in enumerate(found) if w]
            if here and self.model.languages:
                sizes = np.array([len(found[k]) for k in here])
                starts = np.cumsum(sizes) - sizes
                post = posteriors(self.model, self.emissions([found[k] for k in here]), starts, sizes)
                share = np.add.reduceat(post, starts, axis=0) / sizes[:, None]
                sure = np.add.reduceat(post.max(axis=1), starts) / sizes
                for k, row, x, n in zip(here, share, sure.tolist(), sizes.tolist(), strict=True):
                    best = int(row.argmax())
                    out[at + k] = (self.model.languages[best], min(1.0, float(row[best])), min(1.0, x), n)
            at += len(group)
        return out

    def spans(self, text: str) -> list[tuple[str, str]]:
        """(word, language) for each word of a text: the label of the largest posterior."""
        found = words(text)
        if not found or not self.model.languages:
            return []
        post = posteriors(self.model, self.emissions([found]), np.array([0]), np.array([len(found)]))
        return [(w, self.model.languages[k]) for w, k in zip(found, post.argmax(axis=1).tolist(), strict=True)]


def held_out(id_col: str, parts: int = 3, part: int = 1):
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, rows: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model:
    """The model, from at most ``rows`` texts with ``most`` bytes in all, each of them whole, that are not held out, by a hash of the row.

    Rows without a text or a language are not learned from. Rows that repeat, also in their id, count as often as they occur.
    """
    usable = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    texts = usable.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).alias("_lang"))
    got = sampled(texts, ["_id", "_text", "_lang"], rows, size="_text", most=most).collect()
    return train([r["_text"] for r in got], [r["_lang"] for r in got])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score), one row per input row.

    A null or empty text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned. Equal shares go to the first language by
    name. Very long texts are labelled whole, in segments that carry exact messages. Rows that repeat are labelled alike; a null id is not held out. Only id and text are read, so other
    columns may have any name. An empty table gives an empty result.
    """
    schema = T.StructType([plain(id_col, docs.schema[id_col].dataType), plain("held_out", T.BooleanType()), plain("lang_pred", T.StringType()), plain("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = {}

    def run(batch):
        if "labeller" not in held:
            held["labeller"] = Labeller(shared.value)
        found = held["labeller"].label(batch.column(2).to_pylist())
        yield {id_col: batch.column(0), "held_out": batch.column(1), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    return map_rows(docs.select(F.col(id_col), held_out(id_col).alias("_held"), F.col(text_col).cast("string").alias("_text")), run, schema)


def predictions(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """(lang, score, sure, words) of each row's text as a column, for filters that keep all columns of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = {}

    @F.pandas_udf("lang string, score double, sure double, words long")
    def run(texts: pd.Series) -> pd.DataFrame:
        if "labeller" not in held:
            held["labeller"] = Labeller(shared.value)
        return pd.DataFrame(held["labeller"].label(list(texts)), columns=["lang", "score", "sure", "words"])

    return run(F.col(text_col).cast("string"))
