"""Quality classifier: a byte-level convolutional network in numpy.

Filters over WIDTH neighbouring bytes are learned; a document is covered by overlapping chunks (two blocks of BLOCK bytes each, the next chunk one
block on), a chunk's response to a filter is the largest inside it, and the document's are the largest and the mean over all its chunks. A logistic
layer combines them into one probability. The network is fitted on the driver on a bounded sample of labelled rows; scoring is a map over
whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.arrowmap import map_rows, plain, sampled, text_of
from siltstone.session import ship

WIDTH = 5
FILTERS = 16
BLOCK = 32
#: The labelled rows that are learned from: so many, and so many bytes of text in all, at most.
SAMPLE, SAMPLE_BYTES = 4_000, 32 << 20
STEPS = 900
#: Bytes of text that all steps see together, at most; where texts are so long that STEPS would see more, there are fewer steps.
SEEN_BYTES = 256 << 20
THRESHOLD = 0.7
_STEP = 1 << 15


@dataclass(frozen=True)
class Net:
    """Weights: filters (WIDTH, 256, FILTERS), bias (FILTERS), mean and scale of the pooled responses, top (2 * FILTERS) and its bias; or a constant."""

    filters: np.ndarray | None = None
    bias: np.ndarray | None = None
    top: np.ndarray | None = None
    offset: float = 0.0
    constant: float | None = None


def _bytes(text: str) -> np.ndarray:
    """A text's bytes, filled up with zeros to one filter at least and to whole blocks of filter positions."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    positions = max(1, len(raw) - WIDTH + 1)
    blocks = -(-positions // BLOCK)
    out = np.zeros(blocks * BLOCK + WIDTH - 1, dtype=np.uint8)
    out[: len(raw)] = raw
    return out


def _blocks(net: Net, x: np.ndarray) -> np.ndarray:
    """(blocks, FILTERS): the largest response in each block of positions, in steps that bound memory."""
    out = []
    n = len(x) - WIDTH + 1
    for k in range(0, n, _STEP):
        m = min(_STEP, n - k)
        s = net.filters[0][x[k : k + m]]
        for j in range(1, WIDTH):
            s += net.filters[j][x[k + j : k + j + m]]
        out.append(s.reshape(-1, BLOCK, s.shape[1]).max(axis=1))
    return np.maximum(np.concatenate(out) + net.bias, 0)


def _chunks(blocks: np.ndarray) -> np.ndarray:
    return np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks


def probability(net: Net, text: str) -> float:
    """The probability that a text is of quality, over all its bytes."""
    if net.constant is not None:
        return net.constant
    c = _chunks(_blocks(net, _bytes(text)))
    z = float(np.concatenate([c.max(axis=0), c.mean(axis=0, dtype=np.float64)]) @ net.top) + net.offset
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(texts: list[str], labels: list[int], *, seed: int = 7, steps: int = STEPS, filters: int = FILTERS, batch: int = 32, rate: float = 0.02) -> Net:
    """Fit by ``steps`` of Adam on the log loss, however many rows there are; a step sees whole texts, as scoring does. Very long texts mean fewer steps (SEEN_BYTES)."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Net(constant=float(y[0]) if len(y) else 1.0)
    rng, raw = np.random.default_rng(seed), [_bytes(t) for t in texts]
    steps = max(1, min(steps, SEEN_BYTES * len(raw) // (batch * sum(map(len, raw)))))
    p = {"filters": rng.normal(0, 0.25, (WIDTH, 256, filters)).astype(np.float32), "bias": np.zeros(filters, np.float32), "top": rng.normal(0, 0.1, 2 * filters), "offset": np.array([np.log(y.mean() / (1 - y.mean()))])}
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    order = np.zeros(0, dtype=np.int64)
    for step in range(1, steps + 1):
        while len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(y))])
        group, order = order[:batch], order[batch:]
        g = {k: np.zeros(v.shape, dtype=np.float64) for k, v in p.items()}
        net = Net(p["filters"], p["bias"], p["top"], float(p["offset"][0]))
        for i in group:
            _gradient(net, raw[i], y[i], g)
        lr = rate * 0.04 ** (step / steps)
        for k, v in p.items():
            d = g[k] / batch + 1e-5 * v
            m1[k] = 0.9 * m1[k] + 0.1 * d
            m2[k] = 0.99 * m2[k] + 0.01 * d * d
            p[k] = (v - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(v.dtype)
    return Net(p["filters"], p["bias"], p["top"], float(p["offset"][0]))


def _gradient(net: Net, x: np.ndarray, y: float, g: dict) -> None:
    n, f = len(x) - WIDTH + 1, net.filters.shape[2]
    best, where = [], []
    for k in range(0, n, _STEP):
        m = min(_STEP, n - k)
        s = net.filters[0][x[k : k + m]]
        for j in range(1, WIDTH):
            s += net.filters[j][x[k + j : k + j + m]]
        s = s.reshape(-1, BLOCK, f)
        where.append(s.argmax(axis=1))
        best.append(np.take_along_axis(s, where[-1][:, None], axis=1)[:, 0])
    blocks = np.maximum(np.concatenate(best) + net.bias, 0)
    place = np.concatenate(where) + np.arange(len(blocks))[:, None] * BLOCK
    if len(blocks) > 1:
        second = blocks[1:] > blocks[:-1]
        chunk, source = np.where(second, blocks[1:], blocks[:-1]), np.where(second, place[1:], place[:-1])
    else:
        chunk, source = blocks, place
    best = chunk.argmax(axis=0)
    pooled = np.concatenate([chunk.max(axis=0), chunk.mean(axis=0)])
    z = float(pooled @ net.top) + net.offset
    d = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
    g["top"] += d * pooled
    g["offset"] += d
    back = np.broadcast_to(d * net.top[f:] / len(chunk), chunk.shape).copy()
    back[best, np.arange(f)] += d * net.top[:f]
    back[chunk <= 0] = 0
    g["bias"] += back.sum(axis=0)
    column = np.broadcast_to(np.arange(f), source.shape).ravel()
    at, weight = source.ravel(), back.ravel()
    for j in range(WIDTH):
        g["filters"][j] += np.bincount(x[at + j].astype(np.int64) * f + column, weights=weight, minlength=256 * f).reshape(256, f)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, rows: int = SAMPLE, most: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """At most ``rows`` labelled texts with ``most`` bytes in all, each of them whole, by a hash of the id; held-out ids are left to the caller.

    An id with several labels has the largest. Of documents that share a sampled id all are taken, in order of id, text hash and text, within the same bounds. Null ids have no label.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    wanted = sampled(known, ["_id"], rows).collect()
    if not wanted:
        return [], []
    wanted = docs.sparkSession.createDataFrame(wanted, known.schema)  # ``rows`` rows at most
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(wanted), "_id").select("_id", "_text", "_y")
    got = sampled(texts, ["_id", "_text"], rows, size="_text", most=most).collect()
    return [r["_text"] for r in got], [int(r["_y"]) for r in got]


def held_out(id_col: str, parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text leaves that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> Net:
    """The network for rows that are not held out. Without labelled rows every text scores 1; with one class, that class."""
    return train(*sample(docs, labels.filter(~held_out(id_col)), id_col, text_col, label_col, **how))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted), one row per input row.

    Null and empty texts are scored as a run of zero bytes, very long ones over all their bytes, in steps that bound memory. Rows that repeat score alike. A null id is not held out. A
    score equal to the threshold is predicted 1. Only id and text are read, so other columns may have any name. An empty table gives an empty result.
    """
    schema = T.StructType([plain(id_col, docs.schema[id_col].dataType), plain("held_out", T.BooleanType()), plain("score", T.DoubleType()), plain("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch):
        net = shared.value
        scores = [probability(net, t) for t in batch.column(2).to_pylist()]
        yield {id_col: batch.column(0), "held_out": batch.column(1), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_rows(docs.select(F.col(id_col), held_out(id_col).alias("_held"), text_of(text_col).alias("_text")), run, schema)


def probabilities(docs: DataFrame, net: Net, text_col: str = "text") -> Column:
    """The score of each row's text as a column, for filters that keep all columns of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([probability(shared.value, t) for t in texts], dtype="float64")

    return run(text_of(text_col))
