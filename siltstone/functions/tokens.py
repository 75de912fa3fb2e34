"""Exact token costs by a vocabulary that the caller supplies, for use wherever an operator takes a ``cost``."""

from __future__ import annotations

import gzip
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import TokenCost
from siltstone.session import ship


@lru_cache(maxsize=4)
def _load(content: bytes):
    """The tokenizer of a JSON vocabulary, plain or compressed, once per worker."""
    from tokenizers import Tokenizer

    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    made = Tokenizer.from_str(raw.decode("utf-8"))
    made.no_truncation()
    made.no_padding()
    made.encode_special_tokens = True
    return made


def counter(spark: SparkSession, path: str) -> TokenCost:
    """A cost function: tokens of a text by the tokenizer JSON at ``path`` (.json or .json.gz, any store that Spark reads). Null and empty texts cost nothing.

    The file is read once and broadcast (a vocabulary: some megabytes, whatever the data); texts go through in Arrow batches. A missing or broken file raises; there is no estimate
    in its stead.
    """
    ship(spark)
    content = spark.read.format("binaryFile").load(path).select("content").first()
    if content is None:
        raise FileNotFoundError(path)
    _load(bytes(content[0]))
    shared = spark.sparkContext.broadcast(bytes(content[0]))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        known = _load(shared.value)
        return pd.Series([len(e.ids) for e in known.encode_batch_fast(texts.tolist(), add_special_tokens=False)], dtype="int64")

    return lambda text: F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("long")).otherwise(count(F.coalesce(text, F.lit(""))))
