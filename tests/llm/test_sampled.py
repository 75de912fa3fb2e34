"""Samples of rows: which ones, and what reaches the driver on the way."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone.llm.arrowmap import sampled

ROOT = str(Path(__file__).resolve().parents[2])

#: 400 rows of 100 kB whose hex does not compress, and 400 more with one text and no id; tasks may hand the driver 6 MB in all.
BOUNDED = """
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from siltstone.llm.arrowmap import sampled
conf = {"spark.master": "local[2]", "spark.driver.maxResultSize": "6m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
text = lambda seed: F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(1560)), lambda k: F.sha2(F.concat_ws(",", seed, k), 256)))
rows = spark.range(0, 400, 1, 20).select(F.col("id").alias("_id"), text(F.col("id")).alias("_text"))
hot = spark.range(0, 400, 1, 20).select(F.lit(None).cast("long").alias("_id"), text(F.lit(7)).alias("_text"))
for table in (rows, hot, rows.union(hot)):
    print("GOT", len(sampled(table, ["_id", "_text"], 1000, size="_text", most=2_000_000).collect()))
    print("GOT", len(sampled(table, ["_id", "_text"], 20).collect()))
"""


def test_the_driver_gets_no_more_than_the_sample():
    """Fewer rows than the hash thins out, but long ones, and copies of one: the result is 2 MB, though the tables have 40 and 80."""
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.run([sys.executable, "-c", BOUNDED], capture_output=True, text=True, env=env, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    got = [int(x.split()[1]) for x in run.stdout.splitlines() if x.startswith("GOT")]
    assert got == [20] * 6, run.stdout


@pytest.mark.parametrize("most", [None, 0, 40, 333])
@pytest.mark.parametrize("count", [7, 30, 200])
def test_the_rows_are_the_first_by_hash(spark, count, most):
    """Against a plain reading of the rule: rows in order of hash, repeated ones as often as they occur, up to the bounds."""
    data = [(k % 25 if k % 9 else None, "x" * (k * k % 17), k % 2 == 0 and k % 9 != 0) for k in range(90)] + [(3, "copy", True)] * 20
    rows = spark.createDataFrame(data, "_id long, _text string, _more boolean")
    keys, want, held = ["_id", "_text", "_more"], [], 0
    for r in sorted(rows.withColumn("place", F.xxhash64(*keys)).collect(), key=lambda r: r.place):
        held += len(r._text)
        if len(want) == count or most is not None and held > most:
            break
        want.append(tuple(r)[:3])
    bound = {} if most is None else {"size": "_text", "most": most}
    for parts in (1, 5):
        got = sampled(rows.repartition(parts), keys, count, **bound)
        found = [tuple(r) for r in got.collect()]
        assert got.columns == keys and found == (want if len(data) <= 4 * count else want[: len(found)])  # the threshold may leave fewer
    assert sampled(rows.limit(0), keys, count, size="_text", most=5).collect() == []
