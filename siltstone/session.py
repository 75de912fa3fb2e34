"""What an operator needs of its session: worker imports and a shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Bytes of an Arrow batch on its way to a Python worker, where the session sets no bound of its own.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver imported it, and bound the batches that they get.

    On a cluster the package is installed or sent with --py-files; the extra path is then harmless.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without the setting gets a folder of its own; a cluster without it is refused, as its machines share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written by materialise(), by application; and the scratch() blocks that each thread is in.
_WRITTEN: dict[str, list[str]] = {}
_OPEN = threading.local()


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors. release() removes such tables, and scratch() those of its block."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    for block in getattr(_OPEN, "blocks", [])[-1:]:
        block.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def register(spark: SparkSession, path: str) -> str:
    """Have release() remove what will be written at a path of the shared folder; returns the path."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


class Ledger:
    """A table of the shared folder that grows by rounds and is read in one scan."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.rounds = spark, schema, 0
        self.path = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}"
        _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(self.path)

    def add(self, rows: DataFrame) -> None:
        rows.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.path}/round={self.rounds}")
        self.rounds += 1

    def read(self) -> DataFrame:
        if not self.rounds:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).drop("round")


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def release(spark: SparkSession) -> int:
    """Remove the tables that this application's operators have written; call it once their results are written. Returns how many."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)


class scratch:  # noqa: N801
    """A block whose tables go at its end, but for those that keep() names: for steps whose result is itself written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> scratch:
        _OPEN.blocks = [*getattr(_OPEN, "blocks", []), self]
        return self

    def keep(self) -> str:
        """Keep the table written last, for the block around this one or release(); returns where it is."""
        path = self.paths.pop()
        for block in _OPEN.blocks[-2:-1]:
            block.paths.append(path)
        return path

    def remove(self, path: str) -> None:
        """Remove a table at once, whichever block it belongs to."""
        for known in (_WRITTEN.get(self.spark.sparkContext.applicationId, []), *(b.paths for b in getattr(_OPEN, "blocks", []))):
            if path in known:
                known.remove(path)
        _delete(self.spark, path)

    def __exit__(self, *_) -> None:
        _OPEN.blocks = _OPEN.blocks[:-1]
        for p in list(self.paths):
            self.remove(p)
