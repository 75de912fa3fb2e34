"""The run log: formatting, appending and capping of JSON lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import cap_snapshot, describe_error, length16
from siltstone.sources.runlog import PLACE, RECORD, batches, newest

#: The folder of a log in which writers take numbers.
NUMBERS = "_numbers"
MOST_TRIES = 100


def route_label(provider: Column, model: Column, failed: Column) -> Column:
    return F.when(F.coalesce(failed, F.lit(False)), F.lit("error")).when(provider.isNotNull() & model.isNotNull(), F.concat(provider, F.lit("/"), model)).otherwise(F.lit("fallback"))


def format_records(runs: DataFrame, snapshot_chars: int = 0) -> DataFrame:
    """Runs as records: route from provider and model, the count of attempts, a capped snapshot only if one is asked for.

    A run has any of the record's columns, and provider, model, attempt_list (array), region (text), errors (a cause chain).
    """
    have = set(runs.columns)
    failed = F.col("failed") if "failed" in have else F.lit(None).cast("boolean")
    given = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    made = {"route": route_label(given("provider", "string"), given("model", "string"), failed)}
    if "attempt_list" in have:
        made["attempts"] = F.size(F.coalesce("attempt_list", F.array().cast(runs.schema["attempt_list"].dataType)))
    if "errors" in have:
        made["error"] = F.when(F.coalesce(failed, F.lit(False)), describe_error(F.col("errors")))
    if "region" in have and snapshot_chars > 0:
        made |= {"snapshot": cap_snapshot(F.col("region"), snapshot_chars), "snapshotChars": length16(F.col("region"))}
    return runs.select(*[made.get(f.name, given(f.name, f.dataType)).cast(f.dataType).alias(f.name) for f in RECORD.fields])


def record_once(failures: DataFrame) -> DataFrame:
    """The first report of each failure, whichever wrapper reports it again. failures: failure_id, pos and any others; null ids are failures of their own."""
    own = F.coalesce(F.col("failure_id").cast("string"), F.concat(F.lit("-"), F.col("pos").cast("string")))
    return failures.groupBy(own.alias("_own")).agg(F.min_by(F.struct(*failures.columns), "pos").alias("r")).select("r.*")


def _store(spark: SparkSession, path: str):
    """The store of a log, and how its paths are made."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _last(spark: SparkSession, path: str) -> int:
    """The highest number that any writer has taken, -1 if none."""
    fs, make = _store(spark, path)
    listed = lambda p: [s.getPath().getName() for s in fs.listStatus(make(p))] if fs.exists(make(p)) else []
    taken = [n.removeprefix("batch=")[:12] for n in [*listed(path), *listed(f"{path}/{NUMBERS}")]]
    return max((int(n) for n in taken if n.isdigit()), default=-1)


def _claim(spark: SparkSession, path: str, number: int) -> bool:
    """Take a number by creating its file, which one writer alone can do (on stores that create a file only once: HDFS and local ones do); False if another has it."""
    fs, make = _store(spark, path)
    file = make(f"{path}/{NUMBERS}/{number:012d}")
    fs.mkdirs(file.getParent())
    try:
        if fs.getUri().getScheme() == "file":
            spark._jvm.java.nio.file.Files.createFile(spark._jvm.java.io.File(file.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(file, False).close()
        return True
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise


def _publish(spark: SparkSession, staged: str, path: str, tag: str) -> str:
    """Give a whole folder the log's next number. If a base that does not hold it has come before it meanwhile, it goes on behind the base, whoever notices first."""
    fs, make = _store(spark, path)
    for _ in range(MOST_TRIES):
        number = _last(spark, path) + 1
        if not _claim(spark, path, number):
            continue
        name = f"batch={number:012d}{tag}"
        if not fs.exists(make(staged)):
            return name  # the one who capped the log has put it behind the base
        if not fs.rename(make(staged), make(f"{path}/{name}")):
            raise OSError(f"could not rename {staged}")
        if name in batches(spark, path):
            return name
        staged = f"{path}/{name}"
    raise RuntimeError(f"other writers came first {MOST_TRIES} times")


def append_records(records: DataFrame, path: str, tag: str = "") -> str:
    """One JSON line a record, as the log's next batch, in the order of the rows; returns the batch's name, which ends in the tag.

    Several writers may append at a time, and one cap the log meanwhile: rows are written beside the log, a number is claimed, and a rename shows them. A writer that dies leaves a number
    unused or a folder that no reader sees. An append without rows is a batch without records.
    """
    spark = records.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    records.select(*[f.name for f in RECORD.fields]).write.json(staged)
    return _publish(spark, staged, path, tag)


def cap_log(spark: SparkSession, path: str, limit: int, tag: str = "") -> None:
    """Keep the newest ``limit`` records of a log, and those appended meanwhile. One caller at a time caps a log; others may append.

    They are written beside the log and become its base by a rename, in the place of the last batch that they come from; only then do the batches before it go. A crash at any time leaves the log
    as it was or as it should be.
    """
    names = batches(spark, path)
    if not names:
        return
    fs, make = _store(spark, path)
    staged, base = f"{path}/_staged-{uuid.uuid4().hex}", f"{names[-1]}{'' if tag in names[-1] else tag}-base"
    newest(spark, path, limit, names).orderBy(PLACE).select(*[f.name for f in RECORD.fields]).write.json(staged)
    if not fs.rename(make(staged), make(f"{path}/{base}")):
        raise OSError(f"could not rename {staged}")
    found = sorted(s.getPath().getName() for s in fs.listStatus(make(path)))
    for n in [n for n in found if n.startswith("batch=") and n < base and n not in names and not n.endswith("-base")]:
        if fs.exists(make(f"{path}/{n}/_SUCCESS")):  # its number is older than the base, its rows came later
            _publish(spark, f"{path}/{n}", path, n.removeprefix("batch=")[12:])
    for n in names:
        fs.delete(make(f"{path}/{n}"), True)


def runlog_sink(path: str, limit: int | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends each micro-batch of records, and caps the log if a limit is given. A micro-batch that is tried again is written once."""

    def write(records: DataFrame, epoch: int) -> None:
        tag = f"-e{epoch:012d}"
        if not any(tag in n for n in batches(records.sparkSession, path)):
            append_records(records, path, tag)
        if limit is not None:
            cap_log(records.sparkSession, path, limit, tag)

    return write
