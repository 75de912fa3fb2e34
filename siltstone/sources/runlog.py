"""The run log: JSON lines in the order in which they were written, read newest first.

A log is a folder of batches, ``batch=000000000007`` and so on, each with Spark's part files in row order; a batch whose name ends in ``-base`` stands for all before it. A single file of JSON lines, or a
folder of such files, is read as well. A record's place is its batch, file, block and line, whatever its clock says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "chunk:int,model:string,lineStart:int,lineEnd:int,tokens:bigint,coreTokens:bigint,capTokens:bigint,digestTokens:bigint,splitInto:int,splitModels:array<string>"
COOLDOWN = "model:string,job:string,error:string,until:bigint,hours:double"
RECORD = T.StructType.fromDDL(
    "at long, trigger string, regionChars long, stage0Lines int, chunkCount int, mergeLevels int, mergeWindow long, mergeUsableInput long, regionTokens long, route string, fallback boolean, "
    f"fallbackReason string, digestChars int, attempts int, failed boolean, error string, chunks array<struct<{CHUNK}>>, cooldowns array<struct<{COOLDOWN}>>, "
    "ref struct<sessionId:string,seqs:array<bigint>,compactionId:string>, snapshotChars int, snapshot string, result string"
)
PLACE = "_place"
_BROKEN = "_broken"


def batches(spark: SparkSession, path: str) -> list[str]:
    """The names of a log's whole batches that count, in order: from the last base on. A batch whose writer did not finish has no mark of success."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not fs.getFileStatus(folder).isDirectory():
        return []
    found = [s.getPath().getName() for s in fs.listStatus(folder)]
    names = sorted(n for n in found if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    base = max((k for k, n in enumerate(names) if n.endswith("-base")), default=0)
    return names[base:]


def read_records(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """All sound records, or those of some batches, with their place in the log (column ``_place``, which sorts as they were written); blank and broken lines are skipped. A log that is not there is empty."""
    names = batches(spark, path) if names is None else names
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not names and not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], T.StructType([*RECORD.fields, T.StructField(PLACE, T.StringType())]))
    lines = spark.read.text([f"{path}/{n}" for n in names] or path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    place = F.concat_ws("/", "file_path", F.format_string("%020d", "file_block_start"), F.format_string("%020d", "line"))
    schema = T.StructType([*RECORD.fields, T.StructField(_BROKEN, T.StringType())])
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("r"), place.alias(PLACE))
    return parsed.filter(f"r is not null and r.{_BROKEN} is null").select(*[F.col(f"r.{f.name}") for f in RECORD.fields], PLACE)


def recent(records: DataFrame, limit: int, order: str = PLACE) -> DataFrame:
    """The newest ``limit`` records, newest first: the last ones of each task, then of these, so nothing is sorted as a whole."""
    return records.orderBy(F.desc(order)).limit(limit).drop(PLACE)


def newest(spark: SparkSession, path: str, limit: int, names: list[str] | None = None) -> DataFrame:
    """The newest ``limit`` records of a log with their place, newest first. Batches are read from the end, twice as many each time, until they hold enough; older ones are not opened. names: the batches to look at, all by default."""
    names, take = batches(spark, path) if names is None else names, 1
    while take < len(names) and read_records(spark, path, names[-take:]).limit(limit).count() < limit:
        take *= 2
    return read_records(spark, path, names[-take:] or None).orderBy(F.desc(PLACE)).limit(limit)
