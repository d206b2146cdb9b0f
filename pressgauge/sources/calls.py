"""Call records as files: a table of them that is brought up to date file by file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.schemas import MODEL_CALL
from pressgauge.session import staged

_FILE = ["file_path", "file_length", "file_changed"]


def listed_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(file_path, file_length, file_changed) of the files below a folder; none is opened. Files without a
    byte are not listed."""
    return _files(spark, folder, pattern).select(*_named())


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def _together(files: DataFrame, parts: int) -> DataFrame:
    """Spark gives a task 32 small files. This puts some of its parts together, not below one a core: what a task writes
    costs more than what it reads of so few."""
    tasks = files.rdd.getNumPartitions()
    return files.coalesce(max(1, min(tasks, files.sparkSession.sparkContext.defaultParallelism), tasks // parts))


def _named() -> list:
    return [F.col(old).alias(new) for old, new in zip(("path", "length", "modificationTime"), _FILE)]


def put_files(files: DataFrame, folder: str) -> None:
    """Write each row (part, name, value) as a text file of its own in the folder of its part, over one of that name.

    On a local or mounted disk tasks write the files themselves: Hadoop starts two or three processes for each file and
    folder it makes there, to set their modes. Other places have no such cost; there the folders of parts are replaced.
    """
    place = files.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    if place.getFileSystem(files.sparkSession._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        files.drop("name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 1).partitionBy(
            "part"
        ).text(folder)
        return
    root = place.toUri().getPath()

    def put(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                below = f"{root}/part={row['part']}"
                os.makedirs(below, exist_ok=True)
                with open(f"{below}/{row['name']}.txt", "wb") as file:
                    file.write(f"{row['value']}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    files.mapInArrow(put, "files bigint").agg(F.sum("files")).collect()


def decoded(files: DataFrame) -> DataFrame:
    """A row per file from its ``content``. What is no call record keeps its place, marked as not decoded."""
    schema = f"{MODEL_CALL}, _corrupt_record string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    read = files.withColumn("call", F.from_json(F.col("content").cast("string"), schema, options))
    good = F.col("call").isNotNull() & F.col("call._corrupt_record").isNull() & F.col("call.call_id").isNotNull()
    columns = [part.split()[0] for part in MODEL_CALL.split(", ")]
    return read.withColumn("decoded", F.coalesce(good, F.lit(False))).select(
        *(F.when(F.col("decoded"), F.col(f"call.{c}")).alias(c) for c in columns), *_FILE, "decoded"
    )


def refreshed(spark: SparkSession, folder: str, stored: DataFrame, pattern: str = "*.json") -> DataFrame:
    """The table of call files as the folder is now.

    Rows of files that are as they were are taken from ``stored``, those of files that are gone are left out, and
    only new and changed files are opened: the time of the oldest of them goes into the scan, which looks at a file's
    time before its content.
    """
    now = staged(_together(listed_files(spark, folder, pattern), 32), "call-listing")
    same = stored.join(now, _FILE, "left_semi")
    fresh = staged(now.join(stored.select(*_FILE), _FILE, "left_anti"), "fresh-calls")
    since = fresh.agg(F.min("file_changed")).first()[0]
    if since is None:
        return same
    found = _files(spark, folder, pattern).where(F.col("modificationTime") >= F.lit(since))
    content = _together(found.select(F.col("path").alias("file_path"), "content"), 8).join(fresh, "file_path")
    return same.unionByName(decoded(content).select(*stored.columns))


def refresh_calls(lake, folder: str, pattern: str = "*.json") -> DataFrame:
    """Bring the lake's table of call files up to date; readers see the old one until the new one is whole."""
    stored = lake.read_records("index", "call_file")
    return lake.write_records("index", "call_file", staged(refreshed(lake.spark, folder, stored, pattern), "call-files"))

