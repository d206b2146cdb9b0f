"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Partition columns are strings ("06" must stay "06"); time buckets are read in UTC.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Plans here hold hundreds of columns; recording a call site for each costs more than
    # planning them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


#: Paths given out within the open scopes.
_SCOPES: list[list[str]] = []
#: Application -> its folder, used only where the session names no shared one.
_LOCAL_SCRATCH: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the jobs rely on to a session someone else started."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pressgauge")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config(map=SESSION_CONF)
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names.

    A session on one machine may name none and gets a folder there. On a cluster that would put each
    executor's part on its own disk, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL_SCRATCH.setdefault(app, "") or tempfile.mkdtemp(prefix="pressgauge-")
        _LOCAL_SCRATCH[app] = root
    path = f"{root.rstrip('/')}/pressgauge/{name}-{uuid.uuid4().hex}"
    for paths in _SCOPES:
        paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove what is staged within, at the end. For jobs that have written their results by then."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.pop()
        for path in paths:
            remove(spark, path)


#: Rows that a task of a join over whole records gets at most, about.
ROWS = 200_000


@contextmanager
def dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """Deal what is shuffled within out to a task for every ROWS of ``rows``, if that is more than one a core.

    Spark puts small shuffled parts together by their compressed bytes, until there is one a core. Keys of a lake
    compress to a few bytes a row, so a task would sort ever more rows as a table grows.
    """
    tasks = -(-rows // ROWS)
    if tasks <= spark.sparkContext.defaultParallelism:
        yield
        return
    settings = {
        "spark.sql.shuffle.partitions": max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks),
        "spark.sql.adaptive.coalescePartitions.minPartitionNum": tasks,
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: Spark's switch for removing a query's shuffle files when the query is through.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What writes within have shuffled goes with each write: nothing reads it again. Otherwise it stays until the
    driver's garbage is collected."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder, or to ``path`` there, and read it back.

    This cuts the lineage on storage every executor can reach, so a lost executor costs a
    re-read, and it lets a job rewrite a table it has just read.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
