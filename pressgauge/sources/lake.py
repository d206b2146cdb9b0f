"""The lake: datasets addressed by layer and name, in four layouts.

* record datasets are replaced whole: each write is a new snapshot folder, readers take the
  newest committed one, so nobody reads a half-written table;
* partitioned datasets hold one ``year=/month=/day=/hour=`` partition per collection cycle and
  are rewritten partition by partition; those of a few rows a cycle hold one per day;
* object datasets are keyed rows, laid out by the first digit of the key's hash, so that keys which
  all begin alike still spread over the prefixes;
* logs are rows that are only added.

Tables are Parquet. Lakes kept as JSON lines in the same folder layout are read and written
with ``fmt="json"``.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions import buckets
from pressgauge.operators.picks import first_by
from pressgauge.schemas import DATASETS, PARTITION, PARTITION_DDL
from pressgauge.session import configure, remove, shuffles_removed, staged

_PARTS = list(PARTITION)
#: Snapshots of a record dataset that stay after a write; readers may still be at the older ones.
KEPT = 3
#: Files of a log that are read one by one before they are put together.
TAIL = 200
#: Spark would put small parts together by their bytes, until one task wrote the files of all cycles.
_COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


def prefix_of(key: str | Column) -> Column:
    return F.substring(F.sha2(F.col(key) if isinstance(key, str) else key, 256), 1, 1)


class Lake:
    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet") -> None:
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self.fmt = fmt

    # -- places -------------------------------------------------------------------------

    def folder(self, layer: str, dataset: str) -> str:
        return f"{self.root}/{layer}/{dataset}"

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(hadoop)

    def _children(self, path: str) -> list[str]:
        if not self._exists(path):
            return []
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(hadoop))

    def _read(self, path: str, schema: str, **options: str) -> DataFrame:
        return self.spark.read.schema(schema).options(**options).format(self.fmt).load(path)

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    # -- record datasets ----------------------------------------------------------------

    def _committed(self, layer: str, dataset: str) -> list[str]:
        """Folders of the newest committed snapshot and of what was added to it, oldest first.

        Folders are named by the time of their write and count once their commit marker is there.
        """
        base = self.folder(layer, dataset)
        done = [
            (name.split("=", 1)[1], name)
            for name in self._children(base)
            if name.startswith(("snapshot=", "added=")) and self._exists(f"{base}/{name}/_SUCCESS")
        ]
        done.sort()
        whole = [i for i, (_, name) in enumerate(done) if name.startswith("snapshot=")]
        return [f"{base}/{name}" for _, name in done[whole[-1] :]] if whole else []

    def read_records(self, layer: str, dataset: str) -> DataFrame:
        """The newest committed rows, or a JSON-lines file of the same name; else empty."""
        schema = DATASETS[layer, dataset]
        folders = self._committed(layer, dataset)
        if folders:
            rows = self._read(folders[0], schema)
            for folder in folders[1:]:
                rows = rows.unionByName(self._read(folder, schema))
            return rows
        flat = f"{self.folder(layer, dataset)}.jsonl"
        if self._exists(flat):
            return self.spark.read.schema(schema).json(flat)
        return self._empty(schema)

    def _stamp(self) -> str:
        return f"{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%f')}-{uuid.uuid4().hex[:8]}"

    def write_records(
        self, layer: str, dataset: str, rows: DataFrame, by: list[str] | None = None
    ) -> DataFrame:
        """Replace the dataset: the snapshot counts once its commit marker is there. All but the
        last few snapshots, and what was added to them, are removed."""
        base = self.folder(layer, dataset)
        path = f"{base}/snapshot={self._stamp()}"
        rows.write.format(self.fmt).partitionBy(*(by or [])).save(path)
        stamps = sorted(n.split("=", 1)[1] for n in self._children(base) if n.startswith("snapshot="))
        if len(stamps) > KEPT:
            for name in self._children(base):
                kind, _, stamp = name.partition("=")
                if kind in ("snapshot", "added") and stamp < stamps[-KEPT]:
                    remove(self.spark, f"{base}/{name}")
        return self._read(path, DATASETS[layer, dataset])

    def append_new(
        self, layer: str, dataset: str, key: str, rows: DataFrame, first: list[Column] | None = None
    ) -> DataFrame:
        """Add rows whose key is not stored yet, one per key: the first in ``first`` order, by default
        the least in all columns.

        What is stored is read for its keys only and never rewritten. The rows go to a folder of
        their own, so readers see all of them or none. Many additions are put into a new snapshot.
        """
        stored = self.read_records(layer, dataset)
        order = first or [F.col(c) for c in stored.columns if c != key]
        fresh = first_by(rows.select(*stored.columns), [key], order).join(stored.select(key), key, "left_anti")
        folders = self._committed(layer, dataset)
        if not folders or len(folders) > 50:
            return self.write_records(layer, dataset, stored.unionByName(fresh.select(*stored.columns)))
        fresh.select(*stored.columns).write.format(self.fmt).save(f"{self.folder(layer, dataset)}/added={self._stamp()}")
        return self.read_records(layer, dataset)

    # -- logs ---------------------------------------------------------------------------

    def _tail(self, layer: str, dataset: str) -> list[str]:
        names = self._children(f"{self.folder(layer, dataset)}/tail")
        return [n for n in names if not n.startswith(("_", "."))]

    def append_log(self, layer: str, dataset: str, rows: DataFrame) -> None:
        """Add rows, each call in one file that appears at once; meant for a few rows a call. When there are
        many such files, they are put together."""
        rows.coalesce(1).write.format(self.fmt).mode("append").save(f"{self.folder(layer, dataset)}/tail")
        if len(self._tail(layer, dataset)) > TAIL:
            self.compact_log(layer, dataset)

    def _log(self, layer: str, dataset: str, names: list[str]) -> DataFrame:
        """The newest snapshot and what these files of the tail add to it, with the file each row came in. A file
        that the snapshot has in it already may still lie in the tail, if its removal was cut short."""
        base, schema = self.folder(layer, dataset), DATASETS[layer, dataset]
        folders = self._committed(layer, dataset)
        whole = f"{schema}, log_file string"
        rows = self._read(folders[0], whole) if folders else self._empty(whole)
        if not names:
            return rows
        tail = self.spark.read.schema(schema).format(self.fmt).load([f"{base}/tail/{n}" for n in names])
        tail = tail.withColumn("log_file", F.col("_metadata.file_name"))
        return rows.unionByName(tail.join(rows.select("log_file").distinct(), "log_file", "left_anti"))

    def read_log(self, layer: str, dataset: str) -> DataFrame:
        return self._log(layer, dataset, self._tail(layer, dataset)).drop("log_file")

    def compact_log(self, layer: str, dataset: str) -> None:
        """Put the tail's files into a new snapshot; they are removed once it is committed."""
        base, names = self.folder(layer, dataset), self._tail(layer, dataset)
        rows = self._log(layer, dataset, names)
        rows.coalesce(max(1, rows.rdd.getNumPartitions() // 64)).write.format(self.fmt).save(f"{base}/snapshot={self._stamp()}")
        for name in names:
            remove(self.spark, f"{base}/tail/{name}")
        stamps = sorted(n for n in self._children(base) if n.startswith("snapshot="))
        for old in stamps[:-KEPT]:
            remove(self.spark, f"{base}/{old}")

    # -- partitioned datasets -----------------------------------------------------------

    def read_cycles(self, layer: str, dataset: str) -> DataFrame:
        """All partitions; filter on ``year``.. ``hour`` to read only some."""
        schema = f"{DATASETS[layer, dataset]}, {PARTITION_DDL}"
        path = self.folder(layer, dataset)
        return self._read(path, schema) if self._exists(path) else self._empty(schema)

    def read_cycle(self, layer: str, dataset: str, cycle: str) -> DataFrame:
        rows = self.read_cycles(layer, dataset)
        for name, value in buckets.split_cycle(cycle).items():
            rows = rows.filter(F.col(name) == value)
        return rows

    def partitions(self, layer: str, dataset: str) -> DataFrame:
        return self.read_cycles(layer, dataset).select(*_PARTS).distinct()

    def listed(self, layer: str, dataset: str) -> DataFrame:
        """(path, length, modificationTime, partition columns) of the dataset's files. Spark lists the
        folders in tasks; no file is opened."""
        path = self.folder(layer, dataset)
        files = "path string, modificationTime timestamp, length bigint"
        if not self._exists(path):
            return self._empty(f"{files}, {PARTITION_DDL}")
        return self.spark.read.schema(f"{files}, content binary, {PARTITION_DDL}").format("binaryFile").load(path).drop("content")

    def signatures(self, layer: str, dataset: str) -> DataFrame:
        """A token per partition that differs after any rewrite, from the listing of its files alone."""
        mark = F.xxhash64("path", "length", "modificationTime")
        return self.listed(layer, dataset).groupBy(*_PARTS).agg(
            F.concat_ws("-", F.count("*"), F.hex(F.bit_xor(mark)), F.sum("length")).alias("signature")
        )

    def row_counts(self, layer: str, dataset: str, cycles: DataFrame) -> DataFrame:
        """Rows of each of these partitions; no column is read."""
        rows = only_cycles(self.read_cycles(layer, dataset), cycles_of(cycles))
        return rows.groupBy(*_PARTS).agg(F.count("*").alias("row_count"))

    def write_cycles(self, layer: str, dataset: str, rows: DataFrame) -> None:
        """Replace exactly the partitions ``rows`` has rows for."""
        self._write_parts(layer, dataset, rows, _PARTS)

    def write_days(self, layer: str, dataset: str, rows: DataFrame) -> None:
        """Replace exactly the cycles ``rows`` has rows for, in a dataset of a few small rows a cycle: its
        partitions are days, and the hour is a column of its files. ``read_cycles`` reads it like any other."""
        stored = self.read_cycles(layer, dataset)
        kept = _joined(_joined(stored, rows, _PARTS[:-1], "left_semi"), rows, _PARTS, "left_anti")
        merged = staged(kept.select(*rows.columns).unionByName(rows), f"days-{dataset}")
        self._write_parts(layer, dataset, merged, _PARTS[:-1])

    def _write_parts(self, layer: str, dataset: str, rows: DataFrame, parts: list[str]) -> None:
        """``rebalance`` sends a day's rows together, so that small partitions make one file each and their
        folders are made once, and splits a day too large for one task. The days are counted first: it is
        the number of files that says how many tasks they are dealt out to.
        """
        with shuffles_removed(self.spark):
            days = rows.select(*_PARTS[:-1]).distinct().count()
        before = self.spark.conf.get(_COALESCE)
        self.spark.conf.set(_COALESCE, "false")
        try:
            with shuffles_removed(self.spark):
                (
                    rows.hint("rebalance", max(1, days), *_PARTS[:-1])
                    .write.format(self.fmt)
                    .mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy(*parts)
                    .save(self.folder(layer, dataset))
                )
        finally:
            self.spark.conf.set(_COALESCE, before)

    def clear_cycles(self, layer: str, dataset: str, cycles: DataFrame) -> int:
        """Drop whole partitions (a cycle all of whose rows are gone).

        ``cycles`` holds one row per emptied partition. It is walked on the driver one row at a
        time because removing a folder is a file system call, not a job over rows.
        """
        jvm = self.spark._jvm
        dropped = 0
        for row in cycles.select(*_PARTS).distinct().toLocalIterator():
            parts = "/".join(f"{p}={row[p]}" for p in _PARTS)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder(layer, dataset)}/{parts}")
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            dropped += int(fs.delete(path, True))
        return dropped

    def relay_to_cycles(
        self, layer: str, dataset: str, flat: DataFrame, located: DataFrame, keys: tuple[str, ...] = ("record_id", "analyzer_version")
    ) -> None:
        """Lay a flat dataset out in partitions; rows with no known cycle are dropped.

        ``located`` maps ``record_id`` to ``collection_cycle``. Rows already stored in a touched
        partition stay, and rows of their keys are skipped, so a second run changes nothing.
        """
        stored = self.read_cycles(layer, dataset)
        own = [k for k in keys if k in stored.columns]
        moved = with_partition(flat.join(located, "record_id"), F.col("collection_cycle"))
        moved = moved.filter(F.col("year").isNotNull()).select(*stored.columns)
        kept = only_cycles(stored, moved.select(*_PARTS).distinct())
        moved = moved.join(kept.select(*own, *_PARTS), [*own, *_PARTS], "left_anti")
        self.write_cycles(layer, dataset, staged(kept.unionByName(moved), "relay"))

    # -- retiring flat datasets -----------------------------------------------------------

    def flat_rows(self, layer: str, dataset: str) -> DataFrame | None:
        """The rows of a dataset that is still one JSON-lines file, None if there is no such file."""
        path = f"{self.folder(layer, dataset)}.jsonl"
        return self.spark.read.schema(DATASETS[layer, dataset]).json(path) if self._exists(path) else None

    def _retire(self, layer: str, dataset: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(layer, dataset)}.jsonl")
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(layer, dataset)}.jsonl.migrated")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(path, done)

    def migrate_to_objects(self, layer: str, dataset: str, key: str, first: list[Column]) -> int:
        """Move a flat dataset's rows to keyed objects and retire the file; returns how many were new.

        Keys that are stored already stay as they are. The file is renamed only after every key is seen in
        the objects: a run that is cut short leaves it, and the next one skips what has moved.
        """
        flat = self.flat_rows(layer, dataset)
        if flat is None:
            return 0
        written = self.put_objects(layer, dataset, key, flat.filter(F.col(key).isNotNull()), first).count()
        stored = self.read_objects(layer, dataset, key)
        left = flat.filter(F.col(key).isNotNull()).join(stored.select(key), key, "left_anti")
        if not left.isEmpty():
            raise RuntimeError(f"{layer}/{dataset}: rows of the flat file have not arrived; it stays")
        self._retire(layer, dataset)
        return written

    def migrate_to_cycles(self, layer: str, dataset: str, located: DataFrame) -> None:
        """Move a flat dataset's rows to cycle partitions and retire the file after that, as above."""
        flat = self.flat_rows(layer, dataset)
        if flat is not None:
            self.relay_to_cycles(layer, dataset, flat, located)
            self._retire(layer, dataset)

    # -- object datasets ----------------------------------------------------------------

    def read_objects(self, layer: str, dataset: str, key: str) -> DataFrame:
        prefix = f"{key}_prefix"
        schema = f"{DATASETS[layer, dataset]}, {prefix} string"
        path = self.folder(layer, dataset)
        return self._read(path, schema) if self._exists(path) else self._empty(schema)

    def get_object(self, layer: str, dataset: str, key: str, value: str) -> DataFrame:
        """The row of one key; only its prefix partition is listed and read."""
        rows = self.read_objects(layer, dataset, key)
        return rows.filter(
            (F.col(f"{key}_prefix") == hashlib.sha256(value.encode()).hexdigest()[0]) & (F.col(key) == value)
        ).drop(f"{key}_prefix")

    def _write_objects(self, layer: str, dataset: str, key: str, rows: DataFrame, mode: str) -> None:
        prefix = f"{key}_prefix"
        with shuffles_removed(self.spark):
            (
                rows.withColumn(prefix, prefix_of(key))
                .hint("rebalance", prefix)
                .write.format(self.fmt)
                .mode(mode)
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(prefix)
                .save(self.folder(layer, dataset))
            )

    def put_objects(
        self, layer: str, dataset: str, key: str, rows: DataFrame, first: list[Column]
    ) -> DataFrame:
        """Insert rows whose key is absent; of several, the first in ``first`` order.

        Returns the inserted rows. They are staged before the append so that the table read
        and the table written are never the same job.
        """
        prefix = f"{key}_prefix"
        stored = self.read_objects(layer, dataset, key).select(prefix, key)
        new = first_by(rows, [key], first).withColumn(prefix, prefix_of(key))
        fresh = staged(new.join(stored, [prefix, key], "left_anti").drop(prefix), f"put-{dataset}")
        self._write_objects(layer, dataset, key, fresh, "append")
        return fresh

    def upsert_objects(
        self, layer: str, dataset: str, key: str, rows: DataFrame, latest: list[Column]
    ) -> None:
        """Replace or insert keyed rows; only the touched prefix partitions are rewritten."""
        prefix = f"{key}_prefix"
        fresh = first_by(rows, [key], latest)
        touched = fresh.select(prefix_of(key).alias(prefix)).distinct()
        stored = self.read_objects(layer, dataset, key)
        kept = (
            stored.join(touched, prefix, "left_semi")
            .join(fresh.select(key), key, "left_anti")
            .drop(prefix)
        )
        merged = staged(kept.unionByName(fresh.select(*kept.columns)), f"upsert-{dataset}")
        self._write_objects(layer, dataset, key, merged, "overwrite")


def cycles_of(rows: DataFrame) -> DataFrame:
    """Distinct partitions of ``rows``.

    The comparison holds for every year; it tells Spark that the list is selective, so that a
    semi-join with it prunes the partitions of the other side before they are read.
    """
    return rows.select(*_PARTS).distinct().filter(F.col("year") >= "0000")


def only_cycles(rows: DataFrame, cycles: DataFrame) -> DataFrame:
    """The rows of a partitioned dataset that lie in ``cycles``."""
    return rows.join(cycles, _PARTS, "left_semi")


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join with the distinct ``keys`` of ``other``; a null key is a key like any other."""
    named = other.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)


def with_partition(rows: DataFrame, cycle: Column) -> DataFrame:
    return rows.withColumns(buckets.cycle_parts(cycle))


def with_cycle(rows: DataFrame) -> DataFrame:
    cycle = buckets.cycle_of_parts(*[F.col(p) for p in _PARTS])
    return rows.withColumn("collection_cycle", cycle)
