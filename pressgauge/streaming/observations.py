"""Structured Streaming front end of the lake.

The batch jobs stay the authority: the stream lands observations as they arrive and refreshes
only what they touch. Windows anchored at the newest hour and a subject's history need the past,
so they are recomputed from the lake inside ``foreachBatch`` rather than kept as stream state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions import buckets
from pressgauge.operators.picks import first_by, join_observations, serving_rows, unit_picks
from pressgauge.schemas import MODEL_CALL, NEWS_ITEM, PARTITION
from pressgauge.session import staged
from pressgauge.sources.lake import Lake, with_partition

_PARTS = list(PARTITION)
#: Tumbling windows of each unit; weeks start on Monday, four days after the epoch's Thursday.
TUMBLING = {
    "hour": ("1 hour", "0 seconds"),
    "day": ("1 day", "0 seconds"),
    "week": ("1 week", "4 days"),
}


def item_stream(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    return spark.readStream.schema(NEWS_ITEM).options(**options).format(fmt).load(path)


def deduplicated(items: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Each record once, however often it is delivered inside the watermark."""
    return (
        items.withColumn("collected_time", buckets.instant(F.col("collected_at")))
        .withWatermark("collected_time", lateness)
        .dropDuplicatesWithinWatermark(["record_id"])
    )


def tumbling_counts(
    items: DataFrame, unit: str, lateness: str = "2 hours", time: str = "collected_time"
) -> DataFrame:
    """Observations per axis and source in tumbling event-time windows of one unit."""
    length, start = TUMBLING[unit]
    return (
        items.withWatermark(time, lateness)
        .groupBy(F.window(time, length, startTime=start), "axis", "source_id")
        .agg(F.count("*").alias("observations"))
        .select(
            F.col("window.start").alias("window_start"), "axis", "source_id", "observations"
        )
    )


def land_batch(lake: Lake, batch: DataFrame) -> None:
    """Merge one micro-batch into its cycles; running the same batch again changes nothing.

    The touched cycles are read, the batch's rows win by record, and exactly those partitions
    are replaced.
    """
    columns = [c for c in lake.read_cycles("bronze", "news_item").columns if c not in _PARTS]
    fresh = with_partition(batch.select(*columns), F.col("collection_cycle"))
    fresh = staged(first_by(fresh, ["record_id", *_PARTS], [F.col("collected_at").desc()]), "batch")
    stored = lake.read_cycles("bronze", "news_item")
    kept = stored.join(fresh.select(*_PARTS).distinct(), _PARTS, "left_semi").join(
        fresh.select("record_id", *_PARTS), ["record_id", *_PARTS], "left_anti"
    )
    merged = kept.unionByName(fresh.select(*kept.columns))
    lake.write_cycles("bronze", "news_item", staged(merged, "landed"))


def land(items: DataFrame, lake: Lake, checkpoint: str):
    """Start landing a stream; ``availableNow`` stops once the waiting files are in."""
    return (
        items.writeStream.foreachBatch(lambda batch, _: land_batch(lake, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def touched_buckets(items: DataFrame, units: tuple[str, ...] = buckets.UNITS) -> DataFrame:
    """Axis buckets a batch of observations falls into."""
    return items.select(
        "axis", F.inline(buckets.bucket_labels(F.col("collected_at"), units))
    ).distinct()


def refreshed_picks(
    bronze: DataFrame, silver: DataFrame, touched: DataFrame, serving_version: str | Column | None = None
) -> DataFrame:
    """Picks of the touched buckets, recomputed from all their observations.

    A later observation of an article supersedes the earlier one, so a bucket is never patched. Only
    observations of the touched ISO weeks, which hold the touched hours and days, go into the join
    with Silver and the sorts.
    """
    weeks = touched.filter("bucket_unit = 'week'").select("axis", F.col("time_bucket").alias("_week"))
    label = buckets.bucket_label(F.col("collected_at"), "week")
    near = bronze.withColumn("_week", label).join(weeks, ["axis", "_week"], "left_semi").drop("_week")
    labelled = join_observations(near, serving_rows(silver, serving_version))
    return unit_picks(labelled).join(touched, ["axis", "bucket_unit", "time_bucket"], "left_semi")


def call_stream(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """New call-record files only; a file that does not decode is kept and marked as such."""
    raw = (
        spark.readStream.schema(f"{MODEL_CALL}, _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .json(path)
    )
    return raw.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_corrupt_record").isNull().alias("decoded"),
    ).drop("_corrupt_record")


def append_table(stream: DataFrame, path: str, checkpoint: str):
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
