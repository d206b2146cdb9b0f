"""From labelled observations to one pick per article per bucket or window.

Everything here keeps the newest row of a group with ``row_number() == 1``. Spark prunes such a
window before the shuffle (one candidate per group and task), so a group that holds a third of
all rows costs one row per map task downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgauge.functions import buckets, identity
from pressgauge.schemas import PARTITION

BUCKET_KEYS = ["axis", "bucket_unit", "time_bucket"]
WINDOW_KEYS = ["axis", "range", "period"]


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each ``keys`` group in ``order``."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def _lake_keys(*frames: DataFrame) -> list[str]:
    """``record_id`` plus the partition columns when every frame carries them."""
    shared = [c for c in PARTITION if all(c in f.columns for f in frames)]
    return ["record_id", *shared]


def serving_rows(silver: DataFrame, serving_version: str | Column | None = None) -> DataFrame:
    """One analysis per record: the serving version's when present, else the newest."""
    order = [F.col("analyzed_at").desc(), F.col("analyzer_version").desc()]
    if serving_version is not None:
        wanted = serving_version if isinstance(serving_version, Column) else F.lit(serving_version)
        order.insert(0, F.coalesce(F.col("analyzer_version") == wanted, F.lit(False)).desc())
    return first_by(silver, _lake_keys(silver), order)


def join_observations(bronze: DataFrame, served: DataFrame) -> DataFrame:
    """Labelled observations, reduced to what the folds read.

    An analysis whose observation is gone drops out. The join is on the record within its own
    cycle partition, so partitioned tables join partition by partition.
    """
    keys = _lake_keys(bronze, served)
    items = bronze.select(*keys, "source_id", "axis", "source_url", "collected_at")
    labels = served.select(
        *keys, "narrative_subjects", "subject_categories", "sentiment", "analysis_status"
    )
    return items.join(labels, keys).select(
        "axis",
        identity.article_key(F.col("source_url"), F.col("record_id")).alias("article"),
        "collected_at",
        "record_id",
        "source_id",
        F.array_distinct(
            identity.grouping_keys(F.col("subject_categories"), F.col("narrative_subjects"))
        ).alias("keys"),
        identity.pick_sentiment(F.col("analysis_status"), F.col("sentiment")).alias("sentiment"),
    )


def newest_first() -> list[Column]:
    return [F.col("collected_at").desc(), F.col("record_id").desc()]


_PICK = ["article", "collected_at", "record_id", "source_id", "keys", "sentiment"]


def hour_picks(labelled: DataFrame) -> DataFrame:
    """Newest observation of each article per axis and hour."""
    hours = labelled.select(
        "axis",
        F.lit("hour").alias("bucket_unit"),
        buckets.bucket_label(F.col("collected_at"), "hour").alias("time_bucket"),
        *_PICK,
    )
    return first_by(hours, ["axis", "time_bucket", "article"], newest_first())


def unit_picks(labelled: DataFrame, units: tuple[str, ...] = buckets.UNITS) -> DataFrame:
    """Newest observation of each article per axis and bucket, for every unit.

    Hours nest in days and days in ISO weeks, so the newest pick of a wide bucket is one of its
    hours' picks: in the hour picks of one article and week, newest first, it is the row where
    the bucket's label first shows up. That is one sort of single rows, of at most the hours of
    a week per article, instead of a sort of every row once per unit.
    """
    hours = hour_picks(labelled)
    if units == ("hour",):
        return hours
    labels = {u: F.col("time_bucket") if u == "hour" else F.col(f"_{u}") for u in units}
    cut = hours.withColumns(
        {f"_{u}": buckets.bucket_label(F.col("collected_at"), u) for u in ("day", "week")}
    )
    line = W.partitionBy("axis", "article", "_week").orderBy(*newest_first())
    newer = F.lag("_day").over(line)
    opens = {
        "hour": F.lit(True),
        "day": F.col("_newer_day").isNull() | (F.col("_newer_day") != F.col("_day")),
        "week": F.col("_newer_day").isNull(),
    }
    every = F.array(
        *[
            F.struct(
                F.lit(u).alias("bucket_unit"), labels[u].alias("bucket"), opens[u].alias("opens")
            )
            for u in units
        ]
    )
    return cut.withColumn("_newer_day", newer).select(
        "axis",
        F.inline(every).alias("bucket_unit", "bucket", "opens"),
        *_PICK,
    ).filter("opens").select("axis", "bucket_unit", F.col("bucket").alias("time_bucket"), *_PICK)


def article_picks(picks: DataFrame) -> DataFrame:
    """The list behind a raw count: keyed picks only, one row per article per bucket."""
    return picks.filter(F.size("keys") > 0).select(
        "axis",
        "bucket_unit",
        "time_bucket",
        "record_id",
        "source_id",
        "collected_at",
        F.col("keys").alias("counted_subjects"),
    )


def window_anchor(hours: DataFrame) -> Column:
    """The latest collected hour over all axes, as a scalar subquery."""
    latest = hours.agg(F.max("time_bucket").alias("anchor")).scalar()
    return F.to_timestamp(latest, "yyyy-MM-dd'T'HH")


def window_picks(hours: DataFrame) -> DataFrame:
    """Newest observation of each article per axis, range and period.

    Every range holds the hours ending at the anchor and as many hours before them. A pick
    lists the windows it is in itself, so this needs no join with the ranges.
    """
    ranges = F.array(
        *[
            F.struct(F.lit(name).alias("range"), F.lit(span).alias("span"))
            for name, span in buckets.RANGES.items()
        ]
    )
    at = F.to_timestamp("time_bucket", "yyyy-MM-dd'T'HH")
    aged = hours.select(
        "*", window_anchor(hours).alias("anchor"), at.alias("at")
    ).withColumn("back", buckets.hours_between(F.col("anchor"), F.col("at")))
    oldest = 2 * max(buckets.RANGES.values())
    listed = aged.filter(F.col("back") < oldest).select(
        "axis", "article", "collected_at", "record_id", "source_id", "keys", "sentiment",
        "anchor", "back",
        F.inline(ranges),
    ).filter(F.col("back") < F.col("span") * 2)
    placed = listed.withColumn(
        "period", F.when(F.col("back") < F.col("span"), "current").otherwise("previous")
    )
    first, last = buckets.window_bounds(F.col("anchor"), F.col("span"), F.col("period"))
    return first_by(placed, [*WINDOW_KEYS, "article"], newest_first()).select(
        *WINDOW_KEYS, "article", "collected_at", "record_id", "source_id", "keys", "sentiment",
        first.alias("window_start"), last.alias("window_end"),
    )
