"""Slices of Gold: predicates, units and buckets present, ranks, bucket windows.

Ranks that only a top list needs come from ``orderBy().limit(n)``, which keeps n rows per task,
never from a numbering of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgauge.functions import buckets
from pressgauge.functions import vocabulary as V


# -- parameters: bad values fall back ---------------------------------------------------------


def axis_or(value: str | None, fallback: str = "KR") -> str:
    return value if value in V.AXES else fallback


def axis_or_all(value: str | None, fallback: str = "KR") -> str:
    return value if value in V.AXIS_SCOPES else fallback


def range_or(value: str | None, fallback: str = "7d") -> str:
    return value if value in buckets.RANGES else fallback


def unit_or(value: str | None, fallback: str = "") -> str:
    return value if value in buckets.UNITS else fallback


def unit_within(unit: str | None, range_name: str) -> str:
    """A unit shorter than the range; one as long would draw the range as a single point."""
    unit = unit_or(unit, "day")
    return unit if buckets.UNIT_HOURS[unit] < buckets.RANGES[range_name] else "hour"


# -- slices -----------------------------------------------------------------------------------


def trend_slice(
    trend: DataFrame,
    unit: str | Column,
    axis: str | None = None,
    times: list[str] | None = None,
    subjects: list[str] | None = None,
) -> DataFrame:
    """Rows of one unit; an empty list of buckets or subjects keeps none."""
    out = trend.filter(F.col("bucket_unit") == unit)
    if axis:
        out = out.filter(F.col("axis") == axis)
    for column, wanted in (("time_bucket", times), ("subject", subjects)):
        if wanted is not None:
            out = out.filter(F.col(column).isin(*wanted) if wanted else F.lit(False))
    return out


def units_present(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("bucket_unit")
    for frame in frames[1:]:
        out = out.unionByName(frame.select("bucket_unit"))
    return out.distinct()


def finest_unit(*frames: DataFrame) -> Column:
    """The finest unit with rows, as a scalar subquery; "" when there are none."""
    ranks = units_present(*frames).agg(
        F.coalesce(F.min(buckets.unit_rank(F.col("bucket_unit"))), F.lit(3)).alias("rank")
    )
    return ranks.select(buckets.unit_of_rank(F.col("rank")).alias("unit")).scalar()


def latest_bucket(*frames: DataFrame) -> Column:
    """The latest bucket over frames of one unit, as a scalar subquery; "" when empty."""
    out = frames[0].select("time_bucket")
    for frame in frames[1:]:
        out = out.unionByName(frame.select("time_bucket"))
    return out.agg(F.coalesce(F.max("time_bucket"), F.lit("")).alias("latest")).scalar()


def distinct_buckets(rows: DataFrame) -> DataFrame:
    return rows.select("time_bucket").distinct().orderBy("time_bucket")


def subjects_in_order(rows: DataFrame) -> DataFrame:
    """Distinct subjects by the bucket they first appear in, then by share there."""
    return rows.groupBy("subject").agg(
        F.min(F.struct("time_bucket", -F.col("normalized_share"))).alias("first")
    ).select("subject", F.col("first.time_bucket").alias("first_bucket"))


def inside_range(label: Column, anchor: Column, unit: str, span_hours: int) -> Column:
    """Buckets that start in the span ending at the anchor, the anchor's own included."""
    at, end = buckets.bucket_start(label, unit), buckets.bucket_start(anchor, unit)
    back = buckets.hours_between(end, at)
    return (back >= 0) & (back < span_hours)


def before_anchor(label: Column, anchor: Column, unit: Column, span_hours: int) -> Column:
    """Buckets that start in the span before the anchor's bucket; the anchor's is left out."""
    at = buckets.bucket_start_any(label, unit)
    end = buckets.bucket_start_any(anchor, unit)
    back = buckets.hours_between(end, at)
    return (back > 0) & (back <= span_hours)


# -- ranks ------------------------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first ``limit`` rows with their place; the numbering sees only those rows."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint"))


def share_order() -> list[Column]:
    return [F.col("normalized_share").desc(), F.col("subject")]


def top_per_axis(rows: DataFrame, limit: int) -> DataFrame:
    """Leading subjects of each axis; rows past ``limit`` go before the shuffle."""
    window = W.partitionBy("axis").orderBy(*share_order())
    return rows.withColumn("rank", F.row_number().over(window).cast("bigint")).filter(
        F.col("rank") <= limit
    )


def with_raw_rank(top: DataFrame, everyone: DataFrame, keys: list[str]) -> DataFrame:
    """The place each listed subject would have by raw count among all subjects.

    A place is one more than the number of subjects ahead, so the few listed rows meet the
    others in a join and only counts are shuffled; nobody else is ranked.
    """
    listed = top.select(
        *keys, F.col("subject").alias("listed"), F.col("raw_count").alias("listed_raw")
    )
    ahead = (F.col("raw_count") > F.col("listed_raw")) | (
        (F.col("raw_count") == F.col("listed_raw")) & (F.col("subject") < F.col("listed"))
    )
    places = (
        everyone.select(*keys, "subject", "raw_count")
        .join(listed, keys)
        .groupBy(*keys, "listed")
        .agg((F.count_if(ahead) + 1).alias("raw_rank"))
        .withColumnRenamed("listed", "subject")
    )
    return top.join(places, [*keys, "subject"])


def fixed_axes(spark) -> DataFrame:
    """The three axes, in their order; a screen shows each whether or not it has rows."""
    return spark.createDataFrame([(n, a) for n, a in enumerate(V.AXES)], "place int, axis string")
