"""Tone per axis and bucket, and how much of a window was labelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import numeric
from pressgauge.functions import vocabulary as V
from pressgauge.operators import shares
from pressgauge.operators.picks import BUCKET_KEYS

_KINDS = (*V.SENTIMENTS, "unanalyzed")


def _with_all(counted: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Pool the axes into ALL. The grouping sets run on the per-axis counts, not on picks."""
    rest = [k for k in keys if k != "axis"]
    every = [F.col(k) for k in keys]
    pooled = counted.groupingSets(
        [every, [F.col(k) for k in rest]], *every
    ).agg(*[F.sum(s).alias(s) for s in sums])
    return pooled.withColumn("axis", F.coalesce("axis", F.lit(V.ALL_AXIS)))


def tone_counts(picks: DataFrame, keys: list[str]) -> DataFrame:
    counted = picks.groupBy(*keys).agg(
        *[F.count_if(F.col("sentiment") == kind).alias(kind) for kind in _KINDS],
        F.count("*").alias("total"),
    )
    return _with_all(counted, keys, [*_KINDS, "total"])


def axis_sentiment(picks: DataFrame) -> DataFrame:
    """Tones over the labelled picks; the unlabelled share over all picks."""
    counted = tone_counts(picks, ["axis", "bucket_unit", "time_bucket"])
    labelled = F.col("total") - F.col("unanalyzed")
    base = F.greatest(labelled, F.lit(1))
    ratios = {f"{s}_ratio": F.col(s) / base for s in V.SENTIMENTS}
    ratios["unanalyzed_ratio"] = F.col("unanalyzed") / F.col("total")
    return counted.withColumns(ratios).select(
        "axis",
        "bucket_unit",
        "time_bucket",
        F.struct(
            *[numeric.round4(F.col(f"{kind}_ratio")).alias(kind) for kind in _KINDS]
        ).alias("distribution"),
        labelled.alias("analyzed_total"),
    )


def axis_window(window_picks: DataFrame) -> DataFrame:
    keys = ["axis", "range", "period", "window_start", "window_end"]
    counted = window_picks.groupBy(*keys).agg(
        F.count("*").alias("collected"),
        F.count_if(F.col("sentiment") != "unanalyzed").alias("analyzed_total"),
    )
    return _with_all(counted, keys, ["collected", "analyzed_total"]).select(
        *keys, "collected", "analyzed_total"
    )


# -- extensions: tone by subject and by source ------------------------------------------------


def subject_tone(picks: DataFrame, keys: list[str] = BUCKET_KEYS) -> DataFrame:
    """Tone counts of each subject: an article counts under every subject it has."""
    rows = picks.select(*keys, F.explode("keys").alias("subject"), "sentiment")
    return rows.groupBy(*keys, "subject").agg(
        *[F.count_if(F.col("sentiment") == kind).alias(kind) for kind in _KINDS]
    )


def weighted_tone(picks: DataFrame, keys: list[str] = BUCKET_KEYS) -> DataFrame:
    """Tone shares weighted by source as subject shares are; ALL is the mean of the axes."""
    labelled = picks.filter(F.col("sentiment") != "unanalyzed").withColumn(
        "keys", F.array("sentiment")
    )
    return shares.subject_shares(labelled, keys).withColumnRenamed("subject", "sentiment")


def articles_by_tone(
    picks: DataFrame, axis: str, unit: str, bucket: str, subject: str, sentiment: str
) -> DataFrame:
    """The picks behind a subject's value, narrowed to one tone; newest first."""
    return (
        picks.filter(
            (F.col("axis") == axis)
            & (F.col("bucket_unit") == unit)
            & (F.col("time_bucket") == bucket)
            & F.array_contains("keys", subject)
            & (F.col("sentiment") == sentiment)
        )
        .select("record_id", "source_id", "collected_at")
        .orderBy(F.col("collected_at").desc(), "record_id")
    )
