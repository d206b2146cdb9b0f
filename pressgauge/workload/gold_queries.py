"""Registered queries over the Gold folds: sections A, W, J, U, P of the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.operators import contributions, picks, shares, tone
from pressgauge.plans import gold
from pressgauge.session import staged
from pressgauge.workload import tables
from pressgauge.workload.oracle import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **extra: str):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(oracle, extra)
        return fn

    return register


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return gold.labelled_observations(
        tables.observations(spark, sf), tables.analyses(spark, sf)
    )


def hours(spark: SparkSession, sf: str) -> DataFrame:
    """Written once: the window anchor and the windows both read them."""
    return staged(picks.hour_picks(labelled(spark, sf)), "hour-picks")


def every_pick(spark: SparkSession, sf: str) -> DataFrame:
    return picks.unit_picks(labelled(spark, sf))


def joined(column: str) -> F.Column:
    return F.concat_ws(",", column).alias(column)


def spark_units(column: str = "spark"):
    """Lists of doubles are compared as text of whole ten-thousandths."""
    return F.concat_ws(
        ",", F.transform(column, lambda x: F.round(x * 10000).cast("bigint").cast("string"))
    ).alias(column)


TREND = (
    "SELECT subject, axis, bucket_unit, time_bucket, raw_count, normalized_share, delta, "
    "array_to_string(spark_units, ',') AS spark FROM trend"
)


@query("a2_a3_w5_w6_subject_trend", TREND)
def subject_trend(spark: SparkSession, sf: str) -> DataFrame:
    return shares.subject_trend(every_pick(spark, sf)).withColumn("spark", spark_units())


@query(
    "a7_w7_source_contribution",
    "SELECT subject, axis, bucket_unit, time_bucket, source_id, raw_count, raw_share, "
    "normalized_contribution FROM contrib",
)
def source_contribution(spark: SparkSession, sf: str) -> DataFrame:
    return contributions.source_contributions(every_pick(spark, sf))


@query(
    "a4_axis_sentiment",
    "SELECT axis, bucket_unit, time_bucket, positive, neutral, negative, mixed, unanalyzed, "
    "analyzed_total FROM axis_sentiment",
)
def axis_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return tone.axis_sentiment(every_pick(spark, sf)).select(
        "axis", "bucket_unit", "time_bucket", "distribution.*", "analyzed_total"
    )


@query(
    "a5_axis_window",
    "SELECT axis, range, period, window_start, window_end, collected, analyzed_total "
    "FROM axis_window",
)
def axis_window(spark: SparkSession, sf: str) -> DataFrame:
    return tone.axis_window(picks.window_picks(hours(spark, sf)))


@query(
    "a6_subject_window",
    "SELECT subject, axis, range, period, window_start, window_end, raw_count, "
    "normalized_share FROM subject_window",
)
def subject_window(spark: SparkSession, sf: str) -> DataFrame:
    return shares.subject_window(staged(picks.window_picks(hours(spark, sf)), "window-picks"))


@query(
    "w1_p7_article_pick",
    "SELECT axis, bucket_unit, time_bucket, record_id, source_id, collected_at, "
    "array_to_string(keys, ',') AS counted_subjects FROM picks WHERE len(keys) > 0",
)
def article_pick(spark: SparkSession, sf: str) -> DataFrame:
    return picks.article_picks(every_pick(spark, sf)).withColumn(
        "counted_subjects", joined("counted_subjects")
    )


@query(
    "j12_w2_t3_window_pick",
    "SELECT axis, range, period, article, record_id, source_id, sentiment, window_start, "
    "window_end FROM wpicks",
)
def window_pick(spark: SparkSession, sf: str) -> DataFrame:
    return picks.window_picks(hours(spark, sf)).drop("keys", "collected_at")
