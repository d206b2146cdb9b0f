"""Registered queries that read a published Gold: slices, ranks and the screens' questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions import numeric
from pressgauge.operators import records, slices
from pressgauge.plans import gold, screens
from pressgauge.session import scratch_path
from pressgauge.sources.lake import Lake
from pressgauge.workload import tables
from pressgauge.workload.gold_queries import spark_units
from pressgauge.workload.oracle import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_BUILT: dict[tuple[str, str], gold.Gold] = {}


def query(name: str, oracle: str | None = None, **extra: str):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(oracle, extra)
        return fn

    return register


def published(spark: SparkSession, sf: str) -> gold.Gold:
    """Gold of these tables, built and published once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        lake = Lake(spark, scratch_path(spark, "lake"))
        built = gold.aggregate(tables.observations(spark, sf), tables.analyses(spark, sf))
        _BUILT[key] = gold.publish(lake, built)
    return _BUILT[key]


# -- slices and ranks -------------------------------------------------------------------------


@query(
    "p5_s15_gold_slice",
    "SELECT subject, axis, time_bucket, raw_count, normalized_share FROM trend "
    "WHERE bucket_unit = 'day' AND axis = 'US' "
    "AND time_bucket IN ('2024-01-05', '2024-01-06') AND subject IN ('click', 'view', 'big')",
)
def gold_slice(spark: SparkSession, sf: str) -> DataFrame:
    return slices.trend_slice(
        published(spark, sf).subject_trend,
        "day", "US", ["2024-01-05", "2024-01-06"], ["click", "view", "big"],
    ).select("subject", "axis", "time_bucket", "raw_count", "normalized_share")


@query(
    "l11_units_and_latest_buckets",
    "SELECT axis, bucket_unit, max(time_bucket) AS latest, count(DISTINCT time_bucket) AS buckets "
    "FROM trend GROUP BY axis, bucket_unit",
)
def units_and_latest(spark: SparkSession, sf: str) -> DataFrame:
    return (
        published(spark, sf)
        .subject_trend.groupBy("axis", "bucket_unit")
        .agg(
            F.max("time_bucket").alias("latest"),
            F.count_distinct("time_bucket").alias("buckets"),
        )
    )


@query(
    "l11_distinct_buckets",
    "SELECT DISTINCT time_bucket FROM trend WHERE axis = 'KR' AND bucket_unit = 'week'",
)
def distinct_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return slices.distinct_buckets(
        slices.trend_slice(published(spark, sf).subject_trend, "week", "KR")
    )


@query(
    "l11_subjects_in_order",
    "SELECT subject, min(time_bucket) AS first_bucket FROM trend "
    "WHERE axis = 'KR' AND bucket_unit = 'day' GROUP BY subject",
)
def subjects_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return slices.subjects_in_order(
        slices.trend_slice(published(spark, sf).subject_trend, "day", "KR")
    )


@query(
    "p9_baseline_buckets",
    "SELECT DISTINCT time_bucket FROM trend, w_anchor WHERE axis = 'KR' AND bucket_unit = 'week' "
    "AND strptime(time_bucket || '-1', '%G-W%V-%u') < at_week "
    "AND strptime(time_bucket || '-1', '%G-W%V-%u') >= at_week - INTERVAL 7 DAY",
    w_anchor="SELECT max(strptime(time_bucket || '-1', '%G-W%V-%u')) AS at_week FROM trend "
    "WHERE axis = 'KR' AND bucket_unit = 'week'",
)
def baseline_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = slices.trend_slice(published(spark, sf).subject_trend, "week", "KR")
    before = slices.before_anchor(
        F.col("time_bucket"), slices.latest_bucket(rows), F.col("bucket_unit"), 7 * 24
    )
    return rows.filter(before).select("time_bucket").distinct()


@query(
    "w8_l4_top_subjects_per_axis",
    "SELECT axis, rank, subject, normalized_share FROM (SELECT *, row_number() OVER ("
    "PARTITION BY axis ORDER BY normalized_share DESC, subject) AS rank FROM trend "
    "WHERE bucket_unit = 'week' AND time_bucket = '2024-W03') WHERE rank <= 5",
)
def top_per_axis(spark: SparkSession, sf: str) -> DataFrame:
    rows = slices.trend_slice(published(spark, sf).subject_trend, "week", times=["2024-W03"])
    return slices.top_per_axis(rows, 5).select("axis", "rank", "subject", "normalized_share")


@query(
    "a25_mean_share",
    "SELECT axis, subject, CAST(sum(units) AS BIGINT) AS unit_sum, count(*) AS points, "
    "sum(units)::DOUBLE / count(*)::DOUBLE / 10000.0::DOUBLE AS mean_share "
    "FROM trend WHERE bucket_unit = 'day' GROUP BY axis, subject",
)
def mean_share(spark: SparkSession, sf: str) -> DataFrame:
    share_units = F.round(F.col("normalized_share") * numeric.GRID).cast("bigint")
    return (
        slices.trend_slice(published(spark, sf).subject_trend, "day")
        .groupBy("axis", "subject")
        .agg(F.sum(share_units).alias("unit_sum"), F.count("*").alias("points"))
        .withColumn("mean_share", F.col("unit_sum") / F.col("points") / 10000.0)
    )


# -- dashboard --------------------------------------------------------------------------------

_STARTS = {
    "hour": "strptime({}, '%Y-%m-%dT%H')",
    "day": "strptime({}, '%Y-%m-%d')",
    "week": "strptime({} || '-1', '%G-W%V-%u')",
}


def _dash(axis: str, range_name: str, unit: str, hours: int) -> dict[str, str]:
    begins, ends = _STARTS[unit].format("time_bucket"), _STARTS[unit].format("bucket")
    own = f"FROM subject_window WHERE axis = '{axis}' AND range = '{range_name}'"
    return {
        "day_anchor": f"SELECT max(time_bucket) AS bucket FROM trend WHERE bucket_unit = '{unit}'",
        "day_window": "SELECT DISTINCT time_bucket FROM (SELECT axis, bucket_unit, time_bucket "
        "FROM trend UNION ALL SELECT axis, bucket_unit, time_bucket FROM axis_sentiment), "
        f"day_anchor WHERE bucket_unit = '{unit}' AND axis = '{axis}' AND {begins} > "
        f"{ends} - INTERVAL {hours} HOUR AND {begins} <= {ends}",
        "cur": "SELECT *, row_number() OVER (ORDER BY normalized_share DESC, raw_count DESC, "
        "subject) AS rank, row_number() OVER (ORDER BY raw_count DESC, subject) AS raw_rank "
        f"{own} AND period = 'current'",
        "prev": f"SELECT subject, normalized_share AS share_before {own} AND period = 'previous'",
        "gridded": "SELECT c.subject, w.time_bucket, coalesce(t.units, 0) AS u FROM cur c "
        f"CROSS JOIN day_window w LEFT JOIN trend t ON t.axis = '{axis}' "
        f"AND t.bucket_unit = '{unit}' AND t.subject = c.subject "
        "AND t.time_bucket = w.time_bucket WHERE c.rank <= 8",
        "lines": "SELECT subject, string_agg(CAST(u AS VARCHAR), ',' ORDER BY time_bucket) "
        "AS spark FROM gridded GROUP BY subject",
    }


_DASH = _dash("KR", "7d", "day", 7 * 24)
_MOVED = (
    "(normalized_share - coalesce(share_before, 0.0::DOUBLE)) * 1000.0::DOUBLE"
)


def _signed_round(x: str, scale: str) -> str:
    return f"sign({x}) * floor(abs({x}) + 0.5::DOUBLE) / {scale}"


@query(
    "q1_l2_w9_j15_dashboard_top",
    "SELECT rank, subject, normalized_share, raw_count, raw_rank, spark, "
    f"{_signed_round(_MOVED, '10.0::DOUBLE')} AS delta, share_before IS NULL AS is_new, "
    "abs(rank - raw_rank) >= 2 AS rank_shift "
    "FROM cur LEFT JOIN prev USING (subject) JOIN lines USING (subject) WHERE rank <= 8",
    **_DASH,
)
def dashboard_top(spark: SparkSession, sf: str) -> DataFrame:
    board = screens.Dashboard(published(spark, sf), "KR", "7d", "day")
    return board.top_subjects().withColumn("spark", spark_units())


@query(
    "q1_dashboard_top_all_axes_by_week",
    "SELECT rank, subject, normalized_share, raw_count, raw_rank, spark, 0.0::DOUBLE AS delta, "
    "false AS is_new, abs(rank - raw_rank) >= 2 AS rank_shift "
    "FROM cur JOIN lines USING (subject) WHERE rank <= 8",
    **_dash("ALL", "30d", "week", 30 * 24),
)
def dashboard_all(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty days are all there is, so there is no window before to compare with."""
    board = screens.Dashboard(published(spark, sf), "ALL", "30d", "week")
    return board.top_subjects().withColumn("spark", spark_units())


@query(
    "q1_dashboard_top_by_hour",
    "SELECT rank, subject, normalized_share, raw_count, raw_rank, spark, "
    f"{_signed_round(_MOVED, '10.0::DOUBLE')} AS delta, share_before IS NULL AS is_new, "
    "abs(rank - raw_rank) >= 2 AS rank_shift "
    "FROM cur LEFT JOIN prev USING (subject) JOIN lines USING (subject) WHERE rank <= 8",
    **_dash("GLOBAL", "24h", "hour", 24),
)
def dashboard_hours(spark: SparkSession, sf: str) -> DataFrame:
    """A day is as long as the range, so the screen falls back to hours."""
    board = screens.Dashboard(published(spark, sf), "GLOBAL", "24h", "day")
    return board.top_subjects().withColumn("spark", spark_units())


@query(
    "p10_dashboard_movers",
    "SELECT subject, " + _signed_round(_MOVED, "10.0::DOUBLE") + " AS delta "
    "FROM cur LEFT JOIN prev USING (subject) WHERE rank <= 8 "
    "AND abs(" + _signed_round(_MOVED, "10.0::DOUBLE") + ") >= 0.1",
    **_DASH,
)
def dashboard_movers(spark: SparkSession, sf: str) -> DataFrame:
    board = screens.Dashboard(published(spark, sf), "KR", "7d", "day")
    return board.movers(0.1).select("subject", "delta")


_COVER = "(analyzed::DOUBLE / collected::DOUBLE)"


@query(
    "q1_a23_dashboard_summary",
    "SELECT window_start, window_end, collected, collected_prev, analyzed, "
    f"{_signed_round(_COVER + ' * 10000.0::DOUBLE', '10000.0::DOUBLE')} AS coverage, "
    f"{_signed_round('(1 - ' + _COVER + ') * 10000.0::DOUBLE', '10000.0::DOUBLE')} "
    "AS low_confidence, (collected - collected_prev)::DOUBLE / collected_prev::DOUBLE * 100 "
    "AS collected_change FROM counts",
    counts="SELECT max(window_start) FILTER (period = 'current') AS window_start, "
    "max(window_end) FILTER (period = 'current') AS window_end, "
    "max(collected) FILTER (period = 'current') AS collected, "
    "max(collected) FILTER (period = 'previous') AS collected_prev, "
    "max(analyzed_total) FILTER (period = 'current') AS analyzed "
    "FROM axis_window WHERE axis = 'ALL' AND range = '7d'",
)
def dashboard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return screens.Dashboard(published(spark, sf), "ALL", "7d", "day").summary()


@query(
    "q1_p11_dashboard_basis",
    "SELECT 'KR' AS axis, '7d' AS range, 'day' AS unit, bucket, bucket AS last_bucket, "
    "false AS empty_window, true AS has_baseline, "
    "(SELECT string_agg(time_bucket, ',' ORDER BY time_bucket) FROM day_window) AS buckets "
    "FROM day_anchor",
    **_DASH,
)
def dashboard_basis(spark: SparkSession, sf: str) -> DataFrame:
    board = screens.Dashboard(published(spark, sf), "KR", "7d", "day")
    return board.basis().withColumn("buckets", F.concat_ws(",", "buckets"))


# -- trend, comparison, tone ------------------------------------------------------------------

_TREND = {
    "own": "SELECT * FROM trend WHERE axis = 'US' AND bucket_unit = 'day'",
    "last_day": "SELECT max(time_bucket) AS latest FROM own",
    "heads": "SELECT subject, coalesce(max(normalized_share) FILTER (time_bucket = latest), "
    "0.0::DOUBLE) AS latest_share, coalesce(max(delta) FILTER (time_bucket = latest), "
    "0.0::DOUBLE) AS latest_delta FROM own, last_day GROUP BY subject",
    "kept": "SELECT *, row_number() OVER (ORDER BY subject = 'topic1' DESC, latest_share DESC, "
    "subject) AS place FROM heads",
}


@query(
    "q2_l5_trend",
    "SELECT o.subject, o.bucket_unit, o.time_bucket, o.normalized_share, o.raw_count, "
    "k.latest_share, k.latest_delta, k.place = 1 AS selected "
    "FROM own o JOIN kept k USING (subject) WHERE place <= 3",
    **_TREND,
)
def trend(spark: SparkSession, sf: str) -> DataFrame:
    return screens.trend(published(spark, sf), "US", "topic1", "day").drop("mean_share")


_HOUR = "SELECT max(time_bucket) AS latest FROM {} WHERE bucket_unit = 'hour'"
_LATEST_HOUR = (
    "SELECT max(latest) AS latest FROM (" + _HOUR.format("trend") + " UNION ALL "
    + _HOUR.format("axis_sentiment") + ")"
)
_TOP5 = (
    "SELECT axis, time_bucket, rank, subject, normalized_share, raw_count, delta FROM "
    "(SELECT *, row_number() OVER (PARTITION BY axis ORDER BY normalized_share DESC, subject) "
    "AS rank FROM trend, last_hour WHERE bucket_unit = 'hour' AND time_bucket = latest "
    "AND axis <> 'ALL') WHERE rank <= 5"
)
_COMPARE = {"last_hour": _LATEST_HOUR, "top5": _TOP5}
_FIXED = (
    "SELECT x.axis, s.axis IS NOT NULL AS present, coalesce(positive, 0.0::DOUBLE) AS positive, "
    "coalesce(neutral, 0.0::DOUBLE) AS neutral, coalesce(negative, 0.0::DOUBLE) AS negative, "
    "coalesce(mixed, 0.0::DOUBLE) AS mixed, coalesce(unanalyzed, 0.0::DOUBLE) AS unanalyzed, "
    "coalesce(analyzed_total, 0) AS analyzed_total "
    "FROM (VALUES ('KR'), ('US'), ('GLOBAL')) AS x(axis) LEFT JOIN "
    "(SELECT * FROM axis_sentiment, last_hour WHERE bucket_unit = 'hour' "
    "AND time_bucket = latest) s USING (axis)"
)


@query("q3_compare_top", "SELECT * FROM top5", **_COMPARE)
def compare_top(spark: SparkSession, sf: str) -> DataFrame:
    return screens.Comparison(published(spark, sf)).top_subjects()


@query("q3_j11_compare_tone", _FIXED, **_COMPARE)
def compare_tone(spark: SparkSession, sf: str) -> DataFrame:
    return screens.Comparison(published(spark, sf)).tone()


@query(
    "q3_a26_l10_axis_gaps",
    "SELECT *, row_number() OVER (ORDER BY score DESC, subject) AS rank FROM ("
    "SELECT subject, axes, gap, axes = live AS on_all, CASE WHEN axes = live THEN gap ELSE high "
    "END AS score, lead_axis FROM gaps, (SELECT count(DISTINCT axis) AS live FROM top5)) "
    "QUALIFY rank <= 6",
    gaps="SELECT subject, count(*) AS axes, max(normalized_share) AS high, "
    "max(normalized_share) - min(normalized_share) AS gap, "
    "arg_max(axis, normalized_share * 1000 - CASE axis WHEN 'KR' THEN 1 WHEN 'US' THEN 2 ELSE 3 "
    "END * 1e-6) AS lead_axis FROM top5 GROUP BY subject",
    **_COMPARE,
)
def axis_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return screens.Comparison(published(spark, sf)).gaps()


@query(
    "q4_w14_w15_a27_tone_series",
    "SELECT axis, time_bucket, positive, neutral, negative, mixed, unanalyzed, analyzed_total, "
    "CASE WHEN analyzed_total >= 20 AND lag(analyzed_total) OVER o >= 20 "
    "THEN (negative - lag(negative) OVER o) * 100 END AS negative_change, "
    "positive * (1 - unanalyzed) AS bar_positive, neutral * (1 - unanalyzed) AS bar_neutral, "
    "negative * (1 - unanalyzed) AS bar_negative, mixed * (1 - unanalyzed) AS bar_mixed, "
    "CASE WHEN unanalyzed < 1 THEN CAST(greatest(0, floor(analyzed_total / (1 - unanalyzed) + "
    "0.5::DOUBLE) - analyzed_total) AS BIGINT) END AS unanalyzed_count "
    "FROM axis_sentiment WHERE bucket_unit = 'hour' AND axis = 'KR' "
    "WINDOW o AS (ORDER BY time_bucket)",
)
def tone_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = screens.Tone(published(spark, sf), "KR").series()
    return rows.select("distribution.*", "*").drop("distribution")


@query("q4_j11_tone_by_axis", _FIXED, **_COMPARE)
def tone_by_axis(spark: SparkSession, sf: str) -> DataFrame:
    return screens.Tone(published(spark, sf), "KR").by_axis()


# -- one bucket -------------------------------------------------------------------------------


@query(
    "q5_a22_l3_fairness",
    "SELECT row_number() OVER (ORDER BY normalized_share DESC, subject) AS rank, subject, "
    "bucket_unit, time_bucket, raw_count, raw_count::DOUBLE / "
    "(sum(raw_count) OVER ())::DOUBLE AS raw_share, normalized_share, delta, "
    "array_to_string(spark_units, ',') AS spark FROM trend "
    "WHERE axis = 'GLOBAL' AND bucket_unit = 'week' AND time_bucket = '2024-W02' "
    "QUALIFY rank <= 20",
)
def fairness(spark: SparkSession, sf: str) -> DataFrame:
    rows = screens.fairness(published(spark, sf), "GLOBAL", "week", "2024-W02")
    return rows.withColumn("spark", spark_units())


_SPIKE = {
    "own": "SELECT *, strptime(time_bucket, '%Y-%m-%dT%H') AS begins FROM trend "
    "WHERE axis = 'KR' AND bucket_unit = 'hour'",
    "cut": "SELECT max(time_bucket) AS latest, max(begins) AS ends FROM own",
    "base": "SELECT own.* FROM own, cut WHERE begins < ends AND begins >= ends - INTERVAL 7 DAY",
    "base_n": "SELECT count(DISTINCT time_bucket)::DOUBLE AS buckets FROM base",
    "usual": "SELECT subject, sum(raw_count) AS raw_sum, sum(units) AS unit_sum FROM base "
    "GROUP BY subject",
    "measured": "SELECT o.subject, o.raw_count, o.normalized_share, "
    "coalesce(raw_sum, 0)::DOUBLE / buckets AS baseline_raw, "
    "coalesce(unit_sum, 0)::DOUBLE / 10000.0::DOUBLE / buckets AS baseline_share, "
    "coalesce(raw_sum, 0) = 0 AS is_new "
    "FROM own o JOIN cut ON o.time_bucket = cut.latest CROSS JOIN base_n "
    "LEFT JOIN usual u ON u.subject = o.subject",
    "multiples": "SELECT *, CASE WHEN baseline_raw > 0 THEN raw_count::DOUBLE / baseline_raw END "
    "AS raw_multiple, CASE WHEN baseline_share > 0 THEN normalized_share / baseline_share END "
    "AS normalized_multiple FROM measured",
}


@query(
    "q6_a21_spikes",
    "SELECT row_number() OVER (ORDER BY raw_multiple DESC NULLS LAST, raw_count DESC, subject) "
    "AS rank, subject, raw_count, normalized_share, baseline_raw, baseline_share, raw_multiple, "
    "normalized_multiple, is_new, coalesce(raw_multiple >= 1.5, false) AS spike, "
    "coalesce(raw_multiple >= 1.5 AND normalized_multiple < 1.5, false) AS normalized_away "
    "FROM multiples QUALIFY rank <= 20",
    **_SPIKE,
)
def spikes(spark: SparkSession, sf: str) -> DataFrame:
    return screens.spikes(published(spark, sf), "KR", "7d")


_BEHIND = {
    "here": "SELECT * FROM picks WHERE axis = 'KR' AND bucket_unit = 'week' "
    "AND time_bucket = '2024-W02' AND list_contains(keys, 'click')",
    "pieces": "SELECT * FROM contrib WHERE axis = 'KR' AND bucket_unit = 'week' "
    "AND time_bucket = '2024-W02' AND subject = 'click'",
    "listing": "SELECT h.record_id, h.source_id, coalesce(b.title, '') AS title, "
    "coalesce(b.source_url, '') AS source_url, h.collected_at, "
    "coalesce(b.body_hash, '') AS body_hash, coalesce(b.body_available, false) AS body_available, "
    "coalesce(s.shares, 0) > 1 AS body_duplicate, coalesce(s.shares, 0) AS body_shares "
    "FROM here h LEFT JOIN bronze b USING (record_id) LEFT JOIN body_share s USING (body_hash)",
}


def _behind(spark: SparkSession, sf: str) -> screens.Composition:
    return screens.Composition(published(spark, sf), "KR", "click", "week", "2024-W02")


@query("q7_j4_j7_l7_contributing_articles", "SELECT * FROM listing", **_BEHIND)
def contributing_articles(spark: SparkSession, sf: str) -> DataFrame:
    items = tables.observations(spark, sf)
    return _behind(spark, sf).articles(items, records.body_share(items))


@query("p10_duplicate_articles", "SELECT * FROM listing WHERE body_duplicate", **_BEHIND)
def duplicate_articles(spark: SparkSession, sf: str) -> DataFrame:
    items = tables.observations(spark, sf)
    return _behind(spark, sf).articles(items, records.body_share(items), duplicates_only=True)


@query(
    "q7_j16_a15_contributing_sources",
    "SELECT source_id, listed, coalesce(raw_share, 0.0::DOUBLE) AS raw_share, "
    "coalesce(normalized_contribution, 0.0::DOUBLE) AS normalized_contribution "
    "FROM (SELECT source_id, count(*) AS listed FROM here GROUP BY source_id) "
    "LEFT JOIN pieces USING (source_id)",
    **_BEHIND,
)
def contributing_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _behind(spark, sf).sources()


@query(
    "q8_l9_source_contributions",
    "SELECT source_id, raw_count, raw_share, normalized_contribution FROM pieces",
    **_BEHIND,
)
def source_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return _behind(spark, sf).contributions()


@query(
    "q8_a24_contribution_basis",
    "SELECT t.subject, t.axis, t.bucket_unit, t.time_bucket, t.raw_count, t.normalized_share, "
    "(SELECT CAST(sum(raw_count) AS BIGINT) FROM pieces) AS raw_total, "
    "(SELECT CAST(sum(part) AS BIGINT) / 10000.0::DOUBLE FROM parts WHERE axis = 'KR' "
    "AND bucket_unit = 'week' AND time_bucket = '2024-W02' AND subject = 'click') "
    "AS normalized_total, (SELECT count(*) FROM here) AS listed_total "
    "FROM trend t WHERE t.axis = 'KR' AND t.bucket_unit = 'week' "
    "AND t.time_bucket = '2024-W02' AND t.subject = 'click'",
    **_BEHIND,
)
def contribution_basis(spark: SparkSession, sf: str) -> DataFrame:
    return _behind(spark, sf).basis()


@query(
    "a16_concentration",
    "SELECT arg_min(source_id, (-raw_count, source_id)) AS top_source_id, "
    "arg_min(raw_share, (-raw_count, source_id)) AS top_share, count(*) AS source_count "
    "FROM pieces",
    **_BEHIND,
)
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    return _behind(spark, sf).concentration()
