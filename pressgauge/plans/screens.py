"""Questions over Gold: dashboard, trend, comparison, tone, fairness, spikes, composition.

Each function takes the Gold frames and plain parameters and returns DataFrames. What the data
decides (the latest bucket, the finest unit) stays a scalar subquery inside the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgauge.functions import buckets, numeric
from pressgauge.functions import vocabulary as V
from pressgauge.operators import records, slices
from pressgauge.operators.joins import left_join_present
from pressgauge.operators.picks import first_by
from pressgauge.plans.gold import Gold

TOP_DASHBOARD, TOP_FAIRNESS, TOP_SPIKES, TOP_AXIS, TOP_GAPS, SERIES = 8, 20, 20, 5, 6, 3
SPIKE_THRESHOLD = 1.5
RANK_SHIFT_NOTE = 2
MIN_SAMPLE = 20


# -- dashboard --------------------------------------------------------------------------------


class Dashboard:
    """Basis, summary and leading subjects of one axis over one range."""

    def __init__(
        self, gold: Gold, axis: str = "KR", range_name: str = "7d", unit: str = "day"
    ) -> None:
        self.axis = slices.axis_or_all(axis)
        self.range = slices.range_or(range_name)
        self.unit = slices.unit_within(unit, self.range)
        self.gold = gold
        trend = slices.trend_slice(gold.subject_trend, self.unit)
        tone = gold.axis_sentiment.filter(F.col("bucket_unit") == self.unit)
        self._buckets = trend.select("axis", "time_bucket").unionByName(
            tone.select("axis", "time_bucket")
        )
        own = self._buckets.filter(F.col("axis") == self.axis)
        self.anchor = slices.latest_bucket(self._buckets)
        self.last = slices.latest_bucket(own)
        inside = slices.inside_range(
            F.col("time_bucket"), self.anchor, self.unit, buckets.RANGES[self.range]
        )
        self.window = own.filter(inside).select("time_bucket").distinct()
        self._counts = gold.axis_window.filter(
            (F.col("axis") == self.axis) & (F.col("range") == self.range)
        )

    def _live(self) -> Column:
        """The axis took part in the latest collection."""
        return (self.anchor != "") & (self.last == self.anchor)

    def _window_list(self) -> Column:
        """At most one entry per hour of the range, so the list stays small."""
        return self.window.agg(
            F.array_sort(F.collect_set("time_bucket")).alias("buckets")
        ).scalar()

    def summary(self) -> DataFrame:
        """Collected and labelled now, collected before, and the coverage ratios."""
        now, before = F.col("period") == "current", F.col("period") == "previous"

        def pick(column: str, when: Column) -> Column:
            return F.max(F.when(when, F.col(column)))

        row = self._counts.agg(
            pick("window_start", now).alias("window_start"),
            pick("window_end", now).alias("window_end"),
            pick("collected", now).alias("collected"),
            pick("collected", before).alias("collected_prev"),
            pick("analyzed_total", now).alias("analyzed"),
        )
        coverage = F.col("analyzed") / F.col("collected")
        change = (F.col("collected") - F.col("collected_prev")) / F.col("collected_prev") * 100
        return row.filter((F.col("collected") > 0) & self._live()).select(
            "window_start",
            "window_end",
            "collected",
            "collected_prev",
            "analyzed",
            numeric.round4_away(coverage).alias("coverage"),
            numeric.round4_away(1 - coverage).alias("low_confidence"),
            F.when(F.col("collected_prev") > 0, change).alias("collected_change"),
        )

    def has_baseline(self) -> Column:
        return self._counts.agg(
            F.coalesce(
                F.max(F.when(F.col("period") == "previous", F.col("collected") > 0)), F.lit(False)
            ).alias("has_baseline")
        ).scalar()

    def basis(self) -> DataFrame:
        one = self.gold.axis_window.sparkSession.range(1)
        return one.select(
            F.lit(self.axis).alias("axis"),
            F.lit(self.range).alias("range"),
            F.lit(self.unit).alias("unit"),
            self.anchor.alias("bucket"),
            self.last.alias("last_bucket"),
            (~self._live()).alias("empty_window"),
            self.has_baseline().alias("has_baseline"),
            F.when(self._live(), self._window_list()).alias("buckets"),
        )

    def top_subjects(self) -> DataFrame:
        keys = ["axis", "range"]
        windows = self.gold.subject_window.filter(
            (F.col("axis") == self.axis) & (F.col("range") == self.range)
        )
        current = windows.filter("period = 'current'").filter(self._live())
        before = windows.filter("period = 'previous'").select(
            "subject", F.col("normalized_share").alias("share_before")
        )
        order = [F.col("normalized_share").desc(), F.col("raw_count").desc(), F.col("subject")]
        top = slices.numbered(
            current.select(*keys, "subject", "raw_count", "normalized_share"),
            order,
            TOP_DASHBOARD,
        )
        ranked = slices.with_raw_rank(top, current, keys)
        lines = (
            slices.trend_slice(self.gold.subject_trend, self.unit, self.axis)
            .join(self.window, "time_bucket", "left_semi")
            .join(top.select("subject"), "subject", "left_semi")
            .groupBy("subject")
            .agg(
                F.map_from_entries(
                    F.collect_list(F.struct("time_bucket", "normalized_share"))
                ).alias("line")
            )
        )
        seen = F.col("share_before").isNotNull()
        moved = numeric.round_pp1(
            F.col("normalized_share") - F.coalesce("share_before", F.lit(0.0))
        )
        with_base = self.has_baseline()
        return (
            ranked.join(before, "subject", "left")
            .join(lines, "subject", "left")
            .withColumn("window_list", self._window_list())
            .select(
                "rank",
                "subject",
                "normalized_share",
                "raw_count",
                "raw_rank",
                F.transform(
                    "window_list",
                    lambda b: F.coalesce(F.try_element_at("line", b), F.lit(0.0)),
                ).alias("spark"),
                F.when(with_base, moved).otherwise(0.0).alias("delta"),
                F.when(with_base, ~seen).otherwise(False).alias("is_new"),
                (F.abs(F.col("rank") - F.col("raw_rank")) >= RANK_SHIFT_NOTE).alias("rank_shift"),
            )
        )

    def movers(self, threshold: float, only_new: bool = False) -> DataFrame:
        """Listed subjects whose change reaches ``threshold`` points, where there is a baseline."""
        rows = self.top_subjects()
        if only_new:
            rows = rows.filter("is_new")
        return rows.filter(~self.has_baseline() | (F.abs("delta") >= threshold))


# -- trend ------------------------------------------------------------------------------------


def trend(gold: Gold, axis: str = "KR", subject: str = "", unit: str = "") -> DataFrame:
    """Points of at most three series: the requested one, then the leaders of the latest bucket.

    The finest unit of the axis is drawn unless the asked one has rows.
    """
    axis = slices.axis_or_all(axis)
    own = gold.subject_trend.filter(F.col("axis") == axis)
    drawn = slices.finest_unit(own)
    if slices.unit_or(unit):
        asked = own.filter(F.col("bucket_unit") == unit).select("bucket_unit").limit(1)
        drawn = F.coalesce(asked.scalar(), drawn)
    rows = own.filter(F.col("bucket_unit") == drawn)
    latest = slices.latest_bucket(rows)
    at_latest = F.col("time_bucket") == latest
    heads = rows.groupBy("subject").agg(
        F.coalesce(F.max(F.when(at_latest, F.col("normalized_share"))), F.lit(0.0)).alias(
            "latest_share"
        ),
        F.coalesce(F.max(F.when(at_latest, F.col("delta"))), F.lit(0.0)).alias("latest_delta"),
        # in whole grid units, so that the order of rows doesn't matter
        (F.sum(F.round(F.col("normalized_share") * 10000).cast("bigint")) / F.count("normalized_share") / 10000).alias("mean_share"),
    )
    wanted = (F.col("subject") == subject).cast("int")
    order = [wanted.desc(), F.col("latest_share").desc(), F.col("subject")]
    kept = slices.numbered(heads, order, SERIES, "place").withColumn(
        "selected", F.col("place") == 1
    )
    return rows.join(kept, "subject").select(
        "subject",
        "bucket_unit",
        "time_bucket",
        "normalized_share",
        "raw_count",
        "latest_share",
        "latest_delta",
        "mean_share",
        "selected",
    )


# -- comparison -------------------------------------------------------------------------------


class Comparison:
    """All axes at one bucket: the latest of the finest unit, for every axis alike."""

    def __init__(self, gold: Gold) -> None:
        self.gold = gold
        trend_rows, tone_rows = gold.subject_trend, gold.axis_sentiment
        unit = slices.finest_unit(trend_rows, tone_rows)
        self._trend = trend_rows.filter(F.col("bucket_unit") == unit)
        self._tone = tone_rows.filter(F.col("bucket_unit") == unit)
        self.bucket = slices.latest_bucket(self._trend, self._tone)

    def top_subjects(self) -> DataFrame:
        here = self._trend.filter(
            (F.col("time_bucket") == self.bucket) & F.col("axis").isin(*V.AXES)
        )
        return slices.top_per_axis(here, TOP_AXIS).select(
            "axis", "time_bucket", "rank", "subject", "normalized_share", "raw_count", "delta"
        )

    def tone(self) -> DataFrame:
        here = self._tone.filter(F.col("time_bucket") == self.bucket)
        return axis_columns(here)

    def gaps(self) -> DataFrame:
        """Subjects by how far the axes lie apart; one not on every live axis by its share."""
        top = self.top_subjects()
        live = top.agg(F.count_distinct("axis").alias("live")).scalar()
        leader = F.max(F.struct("normalized_share", (-_axis_place()).alias("place"), "axis"))
        high, low = F.max("normalized_share"), F.min("normalized_share")
        rows = top.groupBy("subject").agg(
            F.count("*").alias("axes"),
            high.alias("high"),
            (high - low).alias("gap"),
            leader.alias("leader"),
        )
        everywhere = F.col("axes") == live
        scored = rows.select(
            "subject",
            "axes",
            "gap",
            everywhere.alias("on_all"),
            F.when(everywhere, F.col("gap")).otherwise(F.col("high")).alias("score"),
            F.col("leader.axis").alias("lead_axis"),
        )
        return slices.numbered(scored, [F.col("score").desc(), F.col("subject")], TOP_GAPS)


def _axis_place() -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in V.AXES]), F.col("axis"))


def axis_columns(rows: DataFrame) -> DataFrame:
    """One row per axis whether or not ``rows`` has one; zeros and ``present`` tell which."""
    axes = slices.fixed_axes(rows.sparkSession)
    kinds = (*V.SENTIMENTS, "unanalyzed")
    return axes.join(
        rows.select("axis", "distribution", "analyzed_total"), "axis", "left"
    ).select(
        "axis",
        F.col("distribution").isNotNull().alias("present"),
        *[F.coalesce(F.col(f"distribution.{k}"), F.lit(0.0)).alias(k) for k in kinds],
        F.coalesce("analyzed_total", F.lit(0)).cast("bigint").alias("analyzed_total"),
    )


# -- tone -------------------------------------------------------------------------------------


class Tone:
    def __init__(self, gold: Gold, axis: str = "KR") -> None:
        self.axis = slices.axis_or(axis)
        unit = slices.finest_unit(gold.axis_sentiment)
        self._rows = gold.axis_sentiment.filter(F.col("bucket_unit") == unit)
        self.latest = slices.latest_bucket(self._rows)

    def series(self) -> DataFrame:
        """One point per bucket, with the change of the negative share where both are solid.

        Also the bar the screen draws (classes scaled to the labelled part) and the number of
        unlabelled articles, recovered from the ratio.
        """
        newest = [F.col("analyzed_total").desc(), F.col("distribution")]
        own = first_by(self._rows.filter(F.col("axis") == self.axis), ["time_bucket"], newest)
        line = W.partitionBy("axis").orderBy("time_bucket")
        before = F.lag(F.col("distribution.negative")).over(line)
        solid = (F.col("analyzed_total") >= MIN_SAMPLE) & (
            F.lag("analyzed_total").over(line) >= MIN_SAMPLE
        )
        labelled = 1 - F.col("distribution.unanalyzed")
        total = F.floor(F.col("analyzed_total") / labelled + 0.5)
        return own.select(
            "axis",
            "time_bucket",
            "distribution",
            "analyzed_total",
            F.when(solid, (F.col("distribution.negative") - before) * 100).alias("negative_change"),
            *[
                (F.col(f"distribution.{k}") * labelled).alias(f"bar_{k}")
                for k in V.SENTIMENTS
            ],
            F.when(labelled > 0, F.greatest(F.lit(0), total - F.col("analyzed_total"))).alias(
                "unanalyzed_count"
            ),
        )

    def by_axis(self) -> DataFrame:
        return axis_columns(self._rows.filter(F.col("time_bucket") == self.latest))


# -- one bucket of one axis -------------------------------------------------------------------


class BucketView:
    """One axis at one bucket: the asked one, else the latest of the asked or finest unit."""

    def __init__(self, gold: Gold, axis: str = "KR", unit: str = "", bucket: str = "") -> None:
        self.gold = gold
        self.axis = slices.axis_or(axis)
        own = gold.subject_trend.filter(F.col("axis") == self.axis)
        asked = slices.unit_or(unit)
        self.unit: str | Column = asked or slices.finest_unit(own)
        rows = own.filter(F.col("bucket_unit") == self.unit)
        self.bucket: str | Column = bucket or slices.latest_bucket(rows)
        self.rows = rows.filter(F.col("time_bucket") == self.bucket)

    def subject(self, requested: str = "") -> Column:
        """The requested subject as asked, else the leader; an unknown one is not replaced."""
        if requested:
            return F.lit(requested)
        return self.rows.orderBy(*slices.share_order()).limit(1).select("subject").scalar()

    def here(self, rows: DataFrame) -> DataFrame:
        return rows.filter(
            (F.col("axis") == self.axis)
            & (F.col("bucket_unit") == self.unit)
            & (F.col("time_bucket") == self.bucket)
        )


def fairness(gold: Gold, axis: str = "KR", unit: str = "", bucket: str = "") -> DataFrame:
    """Raw beside normalised shares; raw shares are of all subjects, not of the listed ones."""
    view = BucketView(gold, axis, unit, bucket)
    total = view.rows.agg(F.sum("raw_count").alias("raw_total")).scalar()
    top = slices.numbered(view.rows, slices.share_order(), TOP_FAIRNESS)
    return top.select(
        "rank",
        "subject",
        "bucket_unit",
        "time_bucket",
        "raw_count",
        F.coalesce(F.col("raw_count") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("raw_share"),
        "normalized_share",
        "delta",
        "spark",
    )


def spikes(gold: Gold, axis: str = "KR", baseline: str = "7d") -> DataFrame:
    """Subjects of the latest bucket against their mean over the baseline buckets.

    A bucket the subject is absent from counts as 0: sums are divided by the number of baseline
    buckets, not by the number of rows found.
    """
    axis = slices.axis_or_all(axis)
    baseline = baseline if baseline in ("7d", "30d") else "7d"
    own = gold.subject_trend.filter(F.col("axis") == axis)
    unit = slices.finest_unit(own)
    rows = own.filter(F.col("bucket_unit") == unit)
    current = slices.latest_bucket(rows)
    marked = rows.select(
        "subject",
        "time_bucket",
        "raw_count",
        "normalized_share",
        (F.col("time_bucket") == current).alias("is_now"),
        slices.before_anchor(
            F.col("time_bucket"), current, F.col("bucket_unit"), buckets.RANGES[baseline]
        ).alias("is_base"),
    )
    base = marked.filter("is_base")
    n = base.agg(F.count_distinct("time_bucket").alias("n")).scalar()
    share_units = F.round(F.col("normalized_share") * numeric.GRID).cast("bigint")
    folded = (
        marked.filter("is_now OR is_base")
        .groupBy("subject")
        .agg(
            F.max(F.when(F.col("is_now"), F.col("raw_count"))).alias("raw_count"),
            F.max(F.when(F.col("is_now"), F.col("normalized_share"))).alias("normalized_share"),
            F.coalesce(F.sum(F.when(F.col("is_base"), F.col("raw_count"))), F.lit(0)).alias(
                "raw_sum"
            ),
            F.coalesce(F.sum(F.when(F.col("is_base"), share_units)), F.lit(0)).alias("unit_sum"),
        )
        .filter(F.col("raw_count").isNotNull())
        .withColumn("n", n)
    )
    based = F.col("n") > 0
    usual_raw = F.when(based, F.col("raw_sum") / F.col("n")).otherwise(0.0)
    usual_share = F.when(based, numeric.from_units(F.col("unit_sum")) / F.col("n")).otherwise(0.0)
    measured = (
        folded.withColumn("baseline_raw", usual_raw)
        .withColumn("baseline_share", usual_share)
        .withColumn(
            "raw_multiple", numeric.ratio_or_null(F.col("raw_count"), F.col("baseline_raw"))
        )
        .withColumn(
            "normalized_multiple",
            numeric.ratio_or_null(F.col("normalized_share"), F.col("baseline_share")),
        )
    )
    spike = F.coalesce(F.col("raw_multiple") >= SPIKE_THRESHOLD, F.lit(False))
    away = spike & F.coalesce(F.col("normalized_multiple") < SPIKE_THRESHOLD, F.lit(False))
    order = [F.desc_nulls_last("raw_multiple"), F.col("raw_count").desc(), F.col("subject")]
    return slices.numbered(measured, order, TOP_SPIKES).select(
        "rank",
        "subject",
        "raw_count",
        "normalized_share",
        "baseline_raw",
        "baseline_share",
        "raw_multiple",
        "normalized_multiple",
        (based & (F.col("raw_sum") == 0)).alias("is_new"),
        spike.alias("spike"),
        away.alias("normalized_away"),
    )


# -- what is behind a value -------------------------------------------------------------------


class Composition:
    """The articles and sources behind one subject's value in one bucket."""

    def __init__(
        self,
        gold: Gold,
        axis: str = "KR",
        subject: str = "",
        unit: str = "",
        bucket: str = "",
    ) -> None:
        self.view = BucketView(gold, axis, unit, bucket)
        self.subject = self.view.subject(subject)
        self.parts = self.view.here(gold.subject_source_contribution).filter(
            F.col("subject") == self.subject
        )
        self.picks = self.view.here(gold.article_pick).filter(
            F.array_contains("counted_subjects", self.subject)
        )

    def articles(
        self,
        items: DataFrame,
        body_share: DataFrame,
        source: str = "",
        duplicates_only: bool = False,
    ) -> DataFrame:
        """The picks themselves, newest first, with how many articles carry the same text."""
        listed = self.picks.select("record_id", "source_id", "collected_at")
        if source:
            listed = listed.filter(F.col("source_id") == source)
        behind = items.join(listed.select("record_id"), "record_id", "left_semi")
        seen = records.latest_observation(
            behind.select(
                "record_id", "source_id", "title", "source_url", "body_hash", "body_available",
                "collected_at",
            )
        ).drop("source_id", "collected_at")
        rows = (
            left_join_present(listed.join(seen, "record_id", "left"), body_share, "body_hash")
            .select(
                "record_id",
                "source_id",
                F.coalesce("title", F.lit("")).alias("title"),
                F.coalesce("source_url", F.lit("")).alias("source_url"),
                "collected_at",
                F.coalesce("body_hash", F.lit("")).alias("body_hash"),
                F.coalesce("body_available", F.lit(False)).alias("body_available"),
                (F.coalesce("shares", F.lit(0)) > 1).alias("body_duplicate"),
                F.coalesce("shares", F.lit(0)).cast("bigint").alias("body_shares"),
            )
        )
        if duplicates_only:
            rows = rows.filter("body_duplicate")
        return rows.orderBy(F.col("collected_at").desc(), "record_id")

    def sources(self) -> DataFrame:
        """Listed articles per source beside Gold's own decomposition; the list decides who."""
        tally = self.picks.groupBy("source_id").agg(F.count("*").alias("listed"))
        weights = self.parts.select("source_id", "raw_share", "normalized_contribution")
        return (
            tally.join(weights, "source_id", "left")
            .select(
                "source_id",
                "listed",
                F.coalesce("raw_share", F.lit(0.0)).alias("raw_share"),
                F.coalesce("normalized_contribution", F.lit(0.0)).alias("normalized_contribution"),
            )
            .orderBy(F.col("listed").desc(), "source_id")
        )

    def contributions(self) -> DataFrame:
        return self.parts.select(
            "source_id", "raw_count", "raw_share", "normalized_contribution"
        ).orderBy(F.col("raw_count").desc(), "source_id")

    def concentration(self) -> DataFrame:
        """The source with the most mentions (ties: the lower id), its share, and how many."""
        lead = F.min(F.struct((-F.col("raw_count")).alias("r"), "source_id", "raw_share"))
        return self.parts.agg(lead.alias("lead"), F.count("*").alias("source_count")).select(
            F.coalesce("lead.source_id", F.lit("")).alias("top_source_id"),
            F.coalesce("lead.raw_share", F.lit(0.0)).alias("top_share"),
            "source_count",
        )

    def basis(self) -> DataFrame:
        """The published value beside the sums of its parts, which must equal it."""
        value = self.view.rows.filter(F.col("subject") == self.subject).select(
            "subject", "axis", "bucket_unit", "time_bucket", "raw_count", "normalized_share"
        )
        units = F.sum(F.round(F.col("normalized_contribution") * numeric.GRID).cast("bigint"))
        sums = self.parts.agg(
            F.sum("raw_count").alias("raw_total"), numeric.from_units(units).alias("total")
        )
        total = self.picks.agg(F.count("*").alias("total")).scalar()
        return value.select(
            "*",
            sums.select("raw_total").scalar().alias("raw_total"),
            sums.select("total").scalar().alias("normalized_total"),
            total.alias("listed_total"),
        )
