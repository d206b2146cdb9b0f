"""Sizing a relabelling run: which records, how far along, and what would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import buckets, identity
from pressgauge.functions.vocabulary import AXES
from pressgauge.operators.picks import first_by

MAX_SAMPLE = 500
MAX_BATCH = 1000


def in_scope(
    items: DataFrame, axis: str = "", source: str = "", since: Column | str | None = None
) -> DataFrame:
    """Observations of one axis and source collected at or after an instant.

    Two time tests: the text bound, which a scan can push down, keeps everything from three days
    earlier (an offset shifts a date by two days at most); the exact one reads the instant.
    """
    out = items
    if axis:
        out = out.filter(F.col("axis") == axis)
    if source:
        out = out.filter(F.col("source_id") == source)
    if since is not None:
        bound = F.lit(since).cast("timestamp") if isinstance(since, str) else since
        day = F.date_format(F.date_sub(bound.cast("date"), 3), "yyyy-MM-dd")
        if {"year", "month", "day"} <= set(items.columns):  # a cycle's partition: its files needn't be opened
            out = out.filter(F.concat_ws("-", "year", "month", "day") >= day)
        out = out.filter(F.col("collected_at") >= day).filter(
            buckets.at_or_after(F.col("collected_at"), bound)
        )
    return out


def sample(rows: DataFrame, size: int, mode: str = "random", seed: str = "") -> DataFrame:
    """At most ``size`` records: the newest, or a draw that is the same on every cluster.

    The draw orders records by a seeded hash, so it does not depend on partitioning.
    """
    if size <= 0:
        return rows
    if mode == "recent":
        return rows.orderBy(F.col("collected_at").desc(), "record_id").limit(size)
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("record_id"))), "record_id").limit(size)


def checked_run(
    range_name: str,
    axis: str,
    version: str,
    sample_size: int = 0,
    sample_mode: str = "random",
    batch_size: int = 100,
) -> dict:
    """Validated parameters of a relabelling run."""
    if range_name not in buckets.RANGES:
        raise ValueError(f"range is one of {tuple(buckets.RANGES)}")
    if axis not in AXES:
        raise ValueError(f"axis is one of {AXES}")
    if not version.strip():
        raise ValueError("a run names the version it stamps")
    if not 0 <= sample_size <= MAX_SAMPLE:
        raise ValueError(f"sample_size is at most {MAX_SAMPLE}")
    if sample_mode not in ("random", "recent"):
        raise ValueError("sample_mode is random or recent")
    if not 1 <= batch_size <= MAX_BATCH:
        raise ValueError(f"batch_size is 1 to {MAX_BATCH}")
    return {
        "range": range_name,
        "axis": axis,
        "version": version.strip(),
        "sample_size": sample_size,
        "sample_mode": sample_mode,
        "batch_size": batch_size,
    }


def window_analyses(silver: DataFrame, scope: DataFrame) -> DataFrame:
    """Every analysis of the scoped records, once each however often a record was observed."""
    return silver.join(scope.select("record_id").distinct(), "record_id", "left_semi")


def window_sources(scope: DataFrame) -> DataFrame:
    return scope.groupBy("source_id").agg(F.count("*").alias("kept")).orderBy("source_id")


def window_versions(analyses: DataFrame) -> DataFrame:
    return (
        analyses.groupBy("analyzer_version")
        .agg(
            F.count("*").alias("records"),
            F.min("analyzed_at").alias("first_analyzed_at"),
            F.max("analyzed_at").alias("last_analyzed_at"),
        )
        .orderBy("last_analyzed_at", "analyzer_version")
    )


def latest_version(versions: DataFrame) -> Column:
    """The version stamped last: the default target of a run."""
    return versions.agg(
        F.max_by("analyzer_version", F.struct("last_analyzed_at", "analyzer_version")).alias("v")
    ).scalar()


def cycle_progress(scope: DataFrame, silver: DataFrame, target: str | Column) -> DataFrame:
    """Per cycle: observations kept, those whose record carries the target version, and the rest."""
    done = (
        silver.filter(F.col("analyzer_version") == target)
        .select("record_id")
        .distinct()
        .withColumn("done", F.lit(1))
    )
    return (
        scope.select("record_id", "collection_cycle")
        .join(done, "record_id", "left")
        .groupBy("collection_cycle")
        .agg(F.count("*").alias("kept"), F.count("done").alias("done"))
        .withColumn("todo", F.col("kept") - F.col("done"))
        .orderBy("collection_cycle")
    )


def progress_totals(cycles: DataFrame) -> DataFrame:
    return cycles.agg(
        F.coalesce(F.sum("kept"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("done"), F.lit(0)).alias("already"),
        F.coalesce(F.sum("todo"), F.lit(0)).alias("todo"),
    )


def throughput(analyses: DataFrame, target: str | Column, todo: Column) -> DataFrame:
    """Records per minute at the target version, and the minutes the rest would take.

    Null unless at least two readable times span a positive interval.
    """
    at = buckets.instant(F.col("analyzed_at"))
    seen = analyses.filter(F.col("analyzer_version") == target).select(at.alias("at"))
    spread = seen.filter(F.col("at").isNotNull()).agg(
        F.count("*").alias("n"),
        (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))).alias("micros"),
    )
    rate = F.when(
        (F.col("n") >= 2) & (F.col("micros") > 0), F.col("n") / (F.col("micros") / 60_000_000.0)
    )
    return spread.select(rate.alias("per_minute")).select(
        "per_minute", F.ceil(todo / F.col("per_minute")).cast("double").alias("eta_minutes")
    )


def mention_shares(analyses: DataFrame, versions: list[str | Column]) -> DataFrame:
    """Raw share of each subject among all mentions of a version; a record counts once each."""
    wanted = [F.lit(v) if isinstance(v, str) else v for v in versions]
    rows = first_by(
        analyses.filter(F.col("analyzer_version").isin(*wanted)),
        ["record_id", "analyzer_version"],
        [F.col("analyzed_at"), F.col("run_id")],
    )
    keys = identity.grouping_keys(F.col("subject_categories"), F.col("narrative_subjects"))
    counted = (
        rows.select("analyzer_version", F.explode(keys).alias("subject"))
        .groupBy("analyzer_version", "subject")
        .agg(F.count("*").alias("mentions"))
    )
    totals = counted.groupBy("analyzer_version").agg(F.sum("mentions").alias("total"))
    return counted.join(totals, "analyzer_version").select(
        "analyzer_version", "subject", "mentions", (F.col("mentions") / F.col("total")).alias("share")
    )


def unanalyzed_share(analyses: DataFrame) -> DataFrame:
    """Share of a version's records it did not classify for certain: any status but analyzed."""
    once = first_by(
        analyses.select("record_id", "analyzer_version", "analysis_status", "analyzed_at", "run_id"),
        ["record_id", "analyzer_version"],
        [F.col("analyzed_at"), F.col("run_id")],
    )
    return once.groupBy("analyzer_version").agg(
        F.count("*").alias("records"),
        (F.count_if(F.col("analysis_status") != "analyzed") / F.count("*")).alias(
            "unanalyzed_share"
        ),
    )


def compare_versions(
    analyses: DataFrame, before: str | Column, after: str | Column
) -> DataFrame:
    """Subjects of either version side by side, the largest change first."""
    shares = mention_shares(analyses, [before, after])
    old = shares.filter(F.col("analyzer_version") == before).select(
        "subject", F.col("share").alias("before_share")
    )
    new = shares.filter(F.col("analyzer_version") == after).select(
        "subject", F.col("share").alias("after_share")
    )
    return (
        old.join(new, "subject", "full_outer")
        .select(
            "subject",
            F.coalesce("before_share", F.lit(0.0)).alias("before_share"),
            F.coalesce("after_share", F.lit(0.0)).alias("after_share"),
        )
        .withColumn("delta", F.col("after_share") - F.col("before_share"))
        .orderBy(F.abs("delta").desc(), "subject")
    )


def version_before(versions: DataFrame, target: str | Column) -> Column:
    """The newest version other than the target."""
    others = versions.filter(F.col("analyzer_version") != target)
    return latest_version(others)


def latest_instant(items: DataFrame) -> Column:
    """The newest collection instant: "now" of a lake that is read after the fact."""
    return items.agg(F.max(buckets.instant(F.col("collected_at"))).alias("at")).scalar()


def window_since(items: DataFrame, range_name: str) -> Column:
    hours = buckets.RANGES[range_name]
    return F.timestamp_seconds(F.unix_seconds(latest_instant(items)) - hours * 3600)


def compare_status(versions: DataFrame, target: str | Column) -> DataFrame:
    """Whether two versions can be set side by side, and which: one row.

    The target is the "after" side; the newest other version is "before". Without two versions,
    or when nobody has run the target yet, there is nothing to compare.
    """
    counted = versions.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_or(F.col("analyzer_version") == target), F.lit(False)).alias("has"),
    )
    wanted = F.lit(target) if isinstance(target, str) else target
    ready = (F.col("n") >= 2) & F.col("has")
    return counted.select(
        ready.alias("available"),
        F.when(F.col("n") == 0, "no-silver").when(~ready, "single-version").otherwise("").alias(
            "reason"
        ),
        F.when(ready, version_before(versions, target)).otherwise("").alias("before_version"),
        F.when(F.col("n") > 0, wanted).otherwise("").alias("after_version"),
    )
