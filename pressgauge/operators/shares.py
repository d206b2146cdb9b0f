"""Source-bias-normalised attention shares.

A source's own subject shares are averaged over sources with weights that grow with the square
root of the source's article count, so neither one huge nor many tiny sources decide a bucket.
Each step is a grouped sum with a map-side combine followed by an equi-join on its own result;
no step gathers a bucket in one task. All sums run on integers (see ``functions.numeric``).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgauge.functions import numeric
from pressgauge.functions import vocabulary as V
from pressgauge.operators.picks import BUCKET_KEYS, WINDOW_KEYS
from pressgauge.session import staged

SPARK_POINTS = 6


def mentions(picks: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions per source and subject, and articles per source.

    An article with k subjects is k mentions and one article; one without subjects is still an
    article, kept on a row whose subject is null.

    The counts meet themselves in a join further on. Keys are checked here so that the join adds
    no checks of its own to one side only, which would keep Spark from shuffling once for both.
    """
    known = picks.filter(reduce(and_, [F.col(c).isNotNull() for c in [*keys, "source_id"]]))
    exploded = known.select(*keys, "source_id", F.posexplode_outer("keys").alias("pos", "subject"))
    return exploded.groupBy(*keys, "source_id", "subject").agg(
        F.count("subject").alias("n"),
        F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("articles"),
    )


def source_totals(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Per source: its mentions, its weight, and the sums its bucket is normalised by.

    ``den`` is what the terms of all subjects in the bucket add up to: a source with mentions
    hands out its whole weight. ``axes`` is how many axes have a subject in the bucket. The
    windows run over one row per source, not over mentions.
    """
    bucket = W.partitionBy(*keys)
    every_axis = W.partitionBy(*[k for k in keys if k != "axis"])
    share = numeric.share_term(F.col("weight"), F.col("weight_sum"))
    speaks = F.col("source_total") > 0
    axes = reduce(
        lambda a, b: a + b,
        [F.max(((F.col("axis") == a) & speaks).cast("int")).over(every_axis) for a in V.AXES],
    )
    return (
        counted.groupBy(*keys, "source_id")
        .agg(F.sum("n").alias("source_total"), F.sum("articles").alias("articles"))
        .withColumn("weight", numeric.sqrt_weight(F.col("articles")))
        .withColumn("weight_sum", F.sum("weight").over(bucket))
        .withColumn("den", F.sum(F.when(speaks, share).otherwise(0)).over(bucket))
        .withColumn("axes", axes)
        .drop("articles")
    )


def share_terms(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Each source's part of each subject's share, before the bucket is renormalised.

    The filter on counts (and not on the subject, which would move below the count) leaves both
    sides of the join with the same shuffled counts, so Spark computes them once.
    """
    term = numeric.share_term(
        F.col("weight"),
        F.col("weight_sum"),
        F.col("n").cast("double") / F.col("source_total").cast("double"),
    )
    return (
        counted.filter((F.col("n") > 0) & (F.col("articles") >= 0))
        .drop("articles")
        .join(source_totals(counted, keys), [*keys, "source_id"])
        .select(*keys, "subject", "source_id", "n", "den", "axes", term.alias("term"))
    )


def fold_terms(terms: DataFrame, keys: list[str]) -> DataFrame:
    """Share (in grid units) and raw count per subject."""
    share = F.col("num").cast("double") / F.col("den").cast("double")
    return (
        terms.groupBy(*keys, "subject")
        .agg(
            F.sum("term").alias("num"),
            F.sum("n").alias("raw_count"),
            F.max("den").alias("den"),
            F.max("axes").alias("axes"),
        )
        .withColumn("share", numeric.snapped(share))
        .select(
            *keys, "subject", "raw_count", "axes", numeric.grid_units(F.col("share")).alias("units")
        )
    )


def with_all_axis(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Add the ALL axis: the mean of the axes' rounded shares, each axis counting the same.

    An axis with no subjects in a bucket leaves that bucket's mean; a subject an included axis
    lacks counts 0 there. One row per subject holds all axes side by side, so the axes' rows
    and the pooled row come out of one pass.
    """
    rest = [k for k in keys if k != "axis"]
    units = {a: F.col(f"units_{a}") for a in V.AXES}
    raw = {a: F.col(f"raw_count_{a}") for a in V.AXES}

    def of(axis: str, column: str):
        return F.max(F.when(F.col("axis") == axis, F.col(column))).alias(f"{column}_{axis}")

    def row(axis: str, raw_count, share_units):
        return F.struct(
            F.lit(axis).alias("axis"), raw_count.alias("raw_count"), share_units.alias("units")
        )

    total = numeric.compensated_sum(
        [numeric.from_units(F.coalesce(units[a], F.lit(0))) for a in V.AXES]
    )
    raw_sum = reduce(lambda a, b: a + b, [F.coalesce(raw[a], F.lit(0)) for a in V.AXES])
    rows = [
        *[row(a, raw[a], units[a]) for a in V.AXES],
        row(V.ALL_AXIS, raw_sum, F.col("mean_units")),
    ]
    return (
        folded.groupBy(*rest, "subject")
        .agg(*[of(a, c) for a in V.AXES for c in ("units", "raw_count")], F.max("axes").alias("axes"))
        .withColumn("mean", total / F.col("axes"))
        .withColumn("mean_units", numeric.grid_units(F.col("mean")))
        .select(*rest, "subject", F.inline(F.array(*rows)))
        .filter(F.col("units").isNotNull())
        .select("axis", *rest, "subject", "raw_count", "units")
    )


def subject_shares(picks: DataFrame, keys: list[str] = BUCKET_KEYS) -> DataFrame:
    """Counts, weights and shares of every axis and of ALL, in grid units."""
    terms = share_terms(mentions(picks, keys), keys)
    return with_all_axis(fold_terms(terms, keys), keys)


def with_history(shares: DataFrame) -> DataFrame:
    """Change against the subject's previous present bucket, and its last shares.

    A bucket the subject is absent from is not a zero reading; it is skipped.
    """
    line = W.partitionBy("axis", "bucket_unit", "subject").orderBy("time_bucket")
    before = F.lag("units").over(line)
    recent = F.collect_list("units").over(line.rowsBetween(1 - SPARK_POINTS, 0))
    return shares.select(
        "subject",
        "axis",
        "bucket_unit",
        "time_bucket",
        "raw_count",
        numeric.from_units(F.col("units")).alias("normalized_share"),
        F.coalesce((F.col("units") - before) / F.lit(100.0), F.lit(0.0)).alias("delta"),
        F.transform(recent, numeric.from_units).alias("spark"),
    )


def subject_trend(picks: DataFrame) -> DataFrame:
    return with_history(subject_shares(picks, BUCKET_KEYS))


def subject_window(picks: DataFrame) -> DataFrame:
    """Shares of the 24h / 7d / 30d windows, folded as buckets are."""
    shares = subject_shares(picks, WINDOW_KEYS)
    return shares.join(_bounds(picks), ["range", "period"]).select(
        "subject",
        "axis",
        "range",
        "period",
        "window_start",
        "window_end",
        "raw_count",
        numeric.from_units(F.col("units")).alias("normalized_share"),
    )


def _bounds(picks: DataFrame) -> DataFrame:
    return picks.groupBy("range", "period").agg(
        F.max("window_start").alias("window_start"), F.max("window_end").alias("window_end")
    )


def source_subject_table(picks: DataFrame, min_mentions: int = 1) -> DataFrame:
    """Share of each subject inside each source, for sources with enough mentions."""
    counted = mentions(picks, BUCKET_KEYS)
    totals = (
        counted.groupBy(*BUCKET_KEYS, "source_id")
        .agg(F.sum("n").alias("source_total"))
        .filter(F.col("source_total") >= min_mentions)
    )
    return (
        counted.filter(F.col("n") > 0)
        .join(totals, [*BUCKET_KEYS, "source_id"])
        .withColumn("ratio", F.col("n") / F.col("source_total"))
        .select(
            *BUCKET_KEYS,
            "source_id",
            "subject",
            "n",
            numeric.round4(F.col("ratio")).alias("source_share"),
        )
    )


def source_grid(
    picks: DataFrame, sources: DataFrame, measure: str = "share", min_articles: int = 1
) -> DataFrame:
    """Source x subject tables, one per axis and bucket of ``picks``, with every cell filled.

    ``sources`` holds the configured (source_id, axis). A source that collected anything in a bucket has a
    cell for each subject of the bucket's table: its share inside the source, or its count. A cell nobody
    mentioned is 0 and ``no mention``. A source that collected nothing has one row without a subject or a
    value, ``no collection``: that is no 0. ``enough`` tells sources with fewer articles than ``min_articles``.
    """
    if measure not in ("share", "count"):
        raise ValueError(f"measure is share or count, not {measure!r}")
    counted = staged(mentions(picks, BUCKET_KEYS), "mentions")
    totals = counted.groupBy(*BUCKET_KEYS, "source_id").agg(
        F.sum("n").alias("source_total"), F.sum("articles").alias("articles")
    )
    subjects = counted.filter(F.col("n") > 0).select(*BUCKET_KEYS, "subject").distinct()
    cells = totals.join(subjects, BUCKET_KEYS).join(
        counted.select(*BUCKET_KEYS, "source_id", "subject", "n"), [*BUCKET_KEYS, "source_id", "subject"], "left"
    )
    n = F.coalesce("n", F.lit(0))
    ratio = F.when(F.col("source_total") > 0, n / F.col("source_total")).otherwise(F.lit(0.0))
    value = numeric.round4(F.col("ratio")) if measure == "share" else n.cast("double")
    filled = cells.withColumn("ratio", ratio).select(
        *BUCKET_KEYS, "source_id", "subject", value.alias("value"), "articles",
        F.when(n > 0, "mentioned").otherwise("no mention").alias("state"),
    )
    places = totals.select(*BUCKET_KEYS).distinct().join(sources.select("source_id", "axis").distinct(), "axis")
    silent = places.join(totals.select(*BUCKET_KEYS, "source_id"), [*BUCKET_KEYS, "source_id"], "left_anti").select(
        *BUCKET_KEYS, "source_id", F.lit(None).cast("string").alias("subject"), F.lit(None).cast("double").alias("value"),
        F.lit(0).cast("bigint").alias("articles"), F.lit("no collection").alias("state"),
    )
    return filled.unionByName(silent).withColumn("enough", F.col("articles") >= min_articles)
