"""The aggregation job on a lake: Gold folded again only where something changed.

A cycle counts as changed when the listing of its Bronze or Silver files is not what it was at the last fold.
Its observations fall into some ISO weeks, before and now: these weeks are touched. Hours and days nest in
weeks, so a touched week is folded from all observations of the cycles that reach into it and from no others,
and its partitions of every dataset are replaced.

Two things reach beyond a week. A subject's change and history look at its last present buckets, so a touched
week also changes the next few of them, in whatever week they are: a small index of present weeks finds these,
and only the lines concerned are made anew. The windows of the last days hang on the newest hour: they are
folded from the stored hour picks of the weeks they reach into.

All datasets are switched by one pointer (``sources.builds``). Another serving version changes every week, so
then all is folded. What was folded is noted after the switch: a job that dies in between folds the same again.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgauge.functions import buckets, numeric
from pressgauge.operators import contributions, picks, shares, tone, versions
from pressgauge.operators.picks import BUCKET_KEYS
from pressgauge.schemas import PARTITION
from pressgauge.session import staged
from pressgauge.sources.builds import WHOLE, Builds, week_of, with_week
from pressgauge.sources.lake import cycles_of, only_cycles

_PARTS = list(PARTITION)
LINE = ["axis", "bucket_unit", "subject"]
#: A row's history holds itself and so many earlier rows.
EARLIER = shares.SPARK_POINTS - 1


def cycle_states(lake) -> DataFrame:
    """(partition, bronze_signature, silver_signature) of all cycles that have observations or labels."""
    bronze = lake.signatures("bronze", "news_item").withColumnRenamed("signature", "bronze_signature")
    silver = lake.signatures("silver", "analysis").withColumnRenamed("signature", "silver_signature")
    return bronze.join(silver, _PARTS, "full")


def changed_cycles(now: DataFrame, folded: DataFrame) -> DataFrame:
    """Cycles that are new, gone, or not what they were when Gold was folded."""
    names = ("bronze_signature", "silver_signature")
    old = folded.select(*_PARTS, *(F.col(n).alias(f"old_{n}") for n in names), F.lit(True).alias("known"))
    new = now.select(*_PARTS, *names, F.lit(True).alias("there"))
    same = F.coalesce(F.col("known") & F.col("there"), F.lit(False))
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"old_{n}"))
    return old.join(new, _PARTS, "full").where(~same).select(*_PARTS)


def cycle_weeks(bronze: DataFrame) -> DataFrame:
    """(partition, weeks): the weeks that a cycle's observations fall into, a handful."""
    week = week_of(F.lit("hour"), buckets.bucket_label(F.col("collected_at"), "hour"))
    return bronze.groupBy(*_PARTS).agg(F.sort_array(F.collect_set(week)).alias("weeks"))


def fold(bronze: DataFrame, silver: DataFrame, version: str | Column | None, weeks: list[str] | None) -> dict[str, DataFrame]:
    """The datasets of some weeks, or of all, as far as these depend on a week's observations alone.

    ``share`` holds counts and shares of all axes; ``subject_trend`` is made from it and its neighbours.
    """
    labelled = picks.join_observations(bronze, picks.serving_rows(silver, version))
    every = with_week(picks.unit_picks(labelled))
    every = staged(every if weeks is None else every.where(F.col("week").isin(weeks)), "picks")
    chosen = every.drop("week")
    terms = staged(shares.share_terms(shares.mentions(chosen, BUCKET_KEYS), BUCKET_KEYS), "terms")
    folded = staged(shares.fold_terms(terms, BUCKET_KEYS), "shares")
    share = staged(with_week(shares.with_all_axis(folded, BUCKET_KEYS)), "all-shares")
    return {
        "hour_pick": every.where("bucket_unit = 'hour'"),
        "article_pick": with_week(picks.article_picks(chosen)),
        "subject_source_contribution": with_week(contributions.from_terms(terms, folded)),
        "axis_sentiment": with_week(tone.axis_sentiment(chosen)),
        "share": share,
        "line_week": share.groupBy(*LINE, "week").agg(F.count("*").alias("buckets")),
    }


def near_weeks(index: DataFrame, fresh: DataFrame, weeks: list[str]) -> DataFrame:
    """(line, week, later) of the untouched weeks whose rows are needed: ``later`` ones change with the touched
    weeks, the others only give the history before these."""
    touched = F.col("week").isin(weeks)
    marks = index.where(touched).select(*LINE, "week").unionByName(fresh.select(*LINE, "week")).distinct()
    rest = index.where(~touched).join(marks.select(*LINE).distinct(), LINE, "left_semi")
    both = marks.select(*LINE, "week", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("touched")).unionByName(
        rest.select(*LINE, "week", F.col("buckets").alias("n"), F.lit(False).alias("touched"))
    )

    def gap(order: Column) -> Column:
        """Untouched buckets between this week and the nearest touched one on that side; null without one."""
        line = W.partitionBy(*LINE).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.col("seen") - F.max(F.when(F.col("touched"), F.col("seen"))).over(line)

    def seen(order: Column) -> Column:
        line = W.partitionBy(*LINE).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(line), F.lit(0))

    forward = both.withColumn("seen", seen(F.asc("week"))).withColumn("after", gap(F.asc("week")))
    told = forward.withColumn("seen", seen(F.desc("week"))).withColumn("before", gap(F.desc("week")))
    later = F.coalesce(F.col("after") < EARLIER, F.lit(False))
    return told.where(~F.col("touched") & (later | (F.col("before") < EARLIER))).select(*LINE, "week", later.alias("later"))


def changed_trend(builds: Builds, share: DataFrame, weeks: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows of all weeks whose trend changes, and these weeks."""
    near = staged(near_weeks(builds.read("line_week"), share, weeks), "near-weeks")
    reach = {r.week: r.later for r in near.groupBy("week").agg(F.max("later").alias("later")).collect()}  # a row a week
    later = sorted(w for w, changed in reach.items() if changed)
    stored = builds.read("subject_trend", sorted(reach))
    units = numeric.grid_units(F.col("normalized_share")).alias("units")
    around = stored.join(near.select(*LINE, "week"), [*LINE, "week"], "left_semi").select(
        "axis", "bucket_unit", "time_bucket", "subject", "raw_count", units
    )
    fresh = share.select("axis", "bucket_unit", "time_bucket", "subject", "raw_count", "units")
    lines = with_week(shares.with_history(around.unionByName(fresh)))
    moved = near.where("later").select(*LINE, "week")
    own = F.col("week").isin(weeks)
    made = lines.where(own).unionByName(lines.where(~own).join(moved, [*LINE, "week"], "left_semi"))
    kept = stored.where(F.col("week").isin(later)).join(moved, [*LINE, "week"], "left_anti")
    return made.unionByName(kept.select(*made.columns)), sorted({*weeks, *later})


def window_hours(builds: Builds, fresh: DataFrame | None = None, weeks: list[str] | None = ()) -> DataFrame:
    """Hour picks of the weeks that the windows reach into, with ``fresh`` in place of the stored ``weeks`` (None:
    of all). The newest hour is in the newest week, so that week is the only one read to find the first."""
    stored = [] if weeks is None else [w for w in builds.weeks("hour_pick") if w not in weeks and w != "none"]
    fresh = builds.read("hour_pick", []) if fresh is None else fresh.where("week <> 'none'")
    newest = fresh.unionByName(builds.read("hour_pick", stored[-1:])).agg(F.max("time_bucket")).first()[0]
    if newest is None:
        return fresh.drop("week")
    oldest = datetime.strptime(newest, "%Y-%m-%dT%H") - timedelta(hours=2 * max(buckets.RANGES.values()) - 1)
    first = "{:04d}-W{:02d}".format(*oldest.isocalendar())
    near = builds.read("hour_pick", [w for w in stored if w >= first])
    return fresh.where(F.col("week") >= first).unionByName(near).drop("week")


def windows(hours: DataFrame) -> dict[str, DataFrame]:
    chosen = staged(picks.window_picks(hours), "window-picks")
    return {"subject_window": shares.subject_window(chosen), "axis_window": tone.axis_window(chosen)}


def _of(rows: DataFrame, cycles: DataFrame) -> DataFrame:
    """The rows of these cycles. Their days, a few a week, go into the scan as a filter of partitions."""
    days = [f"{r.year}-{r.month}-{r.day}" for r in cycles.select("year", "month", "day").distinct().collect()]
    return only_cycles(rows.where(F.concat_ws("-", "year", "month", "day").isin(days)), cycles_of(cycles))


def refresh(lake) -> list[str] | None:
    """Bring Gold up to date; returns the weeks that were folded, None for all."""
    builds = Builds(lake, "gold")
    pointed = versions.serving_version(lake.read_records("silver", "reprocess_decision"))
    version = lake.spark.range(1).select(pointed).first()[0]
    now = staged(cycle_states(lake), "cycle-states")  # before anything is read: what changes later is folded next time
    folded = lake.read_records("gold", "fold_cycle")
    bronze, silver = lake.read_cycles("bronze", "news_item"), lake.read_cycles("silver", "analysis")
    last = folded.select("serving_version").limit(1).collect()
    weeks, known = None, cycle_weeks(bronze)
    if last and last[0].serving_version == version and builds.weeks("subject_trend"):
        changed = staged(changed_cycles(now, folded), "changed-cycles")
        fresh = staged(cycle_weeks(_of(bronze, changed)), "fresh-weeks")
        same = folded.join(changed, _PARTS, "left_anti").select(*_PARTS, "weeks")
        before = folded.join(changed, _PARTS, "left_semi").select("weeks")
        touched = before.unionByName(fresh.select("weeks")).select(F.explode("weeks").alias("week")).distinct()
        weeks = sorted(r.week for r in touched.collect())  # a row a week
        known = staged(same.unionByName(fresh), "cycle-weeks")
        reaching = known.where(F.arrays_overlap("weeks", F.array(*map(F.lit, weeks)).cast("array<string>")))
        cycles = staged(reaching.select(*_PARTS), "reaching-cycles")
        bronze, silver = _of(bronze, cycles), _of(silver, cycles)
    if weeks != []:
        made = fold(bronze, silver, version, weeks)
        share = made.pop("share")
        replaced = {name: (rows, weeks) for name, rows in made.items()}
        if weeks is None:
            replaced["subject_trend"] = with_week(shares.with_history(share.drop("week"))), None
        else:
            replaced["subject_trend"] = changed_trend(builds, share, weeks)
        hours = staged(window_hours(builds, made["hour_pick"], weeks), "window-hours")
        replaced |= {name: (with_week(rows), [WHOLE[1]]) for name, rows in windows(hours).items()}
        builds.commit(replaced)
    noted = now.join(known, _PARTS, "left").withColumn("serving_version", F.lit(version).cast("string"))
    names = folded.columns
    lake.write_records("gold", "fold_cycle", staged(noted.select(*names), "fold-cycles"))
    return weeks
