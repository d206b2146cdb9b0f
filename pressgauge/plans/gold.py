"""The aggregation job: six Gold datasets out of Bronze and Silver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from pressgauge.operators import contributions, picks, shares, tone, versions
from pressgauge.operators.picks import BUCKET_KEYS, WINDOW_KEYS
from pressgauge.plans import ingestion, refresh
from pressgauge.session import scratch_scope, staged
from pressgauge.sources.builds import Builds, with_week


def labelled_observations(
    bronze: DataFrame, silver: DataFrame, serving_version: str | Column | None = None
) -> DataFrame:
    return picks.join_observations(bronze, picks.serving_rows(silver, serving_version))


def all_picks(
    bronze: DataFrame, silver: DataFrame, serving_version: str | Column | None = None
) -> DataFrame:
    return picks.unit_picks(labelled_observations(bronze, silver, serving_version))


@dataclass
class Gold:
    article_pick: DataFrame
    subject_trend: DataFrame
    subject_source_contribution: DataFrame
    axis_sentiment: DataFrame
    subject_window: DataFrame
    axis_window: DataFrame

    def datasets(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def aggregate(
    bronze: DataFrame, silver: DataFrame, serving_version: str | Column | None = None
) -> Gold:
    """Build Gold, folding once.

    Picks and share terms feed several datasets. Both are written to the shared scratch folder
    and read back: the join with Silver and the fold run once, and the lineage ends there.
    """
    every = staged(all_picks(bronze, silver, serving_version), "picks")
    hours = every.filter("bucket_unit = 'hour'")
    terms = staged(shares.share_terms(shares.mentions(every, BUCKET_KEYS), BUCKET_KEYS), "terms")
    folded = staged(shares.fold_terms(terms, BUCKET_KEYS), "shares")
    windows = staged(picks.window_picks(hours), "window-picks")
    return Gold(
        article_pick=picks.article_picks(every),
        subject_trend=shares.with_history(shares.with_all_axis(folded, BUCKET_KEYS)),
        subject_source_contribution=contributions.from_terms(terms, folded),
        axis_sentiment=tone.axis_sentiment(every),
        subject_window=shares.subject_window(windows),
        axis_window=tone.axis_window(windows),
    )


def publish(lake, built: Gold) -> Gold:
    """Replace the six datasets at once, whole, and hand back what readers will see. What a later refresh
    would build upon is gone with them, so that one folds all again."""
    Builds(lake, "gold").commit({name: (with_week(rows), None) for name, rows in built.datasets().items()})
    lake.write_records("gold", "fold_cycle", lake.read_records("gold", "fold_cycle").limit(0))
    return read(lake)


def aggregate_lake(lake, decision: tuple[str, str, str] | None = None) -> Gold:
    """The whole job on a lake, after an optional (decision, version, memo).

    Publishing or rolling back only moves the pointer to a label version: Gold is folded again
    from the rows that version serves, and nothing is labelled again. Without a decision only what
    changed since the last time is folded again.
    """
    if decision is not None:
        versions.record_decision(lake, *decision)
    ingestion.recover(lake)
    with scratch_scope(lake.spark):
        refresh.refresh(lake)
    return read(lake)


def read(lake) -> Gold:
    builds = Builds(lake, "gold")
    return Gold(**{name: builds.rows(name) for name in Gold.__dataclass_fields__})


__all__ = ["BUCKET_KEYS", "WINDOW_KEYS", "Gold", "aggregate", "aggregate_lake", "all_picks", "labelled_observations", "publish",
           "read"]
