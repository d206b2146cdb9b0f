"""Stage accounting: what happened to each input of a stage, and how a run went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.operators.picks import first_by

NOT_REACHED = "not_reached"


def label_outcome(failed: Column, reused: Column, status: Column) -> Column:
    """One bucket per record: an outage first, then a replayed reply, then the verdict."""
    return F.when(failed, "call_failed").when(reused, "reused").otherwise(status)


def stage_outcomes(
    outcomes: DataFrame, inputs: DataFrame, keys: list[str]
) -> DataFrame:
    """Outcome counts that partition the input.

    ``outcomes`` holds (keys, outcome_name, outcome_count), ``inputs`` one row per stage with
    input_count and failed. A failed stage books the rest as not reached; a stage that did not
    fail must account for everything, and none may account for more than it got.
    """
    booked = outcomes.groupBy(*keys).agg(F.sum("outcome_count").alias("booked"))
    checked = inputs.join(booked, keys, "left").withColumn(
        "booked", F.coalesce("booked", F.lit(0))
    )
    label = F.concat_ws("/", *keys)
    short = F.col("input_count") - F.col("booked")
    rest = (
        F.when(short < 0, F.raise_error(F.concat(F.lit("outcomes exceed the input of "), label)))
        .when(
            (short > 0) & ~F.col("failed"),
            F.raise_error(F.concat(F.lit("outcomes do not cover the input of "), label)),
        )
        .otherwise(short)
    )
    missing = checked.select(
        *keys, F.lit(NOT_REACHED).alias("outcome_name"), rest.alias("outcome_count")
    ).filter(F.col("outcome_count") > 0)
    return outcomes.select(*keys, "outcome_name", "outcome_count").unionByName(missing)


def merged_runs(stages: DataFrame) -> DataFrame:
    """One row per run: failed if any stage failed, ended with its last stage.

    ``stages`` holds one row per stage attempt; a retry replaces the stage's earlier record. A
    run has few stages, so its list of them is small.
    """
    last = first_by(
        stages, ["run_id", "stage_name"], [F.col("stage_started_at").desc(), F.col("attempt").desc()]
    )
    return last.groupBy("run_id").agg(
        F.when(F.bool_or(F.col("stage_status") == "failed"), "failed")
        .otherwise("succeeded")
        .alias("run_status"),
        F.min("stage_started_at").alias("run_started_at"),
        F.max("stage_ended_at").alias("run_ended_at"),
        F.array_sort(
            F.collect_list(
                F.struct("stage_started_at", "stage_name", "stage_status", "input_count",
                         "output_count")
            )
        ).alias("stages"),
    )


def run_records(states: DataFrame) -> DataFrame:
    """The record of each run from the states of its stages.

    Of a stage the state noted last counts, so a retry replaces what came before. A run is failed if
    a stage failed, else running while one does; only a run that is over has an end.
    """
    last = first_by(states, ["run_id", "stage_name"], [F.col("noted_at").desc(), F.col("attempt").desc()])
    stage = F.struct(*(c for c in states.columns if c not in ("run_id", "run_trigger", "attempt", "noted_at")))
    began = states.groupBy("run_id").agg(
        F.min_by("run_trigger", "noted_at").alias("run_trigger"), F.min("stage_started_at").alias("run_started_at")
    )
    order = F.array_sort(F.collect_list(F.struct("noted_at", stage.alias("stage"))))  # a run has few stages
    ended = last.groupBy("run_id").agg(
        F.bool_or(F.col("stage_status") == "failed").alias("failed"),
        F.bool_or(F.col("stage_status") == "running").alias("running"),
        F.max("stage_ended_at").alias("ended"), order.alias("ordered"),
    )
    status = F.when(F.col("failed"), "failed").when(F.col("running"), "running").otherwise("succeeded")
    return began.join(ended, "run_id").select(
        "run_id", "run_trigger", "run_started_at", F.when(~F.col("running"), F.col("ended")).alias("run_ended_at"),
        status.alias("run_status"), F.transform("ordered", lambda s: s["stage"]).alias("stages"),
    )


def serving_outcomes(silver: DataFrame, served: DataFrame) -> DataFrame:
    """How many analyses are served, and how many a newer or chosen version supersedes."""
    total = silver.agg(F.count("*").alias("rows")).scalar()
    return served.agg(F.count("*").alias("served")).withColumn(
        "superseded", total - F.col("served")
    )
