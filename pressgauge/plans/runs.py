"""The run log: every state of every stage is a row that is only added; runs are rolled up from these.

A stage adds a row when it begins, so a driver that dies leaves a trace, and one when it ends. What a
run looks like is a question over the rows (``operators.runlog.run_records``). Nothing is rewritten for a
state; the lake puts many small files of the log together.
"""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.operators import runlog
from pressgauge.schemas import STAGE_STATE
from pressgauge.sources.lake import Lake

_COUNTED = "outcome_name string, outcome_count bigint"


class RunningStage:
    """``with RunningStage(lake, run, name) as stage``: set counts, ``book`` outcomes.

    Outcomes must add up to ``inputs``; a stage that fails books the rest as not reached.
    """

    def __init__(self, lake: Lake, run_id: str, name: str, trigger: str = "scheduled") -> None:
        self.lake, self.run_id, self.name, self.trigger = lake, run_id, name, trigger
        self.attempt = uuid.uuid4().hex
        self.inputs = self.outputs = 0
        self.failure: str | None = None
        self.sources: dict[str, str] = {}
        self._booked = lake.spark.createDataFrame([], _COUNTED)

    def book(self, counts: DataFrame | dict[str, int]) -> None:
        """Add counted outcomes: a frame of (outcome_name, outcome_count), or a mapping."""
        if isinstance(counts, dict):
            counts = self.lake.spark.createDataFrame(list(counts.items()), _COUNTED)
        self._booked = self._booked.unionByName(counts.select("outcome_name", "outcome_count"))

    def __enter__(self) -> "RunningStage":
        self.began, self._clock = datetime.now(UTC), time.monotonic()
        self._add("running", None, [])
        return self

    def __exit__(self, kind, error, trace) -> None:
        if error is not None and self.failure is None:
            self.failure = f"{kind.__name__}: {error}"
        status = "succeeded" if self.failure is None else "failed"
        self._add(status, datetime.now(UTC), self._outcomes(status == "failed"))

    def _outcomes(self, failed: bool) -> list[tuple[str, int]]:
        """The booked counts, with what was not reached; raises if they don't fit the input."""
        spark, keys = self.lake.spark, ["run_id", "stage_name"]
        place = {"run_id": F.lit(self.run_id), "stage_name": F.lit(self.name)}
        booked = self._booked.groupBy("outcome_name").agg(F.sum("outcome_count").alias("outcome_count")).withColumns(place)
        got = spark.range(1).select(F.lit(self.inputs).cast("long").alias("input_count"), F.lit(failed).alias("failed")).withColumns(place)
        whole = runlog.stage_outcomes(booked, got, keys).orderBy("outcome_name")
        return [(r.outcome_name, r.outcome_count) for r in whole.collect()]  # a handful of names

    def _add(self, status: str, ended: datetime | None, outcomes: list) -> None:
        text = lambda at: at and at.isoformat(timespec="seconds")
        state = (
            self.run_id, self.trigger, self.attempt, datetime.now(UTC).isoformat(timespec="microseconds"), self.name, status,
            text(self.began), text(ended), int((time.monotonic() - self._clock) * 1000), self.inputs, self.outputs, outcomes,
            self.failure, list(self.sources.items()),
        )
        self.lake.append_log("silver", "stage_state", self.lake.spark.createDataFrame([state], STAGE_STATE))


def run_records(lake, run_id: str | None = None) -> DataFrame:
    """The record of each run, or of one, rolled up from the states when it is asked for."""
    states = lake.read_log("silver", "stage_state")
    return runlog.run_records(states if run_id is None else states.where(F.col("run_id") == run_id))
