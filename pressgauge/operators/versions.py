"""Coexisting label versions: upserts into Silver, orphans, retries, settled cycles, decisions."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions import buckets
from pressgauge.schemas import DECISION, PARTITION
from pressgauge.session import dealt, staged
from pressgauge.sources.lake import cycles_of, only_cycles

KEY = ["record_id", "analyzer_version"]
_PARTS = list(PARTITION)
_HOME = ["record_id", *_PARTS]
DECISIONS = ("publish", "rollback")


def merged_analyses(
    stored: DataFrame,
    located: DataFrame,
    rows: DataFrame,
    coexist: bool = True,
    keep_versions: tuple[str, ...] = (),
) -> DataFrame:
    """Partitions touched by ``rows`` after the upsert, all three frames with partition columns.

    Stored rows whose record is gone from, or moved out of, their partition drop out. Without
    ``coexist`` the touched records also lose their other versions, except ``keep_versions``.

    Records are joined by merging: by its estimate of bytes Spark would send millions of keys to every task.
    """
    kept = (
        only_cycles(stored, cycles_of(rows))
        .join(located.select(*_HOME).hint("merge"), _HOME, "left_semi")
        .join(rows.select(*KEY).hint("merge"), KEY, "left_anti")
    )
    if not coexist:
        guarded = F.col("analyzer_version").isin(*keep_versions) if keep_versions else F.lit(False)
        rewritten = rows.select("record_id", F.lit(True).alias("rewritten")).distinct()
        kept = (
            kept.join(rewritten.hint("merge"), "record_id", "left")
            .filter(F.col("rewritten").isNull() | guarded)
            .drop("rewritten")
        )
    return kept.unionByName(rows.select(*stored.columns))


def store_analyses(
    lake,
    located: DataFrame,
    rows: DataFrame,
    coexist: bool = True,
    keep_versions: tuple[str, ...] = (),
    counted: bool = True,
) -> DataFrame:
    """Write ``rows`` into Silver; returns one row with the written and pruned counts, the latter only
    if ``counted``.

    ``located`` needs to hold the observations of the cycles ``rows`` belong to, no others.
    """
    stored = lake.read_cycles("silver", "analysis")
    with dealt(lake.spark, located.count()):
        placed = staged(rows.join(located.select(*_HOME).distinct().hint("merge"), "record_id"), "analyses")
        lost = 0 if counted else None
        if only_cycles(lake.listed("silver", "analysis"), cycles_of(placed)).isEmpty():
            merged = placed.select(*stored.columns)  # first labels of all these cycles: there is nothing to merge
        else:
            merged = staged(
                merged_analyses(stored, located, placed, coexist, keep_versions), "merged-analyses"
            )
            if counted:  # before the write: what is read here is replaced by it
                before = only_cycles(stored, cycles_of(placed))
                gone = before.join(merged.select(*KEY, *_PARTS).hint("merge"), [*KEY, *_PARTS], "left_anti")
                lost = gone.agg(F.count("*").alias("n")).first()["n"]
    lake.write_cycles("silver", "analysis", merged.sortWithinPartitions(*_PARTS, *KEY))
    return merged.agg(F.count("*").alias("written"), F.lit(lost).cast("bigint").alias("pruned"))


def cycles_without_bronze(silver: DataFrame, bronze: DataFrame, cycle: list[str] = _PARTS) -> DataFrame:
    """Cycles that hold labels although Bronze has no observation there (any more)."""
    return silver.select(*cycle).distinct().join(bronze.select(*cycle).distinct(), cycle, "left_anti")


def orphans(stored: DataFrame, located: DataFrame) -> DataFrame:
    """Silver rows whose record Bronze no longer holds in the same partition."""
    return stored.join(located.select(*_HOME).hint("merge"), _HOME, "left_anti")


def prune_orphans(lake, located: DataFrame, cycles: DataFrame | None = None) -> None:
    """Rewrite the partitions that hold orphans; one left empty is dropped.

    With ``cycles`` only these partitions are looked at, and ``located`` need hold no others.
    """
    stored = lake.read_cycles("silver", "analysis")
    if cycles is not None:
        stored = only_cycles(stored, cycles_of(cycles))
    with dealt(lake.spark, located.count()):
        dirty = staged(orphans(stored, located).select(*_PARTS).distinct(), "dirty-cycles")
        kept = staged(
            only_cycles(stored, cycles_of(dirty)).join(located.select(*_HOME).hint("merge"), _HOME, "left_semi"),
            "kept-analyses",
        )
    lake.write_cycles("silver", "analysis", kept)
    lake.clear_cycles(
        "silver", "analysis", dirty.join(kept.select(*_PARTS).distinct(), _PARTS, "left_anti")
    )


# -- what is left to do ---------------------------------------------------------------------


def done_records(silver: DataFrame, retry: DataFrame, version: str) -> DataFrame:
    """Records settled at ``version``: labelled, linked to a run, and not waiting for a retry."""
    waiting = retry.filter(F.col("analyzer_version") == version).select("record_id")
    return (
        silver.filter(
            (F.col("analyzer_version") == version) & (F.coalesce("run_id", F.lit("")) != "")
        )
        .select("record_id")
        .distinct()
        .join(waiting, "record_id", "left_anti")
    )


def pending(scope: DataFrame, silver: DataFrame, retry: DataFrame, version: str) -> DataFrame:
    return scope.join(done_records(silver, retry, version), "record_id", "left_anti")


def updated_retries(
    retry: DataFrame,
    present: DataFrame,
    analyzed: DataFrame,
    failed: DataFrame,
    version: str,
) -> DataFrame:
    """The retry list after a batch.

    ``present`` holds (record_id, collection_cycle) of the visited cycles, ``analyzed`` and
    ``failed`` the batch's record ids. Failed records join, the other analyzed ones leave at
    this version, and a visited cycle's retries leave when their record is gone. A retry that
    names no cycle belongs to the cycle its record is in.
    """
    homes = present.select("record_id", F.col("collection_cycle").alias("home"))
    visited = present.select(
        F.col("collection_cycle").alias("visited_cycle")
    ).distinct()
    done = analyzed.join(failed, "record_id", "left_anti").select(
        "record_id", F.lit(version).alias("analyzer_version"), F.lit(True).alias("done")
    )
    marked = (
        retry.join(homes, "record_id", "left")
        .join(visited, F.col("collection_cycle") == F.col("visited_cycle"), "left")
        .join(done, ["record_id", "analyzer_version"], "left")
    )
    unplaced = F.col("collection_cycle").isNull() & F.col("home").isNotNull()
    mine = F.col("visited_cycle").isNotNull() | unplaced
    gone = F.coalesce(F.col("home"), F.lit("")) != F.coalesce("collection_cycle", "home", F.lit(""))
    kept = marked.filter(~(mine & (gone | F.coalesce("done", F.lit(False))))).select(
        "record_id",
        "analyzer_version",
        F.coalesce("collection_cycle", "home").alias("collection_cycle"),
    )
    joining = failed.join(homes, "record_id").select(
        "record_id",
        F.lit(version).alias("analyzer_version"),
        F.col("home").alias("collection_cycle"),
    )
    return joining.unionByName(kept.join(joining, KEY, "left_anti"))


def still_settled(
    settled: DataFrame,
    bronze_signatures: DataFrame,
    silver_signatures: DataFrame,
    retry: DataFrame,
    version: str,
) -> DataFrame:
    """Cycles whose partitions are as they were when they settled and that wait for no retry."""
    cycle = buckets.cycle_of_parts(*[F.col(p) for p in _PARTS])

    def tokens(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(cycle.alias("collection_cycle"), F.col("signature").alias(name))

    waiting = retry.filter(F.col("analyzer_version") == version).select("collection_cycle")
    now = (
        settled.filter(F.col("analyzer_version") == version)
        .join(tokens(bronze_signatures, "bronze_now"), "collection_cycle", "left")
        .join(tokens(silver_signatures, "silver_now"), "collection_cycle", "left")
    )
    return (
        now.filter(
            F.col("bronze_signature").eqNullSafe(F.col("bronze_now"))
            & F.col("silver_signature").eqNullSafe(F.col("silver_now"))
        )
        .drop("bronze_now", "silver_now")
        .join(waiting, "collection_cycle", "left_anti")
    )


def updated_settled(settled: DataFrame, marks: DataFrame, cleared: DataFrame) -> DataFrame:
    """Replace the marks of the (version, cycle) pairs in ``marks``, drop those in ``cleared``."""
    pair = ["analyzer_version", "collection_cycle"]
    gone = marks.select(*pair).unionByName(cleared.select(*pair))
    return settled.join(gone, pair, "left_anti").unionByName(marks.select(*settled.columns))


# -- the serving decision -------------------------------------------------------------------


def checked_decision(decision: str, version: str, memo: str) -> tuple[str, str, str]:
    if decision not in DECISIONS:
        raise ValueError(f"a decision is one of {DECISIONS}, not {decision!r}")
    if not version.strip():
        raise ValueError("a decision names the label version it serves")
    if not memo.strip():
        raise ValueError("a decision is kept with its reason")
    return decision, version.strip(), memo.strip()


def decision_row(
    spark: SparkSession, decision: str, version: str, memo: str, notify: bool, at: str | None = None
) -> DataFrame:
    kind, named, reason = checked_decision(decision, version, memo)
    stamp = at or datetime.now(UTC).isoformat(timespec="microseconds")
    return spark.createDataFrame([(stamp, kind, named, reason, bool(notify))], DECISION)


def record_decision(lake, decision: str, version: str, memo: str, notify: bool = True) -> None:
    row = decision_row(lake.spark, decision, version, memo, notify)
    log = lake.read_records("silver", "reprocess_decision")
    lake.write_records("silver", "reprocess_decision", staged(log.unionByName(row), "decisions"))


def serving_version(decisions: DataFrame) -> Column:
    """The version named last in the decision log, as a scalar subquery; null when it is empty."""
    return decisions.agg(F.max_by("analyzer_version", "decided_at").alias("serving")).scalar()


def records_of_run(silver: DataFrame, run_id: str) -> DataFrame:
    return silver.filter(F.col("run_id") == run_id)
