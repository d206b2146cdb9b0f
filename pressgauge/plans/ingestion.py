"""The collection job: landing table to Bronze, one cycle or many, as one transaction.

A run first writes all it has found - items, bodies, counters, failed sources - to a folder of its own and then
a marker. Until the marker is there nothing of the run is in the lake, and a run that is cut short leaves
nothing behind but that folder. With it the run counts: its tables are put in place, and if that is cut short, the
next job that calls ``recover`` does it again from the folder. Putting a table in place twice changes nothing.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.schemas import DATASETS, PARTITION
from pressgauge.session import remove, scratch_scope, shuffles_removed, staged
from pressgauge.sources import feeds
from pressgauge.sources.lake import with_partition

#: A folder without a marker that is older than this belongs to a run that died.
FORGOTTEN = timedelta(days=1)
#: Tables of a run that lie by cycle, and the column that names it.
_BY_CYCLE = {"news_item": "collection_cycle", "intake_count": "cycle", "intake_failure": "cycle"}


def _pending(lake) -> str:
    return f"{lake.root}/bronze/_pending"


def collect(
    lake,
    configs: DataFrame,
    attempts: DataFrame,
    pages: DataFrame,
    collected_at: str,
    retries: int = feeds.DEFAULT_RETRIES,
) -> dict[str, DataFrame]:
    """Write the cycles found in ``attempts``; a rerun replaces exactly those cycles.

    Bodies are content-addressed: a text the lake holds already is not written again, an edited
    one lands beside the old. Returns the counters, the failed sources and the new bodies.
    """
    recover(lake)
    run = f"{_pending(lake)}/{lake._stamp()}"
    with scratch_scope(lake.spark):
        got = feeds.ingested(configs, attempts, pages, F.lit(collected_at), retries)
        tables = {"news_item": got.items, "intake_count": got.counters(), "intake_failure": got.failures, "news_body": got.bodies}
        for name, rows in tables.items():
            with shuffles_removed(lake.spark):
                rows.write.format(lake.fmt).save(f"{run}/{name}")
    mark(lake, run)
    mine = cycles_of_run(lake, run)
    fresh = put_in_place(lake, run)
    return {
        "counters": _of(lake, "intake_count", mine), "failures": _of(lake, "intake_failure", mine), "new_bodies": fresh,
    }


def cycles_of_run(lake, run: str) -> DataFrame:
    """The partitions of a run's cycles; written, as the run's folder goes when all is in place."""
    seen = [lake._read(f"{run}/{name}", DATASETS["bronze", name]).select(F.col("cycle")) for name in ("intake_count", "intake_failure")]
    return staged(with_partition(seen[0].union(seen[1]).distinct(), F.col("cycle")).select(*PARTITION), "run-cycles")


def _of(lake, name: str, cycles: DataFrame) -> DataFrame:
    rows = lake.read_cycles("bronze", name)
    return rows.join(cycles, list(PARTITION), "left_semi").drop(*PARTITION)


def mark(lake, run: str) -> None:
    """From here on the run counts."""
    path = lake.spark._jvm.org.apache.hadoop.fs.Path(f"{run}/_MARKED")
    path.getFileSystem(lake.spark._jsc.hadoopConfiguration()).create(path, True).close()


def put_in_place(lake, run: str) -> DataFrame:
    """The tables of a marked run into the lake; returns the bodies that were new."""
    read = lambda name: lake._read(f"{run}/{name}", DATASETS["bronze", name])
    first = [F.col("first_seen_at"), F.col("first_seen_cycle")]
    fresh = lake.put_objects("bronze", "news_body", "body_hash", read("news_body"), first)
    for name, cycle in _BY_CYCLE.items():
        rows = read(name)
        write = lake.write_cycles if name == "news_item" else lake.write_days
        write("bronze", name, with_partition(rows, F.col(cycle)).select(*rows.columns, *PARTITION))
    remove(lake.spark, run)
    return fresh


def recover(lake) -> int:
    """Finish marked runs that were cut short, oldest first, and remove what died before its marker; returns
    how many were finished."""
    done = 0
    dead = (datetime.now(UTC) - FORGOTTEN).strftime("%Y%m%dT%H%M%S")
    for name in lake._children(_pending(lake)):
        run = f"{_pending(lake)}/{name}"
        if lake._exists(f"{run}/_MARKED"):
            put_in_place(lake, run)
            done += 1
        elif name < dead:
            remove(lake.spark, run)
    return done
