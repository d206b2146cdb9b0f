"""Tables the record questions read, derived from the lake after an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.operators import records


def serving_tables(
    silver: DataFrame, items: DataFrame, calls: DataFrame
) -> dict[str, DataFrame]:
    if "decoded" not in calls.columns:
        calls = calls.withColumn("decoded", F.col("call_id").isNotNull())
    return {
        "record_latest": records.record_latest(silver, items, calls),
        "body_share": records.body_share(items),
        "run_call": records.run_call(calls),
    }


def publish(lake, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Write each table as a snapshot, so readers never see half of one; ``record_latest`` in the
    order its list is read."""
    ordered = dict(tables)
    ordered["record_latest"] = tables["record_latest"].sortWithinPartitions(F.col("analyzed_at").desc(), "record_id")
    return {name: lake.write_records("index", name, rows) for name, rows in ordered.items()}


def serve_lake(lake) -> dict[str, DataFrame]:
    """The whole job on a lake: read it, derive the three tables, write them."""
    items = lake.read_cycles("bronze", "news_item")
    silver = lake.read_cycles("silver", "analysis")
    calls = lake.read_objects("silver", "llm_call", "call_id").drop("call_id_prefix")
    return publish(lake, serving_tables(silver, items, calls))
