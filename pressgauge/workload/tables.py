"""The lake as Spark derives it from the given tables, one view per lake dataset.

Every row of ``events`` is one observation of one of about a hundred articles. Axis and source
follow the user, the article follows ``props.k``, so articles are observed again and again and
the newest-observation rule really decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pressgauge.session import configure


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read for the schema once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = configure(spark).read.parquet(path).schema
    return configure(spark).read.schema(_SCHEMAS[path]).parquet(path)


_EVENT = "concat('r', lpad(cast(event_id as string), 12, '0'))"
_K = "get_json_object(props, '$.k')"
_URL = f"CASE WHEN event_id % 20 = 0 THEN '' ELSE concat('https://news.example/', {_K}) END"
_BODY = f"concat('body of ', {_K}, ' version ', cast(user_id % 4 as string))"
_AT = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")"
_CYCLE = "date_format(ts, \"yyyy-MM-dd'T'HH:00\")"
_AXIS = "CASE user_id % 3 WHEN 0 THEN 'KR' WHEN 1 THEN 'US' ELSE 'GLOBAL' END"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bronze.news_item"""
    return table(spark, sf_dir, "events").selectExpr(
        f"{_EVENT} AS record_id",
        "concat('src-', cast(user_id % 18 as string)) AS source_id",
        f"{_AXIS} AS axis",
        "event_id % 100 + 1 AS rank",
        "cast(floor(value) as bigint) AS view_count",
        f"concat(event_type, ' Story ', {_K}) AS title",
        f"{_URL} AS source_url",
        f"CASE WHEN event_id % 10 = 3 THEN '' ELSE sha2({_BODY}, 256) END AS body_hash",
        "event_id % 10 <> 3 AS body_available",
        f"{_AT} AS collected_at",
        f"{_CYCLE} AS collection_cycle",
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body texts as they arrive: one row per observation that carries one."""
    return table(spark, sf_dir, "events").where("event_id % 10 <> 3").selectExpr(
        f"sha2({_BODY}, 256) AS body_hash",
        f"{_BODY} AS raw_text",
        f"{_AT} AS first_seen_at",
        f"{_CYCLE} AS first_seen_cycle",
    )


_SENTIMENT = (
    "CASE event_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' "
    "WHEN 2 THEN 'negative' WHEN 3 THEN 'mixed' END"
)
_STATUS = (
    "CASE WHEN event_id % 5 = 4 THEN 'unanalyzed' "
    "WHEN event_id % 11 = 0 THEN 'low_confidence' ELSE 'analyzed' END"
)


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """silver.analysis: version v1 of every record, v2 of every second one.

    A third of the v2 rows are older than their v1 row. One record in 97 has no observation.
    """
    events = table(spark, sf_dir, "events")
    shared = [
        "CASE WHEN event_id % 97 = 0 THEN concat('gone-', cast(event_id as string)) "
        f"ELSE {_EVENT} END AS record_id",
        f"{_URL} AS source_url",
        "array(cast(NULL as string)) AS target_countries",
    ]
    v1 = events.selectExpr(
        *shared,
        "CASE WHEN value < 1 THEN cast(array() as array<string>) "
        "WHEN value >= 20 THEN array(event_type, 'big') ELSE array(event_type) END "
        "AS narrative_subjects",
        "CASE WHEN event_id % 8 = 5 THEN array(concat('cat', cast(event_id % 7 as string))) "
        "WHEN event_id % 8 = 1 THEN cast(array() as array<string>) END AS subject_categories",
        f"{_SENTIMENT} AS sentiment",
        f"{_STATUS} AS analysis_status",
        "cast(event_id % 100 as double) / 100.0D AS confidence",
        f"{_AT} AS analyzed_at",
        "'v1' AS analyzer_version",
        "concat('run-', date_format(ts, 'yyyy-MM-dd')) AS run_id",
        "CASE WHEN event_id % 6 <> 5 AND event_id % 19 <> 0 "
        "THEN concat('call-', cast(event_id as string)) END AS call_id",
        "CASE WHEN event_id % 6 = 5 THEN 'body_unavailable' END AS no_call_reason",
    )
    v2 = events.where("event_id % 2 = 0").selectExpr(
        *shared,
        "CASE WHEN value < 1 THEN cast(array() as array<string>) "
        f"ELSE array(event_type, concat('topic', cast(cast({_K} as bigint) % 5 as string))) END "
        "AS narrative_subjects",
        "cast(NULL as array<string>) AS subject_categories",
        f"{_SENTIMENT} AS sentiment",
        "CASE WHEN event_id % 5 = 4 THEN 'unanalyzed' ELSE 'analyzed' END AS analysis_status",
        "0.9D AS confidence",
        "date_format(CASE WHEN event_id % 6 = 0 THEN ts - INTERVAL 1 HOUR "
        "ELSE ts + INTERVAL 1 HOUR END, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") AS analyzed_at",
        "'v2' AS analyzer_version",
        "concat('rerun-', date_format(ts, 'yyyy-MM-dd')) AS run_id",
        "concat('call-', cast(event_id as string)) AS call_id",
        "cast(NULL as string) AS no_call_reason",
    )
    return v1.unionByName(v2)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """silver.llm_call headers: some analyses name a call that is not there."""
    return table(spark, sf_dir, "events").where("event_id % 6 <> 5 AND event_id % 17 <> 0").selectExpr(
        "concat('call-', cast(event_id as string)) AS call_id",
        "concat('run-', date_format(ts, 'yyyy-MM-dd')) AS run_id",
        f"{_EVENT} AS record_id",
        f"{_AT} AS called_at",
        "CASE event_id % 9 WHEN 0 THEN 'parse_failed' WHEN 1 THEN 'call_failed' "
        "WHEN 2 THEN 'reused' ELSE 'parsed' END AS call_outcome",
        "CASE WHEN event_id % 9 = 2 THEN concat('call-', cast(event_id - 9 as string)) END "
        "AS reused_from_call_id",
        "event_id % 23 <> 0 AS decoded",
    )
