"""Registered queries that write a lake and read it back: sources, sinks, streams, serving.

Each run gets a fresh folder below the shared scratch folder, so runs never see each other.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.operators import versions
from pressgauge.plans import gold, labelling, refresh, runs, serving
from pressgauge.schemas import ANALYSIS, MODEL_CALL, NEWS_ITEM, PARTITION, STAGE_STATE
from pressgauge.session import remove, scratch_path, staged
from pressgauge.sources import calls
from pressgauge.sources.builds import Builds
from pressgauge.sources.lake import Lake, with_cycle, with_partition
from pressgauge.streaming import observations as stream
from pressgauge.workload import tables
from pressgauge.workload.gold_queries import spark_units
from pressgauge.workload.oracle import _CTES, sql
from pressgauge.workload.screen_queries import published

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **extra: str):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(oracle, extra)
        return fn

    return register


def _new_lake(spark: SparkSession, fmt: str = "parquet") -> Lake:
    return Lake(spark, scratch_path(spark, "lake"), fmt)


def _fields(ddl: str) -> list[str]:
    """The parts of a flat list of columns; commas inside types don't count."""
    return re.split(r", (?=[a-z_]+ (?:string|bigint|array))(?![^<]*>)", ddl)


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Observations with the partition of the hour in which each was collected."""
    placed = with_partition(tables.observations(spark, sf), F.col("collection_cycle"))
    return placed.select(*_names(NEWS_ITEM), *PARTITION)


_HOURLY = {
    "hourly": "SELECT *, substr(collected_at, 1, 4) AS year, substr(collected_at, 6, 2) AS month, "
    "substr(collected_at, 9, 2) AS day, substr(collected_at, 12, 2) AS hour FROM bronze",
}


def _stored_hourly(spark: SparkSession, sf: str) -> Lake:
    lake = _new_lake(spark)
    lake.write_cycles("bronze", "news_item", _hourly(spark, sf))
    return lake


# -- partitioned datasets ---------------------------------------------------------------------


@query(
    "k2_t1_replaced_cycles",
    "SELECT record_id, source_id, day, hour, CASE WHEN again THEN rank + 1000 ELSE rank END AS rank "
    "FROM (SELECT *, day = '07' AND view_count >= 5 AS again, day = '07' AND bool_or(view_count >= 5) "
    "OVER (PARTITION BY collection_cycle) AS touched FROM hourly) WHERE again OR NOT touched",
    **_HOURLY,
)
def replaced_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """The cycles of a day written again with fewer, changed rows; the other cycles stay."""
    lake = _stored_hourly(spark, sf)
    again = _hourly(spark, sf).filter("day = '07' AND view_count >= 5")
    lake.write_cycles("bronze", "news_item", again.withColumn("rank", F.col("rank") + 1000))
    return lake.read_cycles("bronze", "news_item").select(
        "record_id", "source_id", "day", "hour", "rank"
    )


@query(
    "s1_one_cycle",
    "SELECT record_id, title, body_available FROM hourly WHERE collection_cycle = "
    "(SELECT min(collection_cycle) FROM hourly)",
    **_HOURLY,
)
def one_cycle(spark: SparkSession, sf: str) -> DataFrame:
    lake = _stored_hourly(spark, sf)
    first = tables.observations(spark, sf).agg(F.min("collection_cycle")).first()[0]
    return lake.read_cycle("bronze", "news_item", first).select(
        "record_id", "title", "body_available"
    )


@query(
    "s2_x5_partitions",
    "SELECT DISTINCT year, month, day, hour, collection_cycle FROM hourly",
    **_HOURLY,
)
def partitions(spark: SparkSession, sf: str) -> DataFrame:
    return with_cycle(_stored_hourly(spark, sf).partitions("bronze", "news_item"))


@query(
    "s3_t4_changed_cycles",
    "SELECT DISTINCT year, month, day, hour FROM hourly WHERE day IN ('03', '17')",
    **_HOURLY,
)
def changed_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles whose signature differs after those of two days were written again."""
    lake = _stored_hourly(spark, sf)
    keys = list(PARTITION)
    before = lake.signatures("bronze", "news_item")
    path = scratch_path(spark, "signatures")
    before.write.parquet(path)
    lake.write_cycles("bronze", "news_item", _hourly(spark, sf).filter("day IN ('03', '17')"))
    after = lake.signatures("bronze", "news_item")
    same = [*keys, "signature"]
    return after.join(spark.read.schema(before.schema).parquet(path), same, "left_anti").select(
        *keys
    )


@query(
    "s4_json_lines",
    "SELECT record_id, axis, rank, body_available, collected_at FROM hourly",
    **_HOURLY,
)
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same folder layout as JSON lines, written and read with the declared schema."""
    lake = _new_lake(spark, "json")
    lake.write_cycles("bronze", "news_item", _hourly(spark, sf))
    return lake.read_cycles("bronze", "news_item").select(
        "record_id", "axis", "rank", "body_available", "collected_at"
    )


@query(
    "k6_relayed_to_cycles",
    "SELECT s.record_id, s.analyzer_version, d.day FROM silver s JOIN hourly d USING (record_id)",
    **_HOURLY,
)
def relayed(spark: SparkSession, sf: str) -> DataFrame:
    lake = _new_lake(spark)
    flat = tables.analyses(spark, sf).withColumn(
        "sentiment_rationale", F.lit(None).cast("string")
    )
    located = _hourly(spark, sf).select("record_id", "collection_cycle")
    lake.relay_to_cycles("silver", "analysis", flat.select(*_names_of_analysis()), located)
    return lake.read_cycles("silver", "analysis").select("record_id", "analyzer_version", "day")


def _names_of_analysis() -> list[str]:
    return _names(ANALYSIS)


# -- record and object datasets ---------------------------------------------------------------


@query(
    "k1_replaced_records",
    "SELECT subject, axis, bucket_unit, time_bucket, raw_count FROM trend "
    "WHERE bucket_unit <> 'hour'",
)
def replaced_records(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots of one dataset; readers see the second."""
    lake = _new_lake(spark)
    trend = published(spark, sf).subject_trend
    lake.write_records("gold", "subject_trend", trend, ["bucket_unit"])
    lake.write_records("gold", "subject_trend", trend.filter("bucket_unit <> 'hour'"))
    return lake.read_records("gold", "subject_trend").select(
        "subject", "axis", "bucket_unit", "time_bucket", "raw_count"
    )


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("cache_key"),
        F.col("text").alias("reply"),
        F.lit("m").alias("model"),
        F.lit("v1").alias("analyzer_version"),
        F.lit("2024-01-01T00:00:00+00:00").alias("first_seen_at"),
        F.lit(None).cast("string").alias("call_id"),
    )


@query(
    "k3_appended_new_keys",
    "SELECT DISTINCT sha256(text) AS cache_key, length(text) AS size FROM documents",
)
def appended_new(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of one language first, then of all: stored keys are not added again."""
    lake = _new_lake(spark)
    english = tables.table(spark, sf, "documents").filter("lang = 'en'").select(
        F.sha2("text", 256).alias("cache_key")
    )
    every = _replies(spark, sf)
    lake.append_new(
        "silver", "analysis_cache", "cache_key", every.join(english, "cache_key", "left_semi")
    )
    lake.append_new("silver", "analysis_cache", "cache_key", every)
    return lake.read_records("silver", "analysis_cache").select(
        "cache_key", F.length("reply").alias("size")
    )


@query(
    "k4_k7_s5_content_addressed_bodies",
    "SELECT body_hash, any_value(raw_text) AS raw_text, min(first_seen_at) AS first_seen_at, "
    "substr(sha256(body_hash), 1, 1) AS body_hash_prefix FROM bodies GROUP BY body_hash",
)
def content_addressed(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of the first half of the month, then of all of it: the first sighting stays."""
    lake = _new_lake(spark)
    texts = tables.bodies(spark, sf)
    first = [F.col("first_seen_at")]
    early = texts.filter("first_seen_at < '2024-01-16'")
    lake.put_objects("bronze", "news_body", "body_hash", early, first)
    lake.put_objects("bronze", "news_body", "body_hash", texts, first)
    return (
        lake.read_objects("bronze", "news_body", "body_hash")
        .select("body_hash", "raw_text", "first_seen_at", "body_hash_prefix")
        .orderBy("body_hash")
    )


@query(
    "s6_keyed_lookup",
    "SELECT DISTINCT body_hash, raw_text FROM bodies WHERE raw_text = 'body of 42 version 1'",
)
def keyed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    lake = _new_lake(spark)
    lake.put_objects(
        "bronze", "news_body", "body_hash", tables.bodies(spark, sf), [F.col("first_seen_at")]
    )
    key = "sha2('body of 42 version 1', 256)"
    value = spark.range(1).select(F.expr(key).alias("k")).first()["k"]
    return lake.get_object("bronze", "news_body", "body_hash", value).select(
        "body_hash", "raw_text"
    )


@query(
    "k5_upserted_records",
    "SELECT body_hash, max(first_seen_at) AS first_seen_at FROM bodies GROUP BY body_hash",
)
def upserted(spark: SparkSession, sf: str) -> DataFrame:
    lake = _new_lake(spark)
    texts = tables.bodies(spark, sf)
    newest = [F.col("first_seen_at").desc()]
    early = texts.filter("first_seen_at < '2024-01-16'")
    lake.upsert_objects("bronze", "news_body", "body_hash", early, newest)
    lake.upsert_objects("bronze", "news_body", "body_hash", texts, newest)
    return lake.read_objects("bronze", "news_body", "body_hash").select(
        "body_hash", "first_seen_at"
    )


# -- label versions ---------------------------------------------------------------------------


def _silver_rows(spark: SparkSession, sf: str, version: str | None = None) -> DataFrame:
    """Analyses of one version or of both."""
    rows = tables.analyses(spark, sf)
    if version:
        rows = rows.filter(F.col("analyzer_version") == version)
    return rows.withColumn("sentiment_rationale", F.lit(None).cast("string")).select(
        *_names_of_analysis()
    )


def _stored(lake: Lake) -> DataFrame:
    return lake.read_cycles("silver", "analysis").select(
        "record_id", "analyzer_version", "day", "analysis_status"
    )


_BESIDE = (
    "SELECT s.record_id, s.analyzer_version, d.day, s.analysis_status "
    "FROM silver s JOIN hourly d USING (record_id)"
)


@query("k8_coexisting_versions", _BESIDE, **_HOURLY)
def coexisting(spark: SparkSession, sf: str) -> DataFrame:
    lake = _stored_hourly(spark, sf)
    located = lake.read_cycles("bronze", "news_item")
    for version in ("v1", "v2"):
        versions.store_analyses(lake, located, _silver_rows(spark, sf, version))
    return _stored(lake)


@query(
    "k8_retired_versions",
    _BESIDE + " WHERE NOT (s.analyzer_version = 'v1' AND s.record_id IN (SELECT record_id FROM "
    "silver WHERE analyzer_version = 'v2'))",
    **_HOURLY,
)
def retired(spark: SparkSession, sf: str) -> DataFrame:
    """A whole-lake run of v2 takes the v1 rows of the records it touched with it."""
    lake = _stored_hourly(spark, sf)
    located = lake.read_cycles("bronze", "news_item")
    versions.store_analyses(lake, located, _silver_rows(spark, sf, "v1"))
    versions.store_analyses(lake, located, _silver_rows(spark, sf, "v2"), coexist=False)
    return _stored(lake)


@query(
    "k9_pruned_orphans",
    _BESIDE + " WHERE s.analyzer_version = 'v1' AND d.day <> '11' AND d.view_count < 50",
    **_HOURLY,
)
def pruned_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Bronze loses the cycles of a day and every much-read item; Silver follows."""
    lake = _stored_hourly(spark, sf)
    located = lake.read_cycles("bronze", "news_item")
    versions.store_analyses(lake, located, _silver_rows(spark, sf, "v1"))
    versions.prune_orphans(lake, located.filter("day <> '11' AND view_count < 50"))
    return _stored(lake)


@query(
    "k11_decision_log",
    "SELECT 'publish' AS decision, 'v1' AS analyzer_version, 'first' AS memo, true AS "
    "notify_consumer UNION ALL SELECT 'rollback', max(analyzer_version), 'back', false FROM silver",
)
def decision_log(spark: SparkSession, sf: str) -> DataFrame:
    lake = _new_lake(spark)
    newest = tables.analyses(spark, sf).agg(F.max("analyzer_version").alias("v")).first()["v"]
    versions.record_decision(lake, "publish", " v1 ", "first")
    versions.record_decision(lake, "rollback", newest, " back ", notify=False)
    return lake.read_records("silver", "reprocess_decision").drop("decided_at")


def _stored_lake(spark: SparkSession, sf: str, first: str, rest: str = "false") -> Lake:
    """A lake of observations and both versions of their labels, without what ``rest`` selects."""
    lake = _new_lake(spark)
    items = _hourly(spark, sf).filter(first).filter(f"NOT ({rest})")
    lake.write_cycles("bronze", "news_item", items)
    versions.store_analyses(lake, items, _silver_rows(spark, sf), counted=False)
    return lake


_UNITS = "CAST(round({} * 10000) AS BIGINT)"
_TONES = ("positive", "neutral", "negative", "mixed", "unanalyzed")


def _flat(built: gold.Gold) -> DataFrame:
    """All values of the six datasets as (dataset, row) texts; shares in whole ten-thousandths."""
    units = lambda c: F.round(F.col(c) * 10000).cast("bigint")
    bucket = ["axis", "bucket_unit", "time_bucket"]
    window = ["axis", "range", "period", "window_start", "window_end"]
    listed = {
        "article_pick": [*bucket, "record_id", "source_id", "collected_at", F.array_join("counted_subjects", ",")],
        "subject_trend": ["subject", *bucket, "raw_count", units("normalized_share"), F.round(F.col("delta") * 100).cast("bigint"), spark_units()],
        "subject_source_contribution": ["subject", *bucket, "source_id", "raw_count", units("raw_share"), units("normalized_contribution")],
        "axis_sentiment": [*bucket, *[units(f"distribution.{t}") for t in _TONES], "analyzed_total"],
        "subject_window": ["subject", *window, "raw_count", units("normalized_share")],
        "axis_window": [*window, "collected", "analyzed_total"],
    }
    rows = built.datasets()
    flat = [rows[n].select(F.lit(n).alias("dataset"), F.concat_ws("|", *columns).alias("row")) for n, columns in listed.items()]
    return reduce(DataFrame.unionByName, flat)


_BUCKET = "axis, bucket_unit, time_bucket"
_WINDOW = "axis, range, period, window_start, window_end"
#: The DuckDB twin of :func:`_flat`.
_FLAT = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, concat_ws('|', {columns}) AS row FROM {table}"
    for name, columns, table in (
        ("article_pick", f"{_BUCKET}, record_id, source_id, collected_at, array_to_string(keys, ',')", "picks WHERE len(keys) > 0"),
        ("subject_trend", f"subject, {_BUCKET}, raw_count, units, CAST(round(delta * 100) AS BIGINT), array_to_string(spark_units, ',')", "trend"),
        ("subject_source_contribution", f"subject, {_BUCKET}, source_id, raw_count, {_UNITS.format('raw_share')}, "
         f"{_UNITS.format('normalized_contribution')}", "contrib"),
        ("axis_sentiment", f"{_BUCKET}, {', '.join(_UNITS.format(t) for t in _TONES)}, analyzed_total", "axis_sentiment"),
        ("subject_window", f"subject, {_WINDOW}, raw_count, {_UNITS.format('normalized_share')}", "subject_window"),
        ("axis_window", f"{_WINDOW}, collected, analyzed_total", "axis_window"),
    )
)


@query(
    "q13_rebuilt_with_decision",
    _FLAT,
    served="SELECT * FROM silver QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY "
    "analyzer_version = 'v1' DESC, analyzed_at DESC, analyzer_version DESC) = 1",
)
def rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Publishing a version moves a pointer; Gold of the lake is folded again and nothing is relabelled."""
    lake = _stored_lake(spark, sf, "true")
    gold.aggregate_lake(lake)
    gold.aggregate_lake(lake, ("publish", "v2", "newer"))
    return _flat(gold.aggregate_lake(lake, ("rollback", "v1", "compare looked wrong")))


@query("k10_b3_gold_datasets", _FLAT)
def gold_datasets(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(published(spark, sf))


#: What the lake of ``b3_incremental`` holds in the end, as a condition on observations.
_LEFT = "NOT (day = '11' OR (day = '19' AND view_count >= 5))"


@query(
    "b3_incremental",
    _FLAT,
    all_bronze=_CTES["bronze"],
    bronze="SELECT * FROM all_bronze WHERE substr(collected_at, 9, 2) <> '11' AND NOT (substr(collected_at, 9, 2) = '19' AND view_count >= 5)",
)
def incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Gold of a lake, then late cycles, a day that is gone and a day that is written again: only their weeks are
    folded again, and the six datasets are as if all had been."""
    lake = _stored_lake(spark, sf, "true", "day IN ('05', '25')")
    gold.aggregate_lake(lake)
    items = _hourly(spark, sf)
    late = items.filter("day IN ('05', '25')")
    lake.write_cycles("bronze", "news_item", late)
    versions.store_analyses(lake, late, _silver_rows(spark, sf), counted=False)
    gold.aggregate_lake(lake)
    again = items.filter(f"day = '19' AND {_LEFT}")
    empty = items.filter("day = '19'").join(again, list(PARTITION), "left_anti")
    lake.clear_cycles("bronze", "news_item", items.filter("day = '11'").unionByName(empty))
    lake.write_cycles("bronze", "news_item", again)
    return _flat(gold.aggregate_lake(lake))


@query(
    "t3_bounded_windows",
    "SELECT axis, range, period, window_start, window_end, collected, analyzed_total FROM axis_window",
)
def bounded_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a stored Gold, folded from the weeks they reach into and no others."""
    lake = _stored_lake(spark, sf, "true")
    gold.aggregate_lake(lake)
    return refresh.windows(refresh.window_hours(Builds(lake, "gold")))["axis_window"]


@query(
    "b2_labelled_lake",
    "SELECT record_id, day, 'unanalyzed' AS analysis_status, 'keyword_analyzer' AS no_call_reason, "
    "CASE WHEN contains(lower(title), 'fed') THEN 'Federal Reserve' ELSE '' END AS subjects "
    "FROM hourly",
    **_HOURLY,
)
def labelled_lake(spark: SparkSession, sf: str) -> DataFrame:
    """The labelling job over a whole lake; these bodies carry no tone, so no label is forced."""
    lake = _stored_hourly(spark, sf)
    lake.put_objects(
        "bronze", "news_body", "body_hash", tables.bodies(spark, sf), [F.col("first_seen_at")]
    )
    labelling.label_lake(lake, "run-1", "2024-02-01T00:00:00+00:00")
    return lake.read_cycles("silver", "analysis").select(
        "record_id", "day", "analysis_status", "no_call_reason",
        F.array_join("narrative_subjects", ",").alias("subjects"),
    )


@query(
    "t4_waiting_after_settled",
    "SELECT record_id FROM hourly WHERE day = '20'",
    **_HOURLY,
)
def waiting_after_settled(spark: SparkSession, sf: str) -> DataFrame:
    """A labelled lake is settled; rewriting one cycle with new records reopens that cycle."""
    lake = _stored_hourly(spark, sf)
    labelling.label_lake(lake, "run-1", "2024-02-01T00:00:00+00:00")
    again = _hourly(spark, sf).filter("day = '20'")
    renamed = again.withColumn("record_id", F.concat(F.lit("again-"), "record_id"))
    lake.write_cycles("bronze", "news_item", renamed)
    waiting = labelling.waiting_records(lake, labelling.KEYWORD_VERSION, labelling.Scope())
    return waiting.select(F.replace("record_id", F.lit("again-"), F.lit("")).alias("record_id"))


@query(
    "b2_k9_orphans_after_labelling",
    "SELECT record_id FROM hourly WHERE day <> '11' AND NOT (day = '12' AND view_count >= 50)",
    **_HOURLY,
)
def orphans_after_labelling(spark: SparkSession, sf: str) -> DataFrame:
    """Bronze loses the cycles of one day and many rows of another after a run; the next run lets the
    labels of both go."""
    lake = _stored_hourly(spark, sf)
    labelling.label_lake(lake, "run-1", "2024-02-01T00:00:00+00:00")
    items = _hourly(spark, sf)
    rest = items.filter("day = '12' AND view_count < 50")
    gone = items.filter("day = '11'").unionByName(items.filter("day = '12'").join(rest, list(PARTITION), "left_anti"))
    lake.clear_cycles("bronze", "news_item", gone)
    lake.write_cycles("bronze", "news_item", rest)
    labelling.label_lake(lake, "run-2", "2024-02-02T00:00:00+00:00")
    return lake.read_cycles("silver", "analysis").select("record_id")


@query(
    "b5_run_log",
    "SELECT 'run-1' AS run_id, 'failed' AS run_status, 'ingestion:succeeded,analysis:failed' AS "
    "stages, count(*) AS collected, 7 AS not_reached FROM bronze",
)
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """A stage that ran twice and a stage that failed on its way."""
    lake = _new_lake(spark)
    seen = tables.observations(spark, sf).agg(
        F.lit("collected").alias("outcome_name"), F.count("*").alias("outcome_count")
    )
    total = seen.first()["outcome_count"]
    for _ in range(2):
        with runs.RunningStage(lake, "run-1", "ingestion") as stage:
            stage.inputs = total
            stage.book(seen)
    with runs.RunningStage(lake, "run-1", "analysis") as stage:
        stage.inputs, stage.failure = 7, "nobody answered"
    row = runs.run_records(lake)

    def booked(name: str) -> Column:
        every = F.flatten(F.transform("stages", lambda s: s["outcomes"]))
        mine = F.filter(every, lambda o: o["outcome_name"] == name)
        return F.try_element_at(mine, F.lit(1))["outcome_count"].alias(name)

    named = F.transform(
        "stages", lambda s: F.concat_ws(":", s["stage_name"], s["stage_status"])
    )
    return row.select(
        "run_id", "run_status", F.concat_ws(",", named).alias("stages"), booked("collected"),
        booked("not_reached"),
    )


@query(
    "b5_compacted_log",
    "SELECT 'run-' || CAST(event_id % 50 AS VARCHAR) AS run_id, CASE WHEN bool_or(event_id % 11 = 0) THEN 'failed' ELSE "
    "'succeeded' END AS run_status, count(DISTINCT user_id) AS stages FROM events GROUP BY 1",
)
def compacted_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log of many small files, rolled up after they were put together twice: each event is a stage's end."""
    lake = _new_lake(spark)
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    # The last state of a stage counts: one that failed once is noted as failed by the latest row too.
    failed = F.bool_or(F.col("event_id") % 11 == 0)
    run = F.concat(F.lit("run-"), F.col("event_id") % 50)
    ended = tables.table(spark, sf, "events").groupBy(run.alias("run_id"), F.concat(F.lit("stage-"), "user_id").alias("stage_name")).agg(
        F.max(at).alias("noted_at"), F.when(failed, "failed").otherwise("succeeded").alias("stage_status")
    )
    state = {part.split()[0]: part.split(" ", 1)[1] for part in _fields(STAGE_STATE)}
    rows = staged(ended.select(*(F.col(c) if c in ended.columns else F.lit(None).cast(t).alias(c) for c, t in state.items())), "states")
    log = f"{lake.folder('silver', 'stage_state')}/tail"
    for half in (0, 1):
        part = rows.where(F.pmod(F.hash("stage_name"), F.lit(2)) == half)
        part.repartition(60, "run_id", "stage_name").write.mode("append").parquet(log)
        lake.compact_log("silver", "stage_state")
    return runs.run_records(lake).select("run_id", "run_status", F.size("stages").cast("bigint").alias("stages"))


# -- serving tables ---------------------------------------------------------------------------


def _served(spark: SparkSession, sf: str, name: str) -> DataFrame:
    built = serving.serving_tables(
        tables.analyses(spark, sf), tables.observations(spark, sf), tables.calls(spark, sf)
    )
    return serving.publish(_new_lake(spark), built)[name]


@query("k12_b4_record_latest_table", "SELECT * FROM record_latest")
def record_latest_table(spark: SparkSession, sf: str) -> DataFrame:
    return _served(spark, sf, "record_latest")


@query(
    "k12_b4_run_call_table",
    "SELECT run_id, call_outcome, count(*) AS calls FROM calls WHERE decoded GROUP BY ALL",
)
def run_call_table(spark: SparkSession, sf: str) -> DataFrame:
    return _served(spark, sf, "run_call")


@query("k12_b4_body_share_table", "SELECT * FROM body_share")
def body_share_table(spark: SparkSession, sf: str) -> DataFrame:
    return _served(spark, sf, "body_share")


@query(
    "b4_served_lake",
    "SELECT 'record_latest' AS dataset, concat_ws('|', record_id, versions, analyzed_at, analysis_status, sentiment, "
    f"{_UNITS.format('confidence')}, analyzer_version, run_id, call_id, no_call_reason, exchange_state, call_outcome, title, "
    "source_id, collected_at) AS row FROM record_latest "
    "UNION ALL SELECT 'body_share', concat_ws('|', body_hash, shares) FROM body_share "
    "UNION ALL SELECT 'run_call', concat_ws('|', run_id, call_outcome, count(*)) FROM calls WHERE decoded GROUP BY run_id, call_outcome",
    all_silver=_CTES["silver"],
    silver="SELECT * FROM all_silver WHERE record_id IN (SELECT record_id FROM bronze)",
)
def served_lake(spark: SparkSession, sf: str) -> DataFrame:
    """The serving job over a lake that holds observations, labels and call records; all values of its three tables."""
    lake = _stored_lake(spark, sf, "true")
    known = tables.calls(spark, sf).filter("decoded")
    state = {part.split()[0]: part.split()[1] for part in MODEL_CALL.split(", ")}
    full = known.select(*(F.col(c) if c in known.columns else F.lit(None).cast(t).alias(c) for c, t in state.items()))
    lake.put_objects("silver", "llm_call", "call_id", full, [F.col("called_at")])
    served = serving.serve_lake(lake)
    latest = served["record_latest"].withColumn("confidence", F.round(F.col("confidence") * 10000).cast("bigint"))
    flat = [rows.select(F.lit(n).alias("dataset"), F.concat_ws("|", *rows.columns).alias("row")) for n, rows in (served | {"record_latest": latest}).items()]
    return reduce(DataFrame.unionByName, flat)


@query(
    "b2_labelled_tones",
    "SELECT record_id, sentiment, CASE WHEN sentiment IS NULL THEN 'unanalyzed' WHEN sentiment = 'mixed' THEN 'low_confidence' "
    "ELSE 'analyzed' END AS analysis_status, CASE WHEN sentiment IS NULL THEN 0 WHEN sentiment = 'mixed' THEN 5500 ELSE 9200 END "
    "AS confidence FROM (SELECT record_id, CASE WHEN body_available AND num % 6 < 4 THEN "
    "['positive', 'neutral', 'negative', 'mixed'][num % 6 + 1] END AS sentiment FROM "
    "(SELECT *, CAST(substr(record_id, 2) AS BIGINT) AS num FROM bronze))",
)
def labelled_tones(spark: SparkSession, sf: str) -> DataFrame:
    """The labelling job over bodies with every tone, with none, and observations without a body."""
    number = F.substring("record_id", 2, 20).cast("bigint")
    marks = F.array(*(F.lit(f"tone={t} in this text") for t in ("positive", "neutral", "negative", "mixed")))
    text = F.concat(number.cast("string"), F.lit(" "), F.coalesce(F.get(marks, (number % 6).cast("int")), F.lit("no mark")))
    items = _hourly(spark, sf).withColumn("raw_text", text)
    items = items.withColumn("body_hash", F.when(F.col("body_available"), F.sha2("raw_text", 256)).otherwise(F.lit("")))
    lake = _new_lake(spark)
    lake.write_cycles("bronze", "news_item", items.drop("raw_text"))
    seen = [F.col("collected_at").alias("first_seen_at"), F.col("collection_cycle").alias("first_seen_cycle")]
    lake.put_objects("bronze", "news_body", "body_hash", items.filter("body_available").select("body_hash", "raw_text", *seen), [F.col("first_seen_at")])
    labelling.label_lake(lake, "run-1", "2024-02-01T00:00:00+00:00")
    return lake.read_cycles("silver", "analysis").select(
        "record_id", "sentiment", "analysis_status", F.round(F.col("confidence") * 10000).cast("int").alias("confidence")
    )


# -- streams ----------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The ``events`` file as a stream, reduced to what the tumbling counts read."""
    schema = tables.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return events.parquet(sf).selectExpr(
        "cast(ts as timestamp) AS collected_time",
        "CASE user_id % 3 WHEN 0 THEN 'KR' WHEN 1 THEN 'US' ELSE 'GLOBAL' END AS axis",
        "concat('src-', cast(user_id % 18 as string)) AS source_id",
    )


@query(
    "t2_tumbling_week_stream",
    "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CASE user_id % 3 WHEN 0 THEN "
    "'KR' WHEN 1 THEN 'US' ELSE 'GLOBAL' END AS axis, 'src-' || CAST(user_id % 18 AS VARCHAR) AS "
    "source_id, count(*) AS observations FROM events WHERE date_trunc('week', ts) < "
    "(SELECT date_trunc('week', max(ts) - INTERVAL 2 HOUR) FROM events) GROUP BY ALL",
)
def tumbling_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks the watermark has closed; the week still open is not put out."""
    counts = stream.tumbling_counts(_event_stream(spark, sf), "week")
    path = scratch_path(spark, "tumbling")
    stream.append_table(counts, path, scratch_path(spark, "tumbling-log")).awaitTermination()
    return spark.read.schema(counts.schema).parquet(path).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("week"), "axis", "source_id",
        "observations",
    )


@query(
    "t1_t6_landed_stream",
    "SELECT record_id, rank, day FROM hourly",
    **_HOURLY,
)
def landed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Observations delivered twice as files, landed by a stream: each record is there once."""
    feed = scratch_path(spark, "delivered")
    items = _hourly(spark, sf).drop(*PARTITION)
    items.write.mode("append").parquet(feed)
    items.filter("rank % 2 = 0").write.mode("append").parquet(feed)
    lake = _new_lake(spark)
    fresh = stream.deduplicated(stream.item_stream(spark, feed, "parquet"), "60 days")
    stream.land(fresh.drop("collected_time"), lake, scratch_path(spark, "log")).awaitTermination()
    return lake.read_cycles("bronze", "news_item").select("record_id", "rank", "day")


@query(
    "t6_refreshed_picks",
    "SELECT p.axis, p.bucket_unit, p.time_bucket, p.record_id FROM picks p WHERE "
    "(p.axis, p.bucket_unit, p.time_bucket) IN (SELECT (axis, bucket_unit, time_bucket) "
    "FROM placed WHERE collected_at >= '2024-01-28')",
)
def refreshed_picks(spark: SparkSession, sf: str) -> DataFrame:
    items, silver = tables.observations(spark, sf), tables.analyses(spark, sf)
    late = gold.labelled_observations(items, silver).filter("collected_at >= '2024-01-28'")
    return stream.refreshed_picks(items, silver, stream.touched_buckets(late)).select(
        "axis", "bucket_unit", "time_bucket", "record_id"
    )


@query(
    "t7_s14_call_files",
    "SELECT call_id, call_outcome, true AS decoded FROM calls UNION ALL "
    "SELECT NULL, NULL, false FROM calls WHERE call_outcome = 'call_failed'",
)
def call_files(spark: SparkSession, sf: str) -> DataFrame:
    """Call records as JSON files, read by a stream; a broken record is kept and marked."""
    folder = scratch_path(spark, "calls")
    known = tables.calls(spark, sf).select("call_id", "run_id", "record_id", "call_outcome")
    broken = known.filter("call_outcome = 'call_failed'").select(
        F.concat(F.lit('{"call_id": "'), "call_id").alias("value")
    )
    known.select(F.to_json(F.struct("*")).alias("value")).unionByName(broken).write.option(
        "compression", "none"
    ).text(f"{folder}/call_id_prefix=c")
    renamed = stream.call_stream(spark, folder, pattern="*.txt")
    path = scratch_path(spark, "call-table")
    stream.append_table(renamed, path, scratch_path(spark, "call-log")).awaitTermination()
    return (
        spark.read.schema(f"{MODEL_CALL}, file_path string, decoded boolean")
        .parquet(path)
        .select("call_id", "call_outcome", "decoded")
    )


@query(
    "s14_refreshed_call_files",
    "SELECT CASE WHEN doc_id % 7 <> 3 THEN 'call-' || CAST(doc_id AS VARCHAR) END AS call_id, doc_id % 7 <> 3 AS decoded, "
    "CASE WHEN doc_id % 7 <> 3 THEN CASE WHEN doc_id % 9 = 4 THEN 'changed' ELSE lang END END AS call_outcome, "
    "CASE WHEN doc_id % 7 <> 3 THEN length(text) END AS reply_size FROM documents WHERE doc_id % 9 <> 1",
)
def refreshed_call_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder with a file per call, read once; then files are added, written again and removed. Some are broken.

    The files of the calls that are added, changed or removed together lie in folders of their own."""
    folder, lake = scratch_path(spark, "call-files"), _new_lake(spark)
    docs = tables.table(spark, sf, "documents")
    name = F.concat(F.lit("call-"), "doc_id")

    def put(rows: DataFrame, outcome: Column) -> None:
        text = F.to_json(F.struct(name.alias("call_id"), outcome.alias("call_outcome"), F.col("text").alias("response_raw")))
        whole = F.when(F.col("doc_id") % 7 == 3, F.substring(text, 1, 20)).otherwise(text)
        # Lines of one call are one file; a task writes some hundred files.
        dealt = rows.withColumn("part", F.col("doc_id") % 45).repartition(max(1, rows.count() // 200), "part", "doc_id")
        files = dealt.groupBy("part", "doc_id").agg(F.array_join(F.collect_list(whole), "\n").alias("value"))
        calls.put_files(files.select("part", name.alias("name"), "value"), folder)

    put(docs.where("doc_id % 5 <> 2"), F.col("lang"))
    calls.refresh_calls(lake, folder, "*.txt")
    put(docs.where("doc_id % 5 = 2"), F.col("lang"))
    put(docs.where("doc_id % 9 = 4"), F.lit("changed"))
    for part in range(1, 45, 9):  # the folders of calls whose number leaves 1 by nine
        remove(spark, f"{folder}/part={part}")
    calls.refresh_calls(lake, folder, "*.txt")
    return calls.refresh_calls(lake, folder, "*.txt").select(
        "call_id", "decoded", "call_outcome", F.length("response_raw").cast("bigint").alias("reply_size")
    )


@query(
    "k7_migrated_to_objects",
    "SELECT body_hash, any_value(raw_text) AS raw_text, CASE WHEN min(first_seen_at) < '2024-01-16' THEN "
    "min(first_seen_at) ELSE 'flat' END AS first_seen_at FROM bodies GROUP BY body_hash",
)
def migrated(spark: SparkSession, sf: str) -> DataFrame:
    """A flat file of bodies moved to objects that hold some of them already; the second run finds nothing to do."""
    lake, first = _new_lake(spark), [F.col("first_seen_at")]
    texts = tables.bodies(spark, sf)
    lake.put_objects("bronze", "news_body", "body_hash", texts.filter("first_seen_at < '2024-01-16'"), first)
    flat = texts.withColumn("first_seen_at", F.lit("flat"))
    flat.write.json(f"{lake.folder('bronze', 'news_body')}.jsonl")
    lake.migrate_to_objects("bronze", "news_body", "body_hash", first)
    lake.migrate_to_objects("bronze", "news_body", "body_hash", first)
    return lake.read_objects("bronze", "news_body", "body_hash").select("body_hash", "raw_text", "first_seen_at")
