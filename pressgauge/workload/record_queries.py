"""Registered queries over observations, analyses, calls and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.functions import buckets, identity, numeric
from pressgauge.operators import picks, records, runlog, scope, shares, tone, versions
from pressgauge.operators.joins import left_join_present
from pressgauge.operators.picks import BUCKET_KEYS
from pressgauge.plans import gold
from pressgauge.session import staged
from pressgauge.workload import tables
from pressgauge.workload.oracle import round4, sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, **extra: str):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = sql(oracle, extra)
        return fn

    return register


items, labels, calls, bodies = (
    tables.observations, tables.analyses, tables.calls, tables.bodies,
)


# -- joins of the layers ----------------------------------------------------------------------


@query(
    "w3_serving_newest",
    "SELECT record_id, analyzer_version, analyzed_at FROM served",
)
def serving_newest(spark: SparkSession, sf: str) -> DataFrame:
    return picks.serving_rows(labels(spark, sf)).select(
        "record_id", "analyzer_version", "analyzed_at"
    )


@query(
    "w3_serving_version",
    "SELECT record_id, analyzer_version FROM silver QUALIFY row_number() OVER (PARTITION BY "
    "record_id ORDER BY analyzer_version = 'v1' DESC, analyzed_at DESC, analyzer_version DESC) = 1",
)
def serving_version(spark: SparkSession, sf: str) -> DataFrame:
    return picks.serving_rows(labels(spark, sf), "v1").select("record_id", "analyzer_version")


@query(
    "j1_p8_labelled_observations",
    "SELECT axis, article, collected_at, record_id, source_id, array_to_string(keys, ',') AS keys, "
    "sentiment FROM labelled",
)
def labelled_observations(spark: SparkSession, sf: str) -> DataFrame:
    rows = gold.labelled_observations(items(spark, sf), labels(spark, sf))
    return rows.withColumn("keys", F.concat_ws(",", "keys"))


@query(
    "j2_observation_body",
    "SELECT b.record_id, t.raw_text FROM bronze b LEFT JOIN "
    "(SELECT DISTINCT body_hash, raw_text FROM bodies) t USING (body_hash)",
)
def observation_body(spark: SparkSession, sf: str) -> DataFrame:
    texts = picks.first_by(bodies(spark, sf), ["body_hash"], [F.col("first_seen_at")])
    texts = texts.select("body_hash", "raw_text")
    return left_join_present(items(spark, sf), texts, "body_hash").select("record_id", "raw_text")


@query(
    "j13_unlabelled_observations",
    "SELECT record_id FROM bronze WHERE record_id NOT IN (SELECT record_id FROM silver)",
)
def unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    return (
        items(spark, sf).join(labels(spark, sf), "record_id", "left_anti").select("record_id")
    )


@query(
    "u6_cycles_without_bronze",
    "SELECT DISTINCT substr(analyzed_at, 1, 13) || ':00' AS collection_cycle FROM silver "
    "WHERE substr(analyzed_at, 1, 13) || ':00' NOT IN (SELECT collection_cycle FROM bronze)",
)
def cycles_without_bronze(spark: SparkSession, sf: str) -> DataFrame:
    """Labels filed under the hour they were made in; some were made where nothing was collected."""
    cycle = F.concat(F.substring("analyzed_at", 1, 13), F.lit(":00"))
    silver = labels(spark, sf).select(cycle.alias("collection_cycle"))
    return versions.cycles_without_bronze(silver, items(spark, sf), ["collection_cycle"])


@query(
    "j3_w4_record_latest",
    "SELECT * FROM record_latest",
)
def record_latest(spark: SparkSession, sf: str) -> DataFrame:
    return records.record_latest(labels(spark, sf), items(spark, sf), calls(spark, sf))


@query("a8_body_share", "SELECT * FROM body_share")
def body_share(spark: SparkSession, sf: str) -> DataFrame:
    return records.body_share(items(spark, sf))


@query(
    "a9_run_call",
    "SELECT run_id, call_outcome, count(*) AS calls FROM calls WHERE decoded "
    "GROUP BY run_id, call_outcome",
)
def run_call(spark: SparkSession, sf: str) -> DataFrame:
    return records.run_call(calls(spark, sf))


@query(
    "w13_j8_x20_record_versions",
    "SELECT s.record_id, row_number() OVER (PARTITION BY s.record_id ORDER BY analyzed_at DESC, "
    "analyzer_version DESC) AS place, place = 1 AS selected, analyzer_version, analyzed_at, "
    "analysis_status, sentiment, confidence, s.run_id, CASE WHEN no_call_reason IS NOT NULL THEN "
    "'no-call' WHEN s.call_id IS NULL THEN 'unrecorded' WHEN c.call_id IS NULL THEN "
    "'call-record-absent' ELSE 'call' END AS exchange_state, no_call_reason, c.call_outcome, "
    "o.call_id AS reused_from, o.call_outcome AS origin_outcome "
    "FROM silver s LEFT JOIN calls c ON c.call_id = s.call_id AND no_call_reason IS NULL "
    "LEFT JOIN calls o ON o.call_id = c.reused_from_call_id",
)
def record_versions(spark: SparkSession, sf: str) -> DataFrame:
    return records.record_versions(labels(spark, sf), calls(spark, sf))


# -- the record list --------------------------------------------------------------------------

_LISTED = (
    "record_id, coalesce(title, '') AS title, coalesce(source_id, '') AS source_id, "
    "coalesce(collected_at, '') AS collected_at, analysis_status, sentiment, confidence, "
    "analyzer_version, analyzed_at, run_id, versions, exchange_state, call_outcome, no_call_reason"
)


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return records.record_latest(labels(spark, sf), items(spark, sf), calls(spark, sf))


@query(
    "q12_l6_record_list",
    f"SELECT {_LISTED} FROM record_latest ORDER BY analyzed_at DESC, record_id LIMIT 50",
)
def record_list(spark: SparkSession, sf: str) -> DataFrame:
    return records.record_list(_latest(spark, sf))


@query(
    "q12_p6_x22_record_search",
    f"SELECT {_LISTED} FROM record_latest WHERE (contains(lower(record_id), 'story 42') "
    "OR contains(lower(coalesce(title, '')), 'story 42')) AND call_outcome = 'parsed' "
    "ORDER BY analyzed_at DESC, record_id LIMIT 50",
)
def record_search(spark: SparkSession, sf: str) -> DataFrame:
    return records.record_list(_latest(spark, sf), " STORY 42 ", symptom="call_outcome:parsed")


@query(
    "q12_l6_record_list_size",
    "SELECT count(*) AS total, count(*) FILTER (analysis_status = 'unanalyzed') AS matched, "
    "matched > 50 AS truncated FROM record_latest",
)
def record_list_size(spark: SparkSession, sf: str) -> DataFrame:
    return records.record_list_size(_latest(spark, sf), symptom="analysis_status:unanalyzed")


# -- one record, one run ----------------------------------------------------------------------


@query(
    "q9_j9_lineage",
    "SELECT b.record_id, b.source_id, b.axis, b.title, b.source_url, b.body_hash, "
    "b.body_available, b.collected_at, b.collection_cycle, b.rank, b.view_count, "
    "t.raw_text IS NOT NULL AS body_preserved, t.raw_text, t.first_seen_at, "
    "s.record_id IS NOT NULL AS has_silver, s.analysis_status, s.sentiment, s.analyzer_version "
    "FROM bronze b LEFT JOIN (SELECT body_hash, any_value(raw_text) AS raw_text, "
    "min(first_seen_at) AS first_seen_at FROM bodies GROUP BY body_hash) t USING (body_hash) "
    "LEFT JOIN (SELECT * FROM silver QUALIFY row_number() OVER (PARTITION BY record_id "
    "ORDER BY analyzed_at, analyzer_version) = 1) s ON s.record_id = b.record_id",
)
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    texts = picks.first_by(bodies(spark, sf), ["body_hash"], [F.col("first_seen_at")])
    rows = records.lineage(items(spark, sf), texts, labels(spark, sf))
    return rows.select(
        "record_id", "source_id", "axis", "title", "source_url", "body_hash", "body_available",
        "collected_at", "collection_cycle", "rank", "view_count", "body_preserved", "raw_text",
        "first_seen_at", "has_silver", "analysis_status", "sentiment", "analyzer_version",
    )


@query(
    "q9_trace_selection",
    "SELECT min(record_id) FILTER (collection_cycle = first_cycle) AS record_id, "
    "'auto' AS selection FROM bronze, (SELECT min(collection_cycle) AS first_cycle FROM bronze)",
)
def trace_selection(spark: SparkSession, sf: str) -> DataFrame:
    return records.selection(items(spark, sf))


@query(
    "q11_a17_l9_run_symptoms",
    "SELECT run_id, 'analysis_status' AS kind, analysis_status AS name, count(*) AS count "
    "FROM silver GROUP BY ALL UNION ALL SELECT run_id, 'no_call_reason', no_call_reason, count(*) "
    "FROM silver WHERE no_call_reason IS NOT NULL GROUP BY ALL UNION ALL "
    "SELECT run_id, 'call_outcome', call_outcome, count(*) FROM calls WHERE decoded GROUP BY ALL",
)
def run_symptoms(spark: SparkSession, sf: str) -> DataFrame:
    return records.run_symptoms(labels(spark, sf), records.run_call(calls(spark, sf)))


@query(
    "q11_a17_run_totals",
    "SELECT run_id, coalesce(records, 0) AS records, coalesce(calls, 0) AS calls FROM "
    "(SELECT run_id, count(*) AS records FROM silver GROUP BY run_id) FULL JOIN "
    "(SELECT run_id, count(*) AS calls FROM calls WHERE decoded GROUP BY run_id) USING (run_id)",
)
def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return records.run_totals(
        records.run_symptoms(labels(spark, sf), records.run_call(calls(spark, sf)))
    )


@query(
    "j17_records_of_run",
    "SELECT record_id, analyzer_version FROM silver WHERE run_id = 'run-2024-01-07'",
)
def records_of_run(spark: SparkSession, sf: str) -> DataFrame:
    return versions.records_of_run(labels(spark, sf), "run-2024-01-07").select(
        "record_id", "analyzer_version"
    )


_TEXTS = {
    "texts": "SELECT body_hash, min(first_seen_at) AS first_seen_at FROM bodies GROUP BY body_hash",
    "shown": "SELECT DISTINCT coalesce(nullif(source_url, ''), record_id) AS article, body_hash "
    "FROM bronze WHERE body_hash <> ''",
    "histories": "SELECT article, body_hash, first_seen_at, row_number() OVER (PARTITION BY article "
    "ORDER BY first_seen_at, body_hash) AS version, version = count(*) OVER (PARTITION BY article) "
    "AS latest FROM shown JOIN texts USING (body_hash)",
}


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return picks.first_by(bodies(spark, sf), ["body_hash"], [F.col("first_seen_at")])


@query("q11_w12_article_bodies", "SELECT * FROM histories", **_TEXTS)
def article_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return records.article_bodies(items(spark, sf), _texts(spark, sf)).drop(
        "raw_text", "first_seen_cycle"
    )


@query(
    "q11_w12_analyzed_bodies",
    "SELECT record_id, article, body_hash, first_seen_at, version, latest FROM "
    "(SELECT record_id, coalesce(nullif(source_url, ''), record_id) AS article, body_hash "
    "FROM bronze) JOIN histories USING (article, body_hash)",
    **_TEXTS,
)
def analyzed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return records.analyzed_bodies(items(spark, sf), _texts(spark, sf))


@query(
    "q11_body_history",
    "SELECT h.article, h.body_hash, h.first_seen_at, h.version, h.latest, h.body_hash = o.body_hash "
    "AS analyzed FROM histories h JOIN bronze o ON o.source_url = h.article "
    "WHERE o.record_id = 'r000000000042'",
    **_TEXTS,
)
def body_history(spark: SparkSession, sf: str) -> DataFrame:
    return records.body_history(items(spark, sf), _texts(spark, sf), "r000000000042").drop(
        "raw_text", "first_seen_cycle"
    )


# -- relabelling ------------------------------------------------------------------------------

_SCOPE = {
    "since": "SELECT max(strptime(collected_at, '%Y-%m-%dT%H:%M:%S+00:00')) - INTERVAL 7 DAY AS since FROM bronze",
    "scoped": "SELECT b.* FROM bronze b, since s WHERE axis = 'KR' "
    "AND strptime(collected_at, '%Y-%m-%dT%H:%M:%S+00:00') >= s.since",
    "windowed": "SELECT * FROM silver WHERE record_id IN (SELECT record_id FROM scoped)",
    "progress": "SELECT collection_cycle, count(*) AS kept, count(*) FILTER (record_id IN "
    "(SELECT record_id FROM silver WHERE analyzer_version = 'v2')) AS done, kept - done AS todo "
    "FROM scoped GROUP BY collection_cycle",
    "once": "SELECT * FROM windowed QUALIFY row_number() OVER (PARTITION BY record_id, "
    "analyzer_version ORDER BY analyzed_at, run_id) = 1",
    "said": "SELECT analyzer_version, unnest(coalesce(subject_categories, narrative_subjects)) "
    "AS subject FROM once",
    "spoken": "SELECT analyzer_version, subject, count(*) AS mentions FROM said GROUP BY ALL",
    "shares_of": "SELECT *, mentions::DOUBLE / (sum(mentions) OVER (PARTITION BY "
    "analyzer_version))::DOUBLE AS share FROM spoken",
}


def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    every = items(spark, sf)
    return scope.in_scope(every, "KR", since=scope.window_since(every, "7d"))


def _windowed(spark: SparkSession, sf: str) -> DataFrame:
    return scope.window_analyses(labels(spark, sf), _scoped(spark, sf))


@query("p1_p2_scope", "SELECT record_id FROM scoped", **_SCOPE)
def scoped(spark: SparkSession, sf: str) -> DataFrame:
    return _scoped(spark, sf).select("record_id")


@query(
    "q10_j5_window_analyses", "SELECT record_id, analyzer_version FROM windowed", **_SCOPE
)
def window_analyses(spark: SparkSession, sf: str) -> DataFrame:
    return _windowed(spark, sf).select("record_id", "analyzer_version")


@query(
    "q10_a11_window_sources",
    "SELECT source_id, count(*) AS kept FROM scoped GROUP BY source_id",
    **_SCOPE,
)
def window_sources(spark: SparkSession, sf: str) -> DataFrame:
    return scope.window_sources(_scoped(spark, sf))


@query(
    "q10_a10_window_versions",
    "SELECT analyzer_version, count(*) AS records, min(analyzed_at) AS first_analyzed_at, "
    "max(analyzed_at) AS last_analyzed_at FROM windowed GROUP BY analyzer_version",
    **_SCOPE,
)
def window_versions(spark: SparkSession, sf: str) -> DataFrame:
    return scope.window_versions(_windowed(spark, sf))


@query("q10_a12_j6_cycle_progress", "SELECT * FROM progress", **_SCOPE)
def cycle_progress(spark: SparkSession, sf: str) -> DataFrame:
    seen = scope.window_versions(_windowed(spark, sf))
    return scope.cycle_progress(
        _scoped(spark, sf), labels(spark, sf), scope.latest_version(seen)
    )


@query(
    "q10_a12_progress_totals",
    "SELECT CAST(sum(kept) AS BIGINT) AS total, CAST(sum(done) AS BIGINT) AS already, "
    "CAST(sum(todo) AS BIGINT) AS todo FROM progress",
    **_SCOPE,
)
def progress_totals(spark: SparkSession, sf: str) -> DataFrame:
    return scope.progress_totals(
        scope.cycle_progress(_scoped(spark, sf), labels(spark, sf), "v2")
    )


@query(
    "q10_a13_throughput",
    "SELECT per_minute, ceil((SELECT sum(todo) FROM progress)::DOUBLE / per_minute) "
    "AS eta_minutes FROM (SELECT count(*)::DOUBLE / ((epoch_us(max("
    "strptime(analyzed_at, '%Y-%m-%dT%H:%M:%S+00:00'))) - epoch_us(min("
    "strptime(analyzed_at, '%Y-%m-%dT%H:%M:%S+00:00'))))::DOUBLE / "
    "60000000.0::DOUBLE) AS per_minute FROM windowed WHERE analyzer_version = 'v2')",
    **_SCOPE,
)
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    todo = (
        scope.cycle_progress(_scoped(spark, sf), labels(spark, sf), "v2")
        .agg(F.sum("todo").alias("todo"))
        .scalar()
    )
    return scope.throughput(_windowed(spark, sf), "v2", todo)


@query(
    "q10_a14_mention_shares",
    "SELECT analyzer_version, subject, mentions, share FROM shares_of",
    **_SCOPE,
)
def mention_shares(spark: SparkSession, sf: str) -> DataFrame:
    return scope.mention_shares(_windowed(spark, sf), ["v1", "v2"])


@query(
    "q10_a14_unanalyzed_share",
    "SELECT analyzer_version, count(*) AS records, count(*) FILTER (analysis_status <> "
    "'analyzed')::DOUBLE / count(*)::DOUBLE AS unanalyzed_share FROM once "
    "GROUP BY analyzer_version",
    **_SCOPE,
)
def unanalyzed_share(spark: SparkSession, sf: str) -> DataFrame:
    return scope.unanalyzed_share(_windowed(spark, sf))


@query(
    "q10_j10_u3_l8_compare_versions",
    "SELECT subject, coalesce(b.share, 0.0::DOUBLE) AS before_share, "
    "coalesce(a.share, 0.0::DOUBLE) AS after_share, after_share - before_share AS delta "
    "FROM (SELECT * FROM shares_of WHERE analyzer_version = 'v1') b "
    "FULL JOIN (SELECT * FROM shares_of WHERE analyzer_version = 'v2') a USING (subject)",
    **_SCOPE,
)
def compare_versions(spark: SparkSession, sf: str) -> DataFrame:
    return scope.compare_versions(_windowed(spark, sf), "v1", "v2")


_RETRY = {
    "retry": "SELECT record_id, 'v1' AS analyzer_version, collection_cycle FROM bronze "
    "WHERE rank = 7",
}


def _retry(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).filter("rank = 7").select(
        "record_id", F.lit("v1").alias("analyzer_version"), "collection_cycle"
    )


@query(
    "p3_u4_pending",
    "SELECT record_id FROM bronze WHERE record_id NOT IN (SELECT record_id FROM silver "
    "WHERE analyzer_version = 'v2' AND run_id <> '') OR record_id IN "
    "(SELECT record_id FROM retry WHERE analyzer_version = 'v2')",
    **_RETRY,
)
def pending(spark: SparkSession, sf: str) -> DataFrame:
    return versions.pending(
        items(spark, sf), labels(spark, sf), _retry(spark, sf), "v2"
    ).select("record_id")


@query(
    "t5_retry_list",
    "SELECT record_id, analyzer_version, collection_cycle FROM retry WHERE record_id NOT IN "
    "(SELECT record_id FROM bronze WHERE view_count >= 10) "
    "UNION SELECT record_id, 'v1', collection_cycle FROM bronze WHERE view_count >= 100",
    **_RETRY,
)
def retry_list(spark: SparkSession, sf: str) -> DataFrame:
    present = items(spark, sf)
    analyzed = present.filter("view_count >= 10").select("record_id")
    failed = present.filter("view_count >= 100").select("record_id")
    return versions.updated_retries(_retry(spark, sf), present, analyzed, failed, "v1")


@query(
    "p4_sample_recent",
    "SELECT record_id, collected_at FROM bronze WHERE axis = 'US' "
    "ORDER BY collected_at DESC, record_id LIMIT 500",
)
def sample_recent(spark: SparkSession, sf: str) -> DataFrame:
    chosen = scope.sample(scope.in_scope(items(spark, sf), "US"), 500, "recent")
    return chosen.select("record_id", "collected_at")


@query(
    "p4_sample_random",
    "SELECT record_id FROM bronze ORDER BY md5('v2|2024-01-01|' || record_id), record_id LIMIT 500",
)
def sample_random(spark: SparkSession, sf: str) -> DataFrame:
    return scope.sample(items(spark, sf), 500, "random", "v2|2024-01-01").select("record_id")


# -- counts -----------------------------------------------------------------------------------


@query(
    "a1_mentions",
    "SELECT axis, bucket_unit, time_bucket, source_id, subject, count(*) AS n, "
    "count(*) FILTER (pos = 0) AS articles FROM (SELECT axis, bucket_unit, time_bucket, "
    "source_id, unnest(keys) AS subject, unnest(range(len(keys))) AS pos FROM picks "
    "WHERE len(keys) > 0) GROUP BY ALL UNION ALL SELECT axis, bucket_unit, time_bucket, "
    "source_id, NULL, 0, count(*) FROM picks WHERE len(keys) = 0 GROUP BY ALL",
)
def mentions(spark: SparkSession, sf: str) -> DataFrame:
    rows = gold.all_picks(items(spark, sf), labels(spark, sf))
    return shares.mentions(rows, BUCKET_KEYS)


@query(
    "a1_source_articles",
    "SELECT axis, bucket_unit, time_bucket, source_id, source_total, weight, weight_sum "
    "FROM weights",
)
def source_articles(spark: SparkSession, sf: str) -> DataFrame:
    rows = gold.all_picks(items(spark, sf), labels(spark, sf))
    return shares.source_totals(shares.mentions(rows, BUCKET_KEYS), BUCKET_KEYS).select(
        *BUCKET_KEYS, "source_id", "source_total", "weight", "weight_sum"
    )


@query(
    "a20_serving_outcomes",
    "SELECT (SELECT count(*) FROM served) AS served, count(*) - (SELECT count(*) FROM served) "
    "AS superseded FROM silver",
)
def serving_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    silver = labels(spark, sf)
    return runlog.serving_outcomes(silver, picks.serving_rows(silver))


_STAGE = {
    "booked": "SELECT run_id, outcome_name, count(*) AS outcome_count FROM (SELECT run_id, CASE "
    "WHEN analysis_status = 'unanalyzed' AND call_id IS NOT NULL THEN 'call_failed' "
    "WHEN confidence < 0.1 THEN 'reused' ELSE analysis_status END AS outcome_name FROM silver) "
    "GROUP BY ALL",
}


@query(
    "a18_stage_outcomes",
    "SELECT run_id, outcome_name, outcome_count FROM booked UNION ALL "
    "SELECT run_id, 'not_reached', 5 FROM booked GROUP BY run_id",
    **_STAGE,
)
def stage_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Each run as a stage that failed with five inputs still to come."""
    failed = (F.col("analysis_status") == "unanalyzed") & F.col("call_id").isNotNull()
    name = runlog.label_outcome(failed, F.col("confidence") < 0.1, F.col("analysis_status"))
    silver = labels(spark, sf)
    booked = silver.groupBy("run_id", name.alias("outcome_name")).agg(
        F.count("*").alias("outcome_count")
    )
    inputs = silver.groupBy("run_id").agg((F.count("*") + 5).alias("input_count")).withColumn(
        "failed", F.lit(True)
    )
    return runlog.stage_outcomes(booked, inputs, ["run_id"])


@query(
    "a19_run_rollup",
    "SELECT run_id, CASE WHEN bool_or(stage_status = 'failed') THEN 'failed' ELSE 'succeeded' "
    "END AS run_status, min(stage_started_at) AS run_started_at, max(stage_ended_at) "
    "AS run_ended_at, string_agg(stage_name, ',' ORDER BY stage_started_at, stage_name) AS stages "
    "FROM latest_stage GROUP BY run_id",
    latest_stage="SELECT * FROM (SELECT run_id, record_id, call_outcome AS stage_name, "
    "called_at AS stage_started_at, called_at AS stage_ended_at, CASE WHEN call_id LIKE '%7' "
    "THEN 'failed' ELSE 'succeeded' END AS stage_status FROM calls) QUALIFY row_number() OVER "
    "(PARTITION BY run_id, stage_name ORDER BY stage_started_at DESC, record_id DESC) = 1",
)
def run_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Calls read as stage attempts: the outcome names the stage, a later call retries it."""
    stages = calls(spark, sf).select(
        "run_id",
        F.col("call_outcome").alias("stage_name"),
        F.col("called_at").alias("stage_started_at"),
        F.col("called_at").alias("stage_ended_at"),
        F.when(F.col("call_id").endswith("7"), "failed").otherwise("succeeded").alias(
            "stage_status"
        ),
        F.lit(1).alias("input_count"),
        F.lit(1).alias("output_count"),
        F.col("record_id").alias("attempt"),
    )
    return runlog.merged_runs(stages).withColumn("stages", F.concat_ws(",", "stages.stage_name"))


@query(
    "w16_q13_serving_decision",
    "SELECT arg_max(analyzer_version, (analyzed_at, record_id)) AS serving, count(*) AS decisions "
    "FROM silver",
)
def serving_decision(spark: SparkSession, sf: str) -> DataFrame:
    log = labels(spark, sf).select(
        F.concat("analyzed_at", F.lit("#"), "record_id").alias("decided_at"), "analyzer_version"
    )
    return log.agg(F.count("*").alias("decisions")).select(
        versions.serving_version(log).alias("serving"), "decisions"
    )


# -- keys, labels and times of every row ------------------------------------------------------


@query(
    "x3_t2_bucket_labels",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H') AS hour_label, strftime(ts, '%Y-%m-%d') "
    "AS day_label, strftime(ts, '%G-W%V') AS week_label FROM events",
)
def bucket_labels(spark: SparkSession, sf: str) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return tables.table(spark, sf, "events").select(
        "event_id",
        *[buckets.bucket_label(at, u).alias(f"{u}_label") for u in buckets.UNITS],
    )


@query(
    "x3_week_label_year_edges",
    "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week_label FROM orders",
)
def week_labels(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return tables.table(spark, sf, "orders").select(
        "o_orderkey", buckets.week_label(day).alias("week_label")
    )


@query(
    "x4_bucket_start",
    "SELECT o_orderkey, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_start, "
    "strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS day_start FROM orders",
)
def bucket_start(spark: SparkSession, sf: str) -> DataFrame:
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")

    def start(unit: str):
        begin = buckets.bucket_start(buckets.bucket_label(at, unit), unit)
        return F.date_format(begin, "yyyy-MM-dd").alias(f"{unit}_start")

    return tables.table(spark, sf, "orders").select("o_orderkey", start("week"), start("day"))


@query(
    "x5_cycle_partition",
    "SELECT record_id, substr(collection_cycle, 1, 4) AS year, substr(collection_cycle, 6, 2) "
    "AS month, substr(collection_cycle, 9, 2) AS day, substr(collection_cycle, 12, 2) AS hour, "
    "collection_cycle FROM bronze",
)
def cycle_partition(spark: SparkSession, sf: str) -> DataFrame:
    parts = buckets.cycle_parts(F.col("collection_cycle"))
    placed = items(spark, sf).select("record_id", *[c.alias(n) for n, c in parts.items()])
    cycle = buckets.cycle_of_parts(*[F.col(p) for p in parts])
    return placed.withColumn("collection_cycle", cycle)


@query(
    "x6_window_bounds",
    "SELECT record_id, strftime(at_hour - INTERVAL 23 HOUR, '%Y-%m-%dT%H') AS first_hour, "
    "strftime(at_hour - INTERVAL 335 HOUR, '%Y-%m-%dT%H') AS first_before FROM "
    "(SELECT record_id, strptime(substr(collected_at, 1, 13), '%Y-%m-%dT%H') AS at_hour "
    "FROM bronze)",
)
def window_bounds(spark: SparkSession, sf: str) -> DataFrame:
    end = F.to_timestamp(F.substring("collected_at", 1, 13), "yyyy-MM-dd'T'HH")
    now, _ = buckets.window_bounds(end, F.lit(24), F.lit("current"))
    before, _ = buckets.window_bounds(end, F.lit(168), F.lit("previous"))
    return items(spark, sf).select(
        "record_id", now.alias("first_hour"), before.alias("first_before")
    )


@query(
    "x1_x2_x8_identity",
    "SELECT record_id, substr(sha1(source_id || '|' || source_url || '|' || collection_cycle), 1, "
    "12) AS derived_id, sha256(title) AS title_hash, coalesce(nullif(source_url, ''), record_id) "
    "AS article FROM bronze",
)
def identity_keys(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select(
        "record_id",
        identity.record_id(
            F.col("source_id"), F.col("source_url"), F.col("collection_cycle")
        ).alias("derived_id"),
        identity.body_hash(F.col("title")).alias("title_hash"),
        identity.article_key(F.col("source_url"), F.col("record_id")).alias("article"),
    )


@query(
    "x7_x9_u5_pick_labels",
    "SELECT record_id, analyzer_version, array_to_string(coalesce(subject_categories, "
    "narrative_subjects), ',') AS keys, CASE WHEN analysis_status = 'unanalyzed' OR sentiment "
    "IS NULL THEN 'unanalyzed' ELSE sentiment END AS tone FROM silver",
)
def pick_labels(spark: SparkSession, sf: str) -> DataFrame:
    twice = F.concat(
        identity.grouping_keys(F.col("subject_categories"), F.col("narrative_subjects")),
        identity.grouping_keys(F.col("subject_categories"), F.col("narrative_subjects")),
    )
    return labels(spark, sf).select(
        "record_id",
        "analyzer_version",
        F.concat_ws(",", F.array_distinct(twice)).alias("keys"),
        identity.pick_sentiment(F.col("analysis_status"), F.col("sentiment")).alias("tone"),
    )


@query(
    "x16_x17_prompt_digest",
    "SELECT doc_id, sha256('system' || chr(0) || 'TITLE: ' || source || chr(10) || chr(10) || "
    "'BODY:' || chr(10) || text) AS digest FROM documents",
)
def prompt_digest(spark: SparkSession, sf: str) -> DataFrame:
    prompt = identity.user_prompt(F.col("source"), F.col("text"))
    return tables.table(spark, sf, "documents").select(
        "doc_id", identity.prompt_digest(F.lit("system"), prompt).alias("digest")
    )


@query(
    "x21_round4",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {round4('ratio')} AS rounded FROM "
    "(SELECT *, l_quantity / (l_quantity + l_linenumber)::DOUBLE AS ratio FROM lineitem)",
)
def rounding(spark: SparkSession, sf: str) -> DataFrame:
    ratio = F.col("l_quantity") / (F.col("l_quantity") + F.col("l_linenumber"))
    return tables.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numeric.round4(ratio).alias("rounded")
    )


# -- extensions -------------------------------------------------------------------------------

_EXT = {
    "said_tones": "SELECT axis, bucket_unit, time_bucket, source_id, unnest(keys) AS subject, "
    "sentiment FROM picks",
}


@query(
    "e1_subject_tone",
    "SELECT axis, bucket_unit, time_bucket, subject, "
    + ", ".join(
        f"count(*) FILTER (sentiment = '{k}') AS {k}"
        for k in ("positive", "neutral", "negative", "mixed", "unanalyzed")
    )
    + " FROM said_tones GROUP BY ALL",
    **_EXT,
)
def subject_tone(spark: SparkSession, sf: str) -> DataFrame:
    return tone.subject_tone(gold.all_picks(items(spark, sf), labels(spark, sf)))


@query(
    "e2_weighted_tone",
    "SELECT axis, bucket_unit, time_bucket, subject AS sentiment, raw_count, units FROM "
    "tshares_all",
)
def weighted_tone(spark: SparkSession, sf: str) -> DataFrame:
    return tone.weighted_tone(gold.all_picks(items(spark, sf), labels(spark, sf)))


@query(
    "e3_source_subject_table",
    "SELECT axis, bucket_unit, time_bucket, source_id, subject, n, "
    f"{round4('(n::DOUBLE/source_total::DOUBLE)')} AS source_share FROM "
    "(SELECT * FROM mentions JOIN totals USING (axis, bucket_unit, time_bucket, source_id)) "
    "WHERE source_total >= 5",
)
def source_subject_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = gold.all_picks(items(spark, sf), labels(spark, sf))
    return shares.source_subject_table(rows, min_mentions=5)


_CELL = round4("(coalesce(m.n, 0)::DOUBLE/c.source_total::DOUBLE)")


@query(
    "e3_source_grid",
    # Both measures; an hour's table has a line for every configured source of its axis.
    f"SELECT t.axis, t.time_bucket, t.source_id, m.subject, measure, CASE measure WHEN 'count' THEN "
    f"CAST(coalesce(m.n, 0) AS DOUBLE) ELSE m.share END AS value, t.articles, m.state, t.articles >= 2 AS enough "
    "FROM lines t JOIN grid m USING (axis, time_bucket, source_id), (VALUES ('share'), ('count')) AS v(measure) "
    "UNION ALL SELECT p.axis, p.time_bucket, p.source_id, NULL, measure, NULL, 0, 'no collection', false "
    "FROM places p LEFT JOIN lines l USING (axis, time_bucket, source_id), (VALUES ('share'), ('count')) AS v(measure) "
    "WHERE l.source_id IS NULL",
    night="SELECT * FROM picks WHERE bucket_unit = 'hour' AND time_bucket LIKE '2024-01-0%'",
    lines="SELECT axis, time_bucket, source_id, CAST(sum(len(keys)) AS BIGINT) AS source_total, count(*) AS articles "
    "FROM night GROUP BY ALL",
    said="SELECT axis, time_bucket, source_id, subject, count(*) AS n FROM (SELECT axis, time_bucket, source_id, "
    "unnest(keys) AS subject FROM night) GROUP BY ALL",
    grid=f"SELECT c.axis, c.time_bucket, c.source_id, s.subject, m.n, CASE WHEN c.source_total > 0 THEN {_CELL} ELSE 0 END "
    "AS share, CASE WHEN m.n > 0 THEN 'mentioned' ELSE 'no mention' END AS state FROM lines c JOIN (SELECT DISTINCT axis, "
    "time_bucket, subject FROM said) s USING (axis, time_bucket) LEFT JOIN said m ON m.axis = c.axis AND m.time_bucket = "
    "c.time_bucket AND m.source_id = c.source_id AND m.subject = s.subject",
    places="SELECT * FROM (SELECT DISTINCT axis, time_bucket FROM lines) JOIN (SELECT DISTINCT source_id, axis FROM bronze) "
    "USING (axis)",
)
def source_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The first nine days' hours, in which many sources are silent."""
    hours = gold.all_picks(items(spark, sf), labels(spark, sf)).filter("bucket_unit = 'hour' AND time_bucket LIKE '2024-01-0%'")
    hours = staged(hours, "hour-picks")
    configured = items(spark, sf).select("source_id", "axis").distinct()
    tables_ = [shares.source_grid(hours, configured, m, 2).withColumn("measure", F.lit(m)) for m in ("share", "count")]
    return tables_[0].unionByName(tables_[1]).drop("bucket_unit")


@query(
    "e4_articles_by_tone",
    "SELECT record_id, source_id, collected_at FROM picks WHERE axis = 'KR' AND "
    "bucket_unit = 'week' AND time_bucket = '2024-W02' AND list_contains(keys, 'click') "
    "AND sentiment = 'negative'",
)
def articles_by_tone(spark: SparkSession, sf: str) -> DataFrame:
    rows = gold.all_picks(items(spark, sf), labels(spark, sf))
    return tone.articles_by_tone(rows, "KR", "week", "2024-W02", "click", "negative")
