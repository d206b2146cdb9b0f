"""Schemas of the lake datasets, as DDL. Readers always pass one; nothing is inferred."""

PARTITION = ("year", "month", "day", "hour")
PARTITION_DDL = "year string, month string, day string, hour string"

NEWS_ITEM = (
    "record_id string, source_id string, axis string, rank bigint, view_count bigint, "
    "title string, source_url string, body_hash string, body_available boolean, "
    "collected_at string, collection_cycle string"
)
NEWS_BODY = (
    "body_hash string, raw_text string, first_seen_at string, first_seen_cycle string"
)
ANALYSIS = (
    "record_id string, source_url string, target_countries array<string>, "
    "narrative_subjects array<string>, subject_categories array<string>, sentiment string, "
    "sentiment_rationale string, analysis_status string, confidence double, "
    "analyzed_at string, analyzer_version string, run_id string, call_id string, "
    "no_call_reason string"
)
MODEL_CALL = (
    "call_id string, run_id string, record_id string, source_url string, "
    "analyzer_version string, call_model string, call_temperature double, "
    "prompt_system string, prompt_user string, prompt_sha256 string, response_raw string, "
    "call_outcome string, call_failure_reason string, call_attempt_count bigint, "
    "called_at string, duration_ms bigint, reused_from_call_id string"
)
#: A call record with the file it was read from.
CALL_FILE = f"{MODEL_CALL}, file_path string, file_length bigint, file_changed timestamp, decoded boolean"
STAGE = (
    "struct<stage_name:string, stage_status:string, stage_started_at:string, "
    "stage_ended_at:string, duration_ms:bigint, input_count:bigint, output_count:bigint, "
    "outcomes:array<struct<outcome_name:string, outcome_count:bigint>>, "
    "failure_reason:string, "
    "source_failures:array<struct<source_id:string, source_failure_reason:string>>>"
)
STAGE_STATE = (
    "run_id string, run_trigger string, attempt string, noted_at string, "
    "stage_name string, stage_status string, stage_started_at string, stage_ended_at string, "
    "duration_ms bigint, input_count bigint, output_count bigint, "
    "outcomes array<struct<outcome_name:string, outcome_count:bigint>>, failure_reason string, "
    "source_failures array<struct<source_id:string, source_failure_reason:string>>"
)
DECISION = (
    "decided_at string, decision string, analyzer_version string, memo string, "
    "notify_consumer boolean"
)
REPLY_CACHE = (
    "cache_key string, reply string, model string, analyzer_version string, "
    "first_seen_at string, call_id string"
)
RETRY = "record_id string, analyzer_version string, collection_cycle string"
SETTLED = (
    "analyzer_version string, collection_cycle string, bronze_signature string, "
    "silver_signature string, bronze_count bigint, silver_count bigint"
)
#: What a collected cycle's entries came to.
INTAKE_COUNT = (
    "cycle string, collected bigint, duplicates bigint, pages_asked bigint, pages_used bigint, feed_body_kept bigint"
)
INTAKE_FAILURE = "source_id string, cycle string, reason string"
FEED_CONFIG = (
    "source_id string, axis string, feed_url string, `limit` int, format string, "
    "body_extraction string"
)

BUCKET = "bucket_unit string, time_bucket string"
ARTICLE_PICK = (
    f"axis string, {BUCKET}, record_id string, source_id string, collected_at string, "
    "counted_subjects array<string>"
)
SUBJECT_TREND = (
    f"subject string, axis string, {BUCKET}, raw_count bigint, normalized_share double, "
    "delta double, spark array<double>"
)
SOURCE_CONTRIBUTION = (
    f"subject string, axis string, {BUCKET}, source_id string, raw_count bigint, "
    "raw_share double, normalized_contribution double"
)
AXIS_SENTIMENT = (
    f"axis string, {BUCKET}, distribution struct<positive:double, neutral:double, "
    "negative:double, mixed:double, unanalyzed:double>, analyzed_total bigint"
)
WINDOW = "range string, period string, window_start string, window_end string"
SUBJECT_WINDOW = f"subject string, axis string, {WINDOW}, raw_count bigint, normalized_share double"
AXIS_WINDOW = f"axis string, {WINDOW}, collected bigint, analyzed_total bigint"

#: (layer, dataset) -> schema
RECORD_LATEST = (
    "record_id string, versions bigint, analyzed_at string, analysis_status string, sentiment string, "
    "confidence double, analyzer_version string, run_id string, call_id string, no_call_reason string, "
    "exchange_state string, call_outcome string, title string, source_id string, collected_at string"
)
#: Newest observation of each article per axis and hour: what windows are folded from.
HOUR_PICK = (
    f"axis string, {BUCKET}, article string, collected_at string, record_id string, source_id string, "
    "`keys` array<string>, sentiment string"
)
#: In how many buckets of a week a subject is present.
LINE_WEEK = "axis string, bucket_unit string, subject string, buckets bigint"
#: The cycles that Gold was folded from, as they were, and the weeks their observations fall into.
FOLD_CYCLE = (
    f"{PARTITION_DDL}, bronze_signature string, silver_signature string, weeks array<string>, "
    "serving_version string"
)
POINTER = "dataset string, bucket_unit string, week string, build string"
BODY_SHARE = "body_hash string, shares bigint"
RUN_CALL = "run_id string, call_outcome string, calls bigint"

DATASETS = {
    ("bronze", "news_item"): NEWS_ITEM,
    ("bronze", "news_body"): NEWS_BODY,
    ("bronze", "intake_count"): INTAKE_COUNT,
    ("bronze", "intake_failure"): INTAKE_FAILURE,
    ("silver", "analysis"): ANALYSIS,
    ("silver", "llm_call"): MODEL_CALL,
    ("silver", "stage_state"): STAGE_STATE,
    ("silver", "reprocess_decision"): DECISION,
    ("silver", "analysis_cache"): REPLY_CACHE,
    ("silver", "analysis_retry"): RETRY,
    ("silver", "analysis_settled"): SETTLED,
    ("gold", "article_pick"): ARTICLE_PICK,
    ("gold", "subject_trend"): SUBJECT_TREND,
    ("gold", "subject_source_contribution"): SOURCE_CONTRIBUTION,
    ("gold", "axis_sentiment"): AXIS_SENTIMENT,
    ("gold", "subject_window"): SUBJECT_WINDOW,
    ("index", "record_latest"): RECORD_LATEST,
    ("index", "body_share"): BODY_SHARE,
    ("index", "run_call"): RUN_CALL,
    ("index", "call_file"): CALL_FILE,
    ("gold", "axis_window"): AXIS_WINDOW,
    ("gold", "hour_pick"): HOUR_PICK,
    ("gold", "line_week"): LINE_WEEK,
    ("gold", "fold_cycle"): FOLD_CYCLE,
    ("gold", "pointer"): POINTER,
}
