"""The labelling job: Bronze observations in, Silver analyses and call records out.

Two labellers share the output: keyword rules, which are plain column expressions, and a model
behind a *completer*, any picklable ``(system, user) -> str`` that may raise. The model is asked
once per distinct prompt that no stored reply answers; asking is the only step in Python.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions import identity, replies, subjects
from pressgauge.functions import vocabulary as V
from pressgauge.operators import runlog, scope, versions
from pressgauge.operators.joins import left_join_present
from pressgauge.operators.picks import first_by
from pressgauge.plans import ingestion
from pressgauge.schemas import ANALYSIS, MODEL_CALL, PARTITION
from pressgauge.session import scratch_scope, staged
from pressgauge.sources.lake import cycles_of, only_cycles, with_cycle

Completer = Callable[[str, str], str]

KEYWORD_VERSION = "fake-v1"
MODEL_VERSION = "llm-v1"

INSTRUCTIONS = (
    "Read one economic news article and answer with a single JSON object: target_countries, "
    "narrative_subjects, subject_categories (one or two of: "
    + ", ".join(V.CATEGORIES)
    + "), sentiment (positive, neutral, negative or mixed), sentiment_rationale, analyzable, "
    "confidence (0 to 1)."
)


class AllCallsFailed(RuntimeError):
    """Nobody answered: an outage, not a judgement, so no analysis was written."""


def _columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def with_bodies(items: DataFrame, bodies: DataFrame) -> DataFrame:
    """Observations with their text; no hash, no stored text or an empty one is no body."""
    texts = first_by(
        bodies.select("body_hash", "raw_text", "first_seen_at"),
        ["body_hash"],
        [F.col("first_seen_at")],
    ).select("body_hash", "raw_text")
    body = F.when(F.col("body_available"), F.nullif("raw_text", F.lit("")))
    return (
        left_join_present(items, texts, "body_hash").withColumn("body", body).drop("raw_text")
    )


# -- keyword rules ----------------------------------------------------------------------------


def keyword_labels(
    items: DataFrame, bodies: DataFrame, version: str = KEYWORD_VERSION, run_id: str = ""
) -> DataFrame:
    """Subject from the title, tone and countries from marks in the body; no model is asked."""
    body = F.coalesce("body", F.lit(""))
    tone = subjects.body_tone(body)
    confidence = F.when(tone == "mixed", 0.55).when(tone.isNotNull(), 0.92).otherwise(0.0)
    empty = F.array().cast("array<string>")
    return with_bodies(items, bodies).select(
        "record_id",
        "source_url",
        F.when(F.col("body").isNotNull(), subjects.body_countries(body))
        .otherwise(empty)
        .alias("target_countries"),
        F.array_compact(F.array(subjects.title_subject(F.col("title")))).alias(
            "narrative_subjects"
        ),
        F.lit(None).cast("array<string>").alias("subject_categories"),
        tone.alias("sentiment"),
        F.lit(None).cast("string").alias("sentiment_rationale"),
        F.when(tone.isNull(), "unanalyzed")
        .otherwise(replies.judged_status(confidence))
        .alias("analysis_status"),
        confidence.cast("double").alias("confidence"),
        F.col("collected_at").alias("analyzed_at"),
        F.lit(version).alias("analyzer_version"),
        F.lit(run_id).alias("run_id"),
        F.lit(None).cast("string").alias("call_id"),
        F.lit(V.KEYWORD_ANALYZER).alias("no_call_reason"),
    )


# -- model replies ----------------------------------------------------------------------------

_ANSWER = "cache_key string, reply string, error string, duration_ms bigint"


#: Prompts that a task asks, as long as there are no more than TASKS tasks a core; what it has answered is lost
#: if it fails.
PROMPTS = 50
#: Beyond so many tasks a core tasks ask more prompts each: a task and the file of its answers cost a tenth of a
#: second, whatever it asks, and a lost one is a small part of all.
TASKS = 64


def spread(prompts: DataFrame) -> DataFrame:
    """Deal prompts out by their number: they are few bytes, but each is a long call."""
    cores = prompts.sparkSession.sparkContext.defaultParallelism
    count = prompts.count()
    wanted = min(-(-count // PROMPTS), TASKS * cores)
    return prompts.repartition(max(1, min(count, max(cores, wanted))), "cache_key")


def ask(prompts: DataFrame, completer: Completer, system: str) -> DataFrame:
    """One call per prompt; a call that raises gives its reason instead of a reply."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, user in zip(batch["cache_key"], batch["prompt_user"], strict=True):
                started = time.monotonic()
                try:
                    reply, error = completer(system, user), None
                except Exception as exc:  # one prompt's failure is that prompt's alone
                    reply, error = None, f"{type(exc).__name__}: {exc}"
                rows.append((key, reply, error, int((time.monotonic() - started) * 1000)))
            yield pd.DataFrame(rows, columns=["cache_key", "reply", "error", "duration_ms"])

    return prompts.select("cache_key", "prompt_user").mapInPandas(answer, _ANSWER)


@dataclass
class Labelled:
    """Outputs of one labelling pass: Silver rows, call records, replies worth keeping."""

    analyses: DataFrame
    calls: DataFrame
    new_replies: DataFrame
    outcomes: DataFrame

    def counts(self) -> DataFrame:
        return self.outcomes.agg(
            F.count_if("attempted").alias("attempted"),
            F.count_if(F.col("attempted") & F.col("failed")).alias("failed"),
            F.count_if("reused").alias("reused"),
            F.max_by("reason", F.when(F.col("failed"), F.col("record_id"))).alias("last_error"),
        )

    def booked(self) -> DataFrame:
        name = runlog.label_outcome(F.col("failed"), F.col("reused"), F.col("analysis_status"))
        return self.outcomes.groupBy(name.alias("outcome_name")).agg(
            F.count("*").alias("outcome_count")
        )


def model_labels(
    items: DataFrame,
    bodies: DataFrame,
    cache: DataFrame,
    completer: Completer,
    version: str = MODEL_VERSION,
    run_id: str = "",
    model: str = "",
    temperature: float | None = None,
    called_at: str = "",
    system: str = INSTRUCTIONS,
    attempt: str = "",
) -> Labelled:
    """Label observations through stored replies and, where none is usable, the model.

    Identical prompts share one call: the first record (in lake order) is the one that asked,
    the others replay its reply, as they would replay one stored by an earlier run. When that
    call fails they fail with it and are asked again by the retry list.
    """
    lit_system = F.lit(system)
    prepared = staged(with_bodies(items, bodies), "prepared")
    prompt = identity.user_prompt(F.col("title"), F.col("body"))
    reaching = prepared.filter(F.col("body").isNotNull()).select(
        "record_id", "source_url", "collected_at", prompt.alias("prompt_user")
    ).withColumn(
        "cache_key",
        identity.reply_key(F.lit(version), F.lit(model), lit_system, F.col("prompt_user")),
    )
    stored = first_by(cache, ["cache_key"], [F.col("first_seen_at")]).select(
        "cache_key", F.col("reply").alias("stored_reply"), F.col("call_id").alias("stored_call")
    )
    known = (
        stored.withColumn("parsed", replies.reply_object(F.col("stored_reply")))
        .filter(F.coalesce(replies.is_usable(F.col("parsed")), F.lit(False)))
        .drop("parsed")
    )

    # One row per prompt before any join: a prompt that most records share leaves each task once.
    leaders = first_by(
        reaching.select("cache_key", "prompt_user", "record_id", "collected_at"),
        ["cache_key"],
        [F.col("collected_at"), F.col("record_id")],
    ).join(known.select("cache_key"), "cache_key", "left_anti")
    prompts = staged(leaders, "prompts")
    # Written out before it is used: a lost executor must not ask the model a second time.
    answers = staged(ask(spread(prompts), completer, system), "answers")

    nothing = F.lit(None).cast("string")
    asked = prompts.select("cache_key", F.col("record_id").alias("leader")).join(
        answers.select("cache_key", F.col("reply").alias("live_reply"), "error", "duration_ms"),
        "cache_key",
        "left",
    )
    per_prompt = asked.select(
        "*", nothing.alias("stored_reply"), nothing.alias("stored_call")
    ).unionByName(known, allowMissingColumns=True)
    joined = reaching.join(per_prompt, "cache_key")
    replayed = F.col("stored_reply").isNotNull()
    leads = F.col("record_id") == F.col("leader")
    reply = F.coalesce("stored_reply", "live_reply")
    # A column of its own: every label reads the parsed reply, which is parsed once.
    parsed = F.col("parsed")
    told = joined.withColumn("parsed", replies.reply_object(reply)).select(
        "record_id",
        "source_url",
        "collected_at",
        "prompt_user",
        "cache_key",
        "leader",
        "stored_call",
        "error",
        reply.alias("response_raw"),
        F.coalesce(leads, F.lit(False)).alias("attempted"),
        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"),
        replayed.alias("replayed"),
        F.coalesce(replies.is_usable(parsed), F.lit(False)).alias("usable"),
        replies.judgement(parsed).alias("judgement"),
        _call_id(run_id, version, called_at, F.col("record_id"), attempt).alias("call_id"),
        _call_id(run_id, version, called_at, F.col("leader"), attempt).alias("leader_call"),
    )
    told = staged(
        told.withColumn("reused", F.col("usable") & ~F.col("attempted"))
        .withColumn("failed", ~F.col("usable"))
        .withColumn(
            "reason",
            F.when(
                F.col("failed"),
                F.coalesce("error", F.lit("the reply held no usable JSON object")),
            ),
        ),
        "labelled",
    )
    return Labelled(
        analyses=_analyses(told, prepared, version, run_id),
        calls=_call_records(told, version, run_id, model, temperature, called_at, system),
        new_replies=told.filter(F.col("attempted") & F.col("usable")).select(
            "cache_key",
            F.col("response_raw").alias("reply"),
            F.lit(model).alias("model"),
            F.lit(version).alias("analyzer_version"),
            F.col("collected_at").alias("first_seen_at"),
            "call_id",
        ),
        outcomes=_outcomes(told, prepared),
    )


def _call_id(run_id: str, version: str, called_at: str, record: Column, attempt: str) -> Column:
    """One id per run, version, record and attempt at the run: a rerun's calls are calls of their own."""
    known = [F.lit(x) for x in (run_id, version, attempt) if x]
    digest = F.sha2(F.concat_ws("|", *known, record), 256)
    stamp = "".join(c for c in called_at[:19] if c.isdigit() or c == "T")
    return F.when(
        record.isNotNull(), F.concat(F.lit(f"call-{stamp}Z-"), F.substring(digest, 1, 12))
    )


def _analyses(told: DataFrame, prepared: DataFrame, version: str, run_id: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    usable = F.col("usable")

    def judged(field: str, otherwise: Column) -> Column:
        return F.when(usable, F.col(f"judgement.{field}")).otherwise(otherwise).alias(field)

    null_text = F.lit(None).cast("string")
    answered = told.select(
        "record_id",
        "source_url",
        judged("target_countries", empty),
        judged("narrative_subjects", empty),
        judged("subject_categories", F.lit(None).cast("array<string>")),
        judged("sentiment", null_text),
        judged("sentiment_rationale", null_text),
        judged("analysis_status", F.lit("unanalyzed")),
        judged("confidence", F.lit(0.0)),
        F.col("collected_at").alias("analyzed_at"),
        F.lit(version).alias("analyzer_version"),
        F.lit(run_id).alias("run_id"),
        "call_id",
        null_text.alias("no_call_reason"),
    )
    bodiless = prepared.filter(F.col("body").isNull()).select(
        "record_id",
        "source_url",
        empty.alias("target_countries"),
        empty.alias("narrative_subjects"),
        F.lit(None).cast("array<string>").alias("subject_categories"),
        null_text.alias("sentiment"),
        null_text.alias("sentiment_rationale"),
        F.lit("unanalyzed").alias("analysis_status"),
        F.lit(0.0).alias("confidence"),
        F.col("collected_at").alias("analyzed_at"),
        F.lit(version).alias("analyzer_version"),
        F.lit(run_id).alias("run_id"),
        null_text.alias("call_id"),
        F.lit(V.BODY_UNAVAILABLE).alias("no_call_reason"),
    )
    return answered.unionByName(bodiless).select(*_columns(ANALYSIS))


def _call_records(
    told: DataFrame,
    version: str,
    run_id: str,
    model: str,
    temperature: float | None,
    called_at: str,
    system: str,
) -> DataFrame:
    outcome = (
        F.when(F.col("reused"), "reused")
        .when(F.col("usable"), "parsed")
        .when(F.col("response_raw").isNull(), "call_failed")
        .otherwise("parse_failed")
    )
    origin = F.when(F.col("replayed"), F.col("stored_call")).otherwise(F.col("leader_call"))
    return told.select(
        "call_id",
        F.lit(run_id).alias("run_id"),
        "record_id",
        "source_url",
        F.lit(version).alias("analyzer_version"),
        F.lit(model).alias("call_model"),
        F.lit(temperature).cast("double").alias("call_temperature"),
        F.lit(system).alias("prompt_system"),
        "prompt_user",
        identity.prompt_digest(F.lit(system), F.col("prompt_user")).alias("prompt_sha256"),
        "response_raw",
        outcome.alias("call_outcome"),
        F.col("reason").alias("call_failure_reason"),
        F.col("attempted").cast("bigint").alias("call_attempt_count"),
        F.lit(called_at).alias("called_at"),
        F.when(F.col("attempted"), F.col("duration_ms")).otherwise(0).alias("duration_ms"),
        F.when(F.col("reused"), origin).alias("reused_from_call_id"),
    ).select(*_columns(MODEL_CALL))


def _outcomes(told: DataFrame, prepared: DataFrame) -> DataFrame:
    status = F.when(F.col("usable"), F.col("judgement.analysis_status")).otherwise("unanalyzed")
    reached = told.select(
        "record_id", "attempted", "failed", "reused", "reason", status.alias("analysis_status")
    )
    rest = prepared.filter(F.col("body").isNull()).select(
        "record_id",
        F.lit(False).alias("attempted"),
        F.lit(False).alias("failed"),
        F.lit(False).alias("reused"),
        F.lit(None).cast("string").alias("reason"),
        F.lit("unanalyzed").alias("analysis_status"),
    )
    return reached.unionByName(rest)


# -- the job ----------------------------------------------------------------------------------


@dataclass
class Scope:
    """What a run covers. With nothing set it is the whole lake."""

    since: str | None = None
    axis: str = ""
    source: str = ""
    sample: int = 0
    sample_mode: str = "random"

    def is_partial(self) -> bool:
        return bool(self.since or self.axis or self.source or self.sample)


def changed_cycles(lake, version: str, bronze: DataFrame) -> DataFrame:
    """The cycles, of Bronze's signatures, that aren't settled at ``version``."""
    settled = versions.still_settled(
        lake.read_records("silver", "analysis_settled"),
        bronze,
        lake.signatures("silver", "analysis"),
        lake.read_records("silver", "analysis_retry"),
        version,
    )
    return with_cycle(bronze).join(settled.select("collection_cycle"), "collection_cycle", "left_anti")


def waiting_records(lake, version: str, wanted: Scope, bronze: DataFrame | None = None) -> DataFrame:
    """Bronze rows still to be labelled at ``version``.

    A whole-lake run leaves settled cycles alone: they are told by their file signatures, and
    the semi-join on partition columns lets Spark prune the others' files.
    """
    items = lake.read_cycles("bronze", "news_item")
    silver = lake.read_cycles("silver", "analysis")
    retry = lake.read_records("silver", "analysis_retry")
    if not wanted.is_partial():
        signatures = lake.signatures("bronze", "news_item") if bronze is None else bronze
        changed = changed_cycles(lake, version, signatures)
        items = only_cycles(items, cycles_of(changed))
        silver = only_cycles(silver, cycles_of(changed))
    chosen = scope.in_scope(items, wanted.axis, wanted.source, wanted.since)
    todo = versions.pending(chosen, silver, retry, version)
    return scope.sample(todo, wanted.sample, wanted.sample_mode, f"{version}|{wanted.since}")


def label_lake(
    lake,
    run_id: str,
    called_at: str,
    completer: Completer | None = None,
    version: str | None = None,
    wanted: Scope | None = None,
    model: str = "",
) -> DataFrame:
    """Label what waits, write Silver, and keep the retry list and settled marks in step.

    A partial run lands beside the other versions; a whole-lake run retires them, except the
    version a decision serves. Replies and call records are written before the check that
    anybody answered, so an outage leaves its trace and no analyses. Returns outcome counts.
    """
    ingestion.recover(lake)
    with scratch_scope(lake.spark):
        booked = _label_lake(lake, run_id, called_at, completer, version, wanted or Scope(), model).collect()
    return lake.spark.createDataFrame(booked, "outcome_name string, outcome_count bigint")


def _label_lake(lake, run_id, called_at, completer, version, wanted: Scope, model) -> DataFrame:
    version = version or (MODEL_VERSION if completer else KEYWORD_VERSION)
    # Taken before anything is read: a cycle that is rewritten meanwhile is not settled by this run.
    before = staged(lake.signatures("bronze", "news_item"), "bronze-signatures")
    todo = staged(waiting_records(lake, version, wanted, before), "waiting")
    visited = cycles_of(todo) if wanted.is_partial() else staged(
        changed_cycles(lake, version, before).select(*PARTITION), "visited-cycles"
    )
    bodies = lake.read_objects("bronze", "news_body", "body_hash").drop("body_hash_prefix")
    items = todo.drop(*PARTITION)
    located = only_cycles(lake.read_cycles("bronze", "news_item"), cycles_of(todo))
    if completer is None:
        rows = keyword_labels(items, bodies, version, run_id)
        failed = items.select("record_id").limit(0)
        booked = rows.groupBy(F.col("analysis_status").alias("outcome_name")).agg(
            F.count("*").alias("outcome_count")
        )
    else:
        done = model_labels(
            items,
            bodies,
            lake.read_records("silver", "analysis_cache"),
            completer,
            version,
            run_id,
            model,
            called_at=called_at,
            attempt=uuid.uuid4().hex,
        )
        lake.append_new("silver", "analysis_cache", "cache_key", done.new_replies)
        lake.put_objects("silver", "llm_call", "call_id", done.calls, [F.col("called_at")])
        counts = done.counts().first()
        if counts["attempted"] and counts["attempted"] == counts["failed"]:
            raise AllCallsFailed(
                f"all {counts['attempted']} model calls failed; {counts['last_error']}"
            )
        rows = done.analyses
        failed = done.outcomes.filter("failed").select("record_id")
        booked = done.booked()
    keep: tuple[str, ...] = ()
    if not wanted.is_partial():
        served = lake.read_records("silver", "reprocess_decision").agg(
            F.max_by("analyzer_version", "decided_at").alias("v")
        ).first()["v"]
        keep = (served,) if served else ()
    versions.store_analyses(lake, located, rows, wanted.is_partial(), keep, counted=False)
    if not wanted.is_partial():
        _prune(lake, visited)
    _keep_in_step(lake, todo, failed, version, visited, before, whole=not wanted.is_partial())
    return booked.unionByName(_skipped(lake, version, wanted, todo, visited))


def _prune(lake, visited: DataFrame) -> None:
    """Drop labels of records that Bronze lost, in visited cycles and in cycles that Bronze lost."""
    lost = versions.cycles_without_bronze(lake.partitions("silver", "analysis"), lake.partitions("bronze", "news_item"))
    looked = staged(visited.unionByName(lost).distinct(), "pruned-cycles")
    versions.prune_orphans(lake, only_cycles(lake.read_cycles("bronze", "news_item"), cycles_of(looked)), looked)


def _skipped(lake, version: str, wanted: Scope, todo: DataFrame, visited: DataFrame) -> DataFrame:
    """Observations in scope that this run left alone: their cycle is settled, or they are labelled
    already, or the sample left them out."""
    items = lake.read_cycles("bronze", "news_item")
    chosen = scope.in_scope(items, wanted.axis, wanted.source, wanted.since)
    counts = []
    if not wanted.is_partial():
        counts.append(("skipped_settled", chosen.join(visited, list(PARTITION), "left_anti")))
        chosen = only_cycles(chosen, cycles_of(visited))
    elif wanted.sample:
        retry = lake.read_records("silver", "analysis_retry")
        left = versions.pending(chosen, lake.read_cycles("silver", "analysis"), retry, version)
        counts.append(("skipped_not_sampled", left.join(todo.select("record_id"), "record_id", "left_anti")))
    rows = [df.agg(F.lit(name).alias("outcome_name"), F.count("*").alias("outcome_count")) for name, df in counts]
    none = lake.spark.createDataFrame([], "outcome_name string, outcome_count bigint")
    return reduce(DataFrame.unionByName, rows, none).where("outcome_count > 0")


def _keep_in_step(
    lake, todo: DataFrame, failed: DataFrame, version: str, visited: DataFrame, before: DataFrame, whole: bool
) -> None:
    analyzed = todo.select("record_id")
    present = only_cycles(lake.read_cycles("bronze", "news_item"), cycles_of(todo))
    retry = versions.updated_retries(
        lake.read_records("silver", "analysis_retry"),
        present.select("record_id", "collection_cycle"),
        analyzed,
        failed,
        version,
    )
    retry = lake.write_records("silver", "analysis_retry", staged(retry, "retry"))
    if not whole:
        return
    unsettled = retry.filter(F.col("analyzer_version") == version).select("collection_cycle")
    tokens = settled_marks(lake, version, visited, before).join(
        unsettled, "collection_cycle", "left_anti"
    )
    stored = lake.read_records("silver", "analysis_settled")
    cleared = unsettled.select(F.lit(version).alias("analyzer_version"), "collection_cycle")
    lake.write_records(
        "silver",
        "analysis_settled",
        staged(versions.updated_settled(stored, tokens, cleared.distinct()), "settled"),
    )


def settled_marks(lake, version: str, visited: DataFrame, before: DataFrame) -> DataFrame:
    """A mark per visited cycle: Bronze's signature from before the run, Silver's as written by it."""
    parts = list(PARTITION)

    def marks(layer: str, dataset: str, tokens: DataFrame) -> DataFrame:
        counts = lake.row_counts(layer, dataset, visited).withColumnRenamed("row_count", f"{layer}_count")
        own = only_cycles(tokens, visited.select(*parts).distinct())
        return own.withColumnRenamed("signature", f"{layer}_signature").join(counts, parts)

    both = marks("bronze", "news_item", before).join(marks("silver", "analysis", lake.signatures("silver", "analysis")), parts)
    return with_cycle(both).select(
        F.lit(version).alias("analyzer_version"),
        "collection_cycle",
        "bronze_signature",
        "silver_signature",
        "bronze_count",
        "silver_count",
    )
