"""Records, calls and bodies: the serving tables and the walks between layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pressgauge.functions import identity
from pressgauge.operators.joins import left_join_present
from pressgauge.operators.picks import first_by

LIST_LIMIT = 50
SYMPTOMS = ("analysis_status", "call_outcome", "no_call_reason")


def _newest_label() -> list[Column]:
    return [F.col("analyzed_at").desc(), F.col("analyzer_version").desc()]


# -- serving tables ---------------------------------------------------------------------------


def latest_analysis(silver: DataFrame) -> DataFrame:
    """Newest analysis per record, with the number of versions.

    The count is a grouped sum joined back, so a record with very many versions is combined on
    the map side instead of being buffered in a window.
    """
    versions = silver.groupBy("record_id").agg(F.count("*").alias("versions"))
    return first_by(silver, ["record_id"], _newest_label()).join(versions, "record_id")


def latest_observation(items: DataFrame) -> DataFrame:
    return first_by(items, ["record_id"], [F.col("collected_at").desc(), F.col("source_id")])


def record_latest(silver: DataFrame, items: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per analysed record: newest label, newest observation, its decoded call."""
    seen = latest_observation(
        items.select("record_id", "title", "source_id", "collected_at")
    )
    known = calls.filter("decoded").select(
        "call_id", F.col("call_id").alias("found_call"), "call_outcome"
    )
    labels = latest_analysis(silver)
    joined = left_join_present(labels.join(seen, "record_id", "left"), known, "call_id")
    return joined.select(
        "record_id",
        "versions",
        "analyzed_at",
        "analysis_status",
        "sentiment",
        "confidence",
        "analyzer_version",
        "run_id",
        "call_id",
        "no_call_reason",
        identity.exchange_state(
            F.col("no_call_reason"), F.col("call_id"), F.col("found_call")
        ).alias("exchange_state"),
        F.when(F.col("no_call_reason").isNull(), F.col("call_outcome")).alias("call_outcome"),
        "title",
        "source_id",
        "collected_at",
    )


def body_share(items: DataFrame) -> DataFrame:
    """Distinct articles per body text. An empty hash is "no text kept", not a shared text.

    Distinct (hash, article) pairs are combined before they are counted, so a text that a third
    of all observations carry does not meet in one task.
    """
    return (
        items.filter(F.col("body_hash") != "")
        .select(
            "body_hash",
            identity.article_key(F.col("source_url"), F.col("record_id")).alias("article"),
        )
        .distinct()
        .groupBy("body_hash")
        .agg(F.count("*").alias("shares"))
    )


def run_call(calls: DataFrame) -> DataFrame:
    return (
        calls.filter("decoded")
        .groupBy("run_id", "call_outcome")
        .agg(F.count("*").alias("calls"))
    )


# -- the record list --------------------------------------------------------------------------


def record_filter(query: str = "", run_id: str = "", symptom: str = "") -> Column:
    """Text in id or title, one run, one ``group:value`` symptom; an unknown group has none."""
    tests: list[Column] = [F.lit(True)]
    needle = query.strip().lower()
    if needle:
        found = [
            F.instr(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle)) > 0
            for c in (F.col("record_id"), F.col("title"))
        ]
        tests.append(found[0] | found[1])
    if run_id.strip():
        tests.append(F.col("run_id") == run_id.strip())
    if symptom.strip():
        group, _, value = symptom.strip().partition(":")
        tests.append(F.col(group) == value if group in SYMPTOMS and _ else F.lit(False))
    return reduce(lambda a, b: a & b, tests)


def record_list(
    latest: DataFrame, query: str = "", run_id: str = "", symptom: str = ""
) -> DataFrame:
    """The newest fifty matching records."""
    return (
        latest.filter(record_filter(query, run_id, symptom))
        .orderBy(F.col("analyzed_at").desc(), "record_id")
        .limit(LIST_LIMIT)
        .select(
            "record_id",
            *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "source_id", "collected_at")],
            "analysis_status",
            "sentiment",
            "confidence",
            "analyzer_version",
            "analyzed_at",
            "run_id",
            "versions",
            "exchange_state",
            "call_outcome",
            "no_call_reason",
        )
    )


def record_list_size(
    latest: DataFrame, query: str = "", run_id: str = "", symptom: str = ""
) -> DataFrame:
    matched = F.count_if(record_filter(query, run_id, symptom))
    return latest.agg(F.count("*").alias("total"), matched.alias("matched")).withColumn(
        "truncated", F.col("matched") > LIST_LIMIT
    )


# -- one record -------------------------------------------------------------------------------


def record_versions(silver: DataFrame, calls: DataFrame, record_id: str | None = None) -> DataFrame:
    """Versions of a record (or of every record), newest first, each with its model exchange.

    A call that replayed an earlier reply names it; that origin is one hop away.
    """
    rows = silver if record_id is None else silver.filter(F.col("record_id") == record_id)
    lookup = calls.select(
        F.col("call_id").alias("asked_call"),
        F.col("call_id").alias("found_call"),
        "call_outcome",
        "reused_from_call_id",
    )
    origin = calls.select(
        F.col("call_id").alias("reused_from_call_id"),
        F.col("call_id").alias("origin_call"),
        F.col("call_outcome").alias("origin_outcome"),
    )
    asked = F.when(F.col("no_call_reason").isNull(), F.col("call_id"))
    place = F.row_number().over(W.partitionBy("record_id").orderBy(*_newest_label()))
    # The origin is looked up for the calls, a replay's only, before records meet their call.
    exchanges = left_join_present(lookup, origin, "reused_from_call_id")
    placed = rows.withColumn("asked_call", asked).withColumn("place", place.cast("bigint"))
    return (
        left_join_present(placed, exchanges, "asked_call")
        .select(
            "record_id",
            "place",
            (F.col("place") == 1).alias("selected"),
            "analyzer_version",
            "analyzed_at",
            "analysis_status",
            "sentiment",
            "confidence",
            "run_id",
            identity.exchange_state(
                F.col("no_call_reason"), F.col("call_id"), F.col("found_call")
            ).alias("exchange_state"),
            "no_call_reason",
            "call_outcome",
            F.col("origin_call").alias("reused_from"),
            "origin_outcome",
        )
    )


def article_bodies(items: DataFrame, bodies: DataFrame) -> DataFrame:
    """Body texts each article showed over all its observations, oldest first.

    One row per article and text; ``latest`` marks the newest text.
    """
    article = identity.article_key(F.col("source_url"), F.col("record_id"))
    shown = (
        items.filter(F.col("body_hash") != "")
        .select(article.alias("article"), "body_hash")
        .distinct()
    )
    texts = bodies.select("body_hash", "first_seen_at", "first_seen_cycle", "raw_text")
    order = [F.col("first_seen_at"), F.col("body_hash")]
    line = W.partitionBy("article").orderBy(*order)
    return (
        shown.join(texts, "body_hash")
        .withColumn("version", F.row_number().over(line).cast("bigint"))
        .withColumn("latest", F.lead("body_hash").over(line).isNull())
    )


def analyzed_bodies(items: DataFrame, bodies: DataFrame) -> DataFrame:
    """Which of its article's texts a record's first observation was labelled on."""
    article = identity.article_key(F.col("source_url"), F.col("record_id"))
    first = first_by(
        items.select("record_id", article.alias("article"), "body_hash", "collected_at"),
        ["record_id"],
        [F.col("collected_at"), F.col("body_hash")],
    ).filter(F.col("body_hash") != "")
    versions = article_bodies(items, bodies)
    return first.join(versions, ["article", "body_hash"]).select(
        "record_id", "article", "body_hash", "first_seen_at", "version", "latest"
    )


def body_history(items: DataFrame, bodies: DataFrame, record_id: str) -> DataFrame:
    """The texts of one record's article, the one that was labelled marked."""
    article = identity.article_key(F.col("source_url"), F.col("record_id"))
    keyed = items.withColumn("article", article)
    own = keyed.filter(F.col("record_id") == record_id)
    mine = keyed.join(own.select("article").distinct(), "article", "left_semi").drop("article")
    first = own.agg(
        F.min_by("body_hash", F.struct("collected_at", "body_hash")).alias("h")
    ).scalar()
    return article_bodies(mine, bodies).withColumn("analyzed", F.col("body_hash") == first)


def lineage(
    items: DataFrame, bodies: DataFrame, silver: DataFrame, record_id: str | None = None
) -> DataFrame:
    """Observation, body and first analysis of each record, with what was found on the way."""
    own = items if record_id is None else items.filter(F.col("record_id") == record_id)
    first_seen = first_by(own, ["record_id"], [F.col("collected_at"), F.col("source_id")])
    first_label = first_by(
        silver.select(
            "record_id", "analysis_status", "sentiment", "confidence", "analyzed_at",
            "analyzer_version", "narrative_subjects",
        ),
        ["record_id"],
        [F.col("analyzed_at"), F.col("analyzer_version")],
    ).withColumn("has_silver", F.lit(True))
    texts = bodies.select("body_hash", "first_seen_at", "first_seen_cycle", "raw_text")
    return (
        left_join_present(first_seen, texts, "body_hash")
        .join(first_label, "record_id", "left")
        .withColumn("body_preserved", F.col("raw_text").isNotNull())
        .withColumn("has_silver", F.coalesce("has_silver", F.lit(False)))
    )


def selection(rows: DataFrame, requested: str = "") -> DataFrame:
    """How a record was chosen, so that falling back never reads like the one asked for.

    One row: the record (the requested one, or the first in lake order) and the way it was found.
    """
    if requested:
        found = rows.filter(F.col("record_id") == requested).agg(F.count("*").alias("n"))
        return found.select(
            F.lit(requested).alias("record_id"),
            F.when(F.col("n") > 0, "requested").otherwise("requested-missing").alias("selection"),
        )
    order = [c for c in ("collection_cycle", "analyzed_at") if c in rows.columns] + ["record_id"]
    first = rows.agg(F.min_by("record_id", F.struct(*order)).alias("record_id"))
    return first.select(
        F.coalesce("record_id", F.lit("")).alias("record_id"),
        F.when(F.col("record_id").isNull(), "empty").otherwise("auto").alias("selection"),
    )


# -- one run ----------------------------------------------------------------------------------


def run_symptoms(silver: DataFrame, run_calls: DataFrame, run_id: str | None = None) -> DataFrame:
    """Tallies of a run (or of each run): statuses, call outcomes, reasons for no call."""
    rows, calls = silver, run_calls
    if run_id is not None:
        rows, calls = rows.filter(F.col("run_id") == run_id), calls.filter(F.col("run_id") == run_id)

    def tally(kind: str) -> DataFrame:
        return (
            rows.filter(F.col(kind).isNotNull())
            .groupBy("run_id", F.col(kind).alias("name"))
            .agg(F.count("*").alias("count"))
            .select("run_id", F.lit(kind).alias("kind"), "name", "count")
        )

    outcomes = calls.select(
        "run_id", F.lit("call_outcome").alias("kind"), F.col("call_outcome").alias("name"),
        F.col("calls").alias("count"),
    )
    return (
        tally("analysis_status").unionByName(tally("no_call_reason")).unionByName(outcomes)
    ).orderBy("run_id", "kind", F.col("count").desc(), "name")


def run_totals(symptoms: DataFrame) -> DataFrame:
    def total(kind: str) -> Column:
        counted = F.sum(F.when(F.col("kind") == kind, F.col("count")))
        return F.coalesce(counted, F.lit(0))

    return symptoms.groupBy("run_id").agg(
        total("analysis_status").alias("records"), total("call_outcome").alias("calls")
    )
