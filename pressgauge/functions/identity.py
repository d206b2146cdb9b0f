"""Keys of articles, bodies, records and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def body_hash(text: Column) -> Column:
    """Content address of a body: its exact UTF-8 bytes, nothing normalised."""
    return F.sha2(text, 256)


def record_id(source_id: Column, url: Column, cycle: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source_id, url, cycle)), 1, 12)


def article_key(url: Column, record: Column) -> Column:
    """An observation without a link is an article of its own."""
    return F.coalesce(F.nullif(url, F.lit("")), record)


def grouping_keys(categories: Column, subjects: Column) -> Column:
    """What an analysis is counted under. No categories is null; an empty list is a judgement."""
    return F.coalesce(categories, subjects)


def pick_sentiment(status: Column, sentiment: Column) -> Column:
    return F.when(
        (status == "unanalyzed") | sentiment.isNull(), F.lit("unanalyzed")
    ).otherwise(sentiment)


def exchange_state(no_call_reason: Column, call_id: Column, found_call: Column) -> Column:
    return (
        F.when(no_call_reason.isNotNull(), "no-call")
        .when(call_id.isNull(), "unrecorded")
        .when(found_call.isNull(), "call-record-absent")
        .otherwise("call")
    )


def prompt_digest(system: Column, user: Column) -> Column:
    """SHA-256 of both prompts with a NUL between them, which neither can contain."""
    return F.sha2(F.concat(system, F.char(F.lit(0)), user), 256)


def reply_key(version: Column, model: Column, system: Column, user: Column) -> Column:
    return F.sha2(F.to_json(F.array(version, model, system, user)), 256)


def user_prompt(title: Column, body: Column) -> Column:
    return F.concat(F.lit("TITLE: "), title, F.lit("\n\nBODY:\n"), body)
