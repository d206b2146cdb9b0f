"""Reading a model reply: find the JSON object, then judge each field by its own type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgauge.functions import subjects
from pressgauge.functions import vocabulary as V


def reply_object(reply: Column) -> Column:
    """VARIANT of the outermost braces of a reply, null when they hold no JSON object."""
    braces = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.nullif(braces, F.lit("")))
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed)


def _is_array(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def string_list(reply: Column, field: str) -> Column:
    """Trimmed non-empty strings of an array field; other elements are dropped, not cast."""
    value = F.try_variant_get(reply, f"$.{field}", "variant")
    items = F.try_variant_get(value, "$", "array<variant>")
    strings = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    trimmed = F.transform(
        strings, lambda v: subjects.collapse_ends(F.try_variant_get(v, "$", "string"))
    )
    kept = F.filter(trimmed, lambda s: s != "")
    return F.when(_is_array(value), kept).otherwise(F.array().cast("array<string>"))


def has_field(reply: Column, field: str) -> Column:
    """Whether a field is there and not JSON null."""
    value = F.try_variant_get(reply, f"$.{field}", "variant")
    return value.isNotNull() & ~F.is_variant_null(value)


def clean_text(reply: Column, field: str) -> Column:
    value = F.try_variant_get(reply, f"$.{field}", "variant")
    text = F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
    )
    return F.nullif(subjects.collapse(text), F.lit(""))


def confidence(reply: Column) -> Column:
    """A number, or a text that reads as one, held inside 0..1; anything else is 0."""
    value = F.try_variant_get(reply, "$.confidence", "double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def is_unanalyzable(reply: Column) -> Column:
    value = F.try_variant_get(reply, "$.analyzable", "variant")
    return F.coalesce(
        (F.schema_of_variant(value) == "BOOLEAN")
        & ~F.try_variant_get(value, "$", "boolean"),
        F.lit(False),
    )


def sentiment(reply: Column) -> Column:
    value = F.try_variant_get(reply, "$.sentiment", "variant")
    text = F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
    )
    return F.when(text.isin(*V.SENTIMENTS), text)


def is_usable(reply: Column) -> Column:
    """An object that declines to judge, or one with a valid sentiment."""
    return reply.isNotNull() & (is_unanalyzable(reply) | sentiment(reply).isNotNull())


def judged_status(conf: Column) -> Column:
    return F.when(conf >= V.LOW_CONFIDENCE, "analyzed").otherwise("low_confidence")


def judgement(reply: Column) -> Column:
    """Struct of the labels one usable reply gives; nulls and empty lists when it declines."""
    declined = is_unanalyzable(reply)
    empty = F.array().cast("array<string>")
    conf = F.when(declined, F.lit(0.0)).otherwise(confidence(reply))

    def unless_declined(value: Column, otherwise: Column) -> Column:
        return F.when(declined, otherwise).otherwise(value)

    null_text = F.lit(None).cast("string")
    return F.struct(
        unless_declined(string_list(reply, "target_countries"), empty).alias("target_countries"),
        unless_declined(
            subjects.canonical_subjects(string_list(reply, "narrative_subjects")), empty
        ).alias("narrative_subjects"),
        F.when(
            ~declined & has_field(reply, "subject_categories"),
            subjects.canonical_categories(string_list(reply, "subject_categories")),
        ).alias("subject_categories"),
        unless_declined(sentiment(reply), null_text).alias("sentiment"),
        unless_declined(clean_text(reply, "sentiment_rationale"), null_text).alias(
            "sentiment_rationale"
        ),
        F.when(declined, "unanalyzed").otherwise(judged_status(conf)).alias("analysis_status"),
        conf.alias("confidence"),
    )
