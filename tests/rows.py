"""Small frames in the shapes the folds read."""

BRONZE = "record_id string, source_id string, axis string, source_url string, collected_at string"
SILVER = (
    "record_id string, narrative_subjects array<string>, subject_categories array<string>, "
    "sentiment string, analysis_status string, analyzed_at string, analyzer_version string"
)


def bronze(spark, rows):
    """(record, axis, source, time[, url]); a time is an hour like 2026-06-23T14."""
    full = [(r[0], r[2], r[1], r[4] if len(r) > 4 else "", f"{r[3]}:00:00+00:00") for r in rows]
    return spark.createDataFrame(full, BRONZE)


def silver(spark, rows):
    """(record, subjects[, sentiment[, categories]])."""
    full = []
    for record, subjects, *rest in rows:
        tone = rest[0] if rest else "neutral"
        full.append(
            (record, subjects, rest[1] if len(rest) > 1 else None, tone,
             "analyzed" if tone else "unanalyzed", "2026-06-24T00:00:00+00:00", "v1")
        )
    return spark.createDataFrame(full, SILVER)


def keyed(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}
