"""DuckDB twins of the derived lake and of the folds, as named common table expressions.

``sql(final)`` puts in front of ``final`` the expressions it names, and those they name.
"""

from __future__ import annotations

import re

from pressgauge.functions import numeric

_EVENT = "'r' || lpad(CAST(event_id AS VARCHAR), 12, '0')"
_K = "json_extract_string(props, '$.k')"
_URL = f"CASE WHEN event_id % 20 = 0 THEN '' ELSE 'https://news.example/' || {_K} END"
_BODY = f"'body of ' || {_K} || ' version ' || CAST(user_id % 4 AS VARCHAR)"
_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')"
_CYCLE = "strftime(ts, '%Y-%m-%dT%H:00')"
_RECORD = (
    "CASE WHEN event_id % 97 = 0 THEN 'gone-' || CAST(event_id AS VARCHAR) "
    f"ELSE {_EVENT} END"
)
_SENTIMENT = (
    "CASE event_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' "
    "WHEN 2 THEN 'negative' WHEN 3 THEN 'mixed' END"
)


def units(x: str) -> str:
    """Ten-thousandths of ``x``, rounded on the exact double (see ``functions.numeric``)."""
    q = f"floor({x}*10000.0::DOUBLE)"
    hi = f"({x}*134217729.0::DOUBLE-({x}*134217729.0::DOUBLE-{x}))"
    lo = f"({x}-{hi})"
    past = f"(({hi}*20000.0::DOUBLE-(2*{q}+1))+{lo}*20000.0::DOUBLE)"
    return (
        f"CAST({q}+CASE WHEN {past}>0 OR ({past}=0 AND CAST({q} AS BIGINT)%2=1) "
        "THEN 1 ELSE 0 END AS BIGINT)"
    )


def round4(x: str) -> str:
    return f"({units(x)}/10000.0::DOUBLE)"


_CTES: dict[str, str] = {
    "bronze": f"""
        SELECT {_EVENT} AS record_id, 'src-' || CAST(user_id % 18 AS VARCHAR) AS source_id,
          CASE user_id % 3 WHEN 0 THEN 'KR' WHEN 1 THEN 'US' ELSE 'GLOBAL' END AS axis,
          event_id % 100 + 1 AS rank, CAST(floor(value) AS BIGINT) AS view_count,
          event_type || ' Story ' || {_K} AS title, {_URL} AS source_url,
          CASE WHEN event_id % 10 = 3 THEN '' ELSE sha256({_BODY}) END AS body_hash,
          event_id % 10 <> 3 AS body_available, {_AT} AS collected_at,
          {_CYCLE} AS collection_cycle
        FROM events""",
    "bodies": f"""
        SELECT sha256({_BODY}) AS body_hash, {_BODY} AS raw_text, {_AT} AS first_seen_at,
          {_CYCLE} AS first_seen_cycle
        FROM events WHERE event_id % 10 <> 3""",
    "silver": f"""
        SELECT {_RECORD} AS record_id, {_URL} AS source_url,
          CASE WHEN value < 1 THEN CAST([] AS VARCHAR[])
               WHEN value >= 20 THEN [event_type, 'big'] ELSE [event_type] END
            AS narrative_subjects,
          CASE WHEN event_id % 8 = 5 THEN ['cat' || CAST(event_id % 7 AS VARCHAR)]
               WHEN event_id % 8 = 1 THEN CAST([] AS VARCHAR[]) END AS subject_categories,
          {_SENTIMENT} AS sentiment,
          CASE WHEN event_id % 5 = 4 THEN 'unanalyzed' WHEN event_id % 11 = 0
               THEN 'low_confidence' ELSE 'analyzed' END AS analysis_status,
          CAST(event_id % 100 AS DOUBLE) / 100.0::DOUBLE AS confidence, {_AT} AS analyzed_at,
          'v1' AS analyzer_version, 'run-' || strftime(ts, '%Y-%m-%d') AS run_id,
          CASE WHEN event_id % 6 <> 5 AND event_id % 19 <> 0
               THEN 'call-' || CAST(event_id AS VARCHAR) END AS call_id,
          CASE WHEN event_id % 6 = 5 THEN 'body_unavailable' END AS no_call_reason
        FROM events
        UNION ALL
        SELECT {_RECORD}, {_URL},
          CASE WHEN value < 1 THEN CAST([] AS VARCHAR[])
               ELSE [event_type, 'topic' || CAST(CAST({_K} AS BIGINT) % 5 AS VARCHAR)] END,
          CAST(NULL AS VARCHAR[]), {_SENTIMENT},
          CASE WHEN event_id % 5 = 4 THEN 'unanalyzed' ELSE 'analyzed' END,
          CAST(0.9 AS DOUBLE),
          strftime(CASE WHEN event_id % 6 = 0 THEN ts - INTERVAL 1 HOUR
                        ELSE ts + INTERVAL 1 HOUR END, '%Y-%m-%dT%H:%M:%S+00:00'),
          'v2', 'rerun-' || strftime(ts, '%Y-%m-%d'), 'call-' || CAST(event_id AS VARCHAR), NULL
        FROM events WHERE event_id % 2 = 0""",
    "calls": f"""
        SELECT 'call-' || CAST(event_id AS VARCHAR) AS call_id,
          'run-' || strftime(ts, '%Y-%m-%d') AS run_id, {_EVENT} AS record_id, {_AT} AS called_at,
          CASE event_id % 9 WHEN 0 THEN 'parse_failed' WHEN 1 THEN 'call_failed'
               WHEN 2 THEN 'reused' ELSE 'parsed' END AS call_outcome,
          CASE WHEN event_id % 9 = 2 THEN 'call-' || CAST(event_id - 9 AS VARCHAR) END
            AS reused_from_call_id,
          event_id % 23 <> 0 AS decoded
        FROM events WHERE event_id % 6 <> 5 AND event_id % 17 <> 0""",
    "served": """
        SELECT * FROM silver QUALIFY row_number() OVER (
          PARTITION BY record_id ORDER BY analyzed_at DESC, analyzer_version DESC) = 1""",
    "labelled": """
        SELECT b.axis, coalesce(nullif(b.source_url, ''), b.record_id) AS article,
          b.collected_at, b.record_id, b.source_id,
          coalesce(s.subject_categories, s.narrative_subjects) AS keys,
          CASE WHEN s.analysis_status = 'unanalyzed' OR s.sentiment IS NULL THEN 'unanalyzed'
               ELSE s.sentiment END AS sentiment,
          CAST(substr(b.collected_at, 1, 10) AS DATE) AS on_day
        FROM bronze b JOIN served s USING (record_id)""",
    "placed": """
        SELECT *, 'hour' AS bucket_unit, substr(collected_at, 1, 13) AS time_bucket FROM labelled
        UNION ALL SELECT *, 'day', substr(collected_at, 1, 10) FROM labelled
        UNION ALL SELECT *, 'week', strftime(on_day, '%G-W%V') FROM labelled""",
    "picks": """
        SELECT * FROM placed QUALIFY row_number() OVER (
          PARTITION BY axis, bucket_unit, time_bucket, article
          ORDER BY collected_at DESC, record_id DESC) = 1""",
    "anchor": """
        SELECT max(strptime(time_bucket, '%Y-%m-%dT%H')) AS anchor_at FROM picks
        WHERE bucket_unit = 'hour'""",
    "ranges": "SELECT * FROM (VALUES ('24h', 24), ('7d', 168), ('30d', 720)) AS r(range, span)",
    "wplaced": """
        SELECT p.*, r.range, r.span, a.anchor_at,
          CASE WHEN datediff('hour', strptime(p.time_bucket, '%Y-%m-%dT%H'), a.anchor_at) < r.span
               THEN 'current' ELSE 'previous' END AS period
        FROM picks p, anchor a, ranges r
        WHERE p.bucket_unit = 'hour'
          AND datediff('hour', strptime(p.time_bucket, '%Y-%m-%dT%H'), a.anchor_at) < 2 * r.span""",
    "wpicks": """
        SELECT *,
          strftime(anchor_at - to_hours(CASE period WHEN 'current' THEN 0 ELSE span END + span - 1),
                   '%Y-%m-%dT%H') AS window_start,
          strftime(anchor_at - to_hours(CASE period WHEN 'current' THEN 0 ELSE span END),
                   '%Y-%m-%dT%H') AS window_end
        FROM wplaced QUALIFY row_number() OVER (
          PARTITION BY axis, range, period, article
          ORDER BY collected_at DESC, record_id DESC) = 1""",
    "contrib": f"""
        SELECT subject, axis, bucket_unit, time_bucket, source_id, n AS raw_count,
          {round4('(n::DOUBLE/raw_count::DOUBLE)')} AS raw_share,
          part / 10000.0::DOUBLE AS normalized_contribution
        FROM parts""",
    "parts": """
        SELECT *, CAST(floor_units + CASE WHEN row_number() OVER (
            PARTITION BY axis, bucket_unit, time_bucket, subject
            ORDER BY remainder DESC, source_id)
          <= units - sum(floor_units) OVER (PARTITION BY axis, bucket_unit, time_bucket, subject)
          THEN 1 ELSE 0 END AS BIGINT) AS part
        FROM (SELECT t.*, f.raw_count, f.units, (t.term * 10000) // t.den AS floor_units,
                (t.term * 10000) % t.den AS remainder
              FROM terms t JOIN folded f USING (axis, bucket_unit, time_bucket, subject))""",
    "trend": """
        SELECT subject, axis, bucket_unit, time_bucket, raw_count, units,
          units / 10000.0::DOUBLE AS normalized_share,
          coalesce((units - lag(units) OVER line) / 100.0::DOUBLE, 0.0::DOUBLE) AS delta,
          list(units) OVER (PARTITION BY axis, bucket_unit, subject ORDER BY time_bucket
                            ROWS 5 PRECEDING) AS spark_units
        FROM shares_all
        WINDOW line AS (PARTITION BY axis, bucket_unit, subject ORDER BY time_bucket)""",
    "tone": """
        SELECT coalesce(axis, 'ALL') AS axis, bucket_unit, time_bucket,
          count(*) FILTER (sentiment = 'positive') AS positive,
          count(*) FILTER (sentiment = 'neutral') AS neutral,
          count(*) FILTER (sentiment = 'negative') AS negative,
          count(*) FILTER (sentiment = 'mixed') AS mixed,
          count(*) FILTER (sentiment = 'unanalyzed') AS unanalyzed, count(*) AS total
        FROM picks
        GROUP BY GROUPING SETS ((axis, bucket_unit, time_bucket), (bucket_unit, time_bucket))""",
    "axis_sentiment": f"""
        SELECT axis, bucket_unit, time_bucket,
          {round4('(positive::DOUBLE/greatest(total-unanalyzed,1)::DOUBLE)')} AS positive,
          {round4('(neutral::DOUBLE/greatest(total-unanalyzed,1)::DOUBLE)')} AS neutral,
          {round4('(negative::DOUBLE/greatest(total-unanalyzed,1)::DOUBLE)')} AS negative,
          {round4('(mixed::DOUBLE/greatest(total-unanalyzed,1)::DOUBLE)')} AS mixed,
          {round4('(unanalyzed::DOUBLE/total::DOUBLE)')} AS unanalyzed,
          total - unanalyzed AS analyzed_total
        FROM tone""",
    "axis_window": """
        SELECT coalesce(axis, 'ALL') AS axis, range, period, window_start, window_end,
          count(*) AS collected,
          count(*) FILTER (sentiment <> 'unanalyzed') AS analyzed_total
        FROM wpicks GROUP BY GROUPING SETS (
          (axis, range, period, window_start, window_end),
          (range, period, window_start, window_end))""",
    "bounds": "SELECT DISTINCT range, period, window_start, window_end FROM wpicks",
    "subject_window": """
        SELECT s.subject, s.axis, s.range, s.period, b.window_start, b.window_end, s.raw_count,
          s.units / 10000.0::DOUBLE AS normalized_share
        FROM wshares_all s JOIN bounds b USING (range, period)""",
    "record_latest": """
        SELECT a.record_id, a.versions, a.analyzed_at, a.analysis_status, a.sentiment,
          a.confidence, a.analyzer_version, a.run_id, a.call_id, a.no_call_reason,
          CASE WHEN a.no_call_reason IS NOT NULL THEN 'no-call'
               WHEN a.call_id IS NULL THEN 'unrecorded'
               WHEN c.call_id IS NULL THEN 'call-record-absent' ELSE 'call' END AS exchange_state,
          CASE WHEN a.no_call_reason IS NULL THEN c.call_outcome END AS call_outcome,
          n.title, n.source_id, n.collected_at
        FROM (SELECT *, count(*) OVER (PARTITION BY record_id) AS versions FROM silver
              QUALIFY row_number() OVER (PARTITION BY record_id
                ORDER BY analyzed_at DESC, analyzer_version DESC) = 1) a
        LEFT JOIN bronze n ON n.record_id = a.record_id
        LEFT JOIN calls c ON c.call_id = a.call_id AND c.decoded""",
    "body_share": """
        SELECT body_hash, count(DISTINCT coalesce(nullif(source_url, ''), record_id)) AS shares
        FROM bronze WHERE body_hash <> '' GROUP BY body_hash""",
}


def _fold(prefix: str, picks: str, keys: str) -> None:
    """The share fold once per key set: buckets, and windows with the prefix ``w``."""
    rest = keys.removeprefix("axis, ")
    _CTES[f"{prefix}mentions"] = f"""
        SELECT {keys}, source_id, subject, count(*) AS n
        FROM (SELECT {keys}, source_id, unnest(keys) AS subject FROM {picks})
        GROUP BY {keys}, source_id, subject"""
    _CTES[f"{prefix}totals"] = f"""
        SELECT {keys}, source_id, count(*) AS articles, CAST(sum(len(keys)) AS BIGINT)
          AS source_total,
          CAST(round(sqrt(count(*)::DOUBLE) * {numeric.WEIGHT_SCALE}::DOUBLE) AS BIGINT) AS weight
        FROM {picks} GROUP BY {keys}, source_id"""
    _CTES[f"{prefix}weights"] = f"""
        SELECT *, CAST(sum(CASE WHEN source_total > 0 THEN CAST(round(
              (weight::DOUBLE / weight_sum::DOUBLE) * {numeric.TERM_SCALE}::DOUBLE) AS BIGINT)
            ELSE 0 END) OVER (PARTITION BY {keys}) AS BIGINT) AS den
        FROM (SELECT *, CAST(sum(weight) OVER (PARTITION BY {keys}) AS BIGINT) AS weight_sum
              FROM {prefix}totals)"""
    _CTES[f"{prefix}terms"] = f"""
        SELECT m.*, den, CAST(round((n::DOUBLE / source_total::DOUBLE)
            * (weight::DOUBLE / weight_sum::DOUBLE) * {numeric.TERM_SCALE}::DOUBLE) AS BIGINT)
            AS term
        FROM {prefix}mentions m JOIN {prefix}weights USING ({keys}, source_id)"""
    snapped = "(floor((num::DOUBLE/den::DOUBLE)*1e11::DOUBLE+0.5::DOUBLE)/1e11::DOUBLE)"
    _CTES[f"{prefix}folded"] = f"""
        SELECT {keys}, subject, raw_count, {units('d')} AS units
        FROM (SELECT *, {snapped} AS d
              FROM (SELECT {keys}, subject, CAST(sum(term) AS BIGINT) AS num, max(den) AS den,
                      CAST(sum(n) AS BIGINT) AS raw_count
                    FROM {prefix}terms GROUP BY {keys}, subject))"""
    share = {
        a: f"coalesce(max(units) FILTER (axis = '{a}'), 0) / 10000.0::DOUBLE AS {a}"
        for a in ("KR", "US", "GLOBAL")
    }
    _CTES[f"{prefix}pooled"] = f"""
        SELECT *, t2 + (e1 + CASE WHEN abs(t1) >= abs("GLOBAL") THEN (t1 - t2) + "GLOBAL"
                                  ELSE ("GLOBAL" - t2) + t1 END) AS total
        FROM (SELECT *, t1 + "GLOBAL" AS t2,
                CASE WHEN abs("KR") >= abs("US") THEN ("KR" - t1) + "US"
                     ELSE ("US" - t1) + "KR" END AS e1
              FROM (SELECT *, "KR" + "US" AS t1
                    FROM (SELECT {rest}, subject, CAST(sum(raw_count) AS BIGINT) AS raw_count,
                            {share['KR']}, {share['US']}, {share['GLOBAL']}
                          FROM {prefix}folded GROUP BY {rest}, subject)
                    JOIN (SELECT {rest}, count(DISTINCT axis) AS axes FROM {prefix}folded
                          GROUP BY {rest}) USING ({rest})))"""
    _CTES[f"{prefix}shares_all"] = f"""
        SELECT axis, {rest}, subject, raw_count, units FROM {prefix}folded
        UNION ALL
        SELECT 'ALL', {rest}, subject, raw_count, {units('(total/axes::DOUBLE)')}
        FROM {prefix}pooled"""


_fold("", "picks", "axis, bucket_unit, time_bucket")
_CTES["tpicks"] = """
    SELECT axis, bucket_unit, time_bucket, source_id, [sentiment] AS keys FROM picks
    WHERE sentiment <> 'unanalyzed'"""
_fold("t", "tpicks", "axis, bucket_unit, time_bucket")
_fold("w", "wpicks", "axis, range, period")


def sql(final: str, extra: dict[str, str] | None = None) -> str:
    """``final`` behind the named expressions it needs; ``extra`` adds some of its own."""
    known = {**_CTES, **(extra or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"[a-z_][a-z_0-9]*", text):
            if word in known and word not in order and word not in pending:
                pending.append(word)
                need(known[word])
                pending.remove(word)
                order.append(word)

    pending: list[str] = []
    need(final)
    if not order:
        return final.strip()
    return "WITH " + ",\n".join(f"{n} AS ({known[n].strip()})" for n in order) + "\n" + final.strip()
