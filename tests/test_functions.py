"""Scalar functions against Python's own answers and literal cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pressgauge.functions import buckets, identity, numeric, replies, subjects


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_round4_is_python_round(spark):
    cases = [a / b for b in range(1, 700, 3) for a in range(0, b + 1, max(1, b // 60))]
    cases += [k / 20000 for k in range(1, 20000, 2)]
    got = values(spark, [(x,) for x in cases], "x double", numeric.round4(F.col("x")))
    assert got == [round(x, 4) for x in cases]


def test_round_half_away(spark):
    got = values(spark, [(0.00005,), (0.12345,), (-0.5,)], "x double", numeric.round4_away(F.col("x")))
    assert got == [0.0001, 0.1235, -0.5]
    moved = values(spark, [(0.4 - 0.5,), (0.35,)], "x double", numeric.round_pp1(F.col("x")))
    assert moved == [-10.0, 35.0]


@pytest.mark.parametrize(
    ("day", "label"),
    [("2026-06-23", "2026-W26"), ("2027-01-01", "2026-W53"), ("2024-12-30", "2025-W01"),
     ("2021-01-03", "2020-W53")],
)
def test_week_labels_and_back(spark, day, label):
    row = spark.range(1).select(
        buckets.bucket_label(F.lit(day + "T10:00:00+00:00"), "week").alias("label"),
        F.date_format(buckets.bucket_start(F.lit(label), "week"), "yyyy-MM-dd").alias("monday"),
        F.date_format(F.date_trunc("week", F.lit(day).cast("date")), "yyyy-MM-dd").alias("want"),
    ).first()
    assert (row.label, row.monday) == (label, row.want)


def test_unreadable_bucket_labels_are_null(spark):
    for label, unit in [("2026-W54", "week"), ("2026-W00", "week"), ("x", "week"),
                        ("2026-13-01", "day"), ("2026-06-23", "hour"), ("2026-06-23T99", "hour")]:
        assert spark.range(1).select(buckets.bucket_start(F.lit(label), unit)).first()[0] is None
    with pytest.raises(ValueError, match="month"):
        buckets.bucket_label(F.lit("x"), "month")


def test_cycles_have_one_spelling(spark):
    rows = [("2026-06-23T09:00",), ("2026-06-23T9:00",), ("2026-06-23T09:30",), ("2026-02-30T00:00",)]
    got = values(spark, rows, "c string", buckets.valid_cycle(F.col("c")))
    assert got == [True, False, False, False]
    assert buckets.split_cycle("2026-06-03T09:00")["month"] == "06"
    with pytest.raises(ValueError):
        buckets.split_cycle("2026-06-03T9:00")


def test_instants_reject_words_and_dates(spark):
    since = F.lit("2026-09-21T00:00:00Z").cast("timestamp")
    rows = [("2026-09-21T00:00:00+00:00",), ("2026-09-21T08:59:59+09:00",), ("2026-09-21T09:00:00+09:00",),
            ("yesterday",), ("2026-09-22",), ("",)]
    got = values(spark, rows, "t string", buckets.at_or_after(F.col("t"), since))
    assert got == [True, False, True, False, False, False]


def test_identities(spark):
    row = spark.range(1).select(
        identity.body_hash(F.lit("é")).alias("h"),
        identity.record_id(F.lit("s"), F.lit("u"), F.lit("c")).alias("r"),
        identity.prompt_digest(F.lit("a"), F.lit("b")).alias("p"),
    ).first()
    assert row.h == hashlib.sha256("é".encode()).hexdigest()
    assert row.r == hashlib.sha1(b"s|u|c").hexdigest()[:12]
    assert row.p == hashlib.sha256(b"a\0b").hexdigest()


def test_subject_folding(spark):
    cases = {
        "Fed": "연준", "Federal Reserve": "연준", "미 연준": "연준", "NVIDIA": "엔비디아",
        "US CPI": "미국 소비자물가지수", "samsung": "삼성전자", "기준금리": "한국은행 기준금리",
        "미국 기준금리": "미국 기준금리", "삼성SDI": "삼성SDI", "국제통화기금(IMF)": "국제통화기금",
        "국제금융공사 (IFC)": "국제금융공사", "중동전쟁": "중동 전쟁", "S&P500": "S&P 500",
        "한국  조선해양": "한국 조선해양", "삼성전자(우)": "삼성전자(우)",
        "포괄적·점진적 환태평양경제동반자협정(CPTPP)": "포괄적·점진적 환태평양경제동반자협정",
    }
    got = values(spark, [(k,) for k in cases], "s string", subjects.canonical_subject(F.col("s")))
    assert got == list(cases.values())


def test_categories(spark):
    rows = [(["반도체", "없는 분류", "반도체", "주식 시장", "물가"],), ([],), (["없는 분류"],), (None,)]
    got = values(spark, rows, "c array<string>", subjects.canonical_categories(F.col("c")))
    assert got == [["반도체", "주식시장"], ["기타"], ["기타"], None]


def judge(spark, reply):
    parsed = spark.createDataFrame([(reply,)], "r string").withColumn(
        "p", replies.reply_object(F.col("r"))
    )
    row = parsed.select(
        F.coalesce(replies.is_usable(F.col("p")), F.lit(False)).alias("usable"),
        replies.judgement(F.col("p")).alias("j"),
    ).first()
    return row.j if row.usable else None


def test_replies(spark):
    good = judge(spark, 'ok ```{"target_countries":["KR",3," "],"narrative_subjects":["IMF","국제통화기금(IMF)"],'
                 '"sentiment":"mixed","sentiment_rationale":"  a\\n b ","confidence":"0.7"}```')
    assert good.target_countries == ["KR"]
    assert good.narrative_subjects == ["국제통화기금"]
    assert good.subject_categories is None
    assert (good.sentiment, good.sentiment_rationale) == ("mixed", "a b")
    assert (good.analysis_status, good.confidence) == ("analyzed", 0.7)


def test_odd_replies(spark):
    assert judge(spark, "no json") is None
    assert judge(spark, "[1]") is None
    assert judge(spark, '{"sentiment": "glad"}') is None
    assert judge(spark, '{"sentiment": "neutral"').__class__ is type(None)
    declined = judge(spark, '{"analyzable": false, "subject_categories": ["반도체"]}')
    assert (declined.analysis_status, declined.subject_categories) == ("unanalyzed", None)
    low = judge(spark, '{"sentiment": "neutral", "confidence": null, "subject_categories": "반도체"}')
    assert (low.analysis_status, low.confidence) == ("low_confidence", 0.0)
    assert low.subject_categories == ["기타"]
    assert judge(spark, '{"sentiment": "neutral", "confidence": 7}').confidence == 1.0
    assert judge(spark, '{"sentiment": "neutral", "confidence": [1]}').confidence == 0.0
