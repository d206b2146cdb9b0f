"""Questions over a small hand-written Gold."""

import pytest

from pressgauge import schemas
from pressgauge.operators import slices
from pressgauge.plans import screens
from pressgauge.plans.gold import Gold


def gold_of(spark, trend=(), tone=(), windows=(), counts=(), picks=(), parts=()):
    def frame(rows, ddl):
        return spark.createDataFrame(list(rows), ddl)

    return Gold(
        article_pick=frame(picks, schemas.ARTICLE_PICK),
        subject_trend=frame(trend, schemas.SUBJECT_TREND),
        subject_source_contribution=frame(parts, schemas.SOURCE_CONTRIBUTION),
        axis_sentiment=frame(tone, schemas.AXIS_SENTIMENT),
        subject_window=frame(windows, schemas.SUBJECT_WINDOW),
        axis_window=frame(counts, schemas.AXIS_WINDOW),
    )


def line(subject, axis, unit, bucket, raw, share):
    return (subject, axis, unit, bucket, raw, share, 0.0, [share])


NOW, BEFORE = ("2026-06-16T15", "2026-06-23T14"), ("2026-06-09T15", "2026-06-16T14")


@pytest.fixture(scope="module")
def daily(spark):
    trend = [
        line("rate", "KR", "day", "2026-06-21", 4, 0.4), line("chip", "KR", "day", "2026-06-21", 6, 0.6),
        line("rate", "KR", "day", "2026-06-22", 5, 0.5), line("chip", "KR", "day", "2026-06-22", 5, 0.5),
        line("rate", "KR", "day", "2026-06-23", 5, 0.45), line("chip", "KR", "day", "2026-06-23", 9, 0.2),
        line("fab", "KR", "day", "2026-06-23", 3, 0.35), line("usa", "US", "day", "2026-06-22", 3, 1.0),
        line("hourly", "KR", "hour", "2026-06-23T14", 99, 0.99),
    ]
    tone = [
        ("KR", "day", "2026-06-22", (0.5, 0.5, 0.0, 0.0, 0.2), 80),
        ("KR", "day", "2026-06-23", (0.5, 0.5, 0.0, 0.0, 0.1), 90),
        ("US", "day", "2026-06-22", (1.0, 0.0, 0.0, 0.0, 0.0), 3),
    ]
    windows = [
        ("rate", "KR", "7d", "current", *NOW, 9, 0.4), ("fab", "KR", "7d", "current", *NOW, 3, 0.35),
        ("chip", "KR", "7d", "current", *NOW, 20, 0.25),
        ("rate", "KR", "7d", "previous", *BEFORE, 5, 0.5),
        ("chip", "KR", "7d", "previous", *BEFORE, 5, 0.5),
        ("usa", "US", "7d", "current", *NOW, 3, 1.0),
    ]
    counts = [
        ("KR", "7d", "current", *NOW, 100, 90), ("KR", "7d", "previous", *BEFORE, 80, 70),
        ("US", "7d", "current", *NOW, 3, 3),
    ]
    return gold_of(spark, trend, tone, windows, counts)


def test_dashboard_ranks_the_window(daily):
    board = screens.Dashboard(daily, "KR")
    rows = {r.subject: r for r in board.top_subjects().collect()}
    assert [s for s, _ in sorted(rows.items(), key=lambda kv: kv[1]["rank"])] == ["rate", "fab", "chip"]
    assert (rows["chip"]["rank"], rows["chip"].raw_rank, rows["chip"].rank_shift) == (3, 1, True)
    assert rows["rate"].spark == [0.4, 0.5, 0.45]
    assert (rows["rate"].delta, rows["rate"].is_new) == (-10.0, False)
    assert rows["fab"].spark == [0.0, 0.0, 0.35]
    assert (rows["fab"].delta, rows["fab"].is_new) == (35.0, True)
    assert {r.subject for r in board.movers(20.0).collect()} == {"fab", "chip"}
    assert {r.subject for r in board.movers(1.0, only_new=True).collect()} == {"fab"}


def test_dashboard_summary_and_basis(daily):
    board = screens.Dashboard(daily, "KR")
    row = board.summary().first()
    assert (row.collected, row.collected_prev, row.analyzed) == (100, 80, 90)
    assert (row.coverage, row.low_confidence, row.collected_change) == (0.9, 0.1, 25.0)
    basis = board.basis().first()
    assert (basis.bucket, basis.has_baseline, basis.empty_window) == ("2026-06-23", True, False)
    assert basis.buckets == ["2026-06-21", "2026-06-22", "2026-06-23"]


def test_axis_that_missed_the_latest_collection(daily):
    board = screens.Dashboard(daily, "US")
    basis = board.basis().first()
    assert (basis.bucket, basis.last_bucket, basis.empty_window) == ("2026-06-23", "2026-06-22", True)
    assert board.top_subjects().count() == 0
    assert board.summary().count() == 0


def test_parameters_fall_back():
    assert slices.axis_or("ALL") == "KR"
    assert slices.axis_or_all("ALL") == "ALL"
    assert slices.range_or("90d") == "7d"
    assert slices.unit_within("day", "24h") == "hour"
    assert slices.unit_within("week", "30d") == "week"


@pytest.fixture(scope="module")
def spiky(spark):
    rows = [line("fx", "KR", "day", "2026-06-01", 80, 0.8)]
    for d in range(16, 23):
        day = f"2026-06-{d}"
        rows += [line("fx", "KR", "day", day, 10, 0.1), line("rate", "KR", "day", day, 20, 0.2)]
        rows += [line("house", "KR", "day", day, 14, 0.14)] if d <= 19 else []
    day = "2026-06-23"
    rows += [line("fx", "KR", "day", day, 30, 0.3), line("rate", "KR", "day", day, 40, 0.2),
             line("house", "KR", "day", day, 8, 0.08), line("chip", "KR", "day", day, 5, 0.05),
             line("usa", "US", "day", day, 99, 1.0)]
    return gold_of(spark, rows)


def test_spikes(spiky):
    rows = sorted(screens.spikes(spiky, "KR").collect(), key=lambda r: r["rank"])
    assert [r.subject for r in rows] == ["fx", "rate", "house", "chip"]
    fx, rate, house, chip = rows
    assert fx.raw_multiple == pytest.approx(3)
    assert (fx.spike, fx.normalized_away) == (True, False)
    assert rate.raw_multiple == pytest.approx(2)
    assert rate.normalized_multiple == pytest.approx(1)
    assert (rate.spike, rate.normalized_away) == (True, True)
    assert (house.baseline_raw, house.spike) == (8, False)
    assert (chip.is_new, chip.raw_multiple, chip.spike) == (True, None, False)


def test_spikes_over_thirty_days_and_without_baseline(spark, spiky):
    fx = next(r for r in screens.spikes(spiky, "KR", "30d").collect() if r.subject == "fx")
    assert fx.raw_multiple == pytest.approx(30 / (150 / 8))
    alone = gold_of(spark, [line("fx", "KR", "day", "2026-06-23", 30, 0.3)])
    row = screens.spikes(alone, "KR").first()
    assert (row.raw_multiple, row.is_new, row.spike) == (None, False, False)
    assert screens.spikes(gold_of(spark), "GLOBAL", "bogus").count() == 0


def test_spikes_read_the_finest_unit(spark):
    rows = [line("fx", "KR", "hour", "2026-06-22T23", 2, 0.2), line("fx", "KR", "hour", "2026-06-23T00", 6, 0.6),
            line("fx", "KR", "day", "2026-06-23", 6, 0.6)]
    assert screens.spikes(gold_of(spark, rows), "KR").first().raw_multiple == pytest.approx(3)


def test_trend_pins_the_requested_subject(spark):
    rows = [line(s, "KR", "day", d, 1, v) for d, shares in
            {"2026-06-22": {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4},
             "2026-06-23": {"a": 0.5, "b": 0.3, "c": 0.2}}.items() for s, v in shares.items()]
    gold = gold_of(spark, rows)
    kept = {r.subject: r for r in screens.trend(gold, "KR", "d").collect()}
    assert set(kept) == {"a", "b", "d"}
    assert kept["d"].selected
    assert (kept["d"].latest_share, kept["d"].latest_delta) == (0.0, 0.0)
    unknown = {r.subject for r in screens.trend(gold, "KR", "zz").collect() if r.selected}
    assert unknown == {"a"}


def test_comparison_keeps_three_columns(daily):
    both = screens.Comparison(daily)
    assert {r.axis for r in both.top_subjects().collect()} == {"KR"}
    tone = {r.axis: r.present for r in both.tone().collect()}
    assert tone == {"KR": False, "US": False, "GLOBAL": False}


def test_composition_follows_the_requested_subject(spark):
    day = "2026-06-23"
    gold = gold_of(
        spark,
        trend=[line("a", "KR", "day", day, 2, 0.6), line("b", "KR", "day", day, 1, 0.4)],
        picks=[("KR", "day", day, "r1", "s1", "t1", ["a", "b"]), ("KR", "day", day, "r2", "s2", "t2", ["a"])],
        parts=[("a", "KR", "day", day, "s1", 1, 0.5, 0.25), ("a", "KR", "day", day, "s2", 1, 0.5, 0.35)],
    )
    lead = screens.Composition(gold, "KR")
    basis = lead.basis().first()
    assert (basis.subject, basis.raw_total, basis.normalized_total, basis.listed_total) == ("a", 2, 0.6, 2)
    assert lead.concentration().first().top_source_id == "s1"
    assert screens.Composition(gold, "KR", "nothing").contributions().count() == 0
    items = spark.createDataFrame(
        [("r1", "s1", "old", "u", "h", True, "t0"), ("r1", "s1", "T", "u", "h", True, "t1"),
         ("r2", "s2", "T2", "u2", "h", True, "t2")],
        "record_id string, source_id string, title string, source_url string, body_hash string, "
        "body_available boolean, collected_at string",
    )
    shares = spark.createDataFrame([("h", 2)], "body_hash string, shares long")
    listed = lead.articles(items, shares).collect()
    assert [(r.record_id, r.title) for r in listed] == [("r2", "T2"), ("r1", "T")]
    assert all(r.body_duplicate for r in listed)
