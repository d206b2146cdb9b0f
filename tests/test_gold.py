"""The Gold folds on hand-made rows with literal expected values."""

import math
import random
from collections import defaultdict

import pytest
from rows import bronze, keyed, silver

from pressgauge.operators import contributions, picks, shares, tone
from pressgauge.operators.picks import BUCKET_KEYS
from pressgauge.plans import gold

H = "2026-06-23T"


def fold(spark, b, s):
    every = gold.all_picks(bronze(spark, b), silver(spark, s))
    return every, keyed(shares.subject_trend(every), "subject", "axis", "bucket_unit", "time_bucket")


def test_delta_and_history_come_from_present_buckets(spark):
    b = [(str(i), "KR", "s", f"{H}14" if i < 3 else f"{H}15") for i in range(1, 7)]
    s = [("1", ["A"]), ("2", ["B"]), ("3", ["A"]), ("4", ["A"]), ("5", ["A"]), ("6", ["B"])]
    _, rows = fold(spark, b, s)
    first, second = rows["A", "KR", "hour", f"{H}14"], rows["A", "KR", "hour", f"{H}15"]
    assert (first.normalized_share, first.delta, first.spark) == (0.5, 0.0, [0.5])
    assert (second.normalized_share, second.delta, second.spark) == (0.75, 25.0, [0.5, 0.75])
    assert second.raw_count == 3
    assert rows["B", "KR", "hour", f"{H}15"].delta == -25.0


def test_history_keeps_six_points(spark):
    b = [(str(i), "KR", "s", f"{H}{i:02d}") for i in range(8)]
    _, rows = fold(spark, b, [(str(i), ["A"]) for i in range(8)])
    assert rows["A", "KR", "hour", f"{H}07"].spark == [1.0] * 6
    assert rows["A", "KR", "day", "2026-06-23"].raw_count == 8


def test_root_weights(spark):
    b = [(f"a{i}", "KR", "A", f"{H}14") for i in range(30)]
    b += [(f"b{i}", "KR", "B", f"{H}14") for i in range(2)]
    s = [(f"a{i}", ["chips" if i < 15 else "rest"]) for i in range(30)]
    s += [(f"b{i}", ["rates"]) for i in range(2)]
    _, rows = fold(spark, b, s)
    assert rows["chips", "KR", "hour", f"{H}14"].normalized_share == pytest.approx(0.397, abs=1e-3)
    assert rows["rates", "KR", "hour", f"{H}14"].normalized_share == pytest.approx(0.205, abs=1e-3)
    assert rows["chips", "KR", "hour", f"{H}14"].raw_count == 15


def test_all_axis_is_the_mean_of_axes(spark):
    b = [("1", "KR", "kr", f"{H}14"), ("2", "KR", "kr", f"{H}14"), ("3", "KR", "kr", f"{H}14"),
         ("4", "US", "us", f"{H}14")]
    _, rows = fold(spark, b, [("1", ["A"]), ("2", ["A"]), ("3", ["B"]), ("4", ["C"])])
    at = ("ALL", "hour", f"{H}14")
    # (0.6667 + 0) / 2 and (0.3333 + 0) / 2, each rounded on its double.
    assert rows["A", *at].normalized_share == round((0.6667 + 0.0) / 2, 4)
    assert rows["B", *at].normalized_share == round((0.3333 + 0.0) / 2, 4)
    assert rows["C", *at].normalized_share == 0.5
    assert [rows[k, *at].raw_count for k in "ABC"] == [2, 1, 1]


def test_all_axis_leaves_out_an_axis_without_subjects(spark):
    b = [("1", "KR", "kr", f"{H}10"), ("2", "KR", "kr", f"{H}11"), ("3", "US", "us", f"{H}11"),
         ("4", "US", "us", f"{H}10")]
    _, rows = fold(spark, b, [("1", ["A"]), ("2", ["A"]), ("3", ["B"]), ("4", [])])
    assert rows["A", "ALL", "hour", f"{H}10"].normalized_share == 1.0
    assert rows["A", "ALL", "hour", f"{H}11"].normalized_share == 0.5
    assert rows["B", "ALL", "hour", f"{H}11"].normalized_share == 0.5


def test_reobserved_article_counts_once_per_bucket(spark):
    url = "https://n.test/a"
    b = [("a1", "KR", "s", f"{H}14", url), ("a2", "KR", "s", f"{H}15", url),
         ("a3", "KR", "s", f"{H}16", url), ("b", "KR", "s", f"{H}14")]
    every, rows = fold(spark, b, [("a1", ["A"]), ("a2", ["A"]), ("a3", ["A"]), ("b", ["B"])])
    assert rows["A", "KR", "day", "2026-06-23"].raw_count == 1
    assert rows["A", "KR", "day", "2026-06-23"].normalized_share == 0.5
    assert sum(1 for k in rows if k[:3] == ("A", "KR", "hour")) == 3
    day = [r for r in every.collect() if r.bucket_unit == "day" and r.article == url]
    assert [r.record_id for r in day] == ["a3"]


def test_week_buckets_follow_the_iso_year(spark):
    b = [("1", "KR", "s", "2026-06-23T14"), ("2", "KR", "s", "2026-06-28T14"),
         ("3", "KR", "s", "2026-06-29T14"), ("4", "KR", "s", "2027-01-01T00")]
    _, rows = fold(spark, b, [(str(i), ["A"]) for i in range(1, 5)])
    weeks = {k[3]: r.raw_count for k, r in rows.items() if k[1:3] == ("KR", "week")}
    assert weeks == {"2026-W26": 2, "2026-W27": 1, "2026-W53": 1}


def test_categories_win_over_subjects_and_empty_is_a_judgement(spark):
    b = [(str(i), "KR", "s", f"{H}14") for i in range(1, 4)]
    s = [("1", ["x"], "neutral", ["C"]), ("2", ["y"], "neutral", []), ("3", ["z"])]
    every, rows = fold(spark, b, s)
    assert {k[0] for k in rows if k[1] == "KR"} == {"C", "z"}
    listed = picks.article_picks(every).filter("bucket_unit = 'hour'")
    assert {r.record_id for r in listed.collect()} == {"1", "3"}


def test_sentiment_counts_over_labelled_and_all_pools(spark):
    b = [("1", "KR", "kr", f"{H}14"), ("2", "KR", "kr", f"{H}14"), ("3", "US", "us", f"{H}14"),
         ("4", "GLOBAL", "gl", f"{H}14")]
    s = [("1", ["A"], "positive"), ("2", ["A"], "positive"), ("3", ["A"], "negative"),
         ("4", ["A"], None)]
    every = gold.all_picks(bronze(spark, b), silver(spark, s))
    row = keyed(tone.axis_sentiment(every), "axis", "bucket_unit")["ALL", "hour"]
    assert row.analyzed_total == 3
    assert row.distribution.positive == 0.6667
    assert row.distribution.negative == 0.3333
    assert row.distribution.unanalyzed == 0.25


def test_contributions_of_thirds_add_up(spark):
    b = [(str(i), "KR", f"s{i}", f"{H}14") for i in range(3)]
    every = gold.all_picks(bronze(spark, b), silver(spark, [(str(i), ["A"]) for i in range(3)]))
    rows = contributions.source_contributions(every).filter("bucket_unit = 'hour'").collect()
    assert sorted(r.normalized_contribution for r in rows) == [0.3333, 0.3333, 0.3334]
    top = max(rows, key=lambda r: r.normalized_contribution)
    assert top.source_id == "s0"
    assert all(r.raw_share == 0.3333 for r in rows)


def test_windows_end_at_the_latest_hour(spark):
    b = [("now", "KR", "s", f"{H}14"), ("day", "KR", "s", "2026-06-22T14"),
         ("two", "KR", "s", "2026-06-21T14")]
    hours = picks.hour_picks(gold.labelled_observations(
        bronze(spark, b), silver(spark, [("now", ["A"]), ("day", ["B"]), ("two", ["C"])])))
    rows = shares.subject_window(picks.window_picks(hours)).filter("axis = 'KR'").collect()
    at = {(r.range, r.period, r.subject): (r.window_start, r.window_end) for r in rows}
    assert at["24h", "current", "A"] == ("2026-06-22T15", "2026-06-23T14")
    assert at["24h", "previous", "B"] == ("2026-06-21T15", "2026-06-22T14")
    assert {k[2] for k in at if k[:2] == ("7d", "current")} == {"A", "B", "C"}


def test_window_counts(spark):
    b = [("1", "KR", "s", f"{H}14"), ("2", "KR", "s", f"{H}13"), ("3", "US", "s", f"{H}12"),
         ("4", "KR", "s", "2026-06-22T09")]
    s = [("1", ["A"]), ("2", [], None), ("3", ["B"]), ("4", ["A"])]
    hours = picks.hour_picks(gold.labelled_observations(bronze(spark, b), silver(spark, s)))
    rows = keyed(tone.axis_window(picks.window_picks(hours)), "axis", "range", "period")
    counts = {k: (r.collected, r.analyzed_total) for k, r in rows.items()}
    assert counts["KR", "24h", "current"] == (2, 1)
    assert counts["KR", "24h", "previous"] == (1, 1)
    assert counts["ALL", "24h", "current"] == (3, 2)
    assert ("US", "24h", "previous") not in counts


def test_no_input_gives_no_rows(spark):
    labelled = gold.labelled_observations(bronze(spark, []), silver(spark, []))
    every = picks.unit_picks(labelled)
    assert shares.subject_trend(every).count() == 0
    assert tone.axis_sentiment(every).count() == 0
    assert shares.subject_window(picks.window_picks(picks.hour_picks(labelled))).count() == 0


def brute_force(rows):
    """Shares of one bucket from (axis, source, keys), straight from the definition."""
    out = {}
    per_axis = {}
    for axis in {r[0] for r in rows}:
        articles, said = defaultdict(int), defaultdict(lambda: defaultdict(int))
        for _, source, keys in (r for r in rows if r[0] == axis):
            articles[source] += 1
            for key in keys:
                said[source][key] += 1
        weight = sum(math.sqrt(n) for n in articles.values())
        share = defaultdict(float)
        for source, counts in said.items():
            for key, n in counts.items():
                share[key] += n / sum(counts.values()) * math.sqrt(articles[source]) / weight
        total = sum(share.values())
        folded = {k: round(v / total, 4) for k, v in share.items()}
        if folded:
            per_axis[axis] = folded
        out.update({(k, axis): v for k, v in folded.items()})
    subjects = {k for folded in per_axis.values() for k in folded}
    for k in subjects:
        mean = sum(f.get(k, 0.0) for f in per_axis.values()) / len(per_axis)
        out[k, "ALL"] = round(mean, 4)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_match_brute_force_with_a_hot_source(spark, seed):
    """One source holds a third of the articles, one subject most of the mentions."""
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        axis = rng.choice(["KR", "KR", "US", "GLOBAL"])
        source = "hot" if rng.random() < 0.34 else f"s{rng.randrange(9)}"
        keys = ["big"] if rng.random() < 0.4 else rng.sample("abcdefgh", rng.randrange(0, 3))
        rows.append((axis, source, keys))
    b = [(str(i), r[0], r[1], f"{H}14") for i, r in enumerate(rows)]
    every, got = fold(spark, b, [(str(i), r[2]) for i, r in enumerate(rows)])
    want = brute_force(rows)
    shown = {(k[0], k[1]): r.normalized_share for k, r in got.items() if k[2] == "hour"}
    assert shown.keys() == want.keys()
    assert all(shown[k] == pytest.approx(want[k], abs=1.01e-4) for k in want)
    assert sum(abs(shown[k] - want[k]) > 1e-9 for k in want) <= 2
    parts = defaultdict(int)
    for r in contributions.source_contributions(every).filter("bucket_unit = 'hour'").collect():
        parts[r.subject, r.axis] += round(r.normalized_contribution * 10000)
    assert parts == {k: round(v * 10000) for k, v in shown.items() if k[1] != "ALL"}
    raw = sum(r.raw_count for k, r in got.items() if k[1] != "ALL" and k[2] == "hour")
    assert raw == sum(len(r[2]) for r in rows)


def test_folding_the_same_rows_in_other_partitions_changes_nothing(spark):
    rng = random.Random(5)
    b = [(str(i), "KR", f"s{rng.randrange(7)}", f"{H}14") for i in range(120)]
    s = [(str(i), rng.sample("abcdef", 2)) for i in range(120)]
    one = gold.all_picks(bronze(spark, b), silver(spark, s))
    other = gold.all_picks(bronze(spark, b).repartition(7), silver(spark, s).repartition(3))
    terms = [shares.share_terms(shares.mentions(p, BUCKET_KEYS), BUCKET_KEYS) for p in (one, other)]
    left, right = (sorted(t.collect()) for t in terms)
    assert left == right


def test_aggregate_job_publishes_all_datasets(spark, lake):
    b = [(str(i), "KR", "s", f"{H}14") for i in range(3)]
    built = gold.publish(
        lake, gold.aggregate(bronze(spark, b), silver(spark, [(str(i), ["A"]) for i in range(3)]))
    )
    again = gold.read(lake)
    for name, rows in again.datasets().items():
        assert rows.count() == getattr(built, name).count() > 0
    assert again.subject_trend.filter("axis = 'KR' AND bucket_unit = 'week'").first().spark == [1.0]
