"""Gold folded again only where something changed, and datasets that readers see change together."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressgauge import schemas
from pressgauge.operators import versions
from pressgauge.plans import gold, refresh
from pressgauge.sources.builds import Builds
from pressgauge.sources.lake import Lake, with_partition

START = datetime(2026, 1, 5)  # a Monday


def observed(spark, rows):
    """(record, axis, source, hours since START, subjects)."""
    full = []
    for record, axis, source, hour, _ in rows:
        at = (START + timedelta(hours=hour)).strftime("%Y-%m-%dT%H:00")
        full.append((record, source, axis, 1, 1, "t", "", "", False, f"{at}:30+00:00", at))
    items = with_partition(spark.createDataFrame(full, schemas.NEWS_ITEM), F.col("collection_cycle"))
    labels = [(r[0], "u", [], list(r[4]), None, "neutral", None, "analyzed", 0.9, "2026-06-01T00:00:00Z", "v1", "run", None, None) for r in rows]
    return items, spark.createDataFrame(labels, schemas.ANALYSIS)


def put(lake, rows):
    items, labels = observed(lake.spark, rows)
    lake.write_cycles("bronze", "news_item", items)
    versions.store_analyses(lake, items, labels, counted=False)


def values(built):
    return {name: sorted(map(repr, rows.collect())) for name, rows in built.datasets().items()}


def whole(spark, tmp_path, rows, name):
    """All folded at once, in a lake of its own."""
    lake = Lake(spark, str(tmp_path / name))
    put(lake, rows)
    return values(gold.aggregate_lake(lake))


@pytest.fixture(scope="module")
def story():
    """Eleven weeks: a subject of every week, rare ones, and one that is only there at both ends."""
    rnd = random.Random(3)
    rows = []
    for week in range(11):
        for i in range(6):
            subjects = {"steady", rnd.choice(["x", "y", "z"])} | ({"rare"} if week in (0, 4, 10) else set())
            hour = week * 168 + rnd.randrange(168)
            rows.append((f"r{week}-{i}", rnd.choice(["KR", "US", "GLOBAL"]), f"s{i % 3}", hour, sorted(subjects)))
    return rows


def test_touched_weeks_only_and_the_same_gold(spark, tmp_path, story, monkeypatch):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(lake, [r for r in story if not r[0].startswith("r4-")])
    assert refresh.refresh(lake) is None
    before = {(d, u, w): b for d, u, w, b in Builds(lake, "gold").pointer()}
    put(lake, [r for r in story if r[0].startswith("r4-")])
    # the observations of weeks that nothing touched are not readable any more, but listed as before
    for path in glob.glob(f"{lake.root}/*/*/year=*/**/*.parquet", recursive=True):
        day = "-".join(part.split("=")[1] for part in path.split("/") if part.startswith(("year=", "month=", "day=")))
        if not 28 <= (datetime.fromisoformat(day) - START).days < 35:
            at = os.stat(path)
            with open(path, "r+b") as file:
                file.write(b"\0" * at.st_size)
            os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))
    assert refresh.refresh(lake) == ["2026-W06"]
    assert values(gold.read(lake)) == whole(spark, tmp_path, story, "whole")
    after = {(d, u, w): b for d, u, w, b in Builds(lake, "gold").pointer()}
    moved = {w for (d, u, w), b in after.items() if before.get((d, u, w)) != b}
    assert "2026-W06" in moved and "2026-W02" not in moved and "2026-W05" not in moved
    assert {w for (d, u, w), b in after.items() if before.get((d, u, w)) != b and d == "axis_sentiment"} == {"2026-W06"}
    assert refresh.refresh(lake) == []


def test_rows_that_leave_and_weeks_that_empty(spark, tmp_path, story):
    lake = Lake(spark, str(tmp_path / "lake"))
    put(lake, story)
    gold.aggregate_lake(lake)
    left = [r for r in story if not r[0].startswith(("r10-", "r0-")) and r[0] != "r5-1"]
    items, _ = observed(spark, [r for r in story if r not in left])
    still, _ = observed(spark, left)
    parts = list(schemas.PARTITION)
    lake.clear_cycles("bronze", "news_item", items.join(still, parts, "left_anti"))
    lake.write_cycles("bronze", "news_item", still.join(items.select(*parts), parts, "left_semi"))
    assert refresh.refresh(lake) == ["2026-W02", "2026-W07", "2026-W12"]
    assert values(gold.read(lake)) == whole(spark, tmp_path, left, "whole")


def test_another_version_folds_all(spark, lake, story):
    put(lake, story[:12])
    gold.aggregate_lake(lake)
    versions.record_decision(lake, "publish", "v1", "as it is")
    assert refresh.refresh(lake) is None


def test_an_empty_lake(spark, lake):
    built = gold.aggregate_lake(lake)
    assert all(rows.count() == 0 for rows in built.datasets().values())


def test_readers_see_all_datasets_of_a_commit_or_none(spark, lake, story, monkeypatch):
    put(lake, story[:12])
    first = values(gold.aggregate_lake(lake))
    put(lake, story[12:])

    def broken(*_):
        raise RuntimeError("cut short")

    with monkeypatch.context() as m:
        m.setattr(Lake, "write_records", broken)  # the pointer is the last thing to be written
        with pytest.raises(RuntimeError):
            gold.aggregate_lake(lake)
    assert values(gold.read(lake)) == first
    assert values(gold.aggregate_lake(lake)) != first


def test_builds_that_nobody_sees_go(spark, lake):
    builds = Builds(lake, "gold")
    names = "axis string, bucket_unit string, subject string, buckets bigint, week string"
    row = lambda week, n: spark.createDataFrame([("KR", "day", "s", n, week)], names)
    builds.commit({"line_week": (row("2026-W01", 1).unionByName(row("2026-W02", 1)), None)})
    for n in range(2, 8):
        builds.commit({"line_week": (row("2026-W02", n), ["2026-W02"])})
    assert {r.week: r.buckets for r in builds.read("line_week").collect()} == {"2026-W01": 1, "2026-W02": 7}
    assert len(glob.glob(f"{lake.folder('gold', 'line_week')}/build=*")) <= 5  # the first, the seen, and a few before
    assert builds.read("line_week", ["2026-W01"]).inputFiles() == [f for f in builds.read("line_week").inputFiles() if "W01" in f]


def test_windows_read_the_weeks_they_reach_into(spark, lake, story):
    put(lake, story)
    gold.aggregate_lake(lake)
    builds = Builds(lake, "gold")
    hours = refresh.window_hours(builds)
    weeks = {f.split("week=")[1].split("/")[0] for f in hours.inputFiles()}
    assert weeks and min(weeks) >= "2026-W03" and weeks < set(builds.weeks("hour_pick"))
    again = {name: sorted(map(repr, rows.collect())) for name, rows in refresh.windows(hours).items()}
    seen = values(gold.read(lake))
    assert again == {name: seen[name] for name in again}


def test_signatures_come_from_the_listing_alone(spark, lake, story):
    put(lake, story[:6])
    plan = lake.signatures("bronze", "news_item")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan
    before = lake.signatures("bronze", "news_item").collect()
    assert before == lake.signatures("bronze", "news_item").collect() and len({r.signature for r in before}) == len(before)
