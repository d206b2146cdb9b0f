"""Call files read one by one, flat datasets that move, logs put together, collection as a transaction, and the
source table."""

import glob
import json
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from rows import bronze, silver
from test_lake_jobs import analyses

from pressgauge import schemas
from pressgauge.operators import shares
from pressgauge.plans import gold, ingestion, runs
from pressgauge.sources import calls, feeds
from pressgauge.session import remove, staged
from pressgauge.sources.lake import Lake, with_partition
from pressgauge.workload import lake_queries


def put_call(folder, name, text):
    path = folder / name[:1] / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_only_new_and_changed_call_files_are_opened(spark, lake, tmp_path):
    folder = tmp_path / "calls"
    old = put_call(folder, "a1", json.dumps({"call_id": "a1", "call_outcome": "parsed", "duration_ms": 5}))
    put_call(folder, "b1", '{"call_id": "b1", ')
    put_call(folder, "b2", " ")
    put_call(folder, "b4", "")  # no byte, no row
    gone = put_call(folder, "b3", json.dumps({"call_id": "b3"}))
    changed = put_call(folder, "c1", json.dumps({"call_id": "c1", "call_outcome": "parsed"}))
    put_call(folder, "c2", json.dumps({"call_id": "c2", "duration_ms": "long"}))
    put_call(folder, "c3", json.dumps(["c3"]))

    def seen():
        rows = calls.refresh_calls(lake, str(folder)).collect()
        return {os.path.basename(r.file_path): (r.decoded, r.call_id, r.call_outcome) for r in rows}

    broken = (False, None, None)
    first = {"a1.json": (True, "a1", "parsed"), "b1.json": broken, "b2.json": broken, "b3.json": (True, "b3", None),
             "c1.json": (True, "c1", "parsed"), "c2.json": broken, "c3.json": broken}
    assert seen() == first
    # what is known is not opened again: its content may be anything as long as size and time are the same
    at = os.stat(old)
    old.write_bytes(b"x" * at.st_size)
    os.utime(old, ns=(at.st_atime_ns, at.st_mtime_ns))
    gone.unlink()
    changed.write_text(json.dumps({"call_id": "c1", "call_outcome": "call_failed"}))
    put_call(folder, "d1", json.dumps({"call_id": "d1"}))
    want = {k: v for k, v in first.items() if k != "b3.json"}
    assert seen() == want | {"c1.json": (True, "c1", "call_failed"), "d1.json": (True, "d1", None)}
    assert seen() == want | {"c1.json": (True, "c1", "call_failed"), "d1.json": (True, "d1", None)}


def test_call_files_need_no_folder_and_no_removal_each(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", "en") for i in [*range(90), 5, None]]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    removed = []
    monkeypatch.setattr(lake_queries, "remove", lambda spark, path: (removed.append(path), remove(spark, path)))
    got = sorted(map(str, lake_queries.refreshed_call_files(spark, str(tmp_path)).collect()))
    want = [i for i in range(90) if i % 9 != 1]
    full = [(f"call-{i}", True, "changed" if i % 9 == 4 else "en", len(f"text {i}")) if i % 7 != 3 else (None, False, None, None) for i in want]
    names = ["call_id", "decoded", "call_outcome", "reply_size"]
    assert [r for r in got if "call-5'" not in r] == sorted(str(Row(**dict(zip(names, r)))) for r in full if r[0] != "call-5")
    assert len(removed) == 5 < sum(i % 9 == 1 for i in range(90))


def test_call_files_are_written_by_tasks_and_read_many_at_a_time(spark, lake, tmp_path):
    folder = str(tmp_path / "files")
    call = lambda i, outcome: (i % 3 if i else None, f"call-{i}", json.dumps({"call_id": f"call-{i}", "call_outcome": outcome}))
    put = lambda rows: calls.put_files(spark.createDataFrame(rows, "part int, name string, value string"), folder)
    put([call(i, "first") for i in range(200)])
    found = sorted(os.path.join(at, n) for at, _, names in os.walk(folder) for n in names)
    assert len(found) == 200 and f"{folder}/part=1/call-4.txt" in found  # Hadoop would add a checksum file to each
    assert calls.refresh_calls(lake, folder, "*.txt").count() == 200
    put([call(i, "changed") for i in range(0, 200, 2)])
    got = calls.refresh_calls(lake, folder, "*.txt")
    assert {(r.call_id, r.call_outcome) for r in got.collect()} == {(f"call-{i}", "first" if i % 2 else "changed") for i in range(200)}
    assert got.count() == 200
    listed = calls.listed_files(spark, folder, "*.txt")
    assert calls._together(listed, 32).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism < listed.rdd.getNumPartitions()


def flat_file(lake, layer, dataset, rows):
    path = f"{lake.folder(layer, dataset)}.jsonl"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.writelines(json.dumps(r) + "\n" for r in rows)
    return path


def test_a_flat_file_moves_to_objects_and_goes_only_then(spark, lake, monkeypatch):
    body = lambda k, text: {"body_hash": k, "raw_text": text, "first_seen_at": "t1", "first_seen_cycle": "c"}
    path = flat_file(lake, "bronze", "news_body", [body("a", "x"), body("b", "y"), body("c", "z"), body("c", "z"), {"raw_text": "no key"}])
    first = [F.col("first_seen_at")]
    lake.put_objects("bronze", "news_body", "body_hash", spark.createDataFrame([("a", "kept", "t0", "c")], schemas.NEWS_BODY), first)

    def cut_short(*_):
        raise RuntimeError("cut short")

    with monkeypatch.context() as m:
        m.setattr(Lake, "_retire", cut_short)
        with pytest.raises(RuntimeError):
            lake.migrate_to_objects("bronze", "news_body", "body_hash", first)
    assert os.path.exists(path)
    assert lake.migrate_to_objects("bronze", "news_body", "body_hash", first) == 0  # all had moved before
    assert not os.path.exists(path) and os.path.exists(f"{path}.migrated")
    rows = {r.body_hash: r.raw_text for r in lake.read_objects("bronze", "news_body", "body_hash").collect()}
    assert rows == {"a": "kept", "b": "y", "c": "z"} and lake.read_objects("bronze", "news_body", "body_hash").count() == 3
    assert lake.migrate_to_objects("bronze", "news_body", "body_hash", first) == 0


def test_a_flat_file_moves_to_cycles_once(spark, lake):
    one = analyses(spark, ("r1", "v1", "t1", "a"), ("r2", "v1", "t1", "a"), ("r9", "v1", "t1", "a")).toJSON().collect()
    path = flat_file(lake, "silver", "analysis", map(json.loads, one))
    where = spark.createDataFrame([("r1", "2026-06-23T14:00"), ("r2", "2026-06-23T15:00")], "record_id string, collection_cycle string")
    again = lake.flat_rows("silver", "analysis")
    lake.relay_to_cycles("silver", "analysis", again, where)  # a run that died before the file was retired
    lake.migrate_to_cycles("silver", "analysis", where)
    rows = sorted((r.record_id, r.hour) for r in lake.read_cycles("silver", "analysis").collect())
    assert rows == [("r1", "14"), ("r2", "15")] and not os.path.exists(path)


def states(spark, n):
    state = {c: None for c in spark.createDataFrame([], schemas.STAGE_STATE).columns}
    rows = [tuple((state | {
        "run_id": f"run-{i % 7}", "run_trigger": "scheduled", "attempt": f"a{i}", "noted_at": f"2026-06-23T{i // 60:02d}:{i % 60:02d}:00",
        "stage_name": f"s{i % 3}", "stage_status": "failed" if i % 50 == 0 else "succeeded", "stage_started_at": "t0", "stage_ended_at": f"t{i}",
    }).values()) for i in range(n)]
    return spark.createDataFrame(rows, schemas.STAGE_STATE)


def test_a_thousand_states_are_put_together(spark, lake):
    rows = states(spark, 1000)
    folder = lake.folder("silver", "stage_state")
    rows.repartition(1000, "attempt").write.option("maxRecordsPerFile", 1).parquet(f"{folder}/tail")
    files = lambda: len(glob.glob(f"{folder}/**/*.parquet", recursive=True))
    before = sorted(map(repr, runs.run_records(lake).collect()))
    assert files() >= 1000
    kept = f"{folder}/tail/" + lake._tail("silver", "stage_state")[0]
    with open(kept, "rb") as file:
        content = file.read()
    lake.append_log("silver", "stage_state", rows.limit(0))
    assert files() < 100 and not lake._tail("silver", "stage_state")
    assert sorted(map(repr, runs.run_records(lake).collect())) == before
    with open(kept, "wb") as file:  # a removal that was cut short: the file is still there
        file.write(content)
    assert lake.read_log("silver", "stage_state").count() == 1000
    with runs.RunningStage(lake, "run-new", "ingestion"):
        pass
    lake.compact_log("silver", "stage_state")
    assert lake.read_log("silver", "stage_state").count() == 1002 and not lake._tail("silver", "stage_state")


def landing(spark):
    conf = spark.createDataFrame(
        [(0, "s1", "KR", "https://f/1", 5, "feed", "rss"), (1, "s2", "US", "https://f/2", 5, "feed", "rss")],
        "place int, source_id string, axis string, feed_url string, `limit` int, body_extraction string, format string")
    rss = lambda *titles: "<rss><channel>" + "".join(
        f"<item><title>{t}</title><link>https://n/{t}</link><description>text of {t}</description></item>" for t in titles) + "</channel></rss>"
    tried = [("s1", "2026-06-23T14:00", 1, rss("a", "b"), None), ("s2", "2026-06-23T14:00", 1, rss("b", "c"), None),
             ("s2", "2026-06-23T15:00", 1, "<rss", None)]
    attempts = spark.createDataFrame(tried, "source_id string, cycle string, attempt int, payload string, error string")
    return conf, attempts, spark.createDataFrame([], "url string, page_text string")


def test_payloads_are_parsed_once_and_not_shuffled_by_source(spark, monkeypatch):
    """Each payload was read once for its entries and once for its failure, and a source was parsed in one task."""
    plans = []

    def noted(df, name, *more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, name, *more)

    monkeypatch.setattr(feeds, "staged", noted)
    conf, attempts, pages = landing(spark)
    got = feeds.ingested(conf, attempts, pages, F.lit("2026-06-23T15:10:00+00:00"))
    assert [tuple(r) for r in got.failures.collect()] == [("s2", "2026-06-23T15:00", "malformed feed")]
    assert "from_xml" not in got.failures._jdf.queryExecution().optimizedPlan().toString()
    ranked = dict(plans)["ranked-entries"]
    assert "from_xml" in ranked and "hashpartitioning(source_id" in ranked
    assert not [x for x in ranked.split("hashpartitioning(")[1:] if "cycle" not in x.split(")")[0]]


def test_what_writes_have_shuffled_goes_with_them(spark, lake, tmp_path):
    def shuffled():
        places = [str(x) for x in spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]
        return {name for place in places for name in glob.glob(f"{place}/*/shuffle_*")}

    before = shuffled()
    staged(spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").agg(F.collect_list("id")), "grouped")
    lake.write_cycles("bronze", "intake_count", with_partition(
        spark.createDataFrame([("2026-06-23T14:00", 1, 0, 0, 0, 0)], schemas.INTAKE_COUNT), F.col("cycle")))
    assert not shuffled() - before


def test_a_broken_collection_shows_nothing_and_a_marked_one_is_finished(spark, lake, monkeypatch):
    def cut_short(*_):
        raise RuntimeError("cut short")

    def shown():
        return [lake.read_cycles("bronze", n).count() for n in ("news_item", "intake_count", "intake_failure")] + [
            lake.read_objects("bronze", "news_body", "body_hash").count()]

    with monkeypatch.context() as m:
        m.setattr(ingestion, "mark", cut_short)
        with pytest.raises(RuntimeError):
            ingestion.collect(lake, *landing(spark), "2026-06-23T15:10:00+00:00")
    assert shown() == [0, 0, 0, 0] and ingestion.recover(lake) == 0
    with monkeypatch.context() as m:
        m.setattr(Lake, "write_cycles", cut_short)
        with pytest.raises(RuntimeError):
            ingestion.collect(lake, *landing(spark), "2026-06-23T15:10:00+00:00")
    assert ingestion.recover(lake) == 1
    assert shown() == [3, 1, 1, 3]
    got = ingestion.collect(lake, *landing(spark), "2026-06-23T15:10:00+00:00")
    assert shown() == [3, 1, 1, 3] and got["new_bodies"].count() == 0
    assert [tuple(r)[:3] for r in got["counters"].collect()] == [("2026-06-23T14:00", 3, 1)]
    assert [r.reason for r in got["failures"].collect()] == ["malformed feed"]
    with monkeypatch.context() as m:
        m.setattr(ingestion, "FORGOTTEN", ingestion.timedelta(0))
        ingestion.recover(lake)
    assert lake._children(f"{lake.root}/bronze/_pending") == []


def test_cycles_are_dealt_out_by_their_number_and_small_rows_lie_by_day(spark, lake):
    """Many small cycles are not written by one task, however few bytes they have."""
    hours = spark.range(72).select(F.date_format(F.timestamp_seconds(F.col("id") * 3600 + 1704067200), "yyyy-MM-dd'T'HH:00").alias("cycle"))
    full = hours.select("cycle", *(F.lit(1).cast("bigint").alias(c) for c in lake._empty(schemas.INTAKE_COUNT).columns[1:]))
    rows = with_partition(full, F.col("cycle"))
    lake.write_cycles("bronze", "intake_count", rows)
    files = glob.glob(f"{lake.folder('bronze', 'intake_count')}/**/part-*", recursive=True)
    assert len(files) == 72 and len({os.path.basename(f).split("-")[1] for f in files}) > 1

    days = Lake(spark, f"{lake.root}-days", lake.fmt)
    days.write_days("bronze", "intake_count", rows)
    lost = rows.limit(1).select(F.lit(None).cast("string").alias("cycle"), *full.columns[1:], *(F.lit(None).cast("string").alias(p) for p in schemas.PARTITION))
    again = rows.where("day = '02' AND hour < '10'").withColumn("collected", F.lit(7).cast("bigint")).unionByName(lost)
    for _ in range(2):
        days.write_days("bronze", "intake_count", again)
    assert len(glob.glob(f"{days.folder('bronze', 'intake_count')}/**/part-*", recursive=True)) == 4
    got = {(r.cycle, r.day, r.hour): r.collected for r in days.read_cycles("bronze", "intake_count").collect()}
    want = {(r.cycle, r.day, r.hour): r.collected for r in rows.collect()} | {(r.cycle, r.day, r.hour): r.collected for r in again.collect()}
    assert got == want and days.read_cycles("bronze", "intake_count").count() == 73


@pytest.mark.parametrize("measure", ["share", "count"])
def test_source_grid(spark, measure):
    said = [("r1", "KR", "s1", "2026-06-23T14", ["a", "b"]), ("r2", "KR", "s1", "2026-06-23T14", ["a"]), ("r3", "KR", "s2", "2026-06-23T14", ["c"]),
            ("r4", "KR", "s3", "2026-06-23T14", []), ("r5", "US", "s9", "2026-06-23T14", ["a"]), ("r6", "KR", "s2", "2026-06-23T15", ["b"])]
    picks = gold.all_picks(bronze(spark, [r[:4] for r in said]), silver(spark, [(r[0], r[4]) for r in said])).where("bucket_unit = 'hour'")
    configured = spark.createDataFrame([("s1", "KR"), ("s2", "KR"), ("s3", "KR"), ("s4", "KR"), ("s9", "US")], "source_id string, axis string")
    got = {(r.axis, r.time_bucket[-2:], r.source_id, r.subject): (r.value, r.state, r.enough) for r in shares.source_grid(picks, configured, measure, 2).collect()}
    n, total, articles = Counter(), Counter(), Counter()
    table = defaultdict(set)
    for _, axis, source, hour, subjects in said:
        articles[axis, hour[-2:], source] += 1
        for s in subjects:
            n[axis, hour[-2:], source, s] += 1
            total[axis, hour[-2:], source] += 1
            table[axis, hour[-2:]].add(s)
    want = {}
    for (axis, hour), columns in table.items():
        for source in ("s1", "s2", "s3", "s4") if axis == "KR" else ("s9",):
            key = axis, hour, source
            if not articles[key]:
                want[*key, None] = (None, "no collection", False)
                continue
            for s in columns:
                count = n[*key, s]
                value = float(count) if measure == "count" else round(count / max(total[key], 1), 4)
                want[*key, s] = (value, "mentioned" if count else "no mention", articles[key] >= 2)
    assert got == want
    with pytest.raises(ValueError):
        shares.source_grid(picks, configured, "mean")


def test_feed_defaults_are_the_same_for_collection():
    assert ingestion.collect.__defaults__[-1] == feeds.DEFAULT_RETRIES
