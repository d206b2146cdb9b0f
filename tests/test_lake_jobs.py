"""Lake layouts, label versions, and the collection and labelling jobs end to end."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pressgauge import schemas
from pressgauge.operators import picks, runlog, scope, versions
from pressgauge.plans import gold, ingestion, labelling, runs
from pressgauge.session import staged
from pressgauge.sources import feeds, pages
from pressgauge.sources.lake import with_partition

# The completers below run in workers, which cannot import a test module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOURS = {"r1": "2026-06-23T14:00", "r2": "2026-06-23T15:00"}


def located(spark, ids=("r1", "r2")):
    rows = spark.createDataFrame([(i, HOURS[i]) for i in ids], "record_id string, collection_cycle string")
    return with_partition(rows, F.col("collection_cycle"))


def analyses(spark, *rows):
    full = [(r, "u", [], [s], None, "neutral", None, "analyzed", 0.9, at, v, "run", None, None)
            for r, v, at, s in rows]
    return spark.createDataFrame(full, schemas.ANALYSIS)


def stored(lake):
    rows = lake.read_cycles("silver", "analysis").collect()
    return sorted((r.record_id, r.analyzer_version, r.narrative_subjects[0]) for r in rows)


def test_versions_coexist_and_a_key_is_replaced(spark, lake):
    where = located(spark)
    versions.store_analyses(lake, where, analyses(spark, ("r1", "v1", "t1", "a"), ("r2", "v1", "t1", "a")))
    count = versions.store_analyses(lake, where, analyses(spark, ("r1", "v2", "t2", "b"))).first()
    assert (count.written, count.pruned) == (2, 0)
    versions.store_analyses(lake, where, analyses(spark, ("r1", "v2", "t3", "c")))
    assert stored(lake) == [("r1", "v1", "a"), ("r1", "v2", "c"), ("r2", "v1", "a")]
    # A whole-lake v3 on r1 retires v1 and keeps the served v2; r2 is not touched.
    count = versions.store_analyses(
        lake, where, analyses(spark, ("r1", "v3", "t4", "d")), coexist=False, keep_versions=("v2",)
    ).first()
    assert (count.written, count.pruned) == (2, 1)
    assert stored(lake) == [("r1", "v2", "c"), ("r1", "v3", "d"), ("r2", "v1", "a")]
    versions.prune_orphans(lake, located(spark, ["r1"]))
    assert {r[0] for r in stored(lake)} == {"r1"}


def test_only_touched_cycles_change_their_signature(spark, lake):
    where = located(spark)
    versions.store_analyses(lake, where, analyses(spark, ("r1", "v1", "t1", "a"), ("r2", "v1", "t1", "a")))
    before = {r.hour: r.signature for r in lake.signatures("silver", "analysis").collect()}
    versions.store_analyses(lake, where, analyses(spark, ("r1", "v2", "t2", "b")))
    after = {r.hour: r.signature for r in lake.signatures("silver", "analysis").collect()}
    assert before["15"] == after["15"]
    assert before["14"] != after["14"]


def test_serving_rows(spark):
    rows = analyses(spark, ("r1", "v1", "t1", "a"), ("r1", "v2", "t2", "b"), ("r2", "v1", "t1", "a"))
    def served(version):
        return {r.record_id: r.analyzer_version for r in picks.serving_rows(rows, version).collect()}
    assert served("v1") == {"r1": "v1", "r2": "v1"}
    assert served("v2") == {"r1": "v2", "r2": "v1"}
    assert served(None) == {"r1": "v2", "r2": "v1"}


def test_decisions(spark, lake):
    def serving():
        log = lake.read_records("silver", "reprocess_decision")
        return spark.range(1).select(versions.serving_version(log)).first()[0]
    assert serving() is None
    versions.record_decision(lake, "publish", "v2", "better")
    versions.record_decision(lake, "rollback", "v1", "odd", notify=False)
    assert serving() == "v1"
    for bad in (("keep", "v2", "m"), ("publish", " ", "m"), ("publish", "v2", " ")):
        with pytest.raises(ValueError):
            versions.record_decision(lake, *bad)
    assert lake.read_records("silver", "reprocess_decision").count() == 2


def test_reading_what_is_not_there(lake):
    assert lake.read_records("silver", "analysis_cache").count() == 0
    assert lake.read_cycles("bronze", "news_item").count() == 0
    assert lake.read_objects("silver", "llm_call", "call_id").count() == 0
    assert lake.signatures("bronze", "news_item").count() == 0


def test_json_lines_lake_of_one_file_per_dataset(spark, lake, tmp_path):
    folder = tmp_path / "lake" / "silver"
    folder.mkdir(parents=True)
    row = {"decided_at": "t", "decision": "publish", "analyzer_version": "v1", "memo": "m",
           "notify_consumer": True}
    (folder / "reprocess_decision.jsonl").write_text(json.dumps(row) + "\n\n")
    assert lake.read_records("silver", "reprocess_decision").first().analyzer_version == "v1"


def test_compare_versions(spark):
    said = [("k1", "v2", "analyzed", ["r"]), ("k2", "v2", "analyzed", ["r"]), ("k3", "v2", "analyzed", ["r"]),
            ("k4", "v2", "analyzed", ["d"]), ("k1", "v3", "analyzed", ["r"]), ("k2", "v3", "analyzed", ["d"]),
            ("k3", "v3", "analyzed", ["d", "c"]), ("k4", "v3", "unanalyzed", [])]
    full = [(i, "u", [], s, None, None, None, st, 0.9, f"2026-09-21T0{v[1]}:00:00Z", v, "run", None, None)
            for i, v, st, s in said]
    rows = spark.createDataFrame(full, schemas.ANALYSIS)
    got = [(r.subject, r.before_share, r.after_share) for r in scope.compare_versions(rows, "v2", "v3").collect()]
    assert got == [("r", 0.75, 0.25), ("c", 0.0, 0.25), ("d", 0.25, 0.5)]
    missing = {r.analyzer_version: r.unanalyzed_share for r in scope.unanalyzed_share(rows).collect()}
    assert missing == {"v2": 0.0, "v3": 0.25}
    seen = scope.window_versions(rows)
    status = scope.compare_status(seen, "v3").first()
    assert (status.available, status.before_version) == (True, "v2")
    assert scope.compare_status(seen, "v9").first().reason == "single-version"
    assert scope.compare_status(seen.limit(0), "v9").first().reason == "no-silver"


def test_throughput_needs_two_times(spark):
    def rate(*times):
        rows = analyses(spark, *[(f"r{i}", "v1", t, "a") for i, t in enumerate(times)])
        return scope.throughput(rows, "v1", F.lit(5)).first()
    assert rate("2026-09-21T00:00:00Z", "2026-09-21T00:02:00Z").per_minute == 1.0
    assert rate("2026-09-21T00:00:00Z", "2026-09-21T00:02:00Z").eta_minutes == 5.0
    assert rate("2026-09-21T00:00:00Z").per_minute is None
    assert rate("2026-09-21T00:00:00Z", "2026-09-21T00:00:00Z", "junk").eta_minutes is None


def test_stage_accounting(spark):
    outcomes = spark.createDataFrame([("s", "a", 2), ("s", "b", 1)], "stage string, outcome_name string, outcome_count long")
    def account(given, failed):
        inputs = spark.createDataFrame([("s", given, failed)], "stage string, input_count long, failed boolean")
        return {r.outcome_name: r.outcome_count for r in runlog.stage_outcomes(outcomes, inputs, ["stage"]).collect()}
    assert account(3, False) == {"a": 2, "b": 1}
    assert account(5, True) == {"a": 2, "b": 1, "not_reached": 2}
    for given, failed in ((5, False), (2, True)):
        with pytest.raises(Exception, match="outcomes"):
            account(given, failed)


def test_retries_leave_when_done_or_gone(spark):
    retry = spark.createDataFrame(
        [("a", "v1", "c1"), ("b", "v1", "c1"), ("g", "v1", "c1"), ("o", "v1", "c2"), ("a", "v2", "c1"), ("n", "v1", None)],
        schemas.RETRY)
    present = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("f", "c1"), ("n", "c1")], "record_id string, collection_cycle string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "record_id string")
    got = versions.updated_retries(retry, present, ids("a", "f"), ids("f"), "v1").collect()
    assert sorted((r.record_id, r.analyzer_version, r.collection_cycle) for r in got) == [
        ("a", "v2", "c1"), ("b", "v1", "c1"), ("f", "v1", "c1"), ("n", "v1", "c1"), ("o", "v1", "c2")]


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>chan</title>
<item><title>A</title><link>https://n.test/a</link><description>same body</description><viewCount>5</viewCount></item>
<item><title>no link</title></item>
<item><link>https://n.test/b</link><description>same body</description><views>9</views></item>
<item><title>C</title><link>https://n.test/c</link><views>many</views></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>X</title>
<link rel="self" href="https://n.test/self"/><link href="https://n.test/c"/><summary>atom body</summary></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/">
<channel><title>t</title></channel><item><title>R</title><link>https://n.test/r</link></item></rdf:RDF>"""
SEARCH = json.dumps({"rows": 2, "documents": {
    "z": {"url": "https://n.test/z", "title": {"cdata!": " Z "}, "content": {"cdata!": "zz"}},
    "a": {"url": "https://n.test/y", "title": {"cdata!": "Y"}, "descr": "plain"},
    "n": {"title": {"cdata!": "no address"}}, "facets": {}, "odd": 3}})


def landing(spark):
    rows = [("kr", "c", 1, None, "boom"), ("kr", "c", 2, RSS, None), ("us", "c", 1, ATOM, None),
            ("rdf", "c", 1, RDF, None), ("wb", "c", 1, SEARCH, None), ("down", "c", 1, None, "boom 1"),
            ("down", "c", 3, None, "boom 3"), ("bad", "c", 1, "<rss><channel><item>", None),
            ("wbad", "c", 1, '{"rows": 0}', None)]
    rows = [(s, "2026-06-23T14:00", n, p, e) for s, _, n, p, e in rows]
    return spark.createDataFrame(rows, "source_id string, cycle string, attempt int, payload string, error string")


def configured(spark, tmp_path, **changes):
    listed = [{"source_id": s, "axis": "KR", "feed_url": "f", **extra} for s, extra in [
        ("kr", {"limit": 2, "body_extraction": "article"}), ("us", {}), ("rdf", {}),
        ("wb", {"format": "worldbank-json"}), ("down", {}), ("bad", {}), ("wbad", {"format": "worldbank-json"})]]
    listed[0].update(changes)
    path = tmp_path / "feeds.json"
    path.write_text(json.dumps(listed))
    return feeds.feed_configs(spark, str(path))


PAGE = "<html><body><div class='x'><p>" + "Page text of b. " * 20 + "</p></div></body></html>"


def test_collection_job(spark, lake, tmp_path):
    texts = pages.page_texts(spark.createDataFrame([("https://n.test/b", PAGE)], "url string, payload string"))
    def run():
        return ingestion.collect(lake, configured(spark, tmp_path), landing(spark), texts, "2026-06-23T14:05:00+00:00")
    done = run()
    items = {r.source_url: r for r in lake.read_cycles("bronze", "news_item").collect()}
    assert set(items) == {f"https://n.test/{x}" for x in ("a", "b", "c", "r", "z", "y")}
    assert items["https://n.test/b"].title == "(제목 없음)"
    assert (items["https://n.test/b"].rank, items["https://n.test/b"].view_count) == (1, 9)
    assert items["https://n.test/z"].rank == 1
    assert items["https://n.test/z"].title == "Z"
    assert items["https://n.test/r"].body_hash == ""
    assert not items["https://n.test/r"].body_available
    # The limit of two keeps c out of kr, so us has it first.
    assert items["https://n.test/c"].source_id == "us"
    failures = {r.source_id: r.reason for r in done["failures"].collect()}
    assert failures == {"down": "failed after retries: boom 3", "bad": "malformed feed",
                        "wbad": "malformed worldbank-json response"}
    counts = done["counters"].first()
    assert (counts.collected, counts.duplicates, counts.pages_asked, counts.pages_used) == (6, 0, 2, 1)
    bodies = {r.raw_text for r in lake.read_objects("bronze", "news_body", "body_hash").collect()}
    assert {"same body", "atom body", "zz", "plain"} < bodies
    assert any(b.startswith("Page text of b.") for b in bodies)
    # The same cycle again: same rows, no body twice.
    assert run()["new_bodies"].count() == 0
    assert lake.read_cycles("bronze", "news_item").count() == 6


@pytest.mark.parametrize("bad", [{"axis": "EU"}, {"limit": 0}, {"format": "csv"}, {"body_extraction": "scrape"}])
def test_wrong_feed_settings_stop_the_job(spark, tmp_path, bad):
    with pytest.raises(Exception):
        configured(spark, tmp_path, **bad).collect()


SPLIT = b"""<html><head><meta charset="utf-8"></head><body><nav><a href=x>Home</a></nav><main><article>
<div><h1>Headline of the day</h1></div>
<div><div class="rich  body"><p>First part of the story, long enough to win against others on the page.</p></div></div>
<figure><figcaption>caption</figcaption></figure>
<div><div class="rich body"><p>Second&nbsp;part with a <a href=y>short link</a> and more plain text around it here.<br>Next line</p></div></div>
<div><div class="rich body"><p><a href=z>Related: only links in this block, so it is a teaser list</a></p></div></div>
</article></main><script>var x = "</p>";</script></body></html>"""


def test_article_text(spark):
    teaser = b"<html><body><nav><a href='/'>Home</a></nav></body></html>"
    rows = [("split", SPLIT), ("teaser", teaser), ("empty", b""), ("none", None)]
    got = {r.url: r.page_text for r in pages.page_texts(spark.createDataFrame(rows, "url string, payload binary")).collect()}
    assert got.pop("split").split("\n") == [
        "First part of the story, long enough to win against others on the page.",
        "Second part with a short link and more plain text around it here.", "Next line"]
    assert set(got.values()) == {""} and len(got) == 3


def test_decode():
    body = "원/달러 환율 급등"
    assert body in pages.decode(f'<meta charset="euc-kr"><body>{body}'.encode("cp949"), "euc-kr")
    assert body in pages.decode(f"<body>{body}".encode("cp949"))
    assert body in pages.decode(f'<meta charset="nonsense"><body>{body}'.encode(), "nonsense")


def test_page_policy(spark):
    rows = [("article", "x" * 299, "p" * 300), ("article", "x" * 300, "p" * 999), ("article_always", "x" * 300, "p" * 301),
            ("article_always", "x" * 300, "p" * 300), ("article", "", "p" * 199), ("feed", "", "p" * 999)]
    listed = spark.createDataFrame([(str(i), m, b) for i, (m, b, _) in enumerate(rows)], "url string, body_extraction string, body string")
    found = spark.createDataFrame([(str(i), p) for i, (_, _, p) in enumerate(rows)], "url string, page_text string")
    got = {r.url: (r.page_asked, r.page_used) for r in feeds.with_bodies(listed, found).collect()}
    assert [got[str(i)] for i in range(6)] == [(True, True), (False, False), (True, True), (True, False), (True, False), (False, False)]


def bronze_lake(spark, lake, n=6):
    rows = [(f"r{i}", "s", "KR", 1, 0, f"Fed story {i}", f"https://n.test/{i}", f"h{i % 4}" if i else "", bool(i),
             f"2026-06-23T{14 + i % 2}:00:00+00:00", f"2026-06-23T{14 + i % 2}:00") for i in range(n)]
    items = with_partition(spark.createDataFrame(rows, schemas.NEWS_ITEM), F.col("collection_cycle"))
    lake.write_cycles("bronze", "news_item", items)
    bodies = spark.createDataFrame([(f"h{i}", f"text {i} tone=positive 대상국=KR.", "t", "c") for i in range(4)], schemas.NEWS_BODY)
    lake.put_objects("bronze", "news_body", "body_hash", bodies, [F.col("first_seen_at")])


def test_keyword_labelling_settles_cycles(spark, lake):
    bronze_lake(spark, lake)
    counts = {r.outcome_name: r.outcome_count for r in labelling.label_lake(lake, "run-1", "2026-06-24T00:00:00+00:00").collect()}
    assert counts == {"analyzed": 5, "unanalyzed": 1}
    row = lake.read_cycles("silver", "analysis").filter("record_id = 'r1'").first()
    assert (row.narrative_subjects, row.target_countries) == (["Federal Reserve"], ["KR"])
    assert (row.sentiment, row.confidence, row.no_call_reason) == ("positive", 0.92, "keyword_analyzer")
    assert lake.read_records("silver", "analysis_settled").count() == 2
    assert labelling.waiting_records(lake, "fake-v1", labelling.Scope()).count() == 0
    # A new observation reopens its cycle only.
    more = lake.read_cycle("bronze", "news_item", "2026-06-23T15:00")
    added = more.limit(1).withColumn("record_id", F.lit("new"))
    lake.write_cycles("bronze", "news_item", staged(more.unionByName(added), "copy"))
    waiting = labelling.waiting_records(lake, "fake-v1", labelling.Scope()).collect()
    assert [r.record_id for r in waiting] == ["new"]


def answering(system, user):
    if "text 3" in user:
        raise RuntimeError("busy")
    if "text 2" in user:
        return "no"
    return json.dumps({"sentiment": "neutral", "narrative_subjects": ["the Fed"], "confidence": 0.8})


def failing(system, user):
    raise RuntimeError("down")


def test_model_labelling_keeps_failures_for_a_retry(spark, lake):
    bronze_lake(spark, lake)
    at = "2026-06-24T00:00:00+00:00"
    counts = {r.outcome_name: r.outcome_count for r in labelling.label_lake(lake, "run-1", at, answering).collect()}
    assert counts == {"analyzed": 3, "call_failed": 2, "unanalyzed": 1}
    calls = {r.record_id: r for r in lake.read_objects("silver", "llm_call", "call_id").collect()}
    assert calls["r3"].call_outcome == "call_failed"
    assert calls["r2"].call_outcome == "parse_failed"
    assert calls["r1"].call_outcome == "parsed"
    assert "r0" not in calls
    retry = {r.record_id for r in lake.read_records("silver", "analysis_retry").collect()}
    assert retry == {"r2", "r3"}
    assert lake.read_records("silver", "analysis_settled").count() == 0
    waiting = {r.record_id for r in labelling.waiting_records(lake, "llm-v1", labelling.Scope()).collect()}
    assert waiting == {"r2", "r3"}
    # Another version replays nothing stored under this one; a scoped run lands beside it.
    labelling.label_lake(lake, "run-2", at, answering, "llm-v2", labelling.Scope(axis="KR"))
    seen = lake.read_cycles("silver", "analysis").groupBy("analyzer_version").count().collect()
    assert {r.analyzer_version: r["count"] for r in seen} == {"llm-v1": 6, "llm-v2": 6}


def test_stored_replies_are_replayed_and_name_their_call(spark):
    items = spark.createDataFrame([("a", "u", "t", "h", True, "2026-01-01"), ("b", "u", "t", "h", True, "2026-01-02")],
                                  "record_id string, source_url string, title string, body_hash string, body_available boolean, collected_at string")
    bodies = spark.createDataFrame([("h", "text 1", "t")], "body_hash string, raw_text string, first_seen_at string")
    cache = spark.createDataFrame([], schemas.REPLY_CACHE)
    first = labelling.model_labels(items, bodies, cache, answering, "v", "run-1", "m")
    outcomes = {r.record_id: (r.call_outcome, r.reused_from_call_id) for r in first.calls.collect()}
    call = next(r.call_id for r in first.calls.collect() if r.record_id == "a")
    assert outcomes == {"a": ("parsed", None), "b": ("reused", call)}
    again = labelling.model_labels(items, bodies, first.new_replies, failing, "v", "run-2", "m")
    assert {(r.call_outcome, r.reused_from_call_id) for r in again.calls.collect()} == {("reused", call)}
    other = labelling.model_labels(items, bodies, first.new_replies, failing, "v", "run-3", "other model")
    assert {r.call_outcome for r in other.calls.collect()} == {"call_failed"}


def test_an_outage_writes_calls_but_no_analyses(spark, lake):
    bronze_lake(spark, lake)
    with pytest.raises(labelling.AllCallsFailed, match="down"):
        labelling.label_lake(lake, "run-1", "2026-06-24T00:00:00+00:00", failing)
    assert lake.read_cycles("silver", "analysis").count() == 0
    assert lake.read_objects("silver", "llm_call", "call_id").count() == 5


def test_publish_and_roll_back_move_a_pointer(spark, lake):
    bronze_lake(spark, lake, 2)
    where = lake.read_cycles("bronze", "news_item")
    rows = [(f"r{i}", v, at, s) for i in range(2) for v, at, s in (("v1", "t1", "old"), ("v2", "t2", "new"))]
    versions.store_analyses(lake, where, analyses(spark, *rows))

    def subjects_of(decision=None):
        trend = gold.aggregate_lake(lake, decision).subject_trend
        return {r.subject for r in trend.collect()}

    assert subjects_of() == {"new"}
    assert subjects_of(("publish", "v1", "steadier")) == {"old"}
    assert subjects_of(("rollback", "v2", "unexplained change")) == {"new"}


def test_run_parameters_are_checked():
    good = scope.checked_run("7d", "KR", " v3 ", 500, "recent")
    assert (good["version"], good["batch_size"]) == ("v3", 100)
    for bad in (("90d", "KR", "v"), ("7d", "ALL", "v"), ("7d", "KR", " "), ("7d", "KR", "v", 501),
                ("7d", "KR", "v", 1, "first"), ("7d", "KR", "v", 1, "recent", 0)):
        with pytest.raises(ValueError):
            scope.checked_run(*bad)


def test_runs_keep_the_last_attempt_of_a_stage(spark, lake):
    def run(run_id):
        return runs.run_records(lake, run_id).first()

    with pytest.raises(RuntimeError), runs.RunningStage(lake, "run-1", "analysis") as stage:
        assert (run("run-1").run_status, run("run-1").run_ended_at) == ("running", None)  # a killed driver leaves this
        stage.inputs = 5
        stage.book({"analyzed": 2})
        raise RuntimeError("cut short")
    row = run("run-1")
    assert row.run_status == "failed" and row.run_ended_at
    assert {o.outcome_name: o.outcome_count for o in row.stages[0].outcomes} == {"analyzed": 2, "not_reached": 3}
    assert "cut short" in row.stages[0].failure_reason
    with runs.RunningStage(lake, "run-1", "analysis") as stage:
        stage.inputs = 2
        stage.book({"analyzed": 2})
    row = run("run-1")
    assert (row.run_status, len(row.stages)) == ("succeeded", 1)
    assert lake.read_log("silver", "stage_state").count() == 4
    with pytest.raises(Exception, match="do not cover"), runs.RunningStage(lake, "run-2", "analysis") as stage:
        stage.inputs = 1
