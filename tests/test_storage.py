"""Where rows lie: scratch folders, snapshots, additions, object prefixes, prompts dealt to tasks."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_registry import plan_of

from pressgauge import schemas, session
from pressgauge.operators import versions
from pressgauge.plans import labelling
from pressgauge.sources import lake as lakes


def replies(spark, *keys, reply="r"):
    rows = [(k, f"{reply}{i}", "m", "v", "2026-06-23T14:00:00+00:00", None) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, schemas.REPLY_CACHE)


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        cluster = SimpleNamespace(
            conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="a")
        )
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.scratch_path(cluster, "x")


def test_a_scope_removes_what_was_staged_in_it(spark):
    with session.scratch_scope(spark):
        inner = session.staged(spark.range(3), "numbers")
        folder = os.path.dirname(inner.inputFiles()[0]).removeprefix("file://")
        assert os.path.isdir(folder) and inner.count() == 3
    assert not os.path.exists(folder)


def test_old_snapshots_go_and_readers_see_the_newest(spark, lake):
    for n in range(6):
        lake.write_records("silver", "analysis_cache", replies(spark, "a", reply=f"v{n}-"))
    left = [n for n in os.listdir(lake.folder("silver", "analysis_cache")) if n.startswith("snapshot=")]
    assert len(left) == lakes.KEPT
    assert [r.reply for r in lake.read_records("silver", "analysis_cache").collect()] == ["v5-0"]


def test_additions_are_seen_whole_or_not_at_all(spark, lake):
    lake.append_new("silver", "analysis_cache", "cache_key", replies(spark, "a", "b", "a"))
    lake.append_new("silver", "analysis_cache", "cache_key", replies(spark, "c", "b", "c", reply="s"))
    rows = {r.cache_key: r.reply for r in lake.read_records("silver", "analysis_cache").collect()}
    assert rows == {"a": "r0", "b": "r1", "c": "s0"}  # of several rows of a key the least, stored ones stay
    base = lake.folder("silver", "analysis_cache")
    added = next(n for n in os.listdir(base) if n.startswith("added="))
    os.remove(f"{base}/{added}/_SUCCESS")
    assert {r.cache_key for r in lake.read_records("silver", "analysis_cache").collect()} == {"a", "b"}


def test_keys_that_begin_alike_spread_and_a_lookup_reads_one_prefix(spark, lake):
    calls = spark.range(60).select(F.concat(F.lit("call-"), "id").alias("body_hash"), F.lit("t").alias("raw_text"),
                                   F.lit("at").alias("first_seen_at"), F.lit("c").alias("first_seen_cycle"))
    lake.put_objects("bronze", "news_body", "body_hash", calls, [F.col("first_seen_at")])
    names = [n for n in os.listdir(lake.folder("bronze", "news_body")) if n.startswith("body_hash_prefix=")]
    assert len(names) > 8
    found = lake.get_object("bronze", "news_body", "body_hash", "call-7")
    assert found.count() == 1
    assert "PartitionFilters: [isnotnull(body_hash_prefix" in plan_of(found)


def test_prompts_are_dealt_by_their_number(spark):
    prompts = spark.range(1000).select(F.col("id").cast("string").alias("cache_key")).coalesce(1)
    dealt = labelling.spread(prompts)
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) >= max(spark.sparkContext.defaultParallelism, 1000 // labelling.PROMPTS)
    assert sum(sizes) == 1000 and max(sizes) < 3 * labelling.PROMPTS


def test_many_prompts_are_dealt_to_so_many_tasks_a_core_and_no_more(spark):
    tasks = labelling.TASKS * spark.sparkContext.defaultParallelism
    count = 3 * tasks * labelling.PROMPTS
    dealt = labelling.spread(spark.range(count).select(F.col("id").cast("string").alias("cache_key")))
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert dealt.rdd.getNumPartitions() == tasks
    assert sum(sizes) == count and max(sizes) < 6 * labelling.PROMPTS


def test_a_store_of_many_labels_is_dealt_by_their_number(spark, lake, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    files = {}

    def counted(df, name):
        out = session.staged(df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(versions, "staged", counted)
    ids = spark.range(1000).select(F.format_string("r%d", "id").alias("record_id"))
    located = ids.select("record_id", *(F.lit(v).alias(p) for p, v in zip(schemas.PARTITION, ("2026", "06", "24", "10"), strict=True)))
    empty = spark.createDataFrame([], schemas.ANALYSIS)
    rows = empty.drop("analyzer_version").unionByName(ids, allowMissingColumns=True)
    labels = {v: rows.withColumn("analyzer_version", F.lit(v)) for v in ("v1", "v2")}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        count = versions.store_analyses(lake, located, labels["v1"]).first()
        assert (count.written, count.pruned) == (1000, 0)
        assert files.pop("analyses") >= 20 and not files  # nothing was stored: no merge is written
        count = versions.store_analyses(lake, located, labels["v2"].where("record_id < 'r5'"), coexist=False).first()
        assert files["merged-analyses"] >= 20
        assert count.written == 1000 and count.pruned == labels["v2"].where("record_id < 'r5'").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionNum", None) is None
