"""The streaming front end, fed by files."""

from pyspark.sql import functions as F
from rows import bronze, silver

from pressgauge.plans import gold
from pressgauge.schemas import NEWS_ITEM
from pressgauge.streaming import observations as stream


def item(record, hour, rank=1):
    return (record, "s", "KR", rank, 0, "t", "u", "", False, f"2026-06-23T{hour}:05:00+00:00", f"2026-06-23T{hour}:00")


def deliver(spark, folder, *rows):
    spark.createDataFrame(list(rows), NEWS_ITEM).coalesce(1).write.mode("append").json(folder)


def test_landing_is_idempotent_and_resumes(spark, lake, tmp_path):
    feed, log = str(tmp_path / "feed"), str(tmp_path / "log")
    deliver(spark, feed, item("a", "14"), item("b", "14"), item("a", "14"))

    def run():
        fresh = stream.deduplicated(stream.item_stream(spark, feed)).drop("collected_time")
        stream.land(fresh, lake, log).awaitTermination()
        rows = lake.read_cycles("bronze", "news_item").collect()
        return sorted((r.record_id, r.hour) for r in rows)

    assert run() == [("a", "14"), ("b", "14")]
    assert run() == [("a", "14"), ("b", "14")]
    # A later delivery adds to the cycle it belongs to, and opens another one.
    deliver(spark, feed, item("c", "14"), item("d", "15"))
    assert run() == [("a", "14"), ("b", "14"), ("c", "14"), ("d", "15")]


def test_a_batch_landed_twice_changes_nothing(spark, lake):
    batch = spark.createDataFrame([item("a", "14", 3), item("b", "15")], NEWS_ITEM)
    stream.land_batch(lake, batch)
    stream.land_batch(lake, batch)
    assert lake.read_cycles("bronze", "news_item").count() == 2
    stream.land_batch(lake, batch.filter("record_id = 'a'").withColumn("rank", F.lit(9).cast("long")))
    ranks = {r.record_id: r["rank"] for r in lake.read_cycles("bronze", "news_item").collect()}
    assert ranks == {"a": 9, "b": 1}


def test_refreshed_buckets_equal_a_full_fold(spark):
    rows = [(str(i), "KR", "s", f"2026-06-{20 + i % 4}T{10 + i % 3}", f"u{i % 5}") for i in range(40)]
    labelled = gold.labelled_observations(bronze(spark, rows), silver(spark, [(r[0], ["A"]) for r in rows]))
    late = labelled.filter("collected_at >= '2026-06-23'")
    touched = stream.touched_buckets(late)
    labels = silver(spark, [(r[0], ["A"]) for r in rows])
    fresh = sorted(map(repr, stream.refreshed_picks(bronze(spark, rows), labels, touched).collect()))
    full = gold.all_picks(bronze(spark, rows), silver(spark, [(r[0], ["A"]) for r in rows]))
    keys = ["axis", "bucket_unit", "time_bucket"]
    assert fresh == sorted(map(repr, full.join(touched, keys, "left_semi").collect()))
