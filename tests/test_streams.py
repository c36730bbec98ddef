"""Streams in batches, with restarts: item events, first and last seen, newness."""

from pyspark.sql import functions as F

from trendloom.sources.shards import read_lane
from trendloom.streaming import stateful

ITEM = "source string, item string, model string, color string, in_stock boolean, price double"


def test_item_events_over_batches_and_restarts(spark, tmp_path):
    run = stateful.item_events(f"{tmp_path}/lane")

    def feed(rows, batches=1):
        if rows:
            spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = spark.readStream.schema(ITEM).parquet(f"{tmp_path}/in").writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.source, r.item, r.event) for r in read_lane(spark, f"{tmp_path}/lane", "events").collect())

    a, b = ("s", "a", "m1", "black", False, 100.0), ("s", "gone", "m9", "red", True, 5.0)
    assert feed([a, b, ("t", "x", "m1", "black", True, 1.0)]) == [("s", "a", "BASELINE"), ("s", "gone", "BASELINE"), ("t", "x", "BASELINE")]
    now = [("s", "a", "m1", "black", True, 120.0), ("s", "ar", "m1", "red", True, 9.0), ("s", "b", "m2", "black", True, 9.0)]
    told = [("s", "a", "PRICE_CHANGE"), ("s", "a", "RESTOCK"), ("s", "ar", "NEW_COLOR"), ("s", "b", "NEW_MODEL"), ("s", "gone", "REMOVED")]
    assert feed(now) == told  # t is not in the batch: nothing is removed there
    assert feed([]) == told  # a restart without new snapshots does nothing again
    batch = spark.createDataFrame(now, ITEM)
    run(batch, 1)  # the same batch once more
    assert sorted((r.source, r.item, r.event) for r in read_lane(spark, f"{tmp_path}/lane", "events").collect()) == told
    assert feed([*now[:1], b]) == [("s", "a", "UNCHANGED"), ("s", "ar", "REMOVED"), ("s", "b", "REMOVED"), ("s", "gone", "RESTOCK")]  # what was seen before comes back
    assert sorted(r.item for r in read_lane(spark, f"{tmp_path}/lane", "items").collect()) == ["a", "gone", "x"]


def test_running_state_goes_on_after_a_restart(spark, tmp_path):
    kinds = "k string, ts timestamp, ok boolean"
    out = {}

    def feed(rows):
        spark.createDataFrame(rows, "k string, ts string, ok boolean").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
        seen = stateful.latest_rows(stateful.seen_range(source, "k", "ts"), f"{tmp_path}/seen", ["k"])
        new = stateful.latest_rows(stateful.newness(source, "k", "ts", "ok"), f"{tmp_path}/new", ["k"])
        out["seen"] = {r.k: (str(r.first_seen)[:10], str(r.last_seen)[:10], r.sightings) for r in seen.collect()}
        out["new"] = {r.k: (r.status, str(r.first_verified)[:10]) for r in new.collect()}

    feed([("a", "2024-01-05", True), ("a", None, True), ("b", "2024-01-03", None)])
    assert out["seen"] == {"a": ("2024-01-05", "2024-01-05", 2), "b": ("2024-01-03", "2024-01-03", 1)}
    assert out["new"] == {"a": ("VERIFIED_NEW", "2024-01-05"), "b": ("NOT_VERIFIED", "None")}
    feed([("a", "2024-01-02", False), ("a", "2024-01-09", False), ("b", "2024-01-03", True)])
    assert out["seen"] == {"a": ("2024-01-02", "2024-01-09", 4), "b": ("2024-01-03", "2024-01-03", 2)}
    # the later sighting of a is not verified; of b's two at one time the verified one counts
    assert out["new"] == {"a": ("FORMERLY_NEW", "2024-01-05"), "b": ("VERIFIED_NEW", "2024-01-03")}


def test_rows_of_one_source_are_not_one_task(spark, tmp_path):
    """Not even where Spark takes the sources for many, as it does in large snapshots."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    run = stateful.item_events(f"{tmp_path}/lane")

    def snapshot(source, since):
        rows = spark.range(since, 400).select(F.lit(source).alias("source"), F.concat(F.lit("i"), "id").alias("item"), F.concat(F.lit("m"), F.col("id") % 50).alias("model"), F.lit("black").alias("color"), F.lit(True).alias("in_stock"), F.lit(1.0).alias("price"))
        rows.write.parquet(f"{tmp_path}/{source}{since}")
        return spark.read.parquet(f"{tmp_path}/{source}{since}")

    def told():
        return {(r.source, r.event): r["count"] for r in read_lane(spark, f"{tmp_path}/lane", "events").groupBy("source", "event").count().collect()}

    for name in names:
        spark.conf.set(name, "-1")
    try:
        run(snapshot("s", 0), 0)
        assert told() == {("s", "BASELINE"): 400}
        run(snapshot("t", 0), 1)
        assert told() == {("t", "BASELINE"): 400}
        kept = read_lane(spark, f"{tmp_path}/lane", "items").filter("source = 's'").groupBy(F.input_file_name()).count().collect()
        assert sum(r["count"] for r in kept) == 400 and len(kept) > 1
        run(snapshot("s", 100), 2)
        assert told() == {("s", "REMOVED"): 100, ("s", "UNCHANGED"): 300}
    finally:
        for name in names:
            spark.conf.unset(name)
