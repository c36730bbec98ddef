"""Streams: windows with late data, sessions, and running state per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, by: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per tumbling window and key; rows later than the watermark are not counted."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, ts: str, by: str, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))


def unseen(events: DataFrame, key: list[str], ts: str, late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark: an incremental collector's known-URL state."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def seen_range(events: DataFrame, key: str, ts: str) -> DataFrame:
    """First and last time each key was seen, updated as batches arrive; the aggregate's state is two instants and a count per
    key, and is kept for good, as the history is. Rows without a time are counted only."""
    return events.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("sightings"))


def newness(events: DataFrame, key: str, ts: str, verified: str) -> DataFrame:
    """The newness machine as a stream: VERIFIED_NEW while the last sighting of a key is verified, FORMERLY_NEW if an
    earlier one was, else NOT_VERIFIED; with the first and last verified time. Of sightings at one time a verified one is the
    last; those without a time are left out, a null flag is none."""
    known = events.filter(F.col(ts).isNotNull())
    yes = F.coalesce(F.col(verified), F.lit(False))
    at = F.when(yes, F.col(ts))
    out = known.groupBy(key).agg(F.min(at).alias("first_verified"), F.max(at).alias("last_verified"), F.max(F.struct(F.col(ts).alias("ts"), yes.alias("now"))).alias("newest"))
    status = F.when(F.col("newest.now"), "VERIFIED_NEW").when(F.col("first_verified").isNotNull(), "FORMERLY_NEW").otherwise("NOT_VERIFIED")
    return out.select(key, status.alias("status"), "first_verified", "last_verified", F.col("newest.ts").alias("latest"))


def latest_rows(stream: DataFrame, folder: str, key: list[str]) -> DataFrame:
    """Run an updating stream to the end of its input and return the last row of each key. Each batch is a folder of its own
    under its number, so one that is run again after a restart replaces itself; the stream goes on from its checkpoint."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in key]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields), "batch int"])
    rows = stream.sparkSession.read.schema(kinds).parquet(f"{folder}/rows")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")


#: Up to so many sources are sent to every task.
MOST_SOURCES = 100_000


def _sources(rows: DataFrame) -> DataFrame:
    """The sources of rows. They are few and have many rows each, so they go to the rows: joined by source, all rows of one
    would be in one task. Where there are more than MOST_SOURCES, Spark joins them as it likes."""
    found = rows.select("source").distinct()
    return F.broadcast(found) if found.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES else found


def item_events(path: str):
    """A foreachBatch function that turns snapshots of sources into events of their items, with the state as published tables.

    A batch holds whole snapshots: source, item, model, color, in_stock, price. Tables of the lane at `path`: `items` (the last
    snapshot of each source), `seen` (every source, item, model and colour that ever was) and `events` (of the batch). A source
    without a state is a BASELINE; a source that is not in a batch keeps its state. All three are published at once, so a
    batch that fails leaves readers where they were and is taken up again; one that comes twice is published once. State is
    joined by key, not held by a task; of rows that repeat an item in a snapshot one counts. All shuffle partitions share a
    batch, so memory of a task falls with their number.
    """
    from trendloom import stars
    from trendloom.operators.snapshots import catalog_events
    from trendloom.sources.shards import lane, read_lane

    scoped = F.concat_ws("\x01", "source", "model")
    names = ["source", "item", "model", "color", "in_stock", "price"]

    def whole(batch: DataFrame) -> DataFrame:
        # a maximum of texts is found by sorting, so rows are dealt before and not sorted by what files hold
        return stars.spread(batch.select(*names), "source", "item").groupBy("source", "item").agg(F.max(F.struct(*names[2:])).alias("r")).select("source", "item", "r.*")

    def state(batch: DataFrame, table: str, columns: list[str]) -> DataFrame:
        known = read_lane(batch.sparkSession, path, table)
        return batch.limit(0).select(*columns) if known is None else known.select(*columns)

    def items(batch: DataFrame) -> DataFrame:
        kept = state(batch, "items", names).join(_sources(batch), "source", "left_anti")
        return kept.unionByName(whole(batch).select(*names))

    def seen(batch: DataFrame) -> DataFrame:
        return stars.spread(state(batch, "seen", names[:4]).unionByName(batch.select(*names[:4])), *names[:4]).distinct()

    def events(batch: DataFrame) -> DataFrame:
        now, before = whole(batch), state(batch, "items", names)
        known = _sources(before)
        first = now.join(known, "source", "left_anti").select("source", "item", F.lit("BASELINE").alias("event"), F.lit(None).cast("double").alias("price_before"), F.col("price").cast("double").alias("price_now"))
        mine = _sources(batch)
        old, history = (t.join(mine, "source", "left_semi").withColumn("model", scoped) for t in (before, state(batch, "seen", names[:4])))
        told = catalog_events(now.join(known, "source", "left_semi").withColumn("model", scoped), old, ["source", "item"], "model", "color", seen=history)
        return first.unionByName(told.withColumns({c: F.col(c).cast("double") for c in ("price_before", "price_now")}))

    return lane(path, {"events": events, "items": items, "seen": seen})


def last_good_sink(publish, accept, done):
    """A foreachBatch function: publish a batch only if it is accepted. `done(batch_id)` says whether a batch has been
    published before, from what `publish(batch, batch_id)` has kept, so a batch that comes again after a restart is left."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not done(batch_id) and accept(batch):
            publish(batch, batch_id)

    return run
