"""Snapshots: what is new, gone, changed or back between two dated states, and histories over many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom import stars
from trendloom.functions.expr import half_up, reasons


def new_rows(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    return current.join(previous.select(*key).distinct(), key, "left_anti")


def removed_rows(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    return previous.join(current.select(*key).distinct(), key, "left_anti")


def signal_changes(current: DataFrame, previous: DataFrame, key: list[str], brand: str, most: int = 24) -> DataFrame:
    """Counts per signal on both sides of a full outer join; a side without the signal counts zero.

    Frames hold a row per product: key and brand. Rows are counted by (signal, brand) and side first, so a signal that
    most rows share is pre-aggregated and no brand set is built; the report names the first `most` new and gone brands,
    their numbers are whole."""
    both = current.select(*key, brand, F.lit(1).alias("is_now")).unionByName(previous.select(*key, brand, F.lit(0).alias("is_now")))
    pairs = both.groupBy(*key, brand).agg(F.sum("is_now").alias("n"), F.sum(1 - F.col("is_now")).alias("p"))
    fresh, gone = (F.col("n") > 0) & (F.col("p") == 0), (F.col("n") == 0) & (F.col("p") > 0)
    kind = F.when(fresh, "new").when(gone, "gone")
    place = F.row_number().over(Window.partitionBy(*key, kind).orderBy(brand))
    named = pairs.withColumn("named", F.when(kind.isNotNull() & (place <= most), F.col(brand)))
    out = named.groupBy(*key).agg(
        F.sum("n").alias("now"),
        F.sum("p").alias("before"),
        (F.count_if(F.col("n") > 0) - F.count_if(F.col("p") > 0)).alias("brand_delta"),
        F.count_if(fresh).alias("new_brands"),
        F.count_if(gone).alias("gone_brands"),
        F.sort_array(F.collect_list(F.when(fresh, F.col("named")))).alias("first_new"),
        F.sort_array(F.collect_list(F.when(gone, F.col("named")))).alias("first_gone"),
    )
    percent = F.when(F.col("before") > 0, half_up((F.col("now") - F.col("before")) / F.col("before") * 100.0, 1))
    return out.withColumns({"delta": F.col("now") - F.col("before"), "change_percent": percent})


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key: one aggregation, so a key that many rows share is pre-aggregated."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("first")).select(*key, "first.*")


def catalog_events(current: DataFrame, previous: DataFrame, key: list[str], model: str, color: str, seen: DataFrame | None = None, baseline: bool = False) -> DataFrame:
    """Events of items between two catalogs. Frames: key, model, color, in_stock, price.

    An item of both catalogs can RESTOCK and have a PRICE_CHANGE at once, or is UNCHANGED. An item that only the new
    one has is a NEW_MODEL, a NEW_COLOR of a known model, or a RESTOCK if it or its colour was seen before (`seen`: all
    rows of earlier catalogs, the previous one by default). Others are REMOVED. In the first catalog all is BASELINE.
    Rows meet by key in all shuffle partitions, as a task sorts all that it has of both catalogs.
    """
    if baseline:
        return current.select(*key, F.lit("BASELINE").alias("event"), F.lit(None).cast("double").alias("price_before"), F.col("price").alias("price_now"))
    history = seen if seen is not None else previous
    models = history.select(model).distinct().withColumn("model_known", F.lit(True))
    colors = history.select(model, color).distinct().withColumn("color_known", F.lit(True))
    a = current.select(*key, model, color, F.col("in_stock").alias("stock_now"), F.col("price").alias("price_now"), F.lit(True).alias("is_now"))
    b = previous.select(*key, F.col("in_stock").alias("stock_before"), F.col("price").alias("price_before"), F.lit(True).alias("was"))
    # what is known is asked of the current rows only, before they meet the previous ones
    a = stars.spread(a.join(models, model, "left").join(colors, [model, color], "left"), *key)
    if seen is None:
        # what the previous catalog has is no new item, so its items need not be met once more
        a = a.withColumn("item_known", F.lit(None).cast("boolean"))
    else:
        a = a.join(stars.spread(seen.select(*key), *key).distinct().withColumn("item_known", F.lit(True)), key, "left")
    both = a.join(stars.spread(b, *key), key, "full")
    is_now, was = F.col("is_now").isNotNull(), F.col("was").isNotNull()
    back = is_now & was & F.col("stock_now") & ~F.col("stock_before")
    repriced = is_now & was & F.coalesce(F.col("price_now") != F.col("price_before"), F.lit(False))
    fresh = is_now & ~was
    known = F.col("item_known").isNotNull() | (F.col("model_known").isNotNull() & F.col("color_known").isNotNull())
    events = reasons(
        (back | (fresh & known), "RESTOCK"),
        (repriced, "PRICE_CHANGE"),
        (fresh & ~known & F.col("model_known").isNotNull(), "NEW_COLOR"),
        (fresh & ~known & F.col("model_known").isNull(), "NEW_MODEL"),
        (is_now & was & ~F.coalesce(back, F.lit(False)) & ~repriced, "UNCHANGED"),
        (~is_now, "REMOVED"),
    )
    return both.select(*key, F.explode(events).alias("event"), "price_before", "price_now")


def first_last_seen(sightings: DataFrame, key: list[str], ts: str) -> DataFrame:
    return sightings.groupBy(*key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("sightings"))


def latest_per_key(attempts: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The latest attempt of each key; the others are marked superseded."""
    return attempts.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).withColumn("status", F.when(F.col("place") == 1, "CURRENT").otherwise("SUPERSEDED")).drop("place")


def last_good(sources: DataFrame, most_drop_percent: float = 40.0, least_coverage_percent: float = 95.0) -> DataFrame:
    """Whether each source's new state may replace the one before: `collected`, `expected`, `previous` counts."""
    coverage = F.when(F.col("expected") > 0, half_up(F.col("collected") / F.col("expected") * 100.0, 1))
    drop = F.when(F.col("previous") > 0, half_up((F.col("previous") - F.col("collected")) / F.col("previous") * 100.0, 1)).otherwise(0.0)
    out = sources.withColumns({"coverage_percent": coverage, "drop_percent": drop})
    problems = reasons((F.col("collected") == 0, "EMPTY"), (F.col("expected").isNotNull() & (F.col("coverage_percent") < least_coverage_percent), "LOW_COVERAGE"), (F.col("drop_percent") > most_drop_percent, "SHARP_DROP"))
    return out.withColumn("problems", problems).withColumn("publish", F.size("problems") == 0)


def preserve_failed(fresh: DataFrame, archive: DataFrame, failed: DataFrame, source: str) -> DataFrame:
    """Fresh rows, and the archive's rows of sources that failed this time."""
    return fresh.unionByName(archive.join(failed.select(source).distinct(), source, "left_semi"))


def keyed_union(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key, new ones before old ones."""
    return new.unionByName(old.join(new.select(*key).distinct(), key, "left_anti"))


def merge_catalog(existing: DataFrame, incoming: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """Full outer merge by key with a rule per column: min, max, coalesce (incoming first), keep (existing first), or, union."""
    a = existing.select(*key, *(F.col(c).alias(f"a_{c}") for c in rules))
    b = incoming.select(*key, *(F.col(c).alias(f"b_{c}") for c in rules))

    def resolve(c: str, rule: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return {
            "min": F.least(x, y),
            "max": F.greatest(x, y),
            "coalesce": F.coalesce(y, x),
            "keep": F.coalesce(x, y),
            "or": F.coalesce(x.cast("boolean"), F.lit(False)) | F.coalesce(y.cast("boolean"), F.lit(False)) if rule == "or" else x,
            "union": F.array_distinct(F.concat(F.coalesce(x, F.array()), F.coalesce(y, F.array()))) if rule == "union" else x,
        }[rule].alias(c)

    return a.join(b, key, "full").select(*key, *(resolve(c, r) for c, r in rules.items()))


def newness_state(states: DataFrame, key: str, ts: str, verified: str) -> DataFrame:
    """NOT_VERIFIED until first verified, VERIFIED_NEW while verified, FORMERLY_NEW after: the state after the last snapshot."""
    last = F.max_by(verified, ts)
    ever = F.max(verified)
    return states.groupBy(key).agg(F.when(last, "VERIFIED_NEW").when(ever, "FORMERLY_NEW").otherwise("NOT_VERIFIED").alias("status"), F.min(F.when(F.col(verified), F.col(ts))).alias("first_verified"), F.max(F.when(F.col(verified), F.col(ts))).alias("last_verified"))


def with_last_good(attempts: DataFrame, good: DataFrame, key: list[str], ts: str, ties: list[Column]) -> DataFrame:
    """The latest attempt of each key (of equal times the first) beside the last good state there is, if any."""
    latest = attempts.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(ts).desc(), *ties))).filter("_place = 1").drop("_place")
    last = good.groupBy(*key).agg(F.max(ts).alias("last_good"))
    return latest.join(last, key, "left")
