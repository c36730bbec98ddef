"""Filters by scope: what belongs to a brand, a source, a country, a segment or a set of taxonomy values; and orders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.expr import half_up, slug
from trendloom.operators.catalog import brand_scope

NOT_VALUES = ("UNKNOWN", "NOT_APPLICABLE")


def by_priority(brands: DataFrame, priority: str) -> DataFrame:
    """Brands tracked at a priority; that means active ones."""
    return brands.filter((F.col("priority") == priority) & F.col("is_active"))


def scope(kind: str, wanted: str | None = None, category: Column | None = None) -> Column:
    """ALL, BRAND, SOURCE (one of the sightings), CATEGORY or FILTER (a condition given) as one condition."""
    if kind == "ALL":
        return F.lit(True)
    if kind == "BRAND":
        return brand_scope("brand", wanted or "")
    if kind == "SOURCE":
        return F.exists("sources", lambda s: s == wanted)
    if kind == "CATEGORY":
        return F.col("category") == wanted
    if kind == "FILTER" and category is not None:
        return category
    raise ValueError(kind)


def values_of(value: Column) -> Column:
    """The values of a feature: `A+B` stands for both."""
    return F.filter(F.split(value, r"\+"), lambda v: v != "")


def matches_all(filters: Mapping[str, str], features: Mapping[str, Column]) -> Column:
    """Every filter's value is among the values of its feature; unknown features match none."""
    out = F.lit(True)
    for field, wanted in filters.items():
        out = out & F.coalesce(F.array_contains(values_of(features[field]), wanted), F.lit(False))
    return out


def facet_groups(items: DataFrame, features: Mapping[str, Column], active: Mapping[str, str], primary: float = 50.0) -> DataFrame:
    """Facets with coverage and tier: for each field the known values among items that pass all other active filters,
    the share of these items that know the field, and whether that is enough to show it first. One scan."""
    failed = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(~matches_all({f: v}, features), F.lit(f)) for f, v in active.items()]))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.filter(values_of(c), lambda v: ~v.isin(*NOT_VALUES)).alias("own"), (F.coalesce(c, F.lit("UNKNOWN")) != "NOT_APPLICABLE").alias("applies")) for f, c in features.items()]))
    counted = items.select(failed.alias("failed"), each.alias("e")).filter((F.size("failed") == 0) | ((F.size("failed") == 1) & (F.get("failed", F.lit(0)) == F.col("e.field"))))
    field, own = F.col("e.field").alias("field"), F.coalesce(F.col("e.own"), F.array().cast("array<string>"))
    totals = counted.groupBy(field).agg(F.count_if("e.applies").alias("applicable"), F.count_if(F.size(own) > 0).alias("known"))
    values = counted.select(field, F.explode(own).alias("value")).groupBy("field", "value").agg(F.count("*").alias("n"))
    percent = F.when(F.col("applicable") > 0, half_up(F.col("known") / F.col("applicable") * 100.0, 1)).otherwise(0.0)
    tier = F.when(F.col("percent") >= primary, "primary").otherwise("limited")
    return values.join(totals, "field").withColumn("percent", percent).withColumn("tier", tier).select("field", "value", "n", "percent", "tier")


def official_channel(sightings: Column, brand: Column, excluded: tuple[str, ...] = ()) -> Column:
    """Seen nowhere counts as official; else one sighting must be the brand's own shop and no marketplace's.

    sightings: array of struct(source, kind)."""
    own = lambda s: ~s["source"].isin(*excluded, "") & ~F.coalesce(s["kind"] == "LUXURY_MARKETPLACE", F.lit(False)) & (F.coalesce(s["kind"] == "BRAND_OFFICIAL", F.lit(False)) | (s["source"] == slug(brand)))
    return (F.coalesce(F.size(sightings), F.lit(0)) <= 0) | F.exists(sightings, own)


def on_marketplace(sightings: Column, brand: Column, marketplace: str, only: str | None = None, excluded: tuple[str, ...] = ()) -> Column:
    """Seen on the marketplace, and of one brand if one is asked for; excluded marketplaces have nothing."""
    if marketplace in excluded:
        return F.lit(False)
    seen = F.exists(sightings, lambda s: s["source"] == marketplace)
    return seen if only is None else seen & (F.upper(F.trim(brand)) == only.strip().upper())


def in_source_category(refs: Column, source: str, category: str) -> Column:
    """refs: array of struct(source, category)."""
    return F.exists(refs, lambda r: (r["source"] == source) & (r["category"] == category))


def with_segment(brands: DataFrame, segments: DataFrame, by_id: str, key: Column, wanted: str | None = None) -> DataFrame:
    """Add the price segment of each brand, by id, else by key of its name; keep one segment if asked for.

    segments: id, key, segment."""
    ids = segments.select(F.col("id").alias(by_id), F.col("segment").alias("of_id")).filter(f"{by_id} is not null")
    keys = segments.select(F.col("key").alias("_key"), F.col("segment").alias("of_key")).dropDuplicates(["_key"])
    out = brands.withColumn("_key", key).join(ids, by_id, "left").join(keys, "_key", "left")
    out = out.withColumn("price_segment", F.coalesce("of_id", "of_key")).drop("_key", "of_id", "of_key")
    return out if wanted is None else out.filter(F.col("price_segment") == wanted)


def changing(directions: DataFrame, view: str) -> DataFrame:
    """The view of what is changing, or of all."""
    return directions.filter("is_changing") if view == "CHANGING" else directions


def slim(families: DataFrame, keep: list[str], arrays: Mapping[str, int]) -> DataFrame:
    """For delivery: the columns wanted, arrays cut to their first elements."""
    return families.select(*keep, *(F.slice(a, 1, n).alias(a) for a, n in arrays.items()))


def visible_brands(brands: DataFrame, allowed: DataFrame, kinds: tuple[str, ...] = ("BRAND",)) -> DataFrame:
    """Brands that are available, of a kind that is shown, and on the list."""
    return brands.filter(F.col("available") & F.col("kind").isin(*kinds)).join(allowed.select("brand").distinct(), "brand", "left_semi")


def newest_first(ts: str | Column) -> list[Column]:
    """Newest first; a date that does not parse counts as the oldest."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return [F.coalesce(F.unix_micros(F.try_to_timestamp(c)), F.lit(0)).desc()]


def unreviewed_first(reviewed: str, ts: str) -> list[Column]:
    return [(F.coalesce(F.col(reviewed), F.lit("")) != "").cast("int"), *newest_first(ts)]


def by_change(delta: str, brand_delta: str, tag: str) -> list[Column]:
    """The largest change first, whatever its sign."""
    return [F.abs(F.col(delta)).desc(), F.abs(F.col(brand_delta)).desc(), F.col(tag)]


def turkish(c: str) -> Column:
    """A sort key in Turkish order: dotted and dotless i, ç after c."""
    return F.collate(F.col(c), "tr")


def by_influence(c: str, ascending: bool = False) -> list[Column]:
    return [F.col(c).asc() if ascending else F.col(c).desc()]
