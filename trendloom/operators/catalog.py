"""Catalog queries: periods and scopes, facets, coverage, search, review order, paging."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.expr import half_up, within_period

PERIOD_DAYS = {"24H": 1.0, "7D": 7.0, "30D": 30.0, "90D": 90.0}


def new_arrivals(items: DataFrame, first_seen: str, reference: Column, period: str, scope: Column | None = None) -> DataFrame:
    """Items first seen within the period before the reference, newest first. Future dates pass, missing ones do not."""
    kept = items.filter(within_period(first_seen, reference, PERIOD_DAYS[period]))
    return (kept.filter(scope) if scope is not None else kept).orderBy(F.col(first_seen).desc())


def brand_scope(brand: str, wanted: str) -> Column:
    return F.upper(F.trim(F.col(brand))) == wanted.strip().upper()


def verified_new(status: str, evidence: str, seen: str) -> Column:
    """Verified, by a collection or a badge, at a date that parses."""
    return (F.col(status) == "VERIFIED_NEW") & F.col(evidence).isin("NEW_ARRIVALS_COLLECTION", "NEW_BADGE") & F.try_to_timestamp(F.col(seen)).isNotNull()


def newest_per_key(rows: DataFrame, key: list[str], ts: str, ties: list[Column]) -> DataFrame:
    """The newest row of each key; equal dates keep the first by `ties`."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(ts).desc_nulls_last(), *ties))).filter("place = 1").drop("place")


def optional_equals(table: DataFrame, criteria: Mapping[str, object]) -> DataFrame:
    """Equality on every criterion that is given; None is no constraint."""
    for column, value in criteria.items():
        if value is not None:
            table = table.filter(F.col(column) == F.lit(value))
    return table


def search(table: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows with the query in one of the columns, without regard to case; a blank query lets all pass."""
    q = query.strip().lower()
    if not q:
        return table
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    return table.filter(hit)


def marked(state: DataFrame, mark: str) -> DataFrame:
    """Rows of the state whose mark is set: neither null nor empty."""
    return state.filter(F.col(mark).isNotNull() & (F.col(mark).cast("string") != ""))


def without_state(items: DataFrame, state: DataFrame, key: str, mark: str) -> DataFrame:
    """Items whose state has no mark yet."""
    return items.join(marked(state, mark).select(key).distinct(), key, "left_anti")


def with_state(items: DataFrame, state: DataFrame, key: str, mark: str) -> DataFrame:
    return items.join(marked(state, mark).select(key).distinct(), key, "left_semi")


def facet_counts(items: DataFrame, fields: Mapping[str, Column], active: Mapping[str, object]) -> DataFrame:
    """Counts of each field's values among items that pass all *other* active filters.

    One scan: a row knows which filters it fails. With none failed it counts for every field, with one failed only for
    that field. Fields with a constraint in `active` are the filters.
    """
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(fields[f] == F.lit(v), F.lit(False)), F.lit(f)) for f, v in active.items()])) if active else F.array().cast("array<string>")
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in fields.items()]))
    each = items.select(failed.alias("failed"), values.alias("v")).filter((F.size("failed") == 0) | ((F.size("failed") == 1) & (F.get("failed", F.lit(0)) == F.col("v.field"))))
    return each.filter(F.col("v.value").isNotNull()).groupBy(F.col("v.field").alias("field"), F.col("v.value").alias("value")).agg(F.count("*").alias("n"))


def field_coverage(items: DataFrame, fields: Mapping[str, Column], group: str | None = None, not_applicable: str = "NOT_APPLICABLE") -> DataFrame:
    """Known and applicable values per field, with the percentage to one decimal."""
    long = items.select(*([F.col(group).alias("group")] if group else [F.lit("ALL").alias("group")]), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in fields.items()])).alias("v"))
    applicable = F.count_if(F.coalesce(F.col("v.value") != not_applicable, F.lit(True)))
    known = F.count_if(F.col("v.value").isNotNull() & ~F.col("v.value").isin("UNKNOWN", not_applicable))
    out = long.groupBy("group", F.col("v.field").alias("field")).agg(known.alias("known"), applicable.alias("applicable"))
    return out.withColumn("percent", F.when(F.col("applicable") > 0, half_up(F.col("known") / F.col("applicable") * 100.0, 1)).otherwise(0.0))


def next_unreviewed(items: DataFrame, position: str, current: int, total: int) -> DataFrame:
    """The next item after the current position, wrapping around."""
    return items.filter(F.col(position) != current).orderBy(F.pmod(F.col(position) - current - 1, F.lit(total))).limit(1)


def page(items: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    return items.orderBy(*order).offset(size * number).limit(size)


def capped_pick(items: DataFrame, group: str, order: list[Column], cap: int, k: int) -> DataFrame:
    """The best k with at most cap of a group, filled up by those with rank cap + 1."""
    ranked = items.withColumn("in_group", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("in_group") <= cap + 1)
    return ranked.orderBy((F.col("in_group") > cap).cast("int"), *order).limit(k)


def one_per_group_then_fill(items: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """First the best of each group, then the rest, k in all."""
    ranked = items.withColumn("in_group", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.orderBy((F.col("in_group") > 1).cast("int"), *order).limit(k)


def cycled(items: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """k places: the best of each group first, then the rest, and from the start again where there are fewer than k."""
    first = one_per_group_then_fill(items, group, order, k)
    placed = first.withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("in_group") > 1).cast("int"), *order)) - 1)  # of k rows
    count = placed.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    places = placed.sparkSession.range(k).select(F.col("id").alias("place")).join(count).withColumn("_place", F.pmod("place", F.col("_n")))  # one row
    return places.join(placed, "_place").drop("_place", "_n", "in_group")


def newest_by(dates: list[Column], name: Column) -> list[Column]:
    """Newest first by the first of several dates that is known, undated last, then by name in Turkish order."""
    return [F.coalesce(*dates).desc_nulls_last(), F.collate(name, "tr").asc()]
