"""Market analysis: tag counts, breakdowns, signals and provenance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tag_counts(products: DataFrame, tags: Column, brand: str) -> DataFrame:
    """Per tag: products (one that repeats the tag counts once), distinct brands and their sorted names.

    The explode and a two-level aggregation: (tag, brand) first, so a tag that most products share is pre-aggregated
    before it meets in one place, and its brand list is as long as there are brands, not products.
    """
    each = products.select(F.explode(F.array_distinct(tags)).alias("tag"), F.col(brand).alias("brand"))
    by_brand = each.groupBy("tag", "brand").agg(F.count("*").alias("n"))
    return by_brand.groupBy("tag").agg(F.sum("n").alias("product_count"), F.count("brand").alias("brand_count"), F.sort_array(F.collect_list("brand")).alias("brands"))


def value_counts(products: DataFrame, value: Column, brand: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Tag counts of a single-valued dimension, without the unknown ones."""
    return tag_counts(products.filter(value.isNotNull() & (value != unknown)), F.array(value), brand)


def top_per_group(table: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def brand_breakdown(products: DataFrame, brand: str, value: str, k: int = 5) -> DataFrame:
    """Per brand: product count and its k most frequent values."""
    counts = products.groupBy(brand, value).agg(F.count("*").alias("n"))
    top = top_per_group(counts, [brand], [F.desc("n"), F.asc(value)], k).groupBy(brand).agg(F.sort_array(F.collect_list(F.struct("rank", value))).alias("t"))
    total = counts.groupBy(brand).agg(F.sum("n").alias("product_count"))
    return total.join(top, brand).select(brand, "product_count", F.array_join(F.transform("t", lambda x: x[value].cast("string")), ",").alias("top_values"))


def top_signals(products: DataFrame, dimensions: Mapping[str, Column], brand: str, k: int = 12, skip: tuple[str, ...] = ("UNKNOWN", "OTHER")) -> DataFrame:
    """The k strongest (dimension, tag) pairs by products, then brands; ties keep the order of dimensions, then tags.

    All dimensions are exploded in one scan, not one scan each.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(d).alias("dimension"), c.cast("string").alias("tag")) for i, (d, c) in enumerate(dimensions.items())])
    each = products.select(F.col(brand).alias("brand"), F.explode(pairs).alias("p")).select("brand", "p.*").filter(F.col("tag").isNotNull() & ~F.col("tag").isin(*skip))
    counts = each.groupBy("place", "dimension", "tag", "brand").agg(F.count("*").alias("n")).groupBy("place", "dimension", "tag").agg(F.sum("n").alias("product_count"), F.count("brand").alias("brand_count"))
    return counts.orderBy(F.desc("product_count"), F.desc("brand_count"), "place", "tag").limit(k).select("dimension", "tag", "product_count", "brand_count")


def unknown_counts(products: DataFrame, dimensions: Mapping[str, Column], unknown: str = "UNKNOWN") -> DataFrame:
    return products.agg(F.count("*").alias("products"), *[F.count_if(F.coalesce(c, F.lit(unknown)) == unknown).alias(f"unknown_{d}") for d, c in dimensions.items()])


def provenance_counts(records: DataFrame, tag: str, source: str) -> DataFrame:
    """Per tag, how many come from text, from vision, or from both."""
    return records.groupBy(tag).agg(F.count("*").alias("total"), *[F.count_if(F.col(source) == s).alias(f"{s}_count") for s in ("text", "vision", "hybrid")])


def most_common(table: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the smaller one."""
    counts = table.groupBy(group, value).agg(F.count("*").alias("n"))
    return top_per_group(counts, [group], [F.desc("n"), F.asc(value)], 1).select(group, F.col(value).alias("most_common"), "n")


def counts_with_total(table: DataFrame, value: str, total: str = "TOTAL") -> DataFrame:
    """Counts per value with a grand-total row."""
    return table.rollup(value).agg(F.count("*").alias("n"), F.grouping(value).alias("g")).select(F.when(F.col("g") == 1, total).otherwise(F.col(value).cast("string")).alias("value"), "n")


def registry_report(table: DataFrame, fields: list[str]) -> DataFrame:
    """Counts by each field on its own, in one pass with grouping sets."""
    marks = F.coalesce(*[F.when(F.grouping(f) == 0, F.lit(f)) for f in fields])
    values = F.coalesce(*[F.when(F.grouping(f) == 0, F.col(f).cast("string")) for f in fields])
    return table.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(marks.alias("field"), values.alias("value"), F.count("*").alias("n")).select("field", "value", "n")


def date_shares(table: DataFrame, day: Column, k: int = 10) -> DataFrame:
    """The k most frequent days with their share of all rows."""
    counts = table.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy(F.lit(0)))  # of one row per day
    return counts.select("day", "n", (F.floor(F.col("n") / everything * 1000 + 0.5) / 10).alias("share_percent")).orderBy(F.desc("n"), "day").limit(k)
