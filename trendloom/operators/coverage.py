"""Coverage reports: what is known, seen, verified, mapped or missing, per brand, source, category or feature."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.expr import half_up, ladder
from trendloom.operators.market import top_per_group


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, half_up(part / whole * 100.0, digits)).otherwise(0.0)


def normalised_summary(products: DataFrame, group: str, text: Column, vision: Column) -> DataFrame:
    """Per group: products, those with text, with vision and with both evidence."""
    return products.groupBy(group).agg(F.count("*").alias("products"), F.count_if(text).alias("with_text"), F.count_if(vision).alias("with_vision"), F.count_if(text & vision).alias("with_both"))


def completeness(items: DataFrame, features: Mapping[str, Column], category: Column) -> DataFrame:
    """One row: items, those of a known category, known and unknown values of each feature, and the mean share of known
    features among those that apply, in percent."""
    applies = lambda c: F.coalesce(c != "NOT_APPLICABLE", F.lit(True))
    known = lambda c: c.isNotNull() & ~c.isin("UNKNOWN", "NOT_APPLICABLE")
    of = sum((applies(c).cast("int") for c in features.values()), F.lit(0))
    have = sum((F.coalesce(known(c), F.lit(False)).cast("int") for c in features.values()), F.lit(0))
    own = F.when(of > 0, half_up(have / of * 100.0, 1)).otherwise(100.0)
    in_category = F.coalesce(category != "UNCLASSIFIED", F.lit(False))
    return items.agg(
        F.count("*").alias("items"),
        F.count_if(in_category).alias("category_known"),
        percent(F.count_if(in_category), F.count("*")).alias("category_percent"),
        *(F.count_if(known(c)).alias(f"{f}_known") for f, c in features.items()),
        *(F.count_if(~F.coalesce(known(c), F.lit(False)) & applies(c)).alias(f"{f}_unknown") for f, c in features.items()),
        half_up(F.avg(own), 1).alias("average_percent"),
    )


def category_summaries(families: DataFrame, category: str, hero_order: Column, new: Column) -> DataFrame:
    """Per category: families, the one to show first (of equal ones the largest id), and how many are verified new."""
    return families.groupBy(category).agg(F.count("*").alias("families"), F.max_by("id", F.struct(hero_order, F.col("id"))).alias("hero"), F.count_if(new).alias("verified_new"))


def counts_unknown_last(rows: DataFrame, value: Column, unknown: str = "unknown") -> DataFrame:
    """Counts per value, largest first, with the unknown ones in the last place whatever their number."""
    counts = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    order = [(F.col("value") == unknown).cast("int"), F.desc("n"), F.asc("value")]
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # of one row per value


def category_coverage(found: DataFrame, crawled: DataFrame, brand: str, category: str) -> DataFrame:
    """Per brand: categories found, crawled, and those found but not crawled."""
    have = crawled.select(brand, category).distinct().withColumn("have", F.lit(True))
    return found.select(brand, category).distinct().join(have, [brand, category], "left").groupBy(brand).agg(F.count("*").alias("found"), F.count("have").alias("crawled"), F.count_if(F.col("have").isNull()).alias("missing"))


def source_coverage(registry: DataFrame, rows: DataFrame, source: str, complete: Column, least: float = 0.9) -> DataFrame:
    """Per registered source: rows, brands, complete rows and the share of its stated total; sources that gave nothing
    are in it too. registry: source, kind, total."""
    got = rows.groupBy(source).agg(F.count("*").alias("rows"), F.countDistinct("brand").alias("brands"), F.count_if(complete).alias("complete"))
    out = registry.join(got, source, "left").fillna(0, ["rows", "brands", "complete"])
    share = F.when(F.col("total") > 0, half_up(F.col("rows") / F.col("total") * 100.0, 1))
    status = ladder((F.col("rows") == 0, "MISSING"), (F.col("rows") >= F.col("total") * least, "FULL"), default="PARTIAL")
    return out.withColumns({"percent": share, "status": status})


def vision_tags(records: DataFrame, tags: Column, least: float) -> DataFrame:
    """Per tag: records that show it surely enough, each once. tags: array of struct(tag, confidence)."""
    sure = F.array_distinct(F.transform(F.filter(tags, lambda t: t["confidence"] >= least), lambda t: t["tag"]))
    return records.select(F.explode(sure).alias("tag")).groupBy("tag").agg(F.count("*").alias("records"))


def stability_rates(verdicts: DataFrame, feature: str) -> DataFrame:
    """Per feature: how often runs agree, among the items that all runs saw."""
    whole = F.count_if(F.col("verdict") != "INCOMPLETE_RUN")
    stable = F.count_if(F.col("verdict").isin("STABLE_YES", "STABLE_NO"))
    return verdicts.groupBy(feature).agg(F.count("*").alias("items"), whole.alias("complete"), stable.alias("stable"), percent(stable, whole).alias("percent"))


def verification_summary(rows: DataFrame, feature: str) -> DataFrame:
    """Per feature: first answers, verified and rejected ones, and the share corrected."""
    asked = F.count_if(F.col("value") == "YES")
    rejected = F.count_if((F.col("value") == "YES") & (F.col("verifier") == "REJECTED"))
    return rows.groupBy(feature).agg(asked.alias("asked"), F.count_if((F.col("value") == "YES") & (F.col("verifier") == "VERIFIED")).alias("verified"), rejected.alias("rejected"), percent(rejected, asked).alias("corrected_percent"))


def unmapped(rows: DataFrame, label: str, mapped: Column, brand: str, k: int = 40) -> DataFrame:
    """The most frequent labels without a mapping, with how many brands use them."""
    left = rows.filter(mapped.isNull()).groupBy(label, brand).agg(F.count("*").alias("n"))
    return left.groupBy(label).agg(F.sum("n").alias("n"), F.count("*").alias("brands")).orderBy(F.desc("n"), label).limit(k)


def outcomes(rows: DataFrame, status: str, name: str, k: int = 25) -> DataFrame:
    """Per status: how many, and the first names."""
    first = top_per_group(rows.select(status, name), [status], [F.asc(name)], k).groupBy(status).agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("first"))
    return rows.groupBy(status).agg(F.count("*").alias("n")).join(first, status)


def date_sources(rows: DataFrame, dates: Mapping[str, Column]) -> DataFrame:
    """How many rows take their date from each source, the first that is known; `none` for those without any."""
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in dates.items()], F.lit("none"))
    return rows.groupBy(source.alias("source")).agg(F.count("*").alias("n"))


def generic_labels(rows: DataFrame, label: Column, least: int = 8) -> DataFrame:
    """Labels seen so often that they name nothing."""
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def image_share(variants: DataFrame, brand: str, images: Column) -> DataFrame:
    """Per brand: variants, those with images, and their share."""
    some = F.count_if(images > 0)
    return variants.groupBy(brand).agg(F.count("*").alias("variants"), some.alias("with_images"), percent(some, F.count("*")).alias("percent"))
