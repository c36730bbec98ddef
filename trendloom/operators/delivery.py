"""Delivery of a catalog: indexes, cards, shards, look-ups, replacement and merging of what is delivered."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.operators.market import top_per_group


def representatives(items: DataFrame, group: list[str], score: Column, item: str) -> DataFrame:
    """The item of each group with the best score, the smallest of equals."""
    best = F.max_by(F.struct(*items.columns), F.struct(score.alias("s"), (-F.col(item)).alias("i")))
    return items.groupBy(*group).agg(best.alias("b"), F.count("*").alias("variants")).select("b.*", "variants")


def with_prior(families: DataFrame, prior: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Families with what the prior state knew of them; what a family has itself goes first."""
    old = prior.select(key, *(F.col(c).alias(f"prior_{c}") for c in columns))
    out = families.join(old, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"prior_{c}")) for c in columns}).drop(*(f"prior_{c}" for c in columns))


def with_profile(rows: DataFrame, registry: DataFrame, brand: str, defaults: Mapping[str, object]) -> DataFrame:
    """Each row with its brand's profile by upper-case name; brands that are unknown or not eligible get the defaults."""
    known = registry.filter("eligible").select(F.upper(F.trim("name")).alias("_name"), *(F.col(c).alias(f"_{c}") for c in defaults))
    out = rows.join(known, F.upper(F.trim(F.col(brand))) == F.col("_name"), "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(f"_{c}"), F.lit(v)).alias(c) for c, v in defaults.items()))


def family_index(families: DataFrame, products: DataFrame, key: str, category: str, skip: str = "OTHER_FOOTWEAR") -> DataFrame:
    """Families with their representative product; those without one, or of no category, are left out."""
    return families.join(products.filter(F.col(category) != skip), key)


def without_delivered(variants: DataFrame, delivered: DataFrame, url: str, family: str) -> DataFrame:
    """Families with the variants that are not delivered yet; a family whose variants all are is gone."""
    left = variants.join(delivered.select(url).distinct(), url, "left_anti")
    return left.groupBy(family).agg(F.count("*").alias("variants"), F.min(url).alias("first_url"))


def merge_core(shard: DataFrame, core: DataFrame, family: str, host: str) -> DataFrame:
    """Variants of a shard after a core delivery: those of a (family, host) that the core brings are replaced by its own,
    others stay."""
    fresh = core.select(family, host).distinct()
    return core.withColumn("origin", F.lit("core")).unionByName(shard.join(fresh, [family, host], "left_anti").withColumn("origin", F.lit("shard")))


def prune_evidence(variants: DataFrame, gone: DataFrame, family: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Variants without those of withdrawn (family, source) pairs, and the families that would lose all of them: these are
    an error, and the caller must not deliver while there are any."""
    left = variants.join(gone.select(family, source).distinct(), [family, source], "left_anti")
    return left, variants.select(family).distinct().join(left.select(family).distinct(), family, "left_anti")


def replace_brand(catalog: DataFrame, fresh: DataFrame, brand: str, source: str) -> DataFrame:
    """A brand's rows of the sources that were read again are replaced, those of other sources stay."""
    return fresh.unionByName(catalog.join(fresh.select(brand, source).distinct(), [brand, source], "left_anti"))


def accumulate(history: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """The history with what the current state adds, each key once."""
    return history.select(*key).unionByName(current.select(*key)).distinct()


def _equals(c: Column, key: str):
    return lambda x: x[key] == c[key]


def display_categories(refs: DataFrame, source: str, keys: list[str], order: list[str]) -> DataFrame:
    """Categories of each source in order, without those that equal one shown before in any key (id, url, path; null equals
    nothing). A source's categories are its menu, a short list, so the walk is a fold over one array."""
    columns = [*order, *(k for k in keys if k not in order)]
    menu = refs.groupBy(source).agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("menu"))
    kind = menu.schema["menu"].dataType.simpleString()

    def step(shown: Column, c: Column) -> Column:
        again = F.lit(False)
        for k in keys:
            again = again | F.coalesce(F.exists(shown, _equals(c, k)), F.lit(False))
        return F.when(again, shown).otherwise(F.array_append(shown, c))

    folded = F.aggregate("menu", F.array().cast(kind), step)
    return menu.select(source, F.explode(folded).alias("c")).select(source, "c.*")


def shard_summary(families: DataFrame, shard: Column, brand: str, category: str) -> DataFrame:
    """For each delivery shard: families, brands, categories and its smallest and largest id."""
    return families.groupBy(shard.alias("shard")).agg(F.count("*").alias("families"), F.countDistinct(brand).alias("brands"), F.countDistinct(category).alias("categories"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def shards_of(ids: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Which shards hold the ids asked for, and how many of them: only these need to be read."""
    return index.join(ids.select(key).distinct(), key, "left_semi").groupBy("shard").agg(F.count("*").alias("wanted"))


def cards(families: DataFrame, key: str, order: Column, columns: list[str], allowed: Column) -> DataFrame:
    """One card for each id, the first of those that policy allows."""
    return families.filter(allowed).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("c")).select(key, "c.*")


def brand_index(brands: DataFrame, country: str | None, segment: str | None, order: list[Column]) -> DataFrame:
    """Brands of a country and a segment, where given, with their place in an order."""
    for column, wanted in (("country", country), ("segment", segment)):
        if wanted is not None:
            brands = brands.filter(F.col(column) == wanted)
    # A table of brands, not of products.
    return brands.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def color_variants(variants: DataFrame, family: str, fingerprint: Column) -> DataFrame:
    """Colours of a family, one of each fingerprint; a family of one colour has none to show."""
    each = variants.groupBy(family, fingerprint.alias("fingerprint")).agg(F.count("*").alias("items"), F.min("url").alias("url"))
    many = each.groupBy(family).count().filter("count > 1").select(family)
    return each.join(many, family, "left_semi")


def navigation(counts: DataFrame, category: str, rolled: Mapping[str, str]) -> DataFrame:
    """Counts of main categories; a category that is part of another counts there."""
    parts = F.create_map(*[F.lit(x) for pair in rolled.items() for x in pair])
    return counts.groupBy(F.coalesce(F.element_at(parts, F.col(category)), F.col(category)).alias("category")).agg(F.sum("n").alias("n"))


def brand_cards(products: DataFrame, brand: str, image: str, order: list[Column], most: int = 8, images: int = 3) -> DataFrame:
    """The brands with most products, with up to three images each, brands without any left out."""
    ranked = top_per_group(products.filter(F.col(image).isNotNull()), [brand], order, images)
    shown = ranked.groupBy(brand).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", image))), lambda x: x[image].cast("string")), ",").alias("images"))
    counts = products.groupBy(brand).agg(F.count("*").alias("products"))
    return counts.join(shown, brand).orderBy(F.desc("products"), brand).limit(most)


def palette(tags: DataFrame, k: int = 8, skip: tuple[str, ...] = ("UNKNOWN", "OTHER")) -> DataFrame:
    """The k strongest tags of each dimension."""
    return top_per_group(tags.filter(~F.col("tag").isin(*skip)), ["dimension"], [F.desc("n"), F.asc("tag")], k)


def country_summary(products: DataFrame, country: str, brand: str, retailer: str, image: Column) -> DataFrame:
    """For each country: products, brands, retailers and the share of products with an image, in percent."""
    return products.groupBy(country).agg(F.count("*").alias("products"), F.countDistinct(brand).alias("brands"), F.countDistinct(retailer).alias("retailers"), (F.floor(F.avg(image.cast("double")) * 1000 + 0.5) / 10).alias("image_percent"))


def snapshots_in_order(files: DataFrame, pattern: str) -> DataFrame:
    """Snapshot ids of files whose name fits, in order of when they were taken, with their place."""
    named = files.filter(F.col("name").rlike(pattern)).withColumn("id", F.regexp_extract("name", pattern, 1))
    return named.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("taken", "id")))  # of one row per snapshot
