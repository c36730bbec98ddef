"""Merging of records and evidence: variants, tags of two origins, imported states, images, backups, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.expr import ladder


def merge_variants(existing: DataFrame, incoming: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Variants of both sides by key; per column the incoming value, else the existing one, empty texts aside."""
    rows = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    known = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return rows.groupBy(*key).agg(*(F.max_by(F.when(known(c), F.col(c)), F.when(known(c), F.col("_side"))).alias(c) for c in columns), F.count("*").alias("sides"))


def resolve_tags(vision: Column, text: Column, least: float = 0.5) -> tuple[Column, Column]:
    """Tags and their origin: sure ones of vision, else those of the text, else any of vision.

    vision: array of struct(tag, confidence); text: array of strings."""
    tags = lambda a: F.transform(a, lambda t: t["tag"])
    sure = F.filter(F.coalesce(vision, F.array().cast(_TAGS)), lambda t: t["confidence"] >= least)
    any_ = F.filter(F.coalesce(vision, F.array().cast(_TAGS)), lambda t: t["tag"] != "")
    has_text = F.coalesce(F.size(text), F.lit(0)) > 0
    values = F.when(F.size(sure) > 0, tags(sure)).when(has_text, text).when(F.size(any_) > 0, tags(any_)).otherwise(F.array().cast("array<string>"))
    return values, ladder((F.size(sure) > 0, "vision"), (has_text, "text"), (F.size(any_) > 0, "vision"), default="none")


_TAGS = "array<struct<tag:string,confidence:double>>"


def new_tags(vision: Column, text: Column, least: float = 0.5) -> Column:
    """Tags that vision is sure of and the text does not have."""
    sure = F.transform(F.filter(vision, lambda t: t["confidence"] >= least), lambda t: t["tag"])
    return F.array_except(sure, F.coalesce(text, F.array().cast("array<string>")))


def import_states(local: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """States after an import: what is known locally stays, the rest is filled; `changed` says where that did anything."""
    new = incoming.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = local.join(new, key, "full")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(c).isNull() & F.col(f"_{c}").isNotNull())
    return out.select(key, *(F.coalesce(c, f"_{c}").alias(c) for c in columns), changed.alias("changed"))


def backup_faults(items: DataFrame, key: str, dates: list[str], note: str, most: int = 50_000, longest: int = 20_000) -> DataFrame:
    """One row of what is wrong with a backup; it is imported only if all are zero, else nothing is.

    Ids that are empty or repeat, dates that do not parse, notes that are too long, too many items."""
    bad_date = F.lit(False)
    for d in dates:
        bad_date = bad_date | (F.col(d).isNotNull() & F.try_to_timestamp(F.col(d)).isNull())
    each = items.groupBy(key).agg(F.count("*").alias("n"), F.count_if(bad_date).alias("dates"), F.count_if(F.length(note) > longest).alias("notes"))
    empty = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    return each.agg(F.count_if(empty).alias("no_id"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("dates"), F.lit(0)).alias("bad_dates"), F.coalesce(F.sum("notes"), F.lit(0)).alias("long_notes"), (F.coalesce(F.sum("n"), F.lit(0)) > most).alias("too_many"))


def merge_quarantine(archive: DataFrame, fresh: DataFrame, key: str, accepted: DataFrame) -> DataFrame:
    """The quarantine after a run: fresh entries over archived ones, without what has been accepted since."""
    kept = archive.join(fresh.select(key), key, "left_anti")
    return fresh.unionByName(kept).join(accepted.select(key), key, "left_anti")


def last_good_images(fresh: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Variants with their images and status, those of the old state where a fresh one has no image."""
    before = old.select(*key, F.col("images").alias("_images"), F.col("status").alias("_status"))
    none = F.coalesce(F.size("images"), F.lit(0)) <= 0
    out = fresh.join(before, key, "left")
    return out.withColumns({"images": F.when(none, F.coalesce("_images", "images")).otherwise(F.col("images")), "status": F.when(none, F.coalesce("_status", "status")).otherwise(F.col("status"))}).drop("_images", "_status")


def evidence_coverage(combos: DataFrame, text: Column, vision: Column, needs_vision: Column, products: int, with_vision: int) -> DataFrame:
    """For each combination the products with text, vision and both, and the share that gives the evidence it needs."""
    out = combos.groupBy("combo").agg(F.count_if(text).alias("text"), F.count_if(vision).alias("vision"), F.count_if(text & vision).alias("hybrid"))
    share = F.when(needs_vision, F.col("vision") / float(max(with_vision, 1))).otherwise(F.col("text") / float(max(products, 1)))
    return out.withColumn("coverage", share)


def signal_clusters(tags: DataFrame, least_brands: int = 2, per_dimension: int = 3, most: int = 12, skip: tuple[str, ...] = ("UNKNOWN", "OTHER")) -> DataFrame:
    """The strongest tags, at most three of a dimension, twelve in all. tags: dimension, tag, products, brands."""
    order = [F.desc("products"), F.desc("brands"), F.asc("tag")]
    ok = tags.filter((F.col("brands") >= least_brands) & ~F.col("tag").isin(*skip))
    ranked = ok.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(*order))).filter(F.col("rank") <= per_dimension)
    return ranked.orderBy(*order).limit(most)


def chips(features: dict[str, Column], labels: dict[str, str]) -> Column:
    """Short labels of the features that are known, in order."""
    return F.array_compact(F.array(*[F.when(c.isNotNull() & ~c.isin("UNKNOWN", "NOT_APPLICABLE"), F.concat(F.lit(labels[f] + ": "), c)) for f, c in features.items()]))


def without_colorway(title: Column, color: Column, words: tuple[str, ...]) -> Column:
    """A title without its own colour and the words that only describe a colourway."""
    from trendloom.functions.expr import AFTER, BEFORE

    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.trim(title)), r"\s+", " "), F.lit(" "))
    own = F.when(F.coalesce(F.trim(color), F.lit("")) != "", F.replace(plain, F.concat(F.lit(" "), F.lower(F.trim(color)), F.lit(" ")), F.lit(" "))).otherwise(plain)
    return F.trim(F.regexp_replace(F.regexp_replace(own, rf"{BEFORE}(?:{'|'.join(words)}){AFTER}", " "), r"\s+", " "))
