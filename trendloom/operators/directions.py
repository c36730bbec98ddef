"""Directions of the master radar: attribute combinations within a category that several brands show, early or commercial.

Families are aggregated to combinations at once; only combinations, of which a category has as many as its vocabularies
allow, come together for the greedy choice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom import stars
from trendloom.functions.expr import ladder

# The dimensions that are combined, those that need a vision record, and values that say little.
FAMILIES = (
    ("TOE_SHAPE", "CONSTRUCTION"),
    ("TOE_SHAPE", "HEEL_TYPE"),
    ("HEEL_TYPE", "CONSTRUCTION"),
    ("DETAIL", "CONSTRUCTION"),
    ("TOE_SHAPE", "DETAIL"),
    ("HEEL_TYPE", "DETAIL"),
    ("SURFACE_EFFECT", "CONSTRUCTION"),
    ("TOE_SHAPE", "HEEL_TYPE", "CONSTRUCTION"),
    ("DETAIL", "CONSTRUCTION", "HEEL_TYPE"),
)
SEEN_ONLY = ("TOE_SHAPE", "DETAIL", "CONSTRUCTION", "SURFACE_EFFECT")
SKIPPED = ("UNKNOWN", "OTHER", "OTHER_FOOTWEAR")
GENERIC_VALUES = ("CLOSED_TOE", "OPEN_TOE", "BUCKLE", "SLINGBACK", "BACKLESS", "POINTED", "ROUND", "STILETTO", "FLAT", "BLOCK")
# Families and brands that a direction needs, how generic it may be, how many a category gets of each kind.
LEAST_FAMILIES, LEAST_BRANDS, MOST_GENERIC, MOST = 2, 2, 0.35, 6
GENERIC_SCORE, FULL_SPECIFICITY = 0.8, 3
# Segments and roles.
DIRECTIONAL, LEADING = ("DIRECTIONAL", "LUXURY"), ("LEADER", "EARLY_ADOPTER")
PREMIUM, COMMERCIAL = ("DIRECTIONAL", "LUXURY", "PREMIUM", "CONTEMPORARY"), ("CONTEMPORARY", "PREMIUM", "MASS_MARKET")
EARLY_STAGES, LATE_STAGES = ("COK_ERKEN", "ERKEN_SINYAL"), ("DOYGUN_GEC", "NUMUNEYE_GIR", "HAZIRLAN")
# Why a candidate is left out.
THIN, GENERIC = "Yetersiz bağımsız marka / model ailesi kanıtı", "Generic attribute kombinasyonu"
NO_STAGE, NO_TRUST = " radar için yeterli stage kanıtı yok", " radar için yeterli güven yok"


def family_stage(segment: Column, role: Column, directional: Column, commercial: Column) -> Column:
    """How far along a family is, by its brand's profile; null for brands that are not known."""
    unknown = F.coalesce(segment, F.lit("UNKNOWN")).isin("UNKNOWN") | F.coalesce(role, F.lit("UNKNOWN")).isin("UNKNOWN")
    return ladder(
        (unknown, F.lit(None).cast("string")),
        (segment == "MASS_MARKET", "DOYGUN_GEC"),
        ((segment == "CONTEMPORARY") & role.isin("MARKET", "RETAIL"), "NUMUNEYE_GIR"),
        (segment.isin(*COMMERCIAL) & (commercial >= 55), "HAZIRLAN"),
        (segment.isin(*DIRECTIONAL) & role.isin(*LEADING) & (directional >= 60), "COK_ERKEN"),
        (segment.isin(*PREMIUM) & (directional >= 45), "ERKEN_SINYAL"),
    )


def combos(values: dict[str, Column], families: tuple[tuple[str, ...], ...] = FAMILIES) -> Column:
    """All combinations of a family of dimensions with one known value of each, as arrays of DIM:value in the order of the
    dimensions. values: an array of each dimension's values."""

    def known(d: str) -> Column:
        kept = F.filter(F.array_distinct(F.coalesce(values[d], F.array().cast("array<string>"))), lambda v: v.isNotNull() & ~v.isin(*SKIPPED))
        return F.transform(kept, lambda v: F.concat(F.lit(f"{d}:"), v))

    def longer(rows: Column, d: str) -> Column:
        return F.flatten(F.transform(rows, lambda r: F.transform(known(d), lambda v: F.concat(r, F.array(v)))))

    out = []
    for dimensions in families:
        rows = F.transform(known(dimensions[0]), lambda v: F.array(v))
        for d in dimensions[1:]:
            rows = longer(rows, d)
        out.append(rows)
    return F.concat(*out)


def candidates(families: DataFrame, values: dict[str, Column], profiles: DataFrame) -> DataFrame:
    """Every combination of a category with its strict support, stages, score and why it is left out, if it is.

    families: category, family, brand, vision and what `values` reads; all combinations need a vision record, as each has a
    dimension that is only seen. profiles: brand, segment, role, directional, commercial; a brand without one is unknown.
    Rows without a category, or of other footwear, have no direction. Genericity is the mark of a generic first value; what
    families without vision share with a combination is nothing, as none can be matched without it.
    """
    of = families.filter(F.col("category").isNotNull() & (F.col("category") != "OTHER_FOOTWEAR"))
    # Families are dealt out first, so that their combinations are made once and made distinct where they are.
    of = stars.spread(of, "family")
    each = of.select("category", "family", "brand", F.coalesce("vision", F.lit(False)).alias("strict"), F.explode_outer(combos(values)).alias("attributes")).filter(F.col("attributes").isNotNull())
    known = profiles.select("brand", "segment", "role", "directional", "commercial")
    # Families of a brand count once per combination before the profile is joined, so a hot brand is a few rows.
    by_brand = each.distinct().groupBy("category", "attributes", "brand").agg(F.count_if("strict").alias("families"))
    seen = by_brand.join(known, "brand", "left")
    stage = family_stage(F.col("segment"), F.col("role"), F.col("directional"), F.col("commercial"))
    counted = F.col("families") > 0
    unknown = F.coalesce(F.col("segment"), F.lit("UNKNOWN")) == "UNKNOWN"
    quality = F.when(unknown, 0.0).otherwise(F.greatest("directional", "commercial").cast("double"))
    support = seen.groupBy("category", "attributes").agg(
        F.sum("families").alias("families"),
        F.count_if(counted).alias("brands"),
        F.collect_set(F.when(counted, stage)).alias("stages"),
        F.avg(F.when(counted, quality)).alias("quality"),
        F.count_if(counted & ~unknown).alias("profiled"),
        F.count_if(counted & ~unknown & F.col("segment").isin(*DIRECTIONAL) & F.col("role").isin(*LEADING)).alias("leading"),
        F.count_if(counted & ~unknown & F.col("segment").isin(*PREMIUM)).alias("premium"),
    )
    n = F.size("attributes")
    generic = F.when(F.substring_index(F.get("attributes", F.lit(0)), ":", -1).isin(*GENERIC_VALUES), GENERIC_SCORE).otherwise(0.0)
    reason = ladder(((F.col("families") < LEAST_FAMILIES) | (F.col("brands") < LEAST_BRANDS), THIN), ((generic >= MOST_GENERIC) & (n < FULL_SPECIFICITY), GENERIC))
    score = F.col("brands") * 12 + F.col("families") * 8 + F.coalesce("quality", F.lit(0.0)) * 0.35 + n * 10 - generic * 40 + n * 5
    key = F.concat(F.col("category"), F.lit("::"), F.array_join(F.array_sort("attributes"), "|"))
    return support.withColumns({"key": key, "genericity": generic, "score": score, "reason": reason})


def without_nested(found: DataFrame, most: int = 2 * MOST) -> DataFrame:
    """From the best on, candidates of a category that neither hold nor are held by one taken before; ties go by key."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, frozenset]] = []
        ranked = pdf.assign(low=-pdf["score"]).sort_values(["low", "key"])
        for i, attributes in zip(ranked.index, ranked["attributes"]):
            mine = frozenset(attributes)
            if not any(mine < other or other < mine for _, other in taken):
                taken.append((i, mine))
        return pdf.loc[[i for i, _ in taken[:most]]]

    return found.groupBy("category").applyInPandas(choose, found.schema)


def signals(chosen: DataFrame) -> DataFrame:
    """A row for each chosen candidate and kind of radar: stage and confidence, or why there is no signal."""
    kinds = chosen.withColumn("radar", F.explode(F.array(F.lit("EARLY"), F.lit("COMMERCIAL"))))
    early = F.col("radar") == "EARLY"
    first = lambda stages: F.coalesce(*[F.when(F.array_contains("stages", s), F.lit(s)) for s in stages])
    kinds = kinds.withColumn("stage", F.when(early, first(EARLY_STAGES)).otherwise(first(LATE_STAGES)))
    stage, premium, brands = F.col("stage"), F.col("premium"), F.col("brands")
    confidence = ladder(
        (stage.isNull(), F.lit(None).cast("string")),
        (F.col("profiled") == 0, "INSUFFICIENT"),
        (early & (stage == "COK_ERKEN") & (F.col("leading") >= 1), "MEDIUM"),
        (early & (stage == "ERKEN_SINYAL") & (premium >= 3), "MEDIUM"),
        (early & (premium >= 2), "LOW"),
        (early, "INSUFFICIENT"),
        ((stage == "NUMUNEYE_GIR") & (brands >= 3), "MEDIUM"),
        (brands >= 2, "LOW"),
        default="INSUFFICIENT",
    )
    kinds = kinds.withColumn("confidence", confidence)
    reason = F.when(stage.isNull(), F.concat("radar", F.lit(NO_STAGE))).when(F.col("confidence") == "INSUFFICIENT", F.concat("radar", F.lit(NO_TRUST)))
    return kinds.withColumn("reason", reason)


def directions(told: DataFrame) -> DataFrame:
    """The best signals of each category and kind."""
    place = F.row_number().over(Window.partitionBy("category", "radar").orderBy(F.desc("score"), F.asc("key")))
    return told.filter(F.col("reason").isNull()).withColumn("place", place).filter(F.col("place") <= MOST)


def audit(found: DataFrame, told: DataFrame) -> DataFrame:
    """All candidates that gave no direction, with the reason: thin or generic ones, and chosen ones without a stage or
    enough trust."""
    left = found.filter(F.col("reason").isNotNull()).select("category", "key", F.lit(None).cast("string").alias("radar"), "reason", "families", "brands")
    return left.unionByName(told.filter(F.col("reason").isNotNull()).select("category", "key", "radar", "reason", "families", "brands"))
