"""The trend engine: deduplicated evidence, component scores, stage and decision, one row per trend.

Observations have the columns of `OBSERVATION`; sources have source_id, weight, role and is_active. Everything after
the dedupe is one aggregation in two steps, so observations are scanned once whatever the number of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.expr import clamp, days_between, in_window, ladder, mean_of_known, token

OBSERVATION = ("trend", "source_id", "brand", "corporate_group", "model_family", "color", "material", "publication", "country", "confidence", "segment", "signature", "first_seen", "observed_at")

# Markets, roles, segment order, weights.
NOT_A_TREND_MARKET = ("Çin", "CN", "China", "中国")
PRODUCTION_ROLE = "PRODUCTION_SIGNAL"
LEADER_ROLE, EARLY_ROLES, VALIDATION_ROLES = "LEADER", ("LEADER", "EARLY_ADOPTER"), ("MARKET", "RETAIL")
SEGMENTS = 5
MASS_SEGMENT = 4
STRENGTH = {"source_quality": 0.17, "brand_score": 0.17, "country_score": 0.17, "segment_score": 0.17, "leader_score": 0.16, "validation_score": 0.16}


def unit_key(scope: str = "silhouette") -> Column:
    """Who adopted what: group or brand, model family, and in narrower scopes the colour or material."""
    brand = token(F.coalesce(F.when(F.col("corporate_group") != "", F.col("corporate_group")), F.col("brand")))
    parts = [brand, token("model_family")]
    if scope in ("color", "material"):
        parts += [F.lit(scope), token(F.coalesce(F.col(scope), F.lit(f"unknown-{scope}")))]
    return F.concat_ws("::", *parts)


def entity_key(by_group: bool = True) -> Column:
    """Who counts as one independent voice: the corporate group where there is one and it is asked for, else the brand."""
    brand = token("brand")
    return F.when(F.coalesce(F.col("corporate_group"), F.lit("")) != "", token("corporate_group")).otherwise(brand) if by_group else brand


def publication_key() -> Column:
    return F.concat_ws("::", F.col("source_id").cast("string"), token("publication"))


def dedupe_observations(observations: DataFrame, scope: str = "silhouette", ties: list[Column] | None = None) -> DataFrame:
    """Of each trend, unit, source and publication the most confident observation; ties go to the first by `ties`."""
    keyed = observations.withColumn("unit", unit_key(scope))
    order = [F.desc("confidence"), *(ties or [F.col(c).asc_nulls_last() for c in ("observed_at", "first_seen", "country", "segment", "signature")])]
    best = Window.partitionBy("trend", "unit", "source_id", "publication").orderBy(*order)
    return keyed.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")


def eligible(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Observations of active sources outside production, from trend markets, with the source's weight and role.

    The registry of sources is small and joined by hash; Spark broadcasts it while it is below its threshold.
    """
    live = sources.filter(F.col("is_active") & (F.col("role") != PRODUCTION_ROLE)).select("source_id", "weight", "role")
    return observations.filter(~F.trim("country").isin(*NOT_A_TREND_MARKET)).join(live, "source_id")


def production_pressure(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Per trend: observations, sources and pressure of active production sources."""
    made = observations.join(sources.filter(F.col("is_active") & (F.col("role") == PRODUCTION_ROLE)).select("source_id", "weight"), "source_id")
    weighed = F.sum(F.col("confidence") * F.col("weight")).cast("double")
    return made.groupBy("trend").agg(F.count("*").alias("observations"), F.countDistinct("source_id").alias("sources"), F.countDistinct("brand").alias("brands"), F.least(F.lit(100.0), F.count("*") * 15 + weighed * 40).alias("pressure"))


def acceleration(recent: Column, previous: Column) -> Column:
    """Score of the ratio of two counts: 50 stands still, 100 doubles."""
    ratio = recent / previous
    return ladder((((recent == 0) & (previous == 0)), 0.0), (previous == 0, clamp(50.0 + recent * 10.0)), (ratio >= 2, 100.0), (ratio >= 1, clamp(50.0 + (ratio - 1.0) * 50.0)), default=clamp(ratio * 50.0))


def evidence(trend_obs: DataFrame, now: Column) -> DataFrame:
    """All sums and counts that the scores read, one row per trend. trend_obs: `eligible(dedupe_observations(..))`.

    One scan: an observation becomes one fact for the sums and one for each thing that is counted once per trend
    (country, unit, signature, brand, segment). Facts are aggregated by thing first, so hot trends are pre-aggregated
    before they meet, then by trend.
    """
    seen = lambda oldest, newest: in_window("observed_at", now, oldest, newest)
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    things = {"country": F.col("country"), "unit": F.col("unit"), "signature": F.col("signature"), "brand": token("brand"), "segment": F.col("segment")}
    facts = F.array(fact("row", F.lit("")), *(fact(k, v) for k, v in things.items()))
    c = trend_obs.withColumn("first_age", days_between("first_seen", now)).withColumn("age", days_between("observed_at", now))
    c = c.withColumn("fact", F.explode(F.filter(facts, lambda f: f["value"].isNotNull()))).withColumn("kind", F.col("fact.kind")).withColumn("value", F.col("fact.value"))
    weighed = F.col("confidence") * F.col("weight")
    recent30, previous30 = seen(30, 0), seen(60, 30)
    row = F.col("kind") == "row"
    number = lambda test: F.sum(F.when(row & test, 1).otherwise(0))
    total = lambda value, test=F.lit(True): F.sum(F.when(row & test, value))
    early = F.col("role").isin(*EARLY_ROLES)
    sums = {
        "n": number(F.lit(True)),
        "weighed": total(weighed),
        "weights": total(F.col("weight")),
        "leader_confidence": total(F.col("confidence"), F.col("role") == LEADER_ROLE),
        "validation_confidence": total(F.col("confidence"), F.col("role").isin(*VALIDATION_ROLES)),
        "early": number(early),
        "early_weighed": total(weighed, early),
        "first_seen_sum": total(F.unix_seconds(F.col("first_seen").cast("timestamp"))),
        "recent30": number(recent30),
        "in_30_60": number(previous30),
        "previous30": number(previous30 & ~recent30),
        "recent90": number(seen(90, 0)),
        "in_90_180": number(seen(180, 90)),
        "previous90": number(seen(180, 90) & ~seen(90, 0)),
    }
    flags = {"was_recent": recent30, "was_previous": previous30, "during": F.col("first_age").between(0, 90), "before": F.col("first_age") > 90}
    extremes = [F.max(F.when(row, F.col("age"))).alias("oldest"), F.min(F.when(row, F.col("age"))).alias("newest")]
    by_thing = c.groupBy("trend", "kind", "value").agg(*(v.alias(k) for k, v in sums.items()), *extremes, *(F.max(v).alias(k) for k, v in flags.items()))
    of = lambda kind, test=F.lit(True): F.count_if((F.col("kind") == kind) & test)
    segment = F.when(F.col("kind") == "segment", F.col("value").cast("int"))
    money = ("weighed", "weights", "leader_confidence", "validation_confidence", "early_weighed")
    out = by_thing.groupBy("trend").agg(
        *(F.sum(k).cast("double").alias(k) if k in money else F.sum(k).alias(k) for k in sums),
        F.max("oldest").alias("oldest"),
        F.min("newest").alias("newest"),
        of("country").alias("countries"),
        of("unit").alias("units"),
        of("signature").alias("signatures"),
        of("brand").alias("brands"),
        of("brand", F.col("was_recent") & ~F.col("was_previous")).alias("novel_brands"),
        of("brand", F.col("was_previous")).alias("previous_brands"),
        of("segment").alias("segments"),
        F.max(segment).alias("highest"),
        F.max(segment == MASS_SEGMENT).alias("mass"),
        of("segment", F.col("during") & ~F.col("before")).alias("novel_segments"),
    )
    return out.withColumn("mean_first_age", (F.unix_seconds(now) - F.col("first_seen_sum") / F.col("n")) / 86400.0)


def strength_components() -> dict[str, Column]:
    zero = F.lit(0.0)
    return {
        "source_quality": clamp(F.when(F.col("weights") > 0, F.col("weighed") / F.col("weights") * 100.0).otherwise(0.0)),
        "brand_score": clamp(F.col("brands") / 10.0 * 100.0),
        "country_score": clamp(F.col("countries") / 8.0 * 100.0),
        "segment_score": clamp(F.coalesce(F.col("segments"), F.lit(0)) / float(SEGMENTS) * 100.0),
        "leader_score": clamp(F.coalesce("leader_confidence", zero) / 5.0 * 100.0),
        "validation_score": clamp(F.coalesce("validation_confidence", zero) / 6.0 * 100.0),
    }


def momentum_components() -> dict[str, Column]:
    """Null where there is no history to compare with."""
    enough = (F.col("oldest") - F.col("newest") >= 60) & (F.col("n") >= 3) & ((F.col("in_30_60") > 0) | (F.col("in_90_180") > 0))
    ratio = F.when(F.col("previous_brands") == 0, F.col("novel_brands").cast("double")).otherwise(F.col("novel_brands") / F.col("previous_brands"))
    gained = F.when(F.col("recent30") > 0, F.when(F.col("in_30_60") == 0, F.when(F.col("novel_brands") > 0, clamp(40.0 + F.col("novel_brands") * 15.0))).otherwise(clamp(30.0 + ratio * 70.0)))
    moved = F.when(F.col("recent90") > 0, F.when(F.coalesce("novel_segments", F.lit(0)) == 0, 20.0).otherwise(clamp(35.0 + F.col("novel_segments") * 25.0)))
    parts = {
        "change_30d": F.when((F.col("recent30") > 0) & (F.col("in_30_60") > 0), acceleration(F.col("recent30"), F.col("previous30"))),
        "change_90d": F.when((F.col("recent90") > 0) & (F.col("in_90_180") > 0), acceleration(F.col("recent90"), F.col("previous90"))),
        "brand_acquisition": gained,
        "segment_transition": moved,
    }
    return {k: F.when(enough, v) for k, v in parts.items()}


def novelty_parts() -> dict[str, Column]:
    leaders = F.greatest(F.col("early"), F.lit(1))
    bonus = ladder((F.col("early") <= 3, 25.0), (F.col("early") <= 5, 10.0), default=0.0)
    highest = F.coalesce("highest", F.lit(-1))
    return {
        "leader_early": F.when(F.col("early") == 0, 10.0).otherwise(clamp(F.col("early_weighed") / leaders * 70.0 + bonus)),
        "low_mass": ladder((F.coalesce("mass", F.lit(False)), 15.0), (highest <= 1, 95.0), (highest == 2, 75.0), (highest == 3, 50.0), default=30.0),
        "construction": F.when(F.col("units") == 0, 0.0).otherwise(clamp(30.0 + F.col("signatures") / F.col("units") * 70.0)),
        "recency": ladder((F.col("mean_first_age") <= 45, 95.0), (F.col("mean_first_age") <= 90, 75.0), (F.col("mean_first_age") <= 180, 50.0), default=25.0),
    }


def saturation_parts() -> dict[str, Column]:
    m = F.col("momentum")
    return {
        "mass_saturation": F.when(F.coalesce("mass", F.lit(False)), 90.0).otherwise(10.0),
        "brand_penetration": clamp(F.col("brands") / 12.0 * 100.0),
        "proliferation": clamp(F.col("units") / 15.0 * 100.0),
        "lifecycle": F.when(F.col("highest").isNull(), 0.0).otherwise(clamp((F.col("highest") + 1) / float(SEGMENTS) * 100.0)),
        "plateau": ladder((m.isNull(), 20.0), (m <= 25, 80.0), (m <= 45, 55.0), (m <= 60, 30.0), default=10.0),
        "transitions": clamp(F.greatest(F.lit(0), F.coalesce("segments", F.lit(0)) - 1) * 12.0),
    }


def opportunity(strength: Column, momentum: Column, novelty: Column, saturation: Column) -> Column:
    base = F.when(momentum.isNull(), strength * 0.55 + novelty * 0.45).otherwise(strength * 0.4 + momentum * 0.25 + novelty * 0.35)
    return clamp(base * (1.0 - (0.35 + saturation / 100.0 * 0.65) * 0.75))


def stage(strength: Column, momentum: Column, novelty: Column, saturation: Column, mass: Column) -> Column:
    return ladder(
        ((saturation >= 78) | ((strength >= 70) & (saturation >= 65)), "SATURATED"),
        (mass & (strength >= 55) & (momentum.isNull() | (momentum < 55)), "MAINSTREAM"),
        ((strength >= 50) & momentum.isNotNull() & (momentum >= 65), "ACCELERATING"),
        ((strength >= 42) | (momentum.isNotNull() & (momentum >= 48)), "RISING"),
        ((novelty >= 55) & (strength < 42), "EARLY_SIGNAL"),
        default="VERY_EARLY",
    )


def decision(strength: Column, momentum: Column, novelty: Column, saturation: Column, chance: Column, units: Column, quality: Column, leaders: Column, at_stage: Column) -> Column:
    late, sample, watch, wait = "GEÇ KALDIK", "NUMUNEYE GİR", "TAKİP ET", "BEKLE"
    return ladder(
        ((saturation >= 70) | ((strength >= 65) & (saturation >= 55)) | at_stage.isin("SATURATED", "MAINSTREAM"), late),
        (((strength >= 55) | (momentum.isNotNull() & (momentum >= 60))) & (chance >= 55) & (saturation < 60) & (units >= 3) & (quality >= 35), sample),
        (((novelty >= 65) & (strength < 50)) | ((leaders >= 50) & (novelty >= 60) & (strength < 55)) | ((chance >= 35) & (chance < 55)), watch),
        ((quality < 30) | ((strength < 30) & (units < 2)), wait),
        ((chance >= 55) & (saturation < 60), sample),
        (strength >= 45, watch),
        default=wait,
    )


def trend_metrics(observations: DataFrame, sources: DataFrame, now: Column, scope: str = "silhouette") -> DataFrame:
    """Scores, stage, decision and confidence of every trend."""
    c = F.col
    out = evidence(eligible(dedupe_observations(observations, scope), sources), now)
    out = out.withColumns(strength_components())
    out = out.withColumn("strength", clamp(sum((c(k) * w for k, w in STRENGTH.items()), F.lit(0.0))))
    out = out.withColumns(momentum_components())
    out = out.withColumn("momentum", clamp(mean_of_known(c("change_30d"), c("change_90d"), c("brand_acquisition"), c("segment_transition"))))
    out = out.withColumn("momentum", F.when(F.coalesce("change_30d", "change_90d", "brand_acquisition", "segment_transition").isNotNull(), c("momentum")))
    out = out.withColumns(novelty_parts())
    out = out.withColumn("novelty", clamp(c("leader_early") * 0.3 + c("low_mass") * 0.3 + c("construction") * 0.2 + c("recency") * 0.2))
    out = out.withColumns(saturation_parts())
    out = out.withColumn("saturation", clamp(c("mass_saturation") * 0.28 + c("brand_penetration") * 0.22 + c("proliferation") * 0.18 + c("lifecycle") * 0.17 + c("plateau") * 0.1 + c("transitions") * 0.05))
    out = out.withColumn("opportunity", opportunity(c("strength"), c("momentum"), c("novelty"), c("saturation")))
    out = out.withColumn("stage", stage(c("strength"), c("momentum"), c("novelty"), c("saturation"), F.coalesce("mass", F.lit(False))))
    out = out.withColumn("decision", decision(c("strength"), c("momentum"), c("novelty"), c("saturation"), c("opportunity"), c("units"), c("source_quality"), c("leader_score"), c("stage")))
    return out.withColumn("confidence_score", clamp(c("strength") * 0.5 + clamp(c("n") / 8.0 * 100.0) * 0.25 + clamp(c("units") / 6.0 * 100.0) * 0.25))
