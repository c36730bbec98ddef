"""Trend queries over order lines: trend = part type or name, source = supplier, segment = market segment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.expr import half_up
from trendloom.operators import trend as T

NOW = "2001-06-30 00:00:00"
#: A trend of its own for each name and size: many thin ones, where scores do not reach their limits.
MODEL = "p_name || '-' || p_size"
ROLES = ("LEADER", "EARLY_ADOPTER", "MARKET", "RETAIL", "SOCIAL", "PRODUCTION_SIGNAL")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("source_id"), F.greatest(F.lit(0), F.col("s_acctbal") / 10000).cast("decimal(10,4)").alias("weight"), role.alias("role"), (F.col("s_acctbal") > 0).alias("is_active"))


def observations(spark: SparkSession, sf: str, trend: str = "p_type", since: str | None = None) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_shipdate")
    if since:
        lines = lines.filter(F.col("l_shipdate") >= F.lit(since).cast("timestamp"))
    orders = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    customers = read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    nations = read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    parts = read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size")
    joined = lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(nations, "c_nationkey").join(parts, "l_partkey")
    segment = F.array_position(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), F.col("c_mktsegment")) - 1
    return joined.select(
        F.expr(trend).alias("trend"),
        F.col("l_suppkey").alias("source_id"),
        F.col("p_brand").alias("brand"),
        F.lit(None).cast("string").alias("corporate_group"),
        F.col("p_name").alias("model_family"),
        F.col("p_size").cast("string").alias("color"),
        F.col("p_type").alias("material"),
        F.col("l_orderkey").cast("string").alias("publication"),
        F.col("n_name").alias("country"),
        (F.lit(1) - F.col("l_discount")).cast("decimal(10,4)").alias("confidence"),
        F.when(segment >= 0, segment.cast("int")).alias("segment"),
        F.concat_ws("|", F.col("p_type"), F.col("p_size").cast("string")).alias("signature"),
        F.least("o_orderdate", "l_shipdate").alias("first_seen"),
        F.col("l_shipdate").alias("observed_at"),
    )


def _now():
    return F.lit(NOW).cast("timestamp")


def _eligible(spark, sf, **k):
    return T.eligible(T.dedupe_observations(observations(spark, sf, **k)), sources(spark, sf))


SCORES = ("strength", "momentum", "novelty", "saturation", "opportunity", "confidence_score")


def _metrics(spark, sf, trend="p_type", since=None, scope="silhouette"):
    m = T.trend_metrics(observations(spark, sf, trend, since), sources(spark, sf), _now(), scope)
    return m


def trend_metrics(spark, sf, trend="p_type", since=None):
    m = _metrics(spark, sf, trend, since)
    return m.select("trend", F.col("n").alias("observations"), "units", *(half_up(c, 4).alias(c) for c in SCORES), "stage", "decision")


def strength_parts(spark, sf):
    m = _metrics(spark, sf)
    return m.select("trend", *(half_up(c, 4).alias(c) for c in T.STRENGTH))


def momentum_parts(spark, sf):
    m = _metrics(spark, sf, "p_name")
    return m.select("trend", *(half_up(c, 4).alias(c) for c in ("change_30d", "change_90d", "brand_acquisition", "segment_transition", "momentum")))


def novelty_parts(spark, sf):
    m = _metrics(spark, sf, MODEL)
    return m.select("trend", *(half_up(c, 4).alias(c) for c in ("leader_early", "low_mass", "construction", "recency", "novelty")))


def saturation_parts(spark, sf):
    m = _metrics(spark, sf, MODEL)
    return m.select("trend", *(half_up(c, 4).alias(c) for c in ("mass_saturation", "brand_penetration", "proliferation", "lifecycle", "plateau", "transitions", "saturation")))


def production_pressure(spark, sf):
    p = T.production_pressure(observations(spark, sf, MODEL), sources(spark, sf))
    return p.select("trend", "observations", "sources", "brands", half_up("pressure", 4).alias("pressure"))


def adoption_units(spark, sf, scope="silhouette"):
    d = T.dedupe_observations(observations(spark, sf), scope)
    return d.groupBy("trend").agg(F.count("*").alias("observations"), F.countDistinct("unit").alias("units"))


def source_quality(spark, sf):
    e = _eligible(spark, sf)
    return e.groupBy("role").agg(F.count("*").alias("n"), half_up(F.sum(F.col("confidence") * F.col("weight")).cast("double") / F.sum("weight").cast("double") * 100.0, 4).alias("quality"))


def _cte(trend: str = "p_type", since: str | None = None, scope: str = "") -> str:
    bound = f"WHERE l_shipdate >= TIMESTAMP '{since}'" if since else ""
    return f"""
src AS (SELECT s_suppkey AS source_id, greatest(0, s_acctbal / 10000)::DECIMAL(10,4) AS weight,
  ['LEADER','EARLY_ADOPTER','MARKET','RETAIL','SOCIAL','PRODUCTION_SIGNAL'][s_suppkey % 6 + 1] AS role, s_acctbal > 0 AS is_active FROM supplier),
obs AS (SELECT {trend} AS trend, l_suppkey AS source_id, p_brand AS brand, p_name AS family, p_size, l_orderkey AS publication, n_name AS country,
  (1 - l_discount)::DECIMAL(10,4) AS confidence, list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1 AS segment,
  p_type || '|' || p_size AS signature, least(o_orderdate, l_shipdate) AS first_seen, l_shipdate AS observed_at,
  lower(p_brand) || '::' || replace(lower(p_name), ' ', '-') {scope} AS unit
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey {bound}),
ded AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY trend, unit, source_id, publication ORDER BY confidence DESC, observed_at, first_seen, country, segment, signature) = 1),
el AS (SELECT ded.*, weight, role, epoch_us(TIMESTAMP '{NOW}') AS now_us, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(observed_at)) / 86400000000.0::DOUBLE AS age,
  (epoch_us(TIMESTAMP '{NOW}') - epoch_us(first_seen)) / 86400000000.0::DOUBLE AS first_age FROM ded JOIN src USING (source_id) WHERE is_active AND role <> 'PRODUCTION_SIGNAL')"""


def _metrics_cte(trend: str = "p_type", since: str | None = None) -> str:
    def acc(r: str, p: str) -> str:
        return f"CASE WHEN {r} = 0 AND {p} = 0 THEN 0.0 WHEN {p} = 0 THEN least(100, 50.0 + {r} * 10.0) WHEN {r} / {p} >= 2 THEN 100.0 WHEN {r} / {p} >= 1 THEN least(100.0, 50.0 + ({r} / {p} - 1.0) * 50.0) ELSE {r} / {p} * 50.0 END"

    return _cte(trend, since) + f""",
main AS (SELECT trend, count(*)::DOUBLE AS n, sum(confidence * weight)::DOUBLE AS weighed, sum(weight)::DOUBLE AS weights, count(DISTINCT country)::DOUBLE AS countries, count(DISTINCT unit)::DOUBLE AS units,
  count(DISTINCT signature)::DOUBLE AS signatures, coalesce(sum(confidence) FILTER (role = 'LEADER'), 0)::DOUBLE AS leader, coalesce(sum(confidence) FILTER (role IN ('MARKET','RETAIL')), 0)::DOUBLE AS validation,
  count(*) FILTER (role IN ('LEADER','EARLY_ADOPTER'))::DOUBLE AS early, sum(confidence * weight) FILTER (role IN ('LEADER','EARLY_ADOPTER'))::DOUBLE AS early_weighed,
  sum(epoch(first_seen)::BIGINT)::DOUBLE AS first_sum, max(age) AS oldest, min(age) AS newest,
  count(*) FILTER (age BETWEEN 0 AND 30)::DOUBLE AS r30, count(*) FILTER (age BETWEEN 30 AND 60)::DOUBLE AS w30, count(*) FILTER (age > 30 AND age <= 60)::DOUBLE AS p30,
  count(*) FILTER (age BETWEEN 0 AND 90)::DOUBLE AS r90, count(*) FILTER (age BETWEEN 90 AND 180)::DOUBLE AS w90, count(*) FILTER (age > 90 AND age <= 180)::DOUBLE AS p90 FROM el GROUP BY trend),
ent AS (SELECT trend, count(*)::DOUBLE AS brands, count(*) FILTER (r AND NOT p)::DOUBLE AS novel, count(*) FILTER (p)::DOUBLE AS prev FROM
  (SELECT trend, brand, bool_or(age BETWEEN 0 AND 30) AS r, bool_or(age BETWEEN 30 AND 60) AS p FROM el GROUP BY ALL) GROUP BY trend),
seg AS (SELECT trend, count(*)::DOUBLE AS segments, max(segment) AS highest, bool_or(segment = 4) AS mass, count(*) FILTER (du AND NOT be)::DOUBLE AS novel_segments FROM
  (SELECT trend, segment, bool_or(first_age BETWEEN 0 AND 90) AS du, bool_or(first_age > 90) AS be FROM el WHERE segment IS NOT NULL GROUP BY ALL) GROUP BY trend),
a AS (SELECT *, (epoch(TIMESTAMP '{NOW}') - first_sum / n) / 86400.0 AS mean_first_age, oldest - newest >= 60 AND n >= 3 AND (w30 > 0 OR w90 > 0) AS enough FROM main JOIN ent USING (trend) LEFT JOIN seg USING (trend)),
b AS (SELECT *, CASE WHEN weights > 0 THEN least(100.0, weighed / weights * 100.0) ELSE 0.0 END AS source_quality, least(100.0, brands / 10.0 * 100.0) AS brand_score, least(100.0, countries / 8.0 * 100.0) AS country_score,
  least(100.0, segments / 5.0 * 100.0) AS segment_score, least(100.0, leader / 5.0 * 100.0) AS leader_score, least(100.0, validation / 6.0 * 100.0) AS validation_score,
  CASE WHEN enough AND r30 > 0 AND w30 > 0 THEN {acc('r30', 'p30')} END AS change_30d, CASE WHEN enough AND r90 > 0 AND w90 > 0 THEN {acc('r90', 'p90')} END AS change_90d,
  CASE WHEN enough AND r30 > 0 THEN CASE WHEN w30 = 0 THEN CASE WHEN novel > 0 THEN least(100.0, 40.0 + novel * 15.0) END ELSE least(100.0, 30.0 + (CASE WHEN prev = 0 THEN novel ELSE novel / prev END) * 70.0) END END AS brand_acquisition,
  CASE WHEN enough AND r90 > 0 THEN CASE WHEN novel_segments = 0 THEN 20.0 ELSE least(100.0, 35.0 + novel_segments * 25.0) END END AS segment_transition,
  CASE WHEN early = 0 THEN 10.0 ELSE least(100.0, early_weighed / greatest(early, 1) * 70.0 + CASE WHEN early <= 3 THEN 25.0 WHEN early <= 5 THEN 10.0 ELSE 0.0 END) END AS leader_early,
  CASE WHEN mass THEN 15.0 WHEN highest <= 1 THEN 95.0 WHEN highest = 2 THEN 75.0 WHEN highest = 3 THEN 50.0 ELSE 30.0 END AS low_mass, least(100.0, 30.0 + signatures / units * 70.0) AS construction,
  CASE WHEN mean_first_age <= 45 THEN 95.0 WHEN mean_first_age <= 90 THEN 75.0 WHEN mean_first_age <= 180 THEN 50.0 ELSE 25.0 END AS recency FROM a),
c AS (SELECT *, source_quality * 0.17::DOUBLE + brand_score * 0.17::DOUBLE + country_score * 0.17::DOUBLE + segment_score * 0.17::DOUBLE + leader_score * 0.16::DOUBLE + validation_score * 0.16::DOUBLE AS strength,
  list_avg(list_filter([change_30d, change_90d, brand_acquisition, segment_transition]::DOUBLE[], lambda x: x IS NOT NULL)) AS momentum,
  leader_early * 0.3::DOUBLE + low_mass * 0.3::DOUBLE + construction * 0.2::DOUBLE + recency * 0.2::DOUBLE AS novelty, CASE WHEN mass THEN 90.0 ELSE 10.0 END AS mass_saturation, least(100.0, brands / 12.0 * 100.0) AS brand_penetration,
  least(100.0, units / 15.0 * 100.0) AS proliferation, CASE WHEN highest IS NULL THEN 0.0 ELSE least(100.0, (highest + 1) / 5.0 * 100.0) END AS lifecycle, least(100.0, greatest(0, segments - 1) * 12.0) AS transitions FROM b),
d AS (SELECT *, CASE WHEN momentum IS NULL THEN 20.0 WHEN momentum <= 25 THEN 80.0 WHEN momentum <= 45 THEN 55.0 WHEN momentum <= 60 THEN 30.0 ELSE 10.0 END AS plateau FROM c),
e AS (SELECT *, mass_saturation * 0.28::DOUBLE + brand_penetration * 0.22::DOUBLE + proliferation * 0.18::DOUBLE + lifecycle * 0.17::DOUBLE + plateau * 0.1::DOUBLE + transitions * 0.05::DOUBLE AS saturation FROM d),
f AS (SELECT *, greatest(0.0, least(100.0, (CASE WHEN momentum IS NULL THEN strength * 0.55::DOUBLE + novelty * 0.45::DOUBLE ELSE strength * 0.4::DOUBLE + momentum * 0.25::DOUBLE + novelty * 0.35::DOUBLE END) * (1.0 - (0.35::DOUBLE + saturation / 100.0 * 0.65::DOUBLE) * 0.75::DOUBLE))) AS opportunity,
  CASE WHEN saturation >= 78 OR (strength >= 70 AND saturation >= 65) THEN 'SATURATED' WHEN mass AND strength >= 55 AND (momentum IS NULL OR momentum < 55) THEN 'MAINSTREAM' WHEN strength >= 50 AND momentum >= 65 THEN 'ACCELERATING'
       WHEN strength >= 42 OR momentum >= 48 THEN 'RISING' WHEN novelty >= 55 AND strength < 42 THEN 'EARLY_SIGNAL' ELSE 'VERY_EARLY' END AS stage FROM e),
g AS (SELECT *, CASE WHEN saturation >= 70 OR (strength >= 65 AND saturation >= 55) OR stage IN ('SATURATED', 'MAINSTREAM') THEN 'GEÇ KALDIK'
  WHEN (strength >= 55 OR coalesce(momentum >= 60, false)) AND opportunity >= 55 AND saturation < 60 AND units >= 3 AND source_quality >= 35 THEN 'NUMUNEYE GİR'
  WHEN (novelty >= 65 AND strength < 50) OR (leader_score >= 50 AND novelty >= 60 AND strength < 55) OR (opportunity >= 35 AND opportunity < 55) THEN 'TAKİP ET'
  WHEN source_quality < 30 OR (strength < 30 AND units < 2) THEN 'BEKLE' WHEN opportunity >= 55 AND saturation < 60 THEN 'NUMUNEYE GİR' WHEN strength >= 45 THEN 'TAKİP ET' ELSE 'BEKLE' END AS decision,
  strength * 0.5::DOUBLE + least(100.0, n / 8.0 * 100.0) * 0.25::DOUBLE + least(100.0, units / 6.0 * 100.0) * 0.25::DOUBLE AS confidence_score FROM f)"""


def _r(*names: str) -> str:
    return ", ".join(f"floor({n}::DOUBLE * 10000.0 + 0.5) / 10000.0 AS {n}" for n in names)


def _metrics_sql(trend="p_type", since=None):
    return f"WITH {_metrics_cte(trend, since)} SELECT trend, n::BIGINT AS observations, units::BIGINT AS units, {_r(*SCORES)}, stage, decision FROM g"


QUERIES: dict[str, tuple[Callable, str]] = {
    "trend_metrics": (trend_metrics, _metrics_sql()),
    "trend_metrics_by_name": (lambda s, d: trend_metrics(s, d, "p_name"), _metrics_sql("p_name")),
    "trend_metrics_by_model": (lambda s, d: trend_metrics(s, d, MODEL), _metrics_sql(MODEL)),
    "strength_components": (strength_parts, f"WITH {_metrics_cte()} SELECT trend, {_r(*T.STRENGTH)} FROM g"),
    "momentum_components": (momentum_parts, f"WITH {_metrics_cte('p_name')} SELECT trend, {_r('change_30d', 'change_90d', 'brand_acquisition', 'segment_transition', 'momentum')} FROM g"),
    "novelty_components": (novelty_parts, f"WITH {_metrics_cte(MODEL)} SELECT trend, {_r('leader_early', 'low_mass', 'construction', 'recency', 'novelty')} FROM g"),
    "saturation_components": (saturation_parts, f"WITH {_metrics_cte(MODEL)} SELECT trend, {_r('mass_saturation', 'brand_penetration', 'proliferation', 'lifecycle', 'plateau', 'transitions', 'saturation')} FROM g"),
    "production_pressure": (
        production_pressure,
        f"WITH {_cte(MODEL)} SELECT trend, count(*) AS observations, count(DISTINCT source_id) AS sources, count(DISTINCT brand) AS brands, floor(least(100.0, count(*) * 15 + sum(confidence * weight)::DOUBLE * 40) * 10000.0 + 0.5) / 10000.0 AS pressure FROM obs JOIN src USING (source_id) WHERE is_active AND role = 'PRODUCTION_SIGNAL' GROUP BY trend",
    ),
    "adoption_units": (adoption_units, f"WITH {_cte()} SELECT trend, count(*) AS observations, count(DISTINCT unit) AS units FROM ded GROUP BY trend"),
    "adoption_units_color": (lambda s, d: adoption_units(s, d, "color"), f"""WITH {_cte(scope="|| '::color::' || p_size")} SELECT trend, count(*) AS observations, count(DISTINCT unit) AS units FROM ded GROUP BY trend"""),
    "source_quality": (source_quality, f"WITH {_cte()} SELECT role, count(*) AS n, floor(sum(confidence * weight)::DOUBLE / sum(weight)::DOUBLE * 100.0 * 10000.0 + 0.5) / 10000.0 AS quality FROM el GROUP BY role"),
}
