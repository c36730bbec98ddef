"""Ladders: verdicts by the first condition that fails, decisions about publishing, states of features and tasks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.expr import half_up, ladder


def coverage_of(total: Column, collected: Column) -> Column:
    """Percent of a stated total, to two decimals; null if none is stated."""
    return F.when(total.isNull(), None).when(total == 0, 0.0).otherwise(half_up(collected / total * 100.0, 2))


def full_catalog_blocker() -> Column:
    """Why a catalog is not proven whole, null if it is. Columns: sample_only, scope_ok, exhausted, total, collected,
    taxonomy_ok, galleries."""
    c = F.col
    return ladder(
        (c("sample_only"), "SAMPLE_NOT_FULL_CATALOG"),
        (~c("scope_ok"), "WOMENS_FOOTWEAR_SCOPE_NOT_VERIFIED"),
        (~c("exhausted"), "PAGINATION_NOT_EXHAUSTED"),
        (c("total").isNull(), "SOURCE_TOTAL_NOT_VERIFIED"),
        (c("total") <= 0, "EMPTY_CATALOG"),
        (c("collected") != c("total"), "FULL_CATALOG_COVERAGE_NOT_VERIFIED"),
        (~c("taxonomy_ok"), "TAXONOMY_QA_FAILED"),
        (c("galleries") != c("collected"), "GALLERY_QA_INCOMPLETE"),
    )


def assess_storefront() -> tuple[Column, Column]:
    """Status and blocker of one storefront. Columns: blocked, errors, urls, total, exhausted, accepted, quarantined,
    incomplete, no_gallery, new."""
    c = F.col
    rungs = (
        (c("blocked"), "BLOCKED", "OFFICIAL_STOREFRONT_BLOCKED"),
        ((c("errors") > 0) & (c("urls") == 0), "FAILED", "SOURCE_REQUEST_FAILED"),
        (c("total").isNull(), "PARTIAL", "SOURCE_TOTAL_UNKNOWN"),
        (~c("exhausted"), "PARTIAL", "PAGINATION_NOT_EXHAUSTED"),
        (c("urls") != c("total"), "PARTIAL", "SOURCE_TOTAL_NOT_RECONCILED"),
        (c("accepted") + c("quarantined") != c("urls"), "PARTIAL", "SCOPE_URLS_NOT_CLASSIFIED"),
        (c("incomplete") > 0, "PARTIAL", "INCOMPLETE_PRODUCT_RECORDS"),
        (c("no_gallery") > 0, "PARTIAL", "GALLERY_OR_SKU_INCOMPLETE"),
        (c("new") > 0, "PARTIAL", "BASELINE_MARKED_NEW"),
        (c("errors") > 0, "PARTIAL", "PAGE_ERRORS"),
    )
    return ladder(*[(t, s) for t, s, _ in rungs], default="FULL"), ladder(*[(t, b) for t, _, b in rungs])


def publish_decision(status: Column, accepted: Column, previous: Column, share: float = 0.6) -> tuple[Column, Column]:
    """Whether to publish, and what stands against it; a previous state is retained then."""
    dropped = (F.coalesce(previous, F.lit(0)) > 0) & (accepted < previous * share)
    blocker = ladder((status != "FULL", status), (accepted == 0, "EMPTY_OR_FAILED_COLLECT"), (dropped, "CATASTROPHIC_CATALOG_DROP"))
    return blocker.isNull(), blocker


def country_refresh(candidates: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """For each candidate: PUBLISH if its coverage is complete, KEEP_LAST_GOOD if not and there is a previous state, else
    DROP. Columns: status, total, excluded, collected."""
    stated = lambda c: F.when(F.col("total").isNotNull(), c)
    expected = stated(F.greatest(F.lit(0), F.col("total") - F.greatest(F.lit(0), F.coalesce("excluded", F.lit(0)))))
    missing = stated(F.greatest(F.lit(0), expected - F.greatest(F.lit(0), F.col("collected"))))
    complete = (F.col("status") == "source_unavailable") | ((F.col("status") == "ok") & F.coalesce(missing == 0, F.lit(False)))
    percent = F.when(expected.isNull(), None).when(expected == 0, 100.0).otherwise(F.least(F.lit(100.0), half_up(F.col("collected") / expected * 100.0, 2)))
    known = previous.select(key).distinct().withColumn("was", F.lit(True))
    out = candidates.join(known, key, "left").withColumns({"missing": missing, "percent": percent, "complete": complete})
    return out.withColumn("decision", ladder((F.col("complete"), "PUBLISH"), (F.col("was"), "KEEP_LAST_GOOD"), default="DROP")).drop("was")


def registry_errors(brands: DataFrame, sources: DataFrame) -> DataFrame:
    """What is wrong in a registry, a row for each fault: ids that repeat, names that are empty, weights out of range,
    sources of brands that do not exist. brands: id, name, weight; sources: id, brand."""
    repeated = lambda t, what: t.groupBy("id").count().filter("count > 1").select(F.lit(f"DUPLICATE_{what}").alias("error"), F.col("id"))
    empty = brands.filter(F.coalesce(F.trim("name"), F.lit("")) == "").select(F.lit("EMPTY_NAME").alias("error"), "id")
    weights = brands.filter(~F.coalesce(F.col("weight").between(0, 1), F.lit(False))).select(F.lit("WEIGHT_OUT_OF_RANGE").alias("error"), "id")
    orphans = sources.join(brands.select(F.col("id").alias("brand")).distinct(), "brand", "left_anti").select(F.lit("UNKNOWN_BRAND").alias("error"), "id")
    return repeated(brands, "BRAND").unionByName(repeated(sources, "SOURCE")).unionByName(empty).unionByName(weights).unionByName(orphans)


def replace_verified(old: DataFrame, new: DataFrame, key: str, preserve_missing: bool) -> DataFrame:
    """A verified catalog takes the place of the old one; rows that it lacks stay only if asked for."""
    kept = old.join(new.select(key), key, "left_anti").withColumn("kept", F.lit(True))
    fresh = new.withColumn("kept", F.lit(False))
    return fresh.unionByName(kept) if preserve_missing else fresh


# Words for the stages and windows of a trend.
STATUS_OF_STAGE = {"ACCELERATING": "HIZLANIYOR", "RISING": "YÜKSELİYOR", "EARLY_SIGNAL": "ERKEN SİNYAL", "VERY_EARLY": "ERKEN SİNYAL", "MAINSTREAM": "ANA AKIM", "SATURATED": "DOYGUN"}
LEGACY_WEIGHTS = {"source_quality": 0.15, "brand_score": 0.15, "country_score": 0.15, "change_30d": 0.15, "change_90d": 0.1, "leader_score": 0.15, "validation_score": 0.15}


def trend_words(metrics: DataFrame) -> DataFrame:
    """Adds status, window and evidence in words to rows of trend metrics."""
    c = F.col
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_OF_STAGE.items() for x in pair]), c("stage")), F.lit("YÜKSELİYOR"))
    window = ladder(
        (c("saturation") >= 70, "Doygun"),
        (c("opportunity") >= 65, "En İyi Giriş Zamanı"),
        (c("opportunity") >= 50, "Üretime Aday"),
        ((c("novelty") >= 65) & (c("strength") < 45), "Çok Erken"),
        (c("momentum").isNotNull() & (c("momentum") >= 60), "Hızlanıyor"),
        (c("stage") == "MAINSTREAM", "Ana Akım"),
        default="Doygun",
    )
    composite = c("units") * 12 + c("source_quality") * 0.4
    return metrics.withColumns({"status": status, "window": window, "evidence": ladder((composite >= 55, "yüksek"), (composite >= 30, "orta"), default="düşük")})


def legacy_score() -> Column:
    """The weighted mean of the first scoring; components without a history count zero."""
    total = sum(LEGACY_WEIGHTS.values())
    parts = [F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in LEGACY_WEIGHTS.items()]
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), sum(parts[1:], parts[0]) / total))


# A feature is used by the radar from here on, and is uncertain down to there; pairs that exclude each other.
USABLE, UNCERTAIN, CERTAIN = 85, 60, 85
EXCLUSIVE = (("openToe", "closedToe"), ("backless", "closedBack"))


def contradictions(features: DataFrame, item: str) -> DataFrame:
    """Items with two features that exclude each other, both surely seen. Rows: item, feature, value, confidence."""
    sure = features.filter((F.col("value") == "YES") & (F.col("confidence") >= CERTAIN))
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col("feature").isin(*p).alias("of")) for i, p in enumerate(EXCLUSIVE)]))
    each = sure.select(item, "feature", pair.alias("p")).filter("p.of").groupBy(item, F.col("p.pair").alias("pair")).agg(F.countDistinct("feature").alias("n"))
    return each.filter("n = 2").select(item, "pair")


def usability(features: DataFrame, item: str) -> DataFrame:
    """Each feature after the verifier (rejected: NO) and the exclusions: its usability and whether the radar may use it."""
    against = contradictions(features, item)
    names = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in EXCLUSIVE]), F.col("pair") + 1)
    marked = against.select(item, F.explode(names).alias("feature")).distinct().withColumn("contradicts", F.lit(True))
    out = features.join(marked, [item, "feature"], "left")
    value = F.when(F.col("verifier") == "REJECTED", "NO").otherwise(F.col("value"))
    status = ladder((F.col("contradicts"), "CONTRADICTION"), (F.col("confidence") >= USABLE, "RADAR_ELIGIBLE"), (F.col("confidence") >= UNCERTAIN, "VISION_UNCERTAIN"), default="NOT_USABLE_FOR_RADAR")
    out = out.withColumns({"value": value, "usability": status}).drop("contradicts")
    return out.withColumn("eligible", (F.col("value") == "YES") & (F.col("usability") == "RADAR_ELIGIBLE") & (F.col("verifier") == "VERIFIED"))


def next_state(state: Column, event: Column, transitions: Mapping[tuple[str, str], str]) -> Column:
    """The state after an event; null where the event is not allowed."""
    known = F.create_map(*[F.lit(x) for (s, e), to in transitions.items() for x in (f"{s}>{e}", to)])
    return F.element_at(known, F.concat(state, F.lit(">"), event))
