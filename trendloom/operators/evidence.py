"""Evidence about brands' own shops: what may be staged, what an adapter has to solve, what is reviewed; which brands are
collected by machine; which are read again; and which proposals of the vision model are taken over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.expr import half_up, is_strict_iso, ladder
from trendloom.functions.names import without_marks

# The drop in per cent from the last good catalog that is still believed.
MOST_DROP = 40.0


def source_slug(c: Column) -> Column:
    """Letters and digits without marks, lower case, dashes between."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(without_marks(F.coalesce(c, F.lit(""))))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _count_ok(c: str) -> Column:
    return F.coalesce((F.col(c) >= 0) & (F.col(c) == F.floor(F.col(c))), F.lit(False))


def blocker(most_drop: float = MOST_DROP) -> Column:
    """The first thing against a successful attempt. Columns of `plan`, `was_collected` of the last good state."""
    c, no = F.col, lambda x: ~F.coalesce(x, F.lit(False))
    blank = lambda name: F.trim(F.coalesce(c(name), F.lit(""))) == ""
    return ladder(
        (no(is_strict_iso("attempted_at")), "INVALID_ATTEMPTED_AT"),
        (no(c("source_url").rlike(r"(?i)^https://[^/?#\s]+")), "OFFICIAL_URL_MUST_BE_HTTPS"),
        (blank("snapshot_id"), "MISSING_SNAPSHOT_ID"),
        (blank("product_snapshot_id"), "MISSING_PRODUCT_SNAPSHOT_ID"),
        (c("snapshot_id") != c("product_snapshot_id"), "SNAPSHOT_BINDING_MISMATCH"),
        (no(c("women_only")), "WOMENS_FOOTWEAR_SCOPE_NOT_VERIFIED"),
        (no(_count_ok("source_total")), "SOURCE_TOTAL_NOT_VERIFIED"),
        (no(_count_ok("collected")), "INVALID_COLLECTED_COUNT"),
        ((c("source_total") == 0) | (c("collected") != c("source_total")), "FULL_CATALOG_COVERAGE_NOT_VERIFIED"),
        (drop_percent() > most_drop, "CATASTROPHIC_CATALOG_DROP"),
        (no(_count_ok("gallery")), "INVALID_GALLERY_COUNT"),
        (c("gallery") != c("collected"), "GALLERY_QA_INCOMPLETE"),
        (no(c("taxonomy_ok")), "TAXONOMY_QA_FAILED"),
    )


def drop_percent() -> Column:
    """How many per cent fewer than the last good catalog; null without one."""
    was = F.col("was_collected")
    return F.when((was > 0) & _count_ok("collected"), half_up((was - F.col("collected")) / was * 100, 2))


def plan(evidence: DataFrame, last_good: DataFrame, most_drop: float = MOST_DROP) -> DataFrame:
    """Every attempt with its queue (STAGING, ADAPTER, REVIEW or REJECTED), state, reason, coverage, missing and drop.

    evidence: number (the order of attempts), brand, slug, source_slug, source_scope, status, attempted_at, custom_adapter, blocker
    and what `blocker` reads; last_good: slug, source_slug, collected. Attempts without a slug, a source or an instant, of
    other than official shops, and all of a brand but the latest (the first of equal times) are rejected. A last good
    state without slugs is none; of several of a slug the largest source slug counts.
    """
    c = F.col
    named = evidence.withColumns({"slug": source_slug(F.when(c("slug") != "", c("slug")).otherwise(c("brand"))), "source_slug": source_slug(c("source_slug"))})
    bad = ladder((c("slug") == "", "INVALID_BRAND_SLUG"), (c("source_slug") == "", "INVALID_SOURCE_SLUG"), (~F.coalesce(is_strict_iso("attempted_at"), F.lit(False)), "INVALID_ATTEMPTED_AT"), (F.coalesce(c("source_scope") != "OFFICIAL_BRAND", F.lit(True)), "NON_OFFICIAL_SOURCE"))
    named = named.withColumn("bad", bad)
    # strict instants sort as texts; min_by pre-aggregates, so a brand with many attempts is one row per task
    newest = named.filter(c("bad").isNull()).groupBy("slug").agg(F.max_by("number", F.struct("attempted_at", -c("number"))).alias("latest"))
    good = last_good.withColumns({"slug": source_slug(c("slug")), "good_source": source_slug(c("source_slug"))}).filter("slug <> '' and good_source <> ''")
    good = good.groupBy("slug").agg(F.max_by("collected", F.struct("good_source", "collected")).alias("was_collected")).withColumn("has_good", F.lit(True))
    rows = named.join(newest, "slug", "left").join(good, "slug", "left")
    bad = F.coalesce("bad", F.when(c("latest") != c("number"), "SUPERSEDED_ATTEMPT"))
    against = blocker(most_drop)
    failed = F.coalesce(c("status") != "SUCCEEDED", F.lit(True))
    queue = ladder((bad.isNotNull(), "REJECTED"), (F.coalesce("custom_adapter", F.lit(False)), "ADAPTER"), (failed | against.isNotNull(), "REVIEW"), default="STAGING")
    reason = F.when(bad.isNotNull(), bad).when(F.coalesce("custom_adapter", F.lit(False)), F.coalesce("blocker", F.lit("CUSTOM_ADAPTER_REQUIRED"))).when(failed, F.coalesce("blocker", F.concat(F.lit("REFRESH_"), "status"))).otherwise(against)
    has = F.coalesce("has_good", F.lit(False))
    out = rows.withColumns({"queue": queue, "reason": reason})
    state = ladder((c("queue") == "STAGING", "STAGING_READY"), (c("queue") == "ADAPTER", "CUSTOM_ADAPTER_REQUIRED"), (c("queue") == "REVIEW", F.when(has, "LAST_GOOD_RETAINED").otherwise("BLOCKED")))
    kept = c("queue") != "REJECTED"
    return out.withColumns({"state": state, "coverage": F.when(kept & (c("source_total") > 0), c("collected") / c("source_total")), "missing": F.when(kept, F.greatest(F.lit(0), c("source_total") - c("collected"))), "drop": F.when(kept, drop_percent()), "retained": kept & has & (c("queue") != "STAGING")})


def https_url(c: Column) -> Column:
    """Scheme, host and path of a secure URL, without a slash at the end; null for any other."""
    parts = F.regexp_extract(c, r"(?i)^https://([^/?#\s]+)([^?#\s]*)", 0)
    host = F.lower(F.regexp_extract(c, r"(?i)^https://([^/?#\s]+)", 1))
    path = F.regexp_extract(c, r"(?i)^https://[^/?#\s]+([^?#\s]*)", 1)
    return F.when(parts != "", F.concat(F.lit("https://"), host, F.regexp_replace(path, "/$", "")))


def automation_plan(universe: DataFrame, queue: DataFrame, adapters: DataFrame, last_good: DataFrame, limit: int | None = None, refresh_only: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """Brands that are collected by machine, in order (`place`), and those skipped, with the reason: slug, origin, url, place, reason.

    A brand with a last good state must be active, ready and of a public shop; an approved queue entry must be in the
    universe, with an approved adapter that a machine can run. Approved entries come first, then by slug; a brand that both
    give is a refresh. universe: slug, brand, url, active, collection_status, collector; queue: slug, status, url; adapters: slug,
    strategy, adapter_url; last_good: slug. Slugs are unique in each.
    """
    c, f = F.col, F.lit(False)
    good = universe.join(last_good.select("slug").distinct(), "slug")
    reason = ladder(
        (~F.coalesce("active", f) | ~F.coalesce(c("collection_status") == "READY_AUTOMATIC", f), "LAST_GOOD_SOURCE_NOT_ACTIVE_AND_READY"),
        (~F.coalesce(c("collector") == "SHOPIFY_PUBLIC", f), "COLLECTOR_NOT_SUPPORTED_BY_AUTOMATION"),
        (https_url(c("url")).isNull(), "VALID_HTTPS_OFFICIAL_URL_REQUIRED"),
    )
    first = good.select("slug", "brand", F.lit("LAST_GOOD").alias("origin"), https_url(c("url")).alias("url"), reason.alias("reason"))
    waiting = queue.filter(c("status").isin("READY", "ACTIVE")).select("slug", c("url").alias("queued_url")).join(first.filter(c("reason").isNull()).select("slug"), "slug", "left_anti")
    known = universe.select("slug", "brand", "active", F.lit(True).alias("in_universe"))
    asked = waiting.join(known, "slug", "left").join(adapters.select("slug", "strategy", "adapter_url", F.lit(True).alias("has_adapter")), "slug", "left")
    url = https_url(F.when(c("adapter_url") != "", c("adapter_url")).otherwise(c("queued_url")))
    reason = ladder(
        (c("in_universe").isNull(), "UNIVERSE_ENTRY_REQUIRED"),
        (F.lit(refresh_only) & ~F.coalesce("active", f), "REFRESH_ONLY_SOURCE_NOT_ACTIVE"),
        (c("has_adapter").isNull(), "APPROVED_ADAPTER_REQUIRED"),
        (~F.coalesce(c("strategy") == "shopify-public", f), "APPROVED_ADAPTER_NOT_YET_AUTOMATABLE"),
        (url.isNull(), "VALID_HTTPS_OFFICIAL_URL_REQUIRED"),
    )
    second = asked.select("slug", "brand", F.lit("APPROVED_QUEUE").alias("origin"), url.alias("url"), reason.alias("reason"))
    rows = first.unionByName(second)
    wanted = {x.strip().lower() for x in only} - {""}
    chosen = rows.filter(c("reason").isNull())
    if wanted:
        chosen = chosen.filter(c("slug").isin(*wanted) | F.lower("brand").isin(*wanted))
    # brands are few; places beyond the limit are cut before numbering where there is one
    order = [F.when(c("origin") == "APPROVED_QUEUE", 0).otherwise(1), c("slug")]
    chosen = chosen.orderBy(*order).limit(limit) if limit is not None else chosen
    placed = chosen.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
    skipped = rows.filter(c("reason").isNotNull()).withColumn("place", F.lit(None).cast("long"))
    return placed.unionByName(skipped).select("slug", "origin", "url", "place", "reason")


# What a brand's catalog must have; a brand that is always read again.
LEAST_COVERAGE, FEW_CATEGORIES, MANY_PRODUCTS, FEW_IMAGES, MOST_SINGLE = 40.0, 2, 80, 2.0, 0.6
ALWAYS_AGAIN = ("jeffrey-campbell",)


def needs_categories() -> Column:
    """Columns: brand, products, coverage_percent, specific_categories."""
    c = F.col
    again = c("brand").isin(*ALWAYS_AGAIN) | (c("coverage_percent") < LEAST_COVERAGE) | ((c("specific_categories") <= FEW_CATEGORIES) & (c("products") >= MANY_PRODUCTS))
    return F.coalesce((c("products") > 0) & again, F.lit(False))


def needs_images() -> Column:
    """Columns: products, average_images, single_image (products with one image)."""
    c = F.col
    return F.coalesce((c("products") > 0) & (c("average_images") < FEW_IMAGES) & (c("single_image") / F.nullif(c("products"), F.lit(0)) > MOST_SINGLE), F.lit(False))


# Confidence of an accepted proposal, fields that are never proposed, sources that are not overruled.
ACCEPTED, BLOCKED_FIELDS = 0.85, ("heelHeightMm",)
PROTECTED_SOURCES = ("PRODUCT_PAGE", "STRUCTURED_DATA", "PRODUCT_TEXT", "COLLECTION_TAG")
# The values that a field can take; other fields take capitals, digits, dashes below and pluses.
FIELD_VALUES = {
    "toeShape": ("POINTED", "ALMOND", "ROUND", "SQUARE", "CHISEL"),
    "toeLength": ("SHORT", "STANDARD", "ELONGATED"),
    "toeOpening": ("CLOSED", "PEEP", "OPEN"),
    "backConstruction": ("CLOSED", "SLINGBACK", "BACKLESS"),
    "vampHeight": ("LOW", "STANDARD", "HIGH"),
    "heelHeightClass": ("FLAT", "LOW", "MID", "HIGH"),
    "heelType": ("NONE", "KITTEN", "STILETTO", "BLOCK", "CONE", "FLARED", "SCULPTURAL", "WEDGE", "CUBAN", "OTHER"),
    "soleProfile": ("THIN", "STANDARD", "CHUNKY", "LUGGED"),
    "platformConstruction": ("NONE", "FRONT_PLATFORM", "FULL_PLATFORM", "FLATFORM"),
    "sideConstruction": ("FULL_SIDE", "DORSAY", "CUTOUT"),
    "shaftHeight": ("ANKLE", "MID_CALF", "KNEE_HIGH", "OVER_THE_KNEE"),
    "shaftFit": ("TIGHT", "REGULAR", "WIDE", "SLOUCHY"),
    "sneakerHeight": ("LOW_TOP", "MID_TOP", "HIGH_TOP"),
    "panelComplexity": ("MINIMAL", "MODERATE", "COMPLEX"),
    "outsoleVisualWeight": ("LIGHT", "STANDARD", "HEAVY"),
    "lacingConstruction": ("OXFORD", "DERBY", "MONK", "OTHER"),
    "broguingLevel": ("NONE", "SEMI", "FULL"),
    "baseConstruction": ("WOOD", "EVA", "RUBBER", "MOLDED", "OTHER"),
    "espadrilleSoleHeight": ("FLAT", "WEDGE", "PLATFORM"),
    "hardwareIntensity": ("MINIMAL", "MODERATE", "STATEMENT"),
}


def proposal_rejection() -> Column:
    """Why a proposed feature is not taken over, the first reason; null if it is. Columns: field, value, confidence, and of the
    feature that is there status and source."""
    c = F.col
    listed = F.create_map(*[x for field, values in FIELD_VALUES.items() for x in (F.lit(field), F.array(*map(F.lit, values)))])
    allowed = F.coalesce(F.array_contains(F.element_at(listed, c("field")), c("value")), c("value").rlike("^[A-Z0-9_+]+$"))
    known = F.coalesce(c("status") == "KNOWN", F.lit(False))
    return ladder(
        (c("field").isin(*BLOCKED_FIELDS), "blocked-field"),
        ((F.coalesce("value", F.lit("")) == "") | F.coalesce(c("confidence") < ACCEPTED, F.lit(True)), "low-confidence"),
        (~allowed, "invalid-enum"),
        (known & c("source").isin(*PROTECTED_SOURCES), "protected-source"),
        (known & (c("source") == "DERIVED"), "deterministic-derived"),
        (known, "already-known"),
        (c("status") == "NOT_APPLICABLE", "not-applicable"),
    )
