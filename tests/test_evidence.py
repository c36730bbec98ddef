"""Rungs of the evidence ladder, the automation plan and the vision proposals, case by case."""

import pytest

from trendloom.operators import evidence as Z

NAMES = "number long, brand string, slug string, source_slug string, source_scope string, status string, attempted_at string, source_url string, snapshot_id string, product_snapshot_id string, women_only boolean, source_total long, collected long, gallery long, taxonomy_ok boolean, custom_adapter boolean, blocker string"
GOOD = dict(number=1, brand="Ana Bö", slug="", source_slug="ana", source_scope="OFFICIAL_BRAND", status="SUCCEEDED", attempted_at="2026-01-02T00:00:00.000Z", source_url="https://ana.com", snapshot_id="s", product_snapshot_id="s", women_only=True, source_total=60, collected=60, gallery=60, taxonomy_ok=True, custom_adapter=None, blocker=None)
CASES = [
    ({}, "STAGING", None),
    (dict(source_url="http://ana.com"), "REVIEW", "OFFICIAL_URL_MUST_BE_HTTPS"),
    (dict(source_url=None), "REVIEW", "OFFICIAL_URL_MUST_BE_HTTPS"),
    (dict(snapshot_id=" "), "REVIEW", "MISSING_SNAPSHOT_ID"),
    (dict(product_snapshot_id=None), "REVIEW", "MISSING_PRODUCT_SNAPSHOT_ID"),
    (dict(product_snapshot_id="t"), "REVIEW", "SNAPSHOT_BINDING_MISMATCH"),
    (dict(women_only=None), "REVIEW", "WOMENS_FOOTWEAR_SCOPE_NOT_VERIFIED"),
    (dict(source_total=None), "REVIEW", "SOURCE_TOTAL_NOT_VERIFIED"),
    (dict(collected=-1), "REVIEW", "INVALID_COLLECTED_COUNT"),
    (dict(collected=59), "REVIEW", "FULL_CATALOG_COVERAGE_NOT_VERIFIED"),
    (dict(source_total=0, collected=0, gallery=0), "REVIEW", "FULL_CATALOG_COVERAGE_NOT_VERIFIED"),
    (dict(source_total=59, collected=59, gallery=59), "REVIEW", "CATASTROPHIC_CATALOG_DROP"),
    (dict(gallery=-1), "REVIEW", "INVALID_GALLERY_COUNT"),
    (dict(gallery=4), "REVIEW", "GALLERY_QA_INCOMPLETE"),
    (dict(taxonomy_ok=False), "REVIEW", "TAXONOMY_QA_FAILED"),
    (dict(status="FAILED"), "REVIEW", "REFRESH_FAILED"),
    (dict(status="UNAVAILABLE", blocker="captcha"), "REVIEW", "captcha"),
    (dict(custom_adapter=True, status="FAILED"), "ADAPTER", "CUSTOM_ADAPTER_REQUIRED"),
    (dict(brand="--"), "REJECTED", "INVALID_BRAND_SLUG"),
    (dict(source_slug="-"), "REJECTED", "INVALID_SOURCE_SLUG"),
    (dict(attempted_at="2026-01-02"), "REJECTED", "INVALID_ATTEMPTED_AT"),
    (dict(source_scope="MARKETPLACE"), "REJECTED", "NON_OFFICIAL_SOURCE"),
]


@pytest.fixture(scope="module")
def planned(spark):
    rows = [tuple((GOOD | dict(number=i, brand=f"Ana Bö {i}") | change).values()) for i, (change, _, _) in enumerate(CASES)]
    late = [tuple((GOOD | dict(number=100 + i, brand="Two", attempted_at=f"2026-01-0{d}T00:00:00.000Z")).values()) for i, d in enumerate((2, 3, 3))]
    good = spark.createDataFrame([(f"ana-bo-{i}", "ana", 100) for i in range(len(CASES))] + [("x", "", 5)], "slug string, source_slug string, collected long")
    return {r.number: r for r in Z.plan(spark.createDataFrame(rows + late, NAMES), good).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_every_rung_is_reached(planned, case):
    _, queue, reason = CASES[case]
    got = planned[case]
    assert (got.queue, got.reason) == (queue, reason)
    assert got.retained == (queue in ("ADAPTER", "REVIEW")) and (got.state == "LAST_GOOD_RETAINED") == (queue == "REVIEW")


def test_the_latest_attempt_counts_and_the_first_of_equal_ones(planned):
    assert [planned[100 + i].reason for i in range(3)] == ["SUPERSEDED_ATTEMPT", None, "SUPERSEDED_ATTEMPT"] and planned[101].state == "STAGING_READY"
    assert planned[0].slug == "ana-bo-0" and planned[0].drop == 40.0 and planned[11].drop == 41.0 and planned[9].missing == 1


def test_proposals_give_the_first_reason(spark):
    rows = [("heelHeightMm", "55", 0.9, None, None), ("toeShape", "ROUND", 0.84, None, None), ("toeShape", "OVAL", 0.9, None, None), ("toeShape", "ROUND", 0.9, "KNOWN", "PRODUCT_TEXT"), ("toeShape", "ROUND", 0.9, "KNOWN", "DERIVED"), ("toeShape", "ROUND", 0.9, "KNOWN", "VISION"), ("toeShape", "ROUND", 0.9, "NOT_APPLICABLE", "UNKNOWN"), ("toeShape", "ROUND", 0.85, "UNKNOWN", "UNKNOWN"), ("x", "A_1+B", 1.0, None, None), ("x", "a", 1.0, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "field string, value string, confidence double, status string, source string")
    assert [r.r for r in frame.select(Z.proposal_rejection().alias("r")).collect()] == ["blocked-field", "low-confidence", "invalid-enum", "protected-source", "deterministic-derived", "already-known", "not-applicable", None, None, "invalid-enum", "low-confidence"]
