"""Ladders, delivery and coverage reports over the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from trendloom.operators import coverage as V
from trendloom.operators import delivery as D
from trendloom.operators import evidence as Z
from trendloom.operators import ladders as L
from trendloom.operators import merge as G
from trendloom.plans.market import _read, _ts
from trendloom.plans.scoped import _of
from trendloom.plans.trends import _metrics, _metrics_cte

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    """Register a function under its name with the SQL for it."""

    def add(run: Callable) -> Callable:
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


def _columns(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in exprs.items())


def _exprs(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in exprs.items()]


_CATALOG = {"id": "p_partkey", "sample_only": "p_size = 1", "scope_ok": "p_size <> 2", "exhausted": "p_size % 7 <> 0", "total": "CASE WHEN p_size % 11 <> 0 THEN p_size % 10 END", "collected": "CASE WHEN p_size > 40 THEN 1 ELSE p_size % 10 END", "taxonomy_ok": "p_size % 13 <> 0", "galleries": "CASE WHEN p_size % 17 = 0 THEN 0 ELSE p_size % 10 END"}


@query(f"""WITH c AS (SELECT {_columns(_CATALOG)} FROM part) SELECT id, CASE WHEN sample_only THEN 'SAMPLE_NOT_FULL_CATALOG' WHEN NOT scope_ok THEN 'WOMENS_FOOTWEAR_SCOPE_NOT_VERIFIED' WHEN NOT exhausted THEN 'PAGINATION_NOT_EXHAUSTED' WHEN total IS NULL THEN 'SOURCE_TOTAL_NOT_VERIFIED' WHEN total <= 0 THEN 'EMPTY_CATALOG' WHEN collected <> total THEN 'FULL_CATALOG_COVERAGE_NOT_VERIFIED' WHEN NOT taxonomy_ok THEN 'TAXONOMY_QA_FAILED' WHEN galleries <> collected THEN 'GALLERY_QA_INCOMPLETE' END AS blocker,
  CASE WHEN total = 0 THEN 0.0 ELSE floor(collected / total * 100.0 * 100.0 + 0.5) / 100.0 END::DOUBLE AS percent FROM c""")
def full_catalog_blockers(spark, sf):
    c = _of(spark, sf, "part", *_exprs(_CATALOG))
    return c.select("id", L.full_catalog_blocker().alias("blocker"), L.coverage_of(F.col("total"), F.col("collected")).alias("percent"))


_SHOP = {"id": "s_suppkey", "blocked": "s_suppkey % 19 = 0", "errors": "CASE WHEN s_suppkey % 6 = 0 THEN 2 ELSE 0 END", "urls": "s_suppkey % 8", "total": "CASE WHEN s_suppkey % 10 <> 9 THEN CASE WHEN s_suppkey % 7 = 0 THEN 99 ELSE s_suppkey % 8 END END", "exhausted": "s_suppkey % 11 <> 0", "accepted": "CASE WHEN s_suppkey % 8 > 3 THEN s_suppkey % 8 - 2 ELSE s_suppkey % 8 END", "quarantined": "CASE WHEN s_suppkey % 8 > 3 AND s_suppkey % 5 <> 0 THEN 2 ELSE 0 END", "incomplete": "CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END", "no_gallery": "CASE WHEN s_suppkey % 17 = 0 THEN 1 ELSE 0 END", "new": "CASE WHEN s_suppkey % 16 = 1 THEN 1 ELSE 0 END", "previous": "CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 20 END"}


@query(f"""
WITH c AS (SELECT {_columns(_SHOP)} FROM supplier),
b AS (SELECT *, CASE WHEN blocked THEN 'OFFICIAL_STOREFRONT_BLOCKED' WHEN errors > 0 AND urls = 0 THEN 'SOURCE_REQUEST_FAILED' WHEN total IS NULL THEN 'SOURCE_TOTAL_UNKNOWN' WHEN NOT exhausted THEN 'PAGINATION_NOT_EXHAUSTED' WHEN urls <> total THEN 'SOURCE_TOTAL_NOT_RECONCILED' WHEN accepted + quarantined <> urls THEN 'SCOPE_URLS_NOT_CLASSIFIED' WHEN incomplete > 0 THEN 'INCOMPLETE_PRODUCT_RECORDS' WHEN no_gallery > 0 THEN 'GALLERY_OR_SKU_INCOMPLETE' WHEN new > 0 THEN 'BASELINE_MARKED_NEW' WHEN errors > 0 THEN 'PAGE_ERRORS' END AS blocker FROM c),
s AS (SELECT *, CASE WHEN blocker IS NULL THEN 'FULL' WHEN blocked THEN 'BLOCKED' WHEN errors > 0 AND urls = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM b),
d AS (SELECT *, CASE WHEN status <> 'FULL' THEN status WHEN accepted = 0 THEN 'EMPTY_OR_FAILED_COLLECT' WHEN coalesce(previous, 0) > 0 AND accepted < previous * 0.6::DOUBLE THEN 'CATASTROPHIC_CATALOG_DROP' END AS stop FROM s)
SELECT id, status, blocker, stop IS NULL AS publish, stop FROM d""")
def storefront_assessment(spark, sf):
    c = _of(spark, sf, "supplier", *_exprs(_SHOP))
    status, blocker = L.assess_storefront()
    out = c.withColumns({"status": status, "blocker": blocker})
    publish, stop = L.publish_decision(F.col("status"), F.col("accepted"), F.col("previous"))
    return out.select("id", "status", "blocker", publish.alias("publish"), stop.alias("stop"))


_REFRESH = {"id": "s_suppkey", "status": "CASE s_suppkey % 5 WHEN 0 THEN 'source_unavailable' WHEN 1 THEN 'failed' ELSE 'ok' END", "total": "CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 30 END", "excluded": "CASE WHEN s_suppkey % 4 = 0 THEN 3 END", "collected": "s_suppkey % 30 - s_suppkey % 3"}


@query(f"""
WITH c AS (SELECT {_columns(_REFRESH)} FROM supplier), e AS (SELECT *, greatest(0, total - greatest(0, coalesce(excluded, 0))) AS expected FROM c), m AS (SELECT *, CASE WHEN total IS NOT NULL THEN greatest(0, expected - greatest(0, collected)) END AS missing FROM e)
SELECT id, missing, CASE WHEN total IS NULL THEN NULL WHEN expected = 0 THEN 100.0 ELSE least(100.0, floor(collected / expected * 100.0 * 100.0 + 0.5) / 100.0) END::DOUBLE AS percent,
  CASE WHEN status = 'source_unavailable' OR (status = 'ok' AND coalesce(missing = 0, false)) THEN 'PUBLISH' WHEN id % 2 = 0 THEN 'KEEP_LAST_GOOD' ELSE 'DROP' END AS decision FROM m""")
def country_refresh(spark, sf):
    c = _of(spark, sf, "supplier", *_exprs(_REFRESH))
    return L.country_refresh(c, c.filter("id % 2 = 0"), "id").select("id", "missing", "percent", "decision")


@query("""
WITH b AS (SELECT s_suppkey % 90 AS id, CASE WHEN s_suppkey % 21 = 0 THEN ' ' ELSE s_name END AS name, s_acctbal / 9000 AS weight FROM supplier), s AS (SELECT p_partkey AS id, p_partkey % 97 AS brand FROM part)
SELECT 'DUPLICATE_BRAND' AS error, id FROM b GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'EMPTY_NAME', id FROM b WHERE trim(name) = '' UNION ALL SELECT 'WEIGHT_OUT_OF_RANGE', id FROM b WHERE weight NOT BETWEEN 0 AND 1 UNION ALL SELECT 'UNKNOWN_BRAND', id FROM s WHERE brand NOT IN (SELECT id FROM b)""")
def registry_errors(spark, sf):
    brands = _of(spark, sf, "supplier", "s_suppkey % 90 AS id", "CASE WHEN s_suppkey % 21 = 0 THEN ' ' ELSE s_name END AS name", "s_acctbal / 9000 AS weight")
    return L.registry_errors(brands, _of(spark, sf, "part", "p_partkey AS id", "p_partkey % 97 AS brand"))


_NEED = {"id": "s_suppkey", "brand": "CASE WHEN s_suppkey % 40 = 7 THEN 'jeffrey-campbell' ELSE s_name END", "products": "s_suppkey % 7 * 30", "coverage_percent": "s_suppkey % 11 * 10.0", "specific_categories": "s_suppkey % 5", "average_images": "s_suppkey % 9 / 2.0", "single_image": "s_suppkey % 7 * (s_suppkey % 4) * 10"}


@query(f"WITH c AS (SELECT {_columns(_NEED)} FROM supplier) SELECT id, products > 0 AND (brand = 'jeffrey-campbell' OR coverage_percent < 40 OR (specific_categories <= 2 AND products >= 80)) AS categories, products > 0 AND average_images < 2 AND single_image > 0.6 * products AS images FROM c")
def recrawl_needs(spark, sf):
    return _of(spark, sf, "supplier", *_exprs(_NEED)).select("id", Z.needs_categories().alias("categories"), Z.needs_images().alias("images"))


_PROOF = {
    "number": "o_orderkey",
    "brand": "concat('Brand ', CAST(o_custkey % 400 AS STRING))",
    "slug": "CASE WHEN o_custkey % 31 = 0 THEN '--' WHEN o_custkey % 3 = 0 THEN '' ELSE concat(' Bränd_', CAST(o_custkey % 400 AS STRING), ' ') END",
    "source_slug": "CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE 'own shop' END",
    "source_scope": "CASE WHEN o_orderkey % 13 = 0 THEN 'MARKETPLACE' ELSE 'OFFICIAL_BRAND' END",
    "status": "CASE WHEN o_orderkey % 17 = 0 THEN 'FAILED' WHEN o_orderkey % 19 = 0 THEN 'UNAVAILABLE' ELSE 'SUCCEEDED' END",
    "attempted_at": "concat(CAST(1995 + o_orderkey % 7 AS STRING), '-0', CAST(1 + o_orderkey % 9 AS STRING), '-1', CAST(o_orderkey % 10 AS STRING), CASE WHEN o_orderkey % 53 = 0 THEN 'T00:00:00Z' ELSE 'T00:00:00.000Z' END)",
    "source_url": "concat(CASE WHEN o_custkey % 23 = 0 THEN 'http' ELSE 'https' END, '://shop/', CAST(o_custkey AS STRING))",
    "snapshot_id": "CASE WHEN o_custkey % 29 <> 0 THEN concat('s', CAST(o_orderkey AS STRING)) END",
    "product_snapshot_id": "CASE WHEN o_custkey % 37 = 0 THEN ' ' WHEN o_custkey % 41 = 0 THEN 's' ELSE concat('s', CAST(o_orderkey AS STRING)) END",
    "women_only": "o_custkey % 43 <> 0",
    "source_total": "CASE WHEN o_custkey % 47 = 0 THEN NULL WHEN o_custkey % 49 = 0 THEN 0 ELSE 10 + o_custkey % 90 END",
    "collected": "CASE WHEN o_custkey % 51 = 0 THEN -1 WHEN o_custkey % 7 = 0 THEN 3 WHEN o_custkey % 49 = 0 THEN 0 ELSE 10 + o_custkey % 90 END",
    "gallery": "CASE WHEN o_custkey % 57 = 0 THEN -5 WHEN o_custkey % 11 = 0 THEN 1 ELSE 10 + o_custkey % 90 END",
    "taxonomy_ok": "o_custkey % 5 <> 0",
    "custom_adapter": "o_custkey % 59 = 0",
    "blocker": "CASE WHEN o_custkey % 2 = 0 THEN 'captcha' END",
}
_GOOD = {"slug": "concat('brand ', CAST(c_custkey AS STRING))", "source_slug": "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'own-shop' END", "collected": "c_custkey % 200"}


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, e in columns.items())


@query(f"""
WITH raw AS (SELECT {_sql(_PROOF)} FROM orders), g AS (SELECT replace(slug, ' ', '-') AS slug, collected AS was FROM (SELECT {_sql(_GOOD)} FROM customer) WHERE source_slug <> ''),
n AS (SELECT * REPLACE (CASE WHEN slug = '--' THEN '' ELSE 'brand-' || regexp_extract(brand, '[0-9]+') END AS slug, trim(source_slug) AS source_slug) FROM raw),
a AS (SELECT *, CASE WHEN slug = '' THEN 'INVALID_BRAND_SLUG' WHEN source_slug = '' THEN 'INVALID_SOURCE_SLUG' WHEN attempted_at NOT LIKE '%.000Z' THEN 'INVALID_ATTEMPTED_AT' WHEN source_scope <> 'OFFICIAL_BRAND' THEN 'NON_OFFICIAL_SOURCE' END AS bad FROM n),
l AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN row_number() OVER (PARTITION BY slug, bad IS NULL ORDER BY attempted_at DESC, number) > 1 THEN 'SUPERSEDED_ATTEMPT' END AS rejected FROM a),
j AS (SELECT l.*, was, was IS NOT NULL AS has, CASE WHEN was > 0 AND collected >= 0 THEN floor((was - collected)::DOUBLE / was * 100 * 100 + 0.5) / 100 END AS fall FROM l LEFT JOIN g USING (slug)),
k AS (SELECT *, CASE WHEN source_url LIKE 'http:%' THEN 'OFFICIAL_URL_MUST_BE_HTTPS' WHEN snapshot_id IS NULL THEN 'MISSING_SNAPSHOT_ID' WHEN trim(product_snapshot_id) = '' THEN 'MISSING_PRODUCT_SNAPSHOT_ID' WHEN snapshot_id <> product_snapshot_id THEN 'SNAPSHOT_BINDING_MISMATCH' WHEN NOT women_only THEN 'WOMENS_FOOTWEAR_SCOPE_NOT_VERIFIED' WHEN source_total IS NULL THEN 'SOURCE_TOTAL_NOT_VERIFIED' WHEN collected < 0 THEN 'INVALID_COLLECTED_COUNT' WHEN source_total = 0 OR collected <> source_total THEN 'FULL_CATALOG_COVERAGE_NOT_VERIFIED' WHEN fall > 40 THEN 'CATASTROPHIC_CATALOG_DROP' WHEN gallery < 0 THEN 'INVALID_GALLERY_COUNT' WHEN gallery <> collected THEN 'GALLERY_QA_INCOMPLETE' WHEN NOT taxonomy_ok THEN 'TAXONOMY_QA_FAILED' END AS against FROM j),
q AS (SELECT *, CASE WHEN rejected IS NOT NULL THEN 'REJECTED' WHEN custom_adapter THEN 'ADAPTER' WHEN status <> 'SUCCEEDED' OR against IS NOT NULL THEN 'REVIEW' ELSE 'STAGING' END AS queue FROM k)
SELECT number, slug, queue, CASE queue WHEN 'STAGING' THEN 'STAGING_READY' WHEN 'ADAPTER' THEN 'CUSTOM_ADAPTER_REQUIRED' WHEN 'REVIEW' THEN CASE WHEN has THEN 'LAST_GOOD_RETAINED' ELSE 'BLOCKED' END END AS state,
  CASE WHEN rejected IS NOT NULL THEN rejected WHEN custom_adapter THEN coalesce(blocker, 'CUSTOM_ADAPTER_REQUIRED') WHEN status <> 'SUCCEEDED' THEN coalesce(blocker, 'REFRESH_' || status) ELSE against END AS reason,
  CASE WHEN queue <> 'REJECTED' AND source_total > 0 THEN collected::DOUBLE / source_total END AS coverage, CASE WHEN queue <> 'REJECTED' AND source_total IS NOT NULL THEN greatest(0, source_total - collected) END AS missing, CASE WHEN queue <> 'REJECTED' THEN fall END AS "drop", queue NOT IN ('REJECTED', 'STAGING') AND has AS retained FROM q""")
def evidence_queues(spark, sf):
    evidence, good = _of(spark, sf, "orders", *_exprs(_PROOF)), _of(spark, sf, "customer", *_exprs(_GOOD))
    out = Z.plan(evidence, good).withColumn("missing", F.when(F.col("source_total").isNotNull(), F.col("missing")))
    return out.select("number", "slug", "queue", "state", "reason", "coverage", F.col("missing").cast("long").alias("missing"), "drop", "retained")


@query("SELECT p_partkey, p_size, p_size <= 25 AS kept FROM part WHERE p_size > 25 OR p_partkey % 3 = 0")
def replaced_catalog(spark, sf):
    p = _of(spark, sf, "part", "p_partkey", "p_size")
    return L.replace_verified(p.filter("p_partkey % 3 = 0"), p.filter("p_size > 25"), "p_partkey", True)


@query(f"""WITH {_metrics_cte()} SELECT trend, CASE stage WHEN 'ACCELERATING' THEN 'HIZLANIYOR' WHEN 'RISING' THEN 'YÜKSELİYOR' WHEN 'MAINSTREAM' THEN 'ANA AKIM' WHEN 'SATURATED' THEN 'DOYGUN' ELSE 'ERKEN SİNYAL' END AS status,
  CASE WHEN saturation >= 70 THEN 'Doygun' WHEN opportunity >= 65 THEN 'En İyi Giriş Zamanı' WHEN opportunity >= 50 THEN 'Üretime Aday' WHEN novelty >= 65 AND strength < 45 THEN 'Çok Erken' WHEN momentum >= 60 THEN 'Hızlanıyor' WHEN stage = 'MAINSTREAM' THEN 'Ana Akım' ELSE 'Doygun' END AS "window",
  CASE WHEN units * 12 + source_quality * 0.4 >= 55 THEN 'yüksek' WHEN units * 12 + source_quality * 0.4 >= 30 THEN 'orta' ELSE 'düşük' END AS evidence,
  floor(least(100.0, greatest(0.0, (source_quality * 0.15 + brand_score * 0.15 + country_score * 0.15 + coalesce(change_30d, 0) * 0.15 + coalesce(change_90d, 0) * 0.1 + leader_score * 0.15 + validation_score * 0.15) / 1.0)) * 10000.0 + 0.5) / 10000.0 AS legacy FROM g""")
def trend_words(spark, sf):
    from trendloom.functions.expr import half_up

    return L.trend_words(_metrics(spark, sf)).select("trend", "status", "window", "evidence", half_up(L.legacy_score(), 4).alias("legacy"))


_LOOK = {"item": "l_orderkey", "feature": "CASE l_linenumber % 4 WHEN 0 THEN 'openToe' WHEN 1 THEN 'closedToe' WHEN 2 THEN 'backless' ELSE 'closedBack' END", "value": "CASE WHEN max(l_quantity) > 12 THEN 'YES' ELSE 'NO' END", "confidence": "CAST(max(l_quantity) * 2 AS INT)", "verifier": "CASE WHEN max(l_returnflag) = 'R' THEN 'REJECTED' WHEN max(l_returnflag) = 'N' THEN 'VERIFIED' ELSE 'NOT_ASKED' END"}
_LOOKS = f"c AS (SELECT {_columns(_LOOK)} FROM lineitem GROUP BY l_orderkey, 2), s AS (SELECT item, feature LIKE '%Toe' AS toe FROM c WHERE value = 'YES' AND confidence >= 85 GROUP BY ALL HAVING count(*) = 2)"


def _looks(spark, sf):
    rows = _of(spark, sf, "lineitem", "l_orderkey AS item", f"{_LOOK['feature']} AS feature", "l_quantity", "l_returnflag")
    return rows.groupBy("item", "feature").agg(*(F.expr(_LOOK[c]).alias(c) for c in ("value", "confidence", "verifier")))


@query(f"WITH {_LOOKS} SELECT item, CASE WHEN toe THEN 0 ELSE 1 END AS pair FROM s")
def contradictions(spark, sf):
    return L.contradictions(_looks(spark, sf), "item")


@query(f"""WITH {_LOOKS}, u AS (SELECT c.item, feature, CASE WHEN verifier = 'REJECTED' THEN 'NO' ELSE value END AS value, verifier, CASE WHEN s.item IS NOT NULL THEN 'CONTRADICTION' WHEN confidence >= 85 THEN 'RADAR_ELIGIBLE' WHEN confidence >= 60 THEN 'VISION_UNCERTAIN' ELSE 'NOT_USABLE_FOR_RADAR' END AS usability FROM c LEFT JOIN s ON s.item = c.item AND s.toe = (c.feature LIKE '%Toe'))
SELECT item, feature, value, usability, value = 'YES' AND usability = 'RADAR_ELIGIBLE' AND verifier = 'VERIFIED' AS eligible FROM u""")
def feature_usability(spark, sf):
    return L.usability(_looks(spark, sf), "item").select("item", "feature", "value", "usability", "eligible")


@query(f"WITH {_LOOKS} SELECT feature, count(*) FILTER (value = 'YES') AS asked, count(*) FILTER (value = 'YES' AND verifier = 'VERIFIED') AS verified, count(*) FILTER (value = 'YES' AND verifier = 'REJECTED') AS rejected, floor(count(*) FILTER (value = 'YES' AND verifier = 'REJECTED') / count(*) FILTER (value = 'YES') * 100.0 * 10.0 + 0.5) / 10.0 AS corrected_percent FROM c GROUP BY feature")
def verification_summary(spark, sf):
    return V.verification_summary(_looks(spark, sf), "feature")


_PROPOSAL = {
    "id": "p_partkey",
    "field": "element_at(array('toeShape', 'heelHeightMm', 'shaftFit', 'freeField', 'soleProfile'), CAST(p_size % 5 + 1 AS INT))",
    "value": "element_at(array('POINTED', 'THIN', 'WIDE', 'FREE_1+X', 'free', ''), CAST(p_partkey % 6 + 1 AS INT))",
    "confidence": "CASE WHEN p_partkey % 13 > 0 THEN 0.8 + (p_size % 4) * 0.05 END",
    "status": "element_at(array('KNOWN', 'UNKNOWN', 'NOT_APPLICABLE'), CAST(p_partkey % 3 + 1 AS INT))",
    "source": "element_at(array('PRODUCT_TEXT', 'DERIVED', 'VISION', 'COLLECTION_TAG'), CAST(p_size % 4 + 1 AS INT))",
}


@query("""
WITH c AS (SELECT p_partkey AS id, (['toeShape', 'heelHeightMm', 'shaftFit', 'freeField', 'soleProfile'])[p_size % 5 + 1] AS field, (['POINTED', 'THIN', 'WIDE', 'FREE_1+X', 'free', ''])[p_partkey % 6 + 1] AS value, p_partkey % 13 > 0 AND p_size % 4 > 0 AS sure, (['KNOWN', 'UNKNOWN', 'NOT_APPLICABLE'])[p_partkey % 3 + 1] AS status, (['PRODUCT_TEXT', 'DERIVED', 'VISION', 'COLLECTION_TAG'])[p_size % 4 + 1] AS source FROM part)
SELECT id, CASE WHEN field = 'heelHeightMm' THEN 'blocked-field' WHEN value = '' OR NOT sure THEN 'low-confidence' WHEN NOT CASE field WHEN 'toeShape' THEN value = 'POINTED' WHEN 'shaftFit' THEN value = 'WIDE' WHEN 'soleProfile' THEN value = 'THIN' ELSE value <> 'free' END THEN 'invalid-enum'
  WHEN status = 'KNOWN' THEN CASE WHEN source IN ('PRODUCT_TEXT', 'COLLECTION_TAG') THEN 'protected-source' WHEN source = 'DERIVED' THEN 'deterministic-derived' ELSE 'already-known' END WHEN status = 'NOT_APPLICABLE' THEN 'not-applicable' END AS reason FROM c""")
def proposal_rejections(spark, sf):
    return _of(spark, sf, "part", *_exprs(_PROPOSAL)).select("id", Z.proposal_rejection().alias("reason"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'RUNNING' WHEN o_orderstatus = 'P' THEN 'DONE' END AS next FROM orders")
def task_states(spark, sf):
    moves = {("O", "start"): "RUNNING", ("P", "start"): "DONE", ("P", "stop"): "DONE"}
    o = _of(spark, sf, "orders", "o_orderkey", "o_orderstatus", "CASE WHEN o_orderkey % 2 = 0 THEN 'start' ELSE 'stop' END AS event")
    return o.select("o_orderkey", L.next_state(F.col("o_orderstatus"), F.col("event"), moves).alias("next"))


_BRAND = {"slug": "concat('b', lpad(CAST(c_custkey AS STRING), 6, '0'))", "brand": "c_name", "url": "concat(CASE WHEN c_custkey % 11 = 0 THEN 'http' ELSE 'HTTPS' END, '://Shop', CAST(c_custkey AS STRING), '.com/', CASE WHEN c_custkey % 2 = 0 THEN '?x=1#y' ELSE 'a/' END)", "active": "c_custkey % 5 > 0", "collection_status": "CASE WHEN c_custkey % 7 > 0 THEN 'READY_AUTOMATIC' ELSE 'BLOCKED' END", "collector": "CASE WHEN c_custkey % 3 > 0 THEN 'SHOPIFY_PUBLIC' ELSE 'CUSTOM' END"}


@query(f"""
WITH u AS (SELECT c_custkey AS k, {_sql(_BRAND)}, CASE WHEN c_custkey % 11 > 0 THEN 'https://shop' || c_custkey || '.com' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '/a' END END AS clean FROM customer),
f AS (SELECT slug, 'LAST_GOOD' AS origin, clean AS url, CASE WHEN NOT active OR collection_status <> 'READY_AUTOMATIC' THEN 'LAST_GOOD_SOURCE_NOT_ACTIVE_AND_READY' WHEN collector <> 'SHOPIFY_PUBLIC' THEN 'COLLECTOR_NOT_SUPPORTED_BY_AUTOMATION' WHEN clean IS NULL THEN 'VALID_HTTPS_OFFICIAL_URL_REQUIRED' END AS reason FROM u WHERE k % 2 = 0),
s AS (SELECT q.slug, 'APPROVED_QUEUE' AS origin, CASE WHEN q.k % 17 = 0 THEN NULL WHEN q.k % 4 = 0 THEN 'https://adapter.com/' || q.k ELSE 'https://queued.com' END AS url,
  CASE WHEN q.k % 10 = 9 THEN 'UNIVERSE_ENTRY_REQUIRED' WHEN q.k % 5 = 0 THEN 'REFRESH_ONLY_SOURCE_NOT_ACTIVE' WHEN q.k % 6 = 1 THEN 'APPROVED_ADAPTER_REQUIRED' WHEN q.k % 8 = 3 THEN 'APPROVED_ADAPTER_NOT_YET_AUTOMATABLE' WHEN q.k % 17 = 0 THEN 'VALID_HTTPS_OFFICIAL_URL_REQUIRED' END AS reason
  FROM (SELECT k, CASE WHEN k % 10 = 9 THEN 'x' || slug ELSE slug END AS slug FROM u WHERE k % 3 < 2) q WHERE q.slug NOT IN (SELECT slug FROM f WHERE reason IS NULL)),
a AS (SELECT * FROM f UNION ALL SELECT * FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL ORDER BY origin, slug) AS place FROM a)
SELECT slug, origin, url, CASE WHEN reason IS NULL THEN place END AS place, reason FROM p WHERE reason IS NOT NULL OR place <= 40""")
def automation_plan(spark, sf):
    u = _of(spark, sf, "customer", "c_custkey AS k", *_exprs(_BRAND))
    queue = u.filter("k % 3 < 2").select(F.expr("CASE WHEN k % 10 = 9 THEN concat('x', slug) ELSE slug END").alias("slug"), F.expr("CASE WHEN k % 2 = 0 THEN 'READY' ELSE 'ACTIVE' END").alias("status"), F.expr("CASE WHEN k % 17 = 0 THEN NULL ELSE 'https://queued.com/' END").alias("url"))
    adapters = u.filter("k % 6 <> 1").select("slug", F.expr("CASE WHEN k % 8 = 3 THEN 'custom' ELSE 'shopify-public' END").alias("strategy"), F.expr("CASE WHEN k % 17 = 0 THEN 'ftp://x' WHEN k % 4 = 0 THEN concat('https://adapter.com/', k, '/?q') ELSE '' END").alias("adapter_url"))
    return Z.automation_plan(u, queue, adapters, u.filter("k % 2 = 0"), limit=40, refresh_only=True)


@query("SELECT p_brand, p_partkey, variants FROM (SELECT p_brand, p_partkey, count(*) OVER (PARTITION BY p_brand) AS variants, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) WHERE k = 1")
def representatives(spark, sf):
    return D.representatives(_of(spark, sf, "part", "p_brand", "p_partkey", "p_size"), ["p_brand"], F.col("p_size"), "p_partkey").select("p_brand", "p_partkey", "variants")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size END, CASE WHEN p_partkey % 2 = 0 THEN 100 END)::INT AS size FROM part")
def with_prior(spark, sf):
    fresh = _of(spark, sf, "part", "p_partkey", "CASE WHEN p_size > 25 THEN p_size END AS size")
    return D.with_prior(fresh, _of(spark, sf, "part", "p_partkey", "100 AS size").filter("p_partkey % 2 = 0"), "p_partkey", ["size"])


@query("SELECT p_partkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'REGION' || n_regionkey END, 'UNKNOWN') AS segment, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END, 0)::INT AS weight FROM part LEFT JOIN nation ON upper(n_name) = 'NATION_' || (p_size % 30)")
def brand_profiles(spark, sf):
    rows = _of(spark, sf, "part", "p_partkey", "' nation_' || (p_size % 30) AS brand").withColumn("brand", F.trim("brand"))
    registry = _of(spark, sf, "nation", "n_name AS name", "n_nationkey % 2 = 0 AS eligible", "'REGION' || n_regionkey AS segment", "n_nationkey AS weight")
    return D.with_profile(rows, registry, "brand", {"segment": "UNKNOWN", "weight": 0}).select("p_partkey", "segment", "weight")


@query("SELECT l_orderkey, p_partkey, p_type FROM (SELECT l_orderkey, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1) JOIN part USING (p_partkey) WHERE p_type <> 'PROMO'")
def family_index(spark, sf):
    families = _read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    return D.family_index(families, _of(spark, sf, "part", "p_partkey", "p_type"), "p_partkey", "p_type", "PROMO")


@query("SELECT l_orderkey AS family, count(*) AS variants, min(l_partkey) AS first_url FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) GROUP BY 1")
def undelivered_variants(spark, sf):
    lines = _of(spark, sf, "lineitem", "l_orderkey AS family", "l_partkey AS url", "l_quantity")
    return D.without_delivered(lines.select("family", "url").distinct(), lines.filter("l_quantity > 49"), "url", "family")


_SHARD = "SELECT DISTINCT l_partkey AS family, 'h' || (l_suppkey % 3) AS host, l_suppkey AS source FROM lineitem"


@query(f"WITH v AS ({_SHARD}), s AS (SELECT * FROM v WHERE source % 2 = 0), c AS (SELECT * FROM v WHERE source % 5 = 1) SELECT family, host, source, 'core' AS origin FROM c UNION ALL SELECT family, host, source, 'shard' FROM s WHERE (family, host) NOT IN (SELECT (family, host) FROM c)")
def merged_core(spark, sf):
    v = _of(spark, sf, "lineitem", "l_partkey AS family", "'h' || (l_suppkey % 3) AS host", "l_suppkey AS source").distinct()
    return D.merge_core(v.filter("source % 2 = 0"), v.filter("source % 5 = 1"), "family", "host")


@query(f"WITH v AS ({_SHARD}), k AS (SELECT * FROM v WHERE NOT (source % 7 = 0 OR family % 50 = 3)) SELECT family, count(*) AS n, false AS lost FROM k GROUP BY family UNION ALL SELECT family, 0, true FROM v WHERE family NOT IN (SELECT family FROM k) GROUP BY family")
def pruned_evidence(spark, sf):
    v = _of(spark, sf, "lineitem", "l_partkey AS family", "l_suppkey AS source").distinct()
    left, lost = D.prune_evidence(v, v.filter("source % 7 = 0 OR family % 50 = 3"), "family", "source")
    return left.groupBy("family").agg(F.count("*").alias("n")).withColumn("lost", F.lit(False)).unionByName(lost.select("family", F.lit(0).cast("long").alias("n"), F.lit(True).alias("lost")))


@query("WITH f AS (SELECT p_partkey, p_brand, p_type, 'new' AS side FROM part WHERE p_size > 30 AND p_brand < 'Brand#2'), o AS (SELECT p_partkey, p_brand, p_type, 'old' AS side FROM part WHERE p_size <= 35) SELECT * FROM f UNION ALL SELECT * FROM o WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM f)")
def replaced_brands(spark, sf):
    p = _of(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_size")
    fresh = p.filter("p_size > 30 AND p_brand < 'Brand#2'").drop("p_size").withColumn("side", F.lit("new"))
    return D.replace_brand(p.filter("p_size <= 35").drop("p_size").withColumn("side", F.lit("old")), fresh, "p_brand", "p_type")


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def accumulated_history(spark, sf):
    o = _read(spark, sf, "orders")
    cut = _ts("1998-01-01")
    return D.accumulate(o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut), ["o_custkey", "o_orderpriority"])


_MENU = {"source": "p_brand", "name": "p_name", "id": "'c' || (p_size % 12)", "url": "CASE WHEN p_size % 3 > 0 THEN 'u' || (p_size % 15) END"}


@query(f"""
WITH RECURSIVE m AS (SELECT source, name, id, url, row_number() OVER (PARTITION BY source ORDER BY name, id, url NULLS FIRST) AS k FROM (SELECT DISTINCT {_columns(_MENU)} FROM part)),
w AS (SELECT source, 0 AS k, []::VARCHAR[] AS ids, []::VARCHAR[] AS urls, NULL::VARCHAR AS name, NULL::VARCHAR AS id, NULL::VARCHAR AS url, false AS shown FROM (SELECT DISTINCT source FROM m)
  UNION ALL
  SELECT m.source, m.k, CASE WHEN s THEN list_append(w.ids, m.id) ELSE w.ids END, CASE WHEN s AND m.url IS NOT NULL THEN list_append(w.urls, m.url) ELSE w.urls END, m.name, m.id, m.url, s
  FROM w JOIN m ON m.source = w.source AND m.k = w.k + 1, LATERAL (SELECT NOT (list_contains(w.ids, m.id) OR coalesce(list_contains(w.urls, m.url), false)) AS s))
SELECT source, name, id, url FROM w WHERE shown""")
def display_categories(spark, sf):
    return D.display_categories(_of(spark, sf, "part", *_exprs(_MENU)), "source", ["id", "url"], ["name", "id", "url"]).select("source", "name", "id", "url")


@query("SELECT p_partkey % 8 AS shard, count(*) AS families, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS categories, min(p_partkey) AS first_id, max(p_partkey) AS last_id FROM part GROUP BY 1")
def shard_summary(spark, sf):
    return D.shard_summary(_of(spark, sf, "part", "p_partkey AS id", "p_brand", "p_type"), F.col("id") % 8, "p_brand", "p_type")


@query("SELECT p_partkey % 8 AS shard, count(*) AS wanted FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) GROUP BY 1")
def shards_of_saved(spark, sf):
    saved = _of(spark, sf, "lineitem", "l_partkey AS p_partkey", "l_quantity").filter("l_quantity > 49")
    return D.shards_of(saved, _of(spark, sf, "part", "p_partkey", "p_partkey % 8 AS shard"), "p_partkey")


@query("SELECT p_name, p_partkey, p_brand, p_type FROM part WHERE p_type <> 'PROMO' QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def family_cards(spark, sf):
    return D.cards(_read(spark, sf, "part"), "p_name", F.col("p_partkey"), ["p_partkey", "p_brand", "p_type"], F.col("p_type") != "PROMO")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier WHERE s_nationkey % 3 = 1 AND s_acctbal > 0")
def brand_index(spark, sf):
    b = _of(spark, sf, "supplier", "s_suppkey", "s_acctbal", "'c' || (s_nationkey % 3) AS country", "CASE WHEN s_acctbal > 0 THEN 'A' ELSE 'B' END AS segment")
    return D.brand_index(b, "c1", "A", [F.desc("s_acctbal"), F.asc("s_suppkey")]).select("s_suppkey", "place")


@query("WITH e AS (SELECT p_name AS family, p_type AS fingerprint, count(*) AS items, min(p_partkey) AS url FROM part GROUP BY 1, 2) SELECT * FROM e WHERE family IN (SELECT family FROM e GROUP BY family HAVING count(*) > 1)")
def color_variants(spark, sf):
    return D.color_variants(_of(spark, sf, "part", "p_name AS family", "p_partkey AS url", "p_type"), "family", F.col("p_type"))


@query("SELECT CASE WHEN p_type = 'SMALL' THEN 'MEDIUM' ELSE p_type END AS category, count(*)::BIGINT AS n FROM part GROUP BY 1")
def navigation(spark, sf):
    counts = _read(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return D.navigation(counts, "p_type", {"SMALL": "MEDIUM"})


@query("WITH c AS (SELECT p_brand, count(*) AS products FROM part GROUP BY 1), i AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part WHERE p_size % 4 > 0) SELECT p_brand, products, array_to_string(list(p_partkey::VARCHAR ORDER BY k), ',') AS images FROM c JOIN i USING (p_brand) WHERE k <= 3 GROUP BY ALL ORDER BY products DESC, p_brand LIMIT 8")
def brand_cards(spark, sf):
    p = _of(spark, sf, "part", "p_brand", "p_size", "p_partkey", "CASE WHEN p_size % 4 > 0 THEN p_partkey END AS image")
    return D.brand_cards(p, "p_brand", "image", [F.desc("p_size"), F.asc("p_partkey")]).select("p_brand", "products", "images")


@query("WITH t AS (SELECT 'type' AS dimension, p_type AS tag, count(*) AS n FROM part WHERE p_type <> 'PROMO' GROUP BY 2 UNION ALL SELECT 'word', split_part(p_name, ' ', 1), count(*) FROM part GROUP BY 2) SELECT dimension, tag, n, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, tag) AS rank FROM t QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY n DESC, tag) <= 4")
def palette(spark, sf):
    pairs = F.array(F.struct(F.lit("type").alias("dimension"), F.when(F.col("p_type") == "PROMO", "OTHER").otherwise(F.col("p_type")).alias("tag")), F.struct(F.lit("word").alias("dimension"), F.element_at(F.split("p_name", " "), 1).alias("tag")))
    tags = _read(spark, sf, "part").select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.tag").agg(F.count("*").alias("n"))
    return D.palette(tags, 4)


@query("SELECT n_name, count(*) AS products, count(DISTINCT l_partkey) AS brands, count(DISTINCT l_suppkey) AS retailers, floor(avg((l_quantity > 10)::INT) * 1000 + 0.5) / 10 AS image_percent FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")
def country_summary(spark, sf):
    lines = _read(spark, sf, "lineitem").join(_of(spark, sf, "supplier", "s_suppkey AS l_suppkey", "s_nationkey AS n_nationkey"), "l_suppkey").join(_of(spark, sf, "nation", "n_nationkey", "n_name"), "n_nationkey")
    return D.country_summary(lines, "n_name", "l_partkey", "l_suppkey", F.col("l_quantity") > 10)


@query("SELECT 's' || page_id AS id, row_number() OVER (ORDER BY page_id % 7, 's' || page_id) AS place FROM pages WHERE page_id % 3 > 0")
def snapshot_listing(spark, sf):
    files = _of(spark, sf, "pages", "CASE WHEN page_id % 3 > 0 THEN 'dir/s' || page_id || '.json' ELSE 'dir/s' || page_id || '.tmp' END AS name", "page_id % 7 AS taken")
    return D.snapshots_in_order(files, r"/(s\d+)\.json$").select("id", "place")


_DOCS = "documents LEFT JOIN labels USING (doc_id)"


def _docs(spark, sf):
    return _of(spark, sf, "documents", "doc_id", "lang", "source", "n_chars").join(_read(spark, sf, "labels"), "doc_id", "left")


@query(f"SELECT source, count(*) AS products, count(*) FILTER (n_chars > 500) AS with_text, count(*) FILTER (quality IS NOT NULL) AS with_vision, count(*) FILTER (n_chars > 500 AND quality IS NOT NULL) AS with_both FROM {_DOCS} GROUP BY source")
def normalised_summary(spark, sf):
    return V.normalised_summary(_docs(spark, sf), "source", F.col("n_chars") > 500, F.col("quality").isNotNull())


@query(f"""
WITH d AS (SELECT CASE WHEN lang = 'fr' THEN 'UNCLASSIFIED' ELSE lang END AS c, CASE WHEN n_chars > 3000 THEN 'NOT_APPLICABLE' WHEN n_chars > 800 THEN 'long' END AS a, quality::VARCHAR AS b FROM {_DOCS}),
s AS (SELECT *, (coalesce(a, '') <> 'NOT_APPLICABLE')::INT + 1 AS o, (coalesce(a, 'NOT_APPLICABLE') <> 'NOT_APPLICABLE')::INT + (b IS NOT NULL)::INT AS h FROM d)
SELECT count(*) AS items, count(*) FILTER (c <> 'UNCLASSIFIED') AS category_known, floor(count(*) FILTER (c <> 'UNCLASSIFIED') / count(*) * 100.0 * 10.0 + 0.5) / 10.0 AS category_percent, count(*) FILTER (a = 'long') AS length_known, count(b) AS quality_known,
  count(*) FILTER (a IS NULL) AS length_unknown, count(*) FILTER (b IS NULL) AS quality_unknown, floor(avg(floor(h / o * 100.0 * 10.0 + 0.5) / 10.0) * 10.0 + 0.5) / 10.0 AS average_percent FROM s""")
def taxonomy_completeness(spark, sf):
    length = F.when(F.col("n_chars") > 3000, "NOT_APPLICABLE").when(F.col("n_chars") > 800, "long")
    return V.completeness(_docs(spark, sf), {"length": length, "quality": F.col("quality").cast("string")}, F.when(F.col("lang") == "fr", "UNCLASSIFIED").otherwise(F.col("lang")))


@query("SELECT p_type, count(*) AS families, arg_max(p_partkey, p_size * 100000 - p_partkey) AS hero, count(*) FILTER (p_size % 5 = 0) AS verified_new FROM part GROUP BY p_type")
def category_summaries(spark, sf):
    p = _of(spark, sf, "part", "p_partkey AS id", "p_type", "p_size")
    return V.category_summaries(p, "p_type", F.col("p_size") * 100000 - F.col("id"), F.col("p_size") % 5 == 0)


@query("WITH f AS (SELECT DISTINCT p_brand, p_name FROM part), h AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size > 20) SELECT f.p_brand, count(*) AS found, count(h.p_name) AS crawled, count(*) - count(h.p_name) AS missing FROM f LEFT JOIN h ON h.p_brand = f.p_brand AND h.p_name = f.p_name GROUP BY 1")
def category_coverage(spark, sf):
    p = _read(spark, sf, "part")
    return V.category_coverage(p, p.filter("p_size > 20"), "p_brand", "p_name")


@query("""
WITH r AS (SELECT s_suppkey AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'BRAND' ELSE 'MARKETPLACE' END AS kind, 500 + s_suppkey * 3 AS total FROM supplier),
g AS (SELECT l_suppkey AS source, count(*) AS n, count(DISTINCT l_partkey) AS b, count(*) FILTER (l_quantity > 5) AS c FROM lineitem WHERE l_suppkey % 10 <> 7 GROUP BY 1)
SELECT source, kind, total, coalesce(n, 0) AS "rows", coalesce(b, 0) AS brands, coalesce(c, 0) AS complete, floor(coalesce(n, 0) / total * 100.0 * 10.0 + 0.5) / 10.0 AS percent, CASE WHEN n IS NULL THEN 'MISSING' WHEN n >= total * 0.9::DOUBLE THEN 'FULL' ELSE 'PARTIAL' END AS status FROM r LEFT JOIN g USING (source)""")
def source_coverage(spark, sf):
    registry = _of(spark, sf, "supplier", "s_suppkey AS source", "CASE WHEN s_suppkey % 2 = 0 THEN 'BRAND' ELSE 'MARKETPLACE' END AS kind", "500 + s_suppkey * 3 AS total")
    rows = _of(spark, sf, "lineitem", "l_suppkey AS source", "l_partkey AS brand", "l_quantity").filter("source % 10 <> 7")
    return V.source_coverage(registry, rows, "source", F.col("l_quantity") > 5)


@query("SELECT event_type AS tag, count(DISTINCT user_id) AS records FROM events WHERE value / 100 >= 0.3::DOUBLE GROUP BY 1")
def vision_tags(spark, sf):
    e = _read(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.struct(F.col("event_type").alias("tag"), (F.col("value") / 100).alias("confidence"))).alias("tags"))
    return V.vision_tags(e, F.col("tags"), 0.3)


@query("""
WITH r AS (SELECT user_id, event_type, event_id % 3 AS run, max(value) > 30 AS yes FROM events GROUP BY ALL), s AS (SELECT user_id, event_type, count(*) AS runs, bool_and(yes) AS y, bool_or(yes) AS o FROM r GROUP BY ALL)
SELECT event_type, count(*) AS items, count(*) FILTER (runs = 3) AS complete, count(*) FILTER (runs = 3 AND (y OR NOT o)) AS stable, CASE WHEN count(*) FILTER (runs = 3) > 0 THEN floor(count(*) FILTER (runs = 3 AND (y OR NOT o)) / count(*) FILTER (runs = 3) * 100.0 * 10.0 + 0.5) / 10.0 ELSE 0.0 END AS percent FROM s GROUP BY event_type""")
def stability_rates(spark, sf):
    e = _read(spark, sf, "events").withColumn("run", F.col("event_id") % 3)
    seen = e.groupBy("user_id", "event_type", "run").agg(F.when(F.max("value") > 30, "YES").otherwise("NO").alias("value"))
    return V.stability_rates(G.stability(seen, seen, ["user_id", "event_type"], "run", "value", 3), "event_type")


@query("SELECT p_name, count(*)::BIGINT AS n, count(DISTINCT p_brand) AS brands FROM part WHERE p_type NOT IN ('PROMO', 'SMALL') GROUP BY 1 ORDER BY n DESC, p_name LIMIT 40")
def unmapped_labels(spark, sf):
    return V.unmapped(_read(spark, sf, "part"), "p_name", F.when(F.col("p_type").isin("PROMO", "SMALL"), F.col("p_type")), "p_brand")


@query("WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders) SELECT o_orderstatus, count(*) AS n, array_to_string(list(o_orderkey::VARCHAR ORDER BY k) FILTER (k <= 25), ',') AS first FROM r GROUP BY 1")
def outcomes_by_status(spark, sf):
    return V.outcomes(_read(spark, sf, "orders"), "o_orderstatus", "o_orderkey")


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'published' WHEN o_orderkey % 3 = 0 THEN 'created' WHEN o_orderstatus <> 'P' THEN 'first_seen' ELSE 'none' END AS source, count(*) AS n FROM orders GROUP BY 1")
def date_sources(spark, sf):
    o, d = F.col("o_orderkey"), F.col("o_orderdate")
    return V.date_sources(_read(spark, sf, "orders"), {"published": F.when(o % 5 == 0, d), "created": F.when(o % 3 == 0, d), "first_seen": F.when(F.col("o_orderstatus") != "P", d)})


@query("SELECT lower(p_name) AS label, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 8")
def generic_labels(spark, sf):
    return V.generic_labels(_read(spark, sf, "part"), F.lower("p_name"))


@query("SELECT p_brand, count(*) AS variants, count(*) FILTER (p_size % 4 > 0) AS with_images, floor(count(*) FILTER (p_size % 4 > 0) / count(*) * 100.0 * 10.0 + 0.5) / 10.0 AS percent FROM part GROUP BY 1")
def image_share(spark, sf):
    return V.image_share(_read(spark, sf, "part"), "p_brand", F.col("p_size") % 4)
