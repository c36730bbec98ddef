"""Filters by scope, names and sightings over the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from trendloom.functions import names as N
from trendloom.operators import scopes as P
from trendloom.operators import sightings as S
from trendloom.plans.market import _read, _ts
from trendloom.plans.registry import _SEASON_SQL, seasons

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    """Register a function under its name with the SQL for it."""

    def add(run: Callable) -> Callable:
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


def _of(spark, sf, table: str, *columns: str):
    """Columns of a table by expressions that both dialects read alike."""
    return _read(spark, sf, table).selectExpr(*columns)


_BRAND = ("c_custkey AS id", "c_name AS name", "'P' || (c_nationkey % 4) AS priority", "c_acctbal > 0 AS is_active")


@query(f"SELECT id FROM (SELECT {', '.join(_BRAND)} FROM customer) WHERE priority = 'P1' AND is_active")
def brands_p1(spark, sf):
    return P.by_priority(_of(spark, sf, "customer", *_BRAND), "P1").select("id")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3)")
def scope_source(spark, sf):
    seen = _read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("sources"))
    return _read(spark, sf, "part").join(seen, "p_partkey").filter(P.scope("SOURCE", "3")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO'")
def scope_category(spark, sf):
    return _of(spark, sf, "part", "p_partkey", "p_type AS category").filter(P.scope("CATEGORY", "PROMO")).select("p_partkey")


_FEATURES = {"words": "replace(p_name, ' ', '+')", "type": "CASE WHEN p_size % 3 = 0 THEN 'UNKNOWN' ELSE p_type END", "bin": "CASE WHEN p_size < 10 THEN 'LOW' WHEN p_size > 45 THEN 'NOT_APPLICABLE' WHEN p_size > 30 THEN 'HIGH' END"}


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'blue') AND p_size % 3 <> 0 AND p_type = 'PROMO'")
def taxonomy_filter(spark, sf):
    features = {f: F.expr(e) for f, e in _FEATURES.items()}
    return _read(spark, sf, "part").filter(P.matches_all({"words": "blue", "type": "PROMO"}, features)).select("p_partkey")


@query(f"""
WITH f AS (SELECT {', '.join(f'{e} AS {f}' for f, e in _FEATURES.items())} FROM part),
l AS (SELECT 'words' AS field, words AS v FROM f WHERE type = 'PROMO' UNION ALL SELECT 'type', type FROM f WHERE contains(words, 'blue') UNION ALL SELECT 'bin', bin FROM f WHERE type = 'PROMO' AND contains(words, 'blue')),
o AS (SELECT field, v, list_filter(string_split(coalesce(v, ''), '+'), lambda x: x NOT IN ('', 'UNKNOWN', 'NOT_APPLICABLE')) AS own FROM l),
t AS (SELECT field, count(*) FILTER (coalesce(v, 'UNKNOWN') <> 'NOT_APPLICABLE') AS a, count(*) FILTER (len(own) > 0) AS k FROM o GROUP BY field),
c AS (SELECT field, value, count(*) AS n FROM (SELECT field, unnest(own) AS value FROM o) GROUP BY ALL)
SELECT field, value, n, floor(k / a * 100.0 * 10.0 + 0.5) / 10.0 AS percent, CASE WHEN floor(k / a * 100.0 * 10.0 + 0.5) / 10.0 >= 50 THEN 'primary' ELSE 'limited' END AS tier FROM c JOIN t USING (field)""")
def facet_tiers(spark, sf):
    return P.facet_groups(_read(spark, sf, "part"), {f: F.expr(e) for f, e in _FEATURES.items()}, {"type": "PROMO", "words": "blue"})


_SEEN_AT = "CASE WHEN l_suppkey % 5 = 0 THEN 'brand-' || (l_partkey % 25) ELSE 's' || l_suppkey END"
_KIND = "CASE WHEN l_suppkey % 5 = 1 THEN 'LUXURY_MARKETPLACE' WHEN l_suppkey % 7 = 0 THEN 'BRAND_OFFICIAL' END"


def _seen(spark, sf):
    rows = _of(spark, sf, "lineitem", "l_partkey AS p_partkey", f"{_SEEN_AT} AS source", f"{_KIND} AS kind").distinct()
    by_part = rows.groupBy("p_partkey").agg(F.collect_set(F.struct("source", "kind")).alias("sightings"))
    return _read(spark, sf, "part").join(by_part, "p_partkey", "left")


_SEEN = f"x AS (SELECT p_partkey, p_brand, {_SEEN_AT} AS source, {_KIND} AS kind, l_partkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey)"


@query(f"WITH {_SEEN} SELECT p_partkey FROM x GROUP BY p_partkey HAVING count(l_partkey) = 0 OR bool_or(source <> 's7' AND coalesce(kind, '') <> 'LUXURY_MARKETPLACE' AND (coalesce(kind, '') = 'BRAND_OFFICIAL' OR source = replace(lower(p_brand), '#', '-')))")
def official_channel(spark, sf):
    return _seen(spark, sf).filter(P.official_channel(F.col("sightings"), F.col("p_brand"), ("s7",))).select("p_partkey")


@query(f"WITH {_SEEN} SELECT DISTINCT p_partkey FROM x WHERE source = 's3' AND p_brand = 'Brand#11'")
def marketplace_families(spark, sf):
    return _seen(spark, sf).filter(P.on_marketplace(F.col("sightings"), F.col("p_brand"), "s3", " brand#11")).select("p_partkey")


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_suppkey = 4 AND l_returnflag = 'R'")
def source_category(spark, sf):
    refs = _of(spark, sf, "lineitem", "l_partkey AS p_partkey", "'s' || l_suppkey AS source", "l_returnflag AS category").distinct()
    return refs.groupBy("p_partkey").agg(F.collect_set(F.struct("source", "category")).alias("refs")).filter(P.in_source_category(F.col("refs"), "s4", "R")).select("p_partkey")


@query(f"SELECT p_partkey, season FROM ({_SEASON_SQL}) WHERE season = 'SS27'")
def season_filter(spark, sf):
    return seasons(spark, sf).filter(F.col("season") == "SS27").select("p_partkey", "season")


_COUNTRY = "CASE WHEN c_custkey % 7 = 0 THEN ' Worldwide' WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'Güney İl' || c_nationkey ELSE 'Nation ' || c_nationkey END"


@query(f"""
WITH c AS (SELECT {_COUNTRY} AS country FROM customer),
g AS (SELECT CASE WHEN trim(country) = '' OR lower(trim(country)) = 'worldwide' THEN 'unknown' WHEN country = 'Nation 3' THEN 'ulke-uc' WHEN starts_with(country, 'G') THEN 'guney-il' || country[9:] ELSE 'nation-' || country[8:] END AS value FROM c),
n AS (SELECT value, count(*) AS n FROM g GROUP BY value)
SELECT value, n, row_number() OVER (ORDER BY (value = 'unknown')::INT, n DESC, value) AS place FROM n""")
def country_groups(spark, sf):
    from trendloom.operators.coverage import counts_unknown_last

    group, _ = N.country_group("country", {"nation 3": "Ülke Üç"})
    return counts_unknown_last(_of(spark, sf, "customer", f"{_COUNTRY} AS country"), group)


@query("""
SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN 'LUXURY' WHEN c_nationkey % 2 = 0 THEN 'PREMIUM' END AS price_segment FROM customer WHERE c_nationkey < 8 OR c_nationkey % 2 = 0""")
def price_segments(spark, sf):
    nations = _read(spark, sf, "nation")
    table = nations.selectExpr("CASE WHEN n_nationkey < 8 THEN n_nationkey END AS id", "CASE WHEN n_nationkey % 2 = 0 THEN lower(replace(n_name, '_', '')) END AS key", "CASE WHEN n_nationkey < 8 THEN 'LUXURY' ELSE 'PREMIUM' END AS segment")
    brands = _read(spark, sf, "customer").join(nations.selectExpr("n_nationkey AS c_nationkey", "n_name"), "c_nationkey").select("c_custkey", F.col("c_nationkey"), F.concat(F.lit("É"), F.col("n_name")).alias("n"))
    return P.with_segment(brands, table, "c_nationkey", F.substring(N.brand_key("n"), 2, 100)).filter("price_segment is not null").select("c_custkey", "price_segment")


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0")
def changing_view(spark, sf):
    return P.changing(_of(spark, sf, "part", "p_partkey", "p_size % 2 = 0 AS is_changing"), "CHANGING").select("p_partkey")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS words FROM part")
def slim_families(spark, sf):
    return P.slim(_read(spark, sf, "part").withColumn("words", F.split("p_name", " ")), ["p_partkey"], {"words": 1}).select("p_partkey", F.array_join("words", ",").alias("words"))


@query("SELECT p_partkey FROM part WHERE p_size > 5 AND p_type IN ('PROMO', 'SMALL') AND p_brand IN (SELECT p_brand FROM part WHERE p_retailprice > 950)")
def visible_brands(spark, sf):
    brands = _of(spark, sf, "part", "p_partkey", "p_brand AS brand", "p_size > 5 AS available", "p_type AS kind")
    return P.visible_brands(brands, _of(spark, sf, "part", "p_brand AS brand", "p_retailprice").filter("p_retailprice > 950"), ("PROMO", "SMALL")).select("p_partkey")


_TEXT_DATE = "CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE CAST(o_orderdate AS VARCHAR(40)) END"


def _placed(rows, group: str, order, key: str):
    from pyspark.sql.window import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order, F.col(key)))).select(key, "place")


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(epoch_us(try_cast({_TEXT_DATE} AS TIMESTAMP)), 0) DESC, o_orderkey) AS place FROM orders")
def newest_first(spark, sf):
    return _placed(_of(spark, sf, "orders", "o_orderkey", "o_custkey", f"{_TEXT_DATE} AS at"), "o_custkey", P.newest_first("at"), "o_orderkey")


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F')::INT, coalesce(epoch_us(try_cast({_TEXT_DATE} AS TIMESTAMP)), 0) DESC, o_orderkey) AS place FROM orders")
def unreviewed_first(spark, sf):
    rows = _of(spark, sf, "orders", "o_orderkey", "o_custkey", f"{_TEXT_DATE} AS at", "CASE WHEN o_orderstatus = 'F' THEN 'yes' WHEN o_orderstatus = 'O' THEN '' END AS seen")
    return _placed(rows, "o_custkey", P.unreviewed_first("seen", "at"), "o_orderkey")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25) DESC, abs(length(p_name) - 9) DESC, p_name, p_partkey) AS place FROM part")
def largest_change_first(spark, sf):
    return _placed(_of(spark, sf, "part", "p_partkey", "p_brand", "p_size - 25 AS a", "length(p_name) - 9 AS b", "p_name"), "p_brand", P.by_change("a", "b", "p_name"), "p_partkey")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS place FROM part")
def turkish_order(spark, sf):
    return _placed(_of(spark, sf, "part", "p_partkey", "p_brand", "p_name"), "p_brand", [P.turkish("p_name")], "p_partkey")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS place FROM customer")
def influence_order(spark, sf):
    return _placed(_of(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", P.by_influence("c_acctbal", ascending=True), "c_custkey")


# Sightings: a part (family) at a supplier (source).
_VERIFIED = {
    "status": "CASE WHEN l_returnflag = 'N' THEN 'VERIFIED_NEW' WHEN l_returnflag = 'A' THEN 'FORMERLY_NEW' ELSE 'NOT_VERIFIED' END",
    "evidence": "CASE WHEN l_suppkey % 3 = 0 THEN 'NEW_BADGE' WHEN l_suppkey % 3 = 1 THEN 'NEW_ARRIVALS_COLLECTION' ELSE 'CATALOG_DIFF' END",
    "new_at": "CASE WHEN l_suppkey % 10 = 9 THEN 'spring' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR(40)) END",
}


def _sightings(spark, sf):
    columns = [f"{e} AS {c}" for c, e in _VERIFIED.items()]
    return _of(spark, sf, "lineitem", "l_partkey AS family", "l_suppkey AS source", "'s' || l_suppkey AS label", "l_suppkey * 10 + l_linenumber AS place", *columns).distinct()


_ARRIVED = """
WITH s AS (SELECT DISTINCT l_partkey AS family, l_suppkey AS source, l_suppkey * 10 + l_linenumber AS place, {columns} FROM lineitem),
v AS (SELECT family, source, try_cast(new_at AS TIMESTAMP) AS seen, place FROM s WHERE status = 'VERIFIED_NEW' AND evidence <> 'CATALOG_DIFF' AND try_cast(new_at AS TIMESTAMP) IS NOT NULL {scope}),
a AS (SELECT family, source, seen FROM v QUALIFY row_number() OVER (PARTITION BY family ORDER BY seen DESC, place) = 1),
n AS (SELECT * FROM a WHERE epoch_us(TIMESTAMP '2001-06-30') - epoch_us(seen) <= {days} * 86400000000)
"""


def _arrived(scope: str = "", days: int = 90) -> str:
    return _ARRIVED.format(columns=", ".join(f"{e} AS {c}" for c, e in _VERIFIED.items()), scope=scope, days=days)


@query(_arrived() + "SELECT family, source, strftime(seen, '%Y-%m-%d') AS seen FROM n")
def verified_arrivals(spark, sf):
    return S.verified_arrivals(_sightings(spark, sf), _ts("2001-06-30"), "90D").select("family", "source", F.date_format("at", "yyyy-MM-dd").alias("seen"))


@query(_arrived("AND source = 6", 30) + "SELECT family FROM n")
def verified_arrivals_source(spark, sf):
    return S.verified_arrivals(_sightings(spark, sf), _ts("2001-06-30"), "30D", F.col("source") == 6).select("family")


@query(_arrived() + "SELECT p_brand AS brand, count(*) AS families, count(n.family) AS verified_new FROM part LEFT JOIN n ON n.family = p_partkey GROUP BY p_brand")
def verified_counts(spark, sf):
    families = _of(spark, sf, "part", "p_partkey AS family", "p_brand AS brand")
    return S.count_by(S.verified_arrivals(_sightings(spark, sf), _ts("2001-06-30"), "90D"), families, "brand")


_HINTS = ("page_id", "url AS path", "page_id % 11 = 0 AS in_collection", "page_id % 5 = 0 AS badge", "CASE WHEN page_id % 3 = 0 THEN '2024-01-05' WHEN page_id % 3 = 1 THEN 'today' END AS published", "'2023-12-01' AS created")


@query(f"""
WITH h AS (SELECT {', '.join(_HINTS)} FROM pages),
e AS (SELECT *, CASE WHEN in_collection OR regexp_matches(path, '(?i)new[-_]?arrivals?|new[-_]?in|whats[-_]?new|new[-_]?season|latest|new[-_]?shoes?|new[-_]?footwear|just[-_]?in|/new(?:\\.html)?(?:/|$)') THEN 'NEW_ARRIVALS_COLLECTION' WHEN badge THEN 'NEW_BADGE' END AS evidence FROM h)
SELECT page_id, CASE WHEN evidence IS NULL THEN 'NOT_VERIFIED' ELSE 'VERIFIED_NEW' END AS status, evidence, CASE evidence WHEN 'NEW_BADGE' THEN 0.85 WHEN 'NEW_ARRIVALS_COLLECTION' THEN 0.9 END::DOUBLE AS confidence,
  CASE WHEN evidence IS NOT NULL THEN strftime(coalesce(try_cast(coalesce(published, created) AS TIMESTAMP), TIMESTAMP '2024-02-01'), '%Y-%m-%d') END AS new_at FROM e""")
def newness_hints(spark, sf):
    out = S.from_hints(_of(spark, sf, "pages", *_HINTS), _ts("2024-02-01"))
    return out.select("page_id", "status", "evidence", "confidence", F.date_format("new_at", "yyyy-MM-dd").alias("new_at"))


_STATE = "CASE WHEN max(value) > 60 THEN 'VERIFIED_NEW' ELSE 'NOT_VERIFIED' END"
_PROOF = "CASE WHEN max(value) > 60 THEN CASE WHEN count(*) % 3 = 0 THEN 'CATALOG_DIFF' WHEN count(*) % 3 = 1 THEN 'NEW_BADGE' ELSE 'NEW_ARRIVALS_COLLECTION' END END"
_STEP = "user_id, event_type, {state} AS status, {proof} AS evidence, min(ts) AS first_at, max(ts) AS last_at".format(state=_STATE, proof=_PROOF)


@query(f"""
WITH a AS (SELECT {_STEP} FROM events WHERE day(ts) <= 10 GROUP BY user_id, event_type), b AS (SELECT {_STEP} FROM events WHERE day(ts) > 20 GROUP BY user_id, event_type),
o AS (SELECT *, evidence = 'CATALOG_DIFF' AS void FROM a), n AS (SELECT *, evidence = 'CATALOG_DIFF' AS void FROM b),
j AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, CASE WHEN o.void THEN 'NOT_VERIFIED' ELSE o.status END AS os, CASE WHEN n.void THEN 'NOT_VERIFIED' ELSE n.status END AS ns,
  CASE WHEN o.void THEN NULL ELSE o.evidence END AS oe, CASE WHEN n.void THEN NULL ELSE n.evidence END AS ne, CASE WHEN o.void THEN NULL ELSE o.first_at END AS f, CASE WHEN n.void THEN NULL ELSE n.first_at END AS nf FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type)
SELECT user_id, event_type, CASE WHEN ns = 'VERIFIED_NEW' THEN ns WHEN os = 'VERIFIED_NEW' AND ns = 'NOT_VERIFIED' THEN 'FORMERLY_NEW' ELSE coalesce(os, ns) END AS status,
  CASE WHEN ns = 'VERIFIED_NEW' OR os IS NULL THEN ne ELSE oe END AS evidence,
  CASE WHEN ns = 'VERIFIED_NEW' THEN CASE WHEN os = 'VERIFIED_NEW' THEN coalesce(f, nf) ELSE nf END WHEN os IS NULL THEN nf ELSE f END AS first_at FROM j""")
def newness_merge(spark, sf):
    def side(days):
        rows = _read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter(days)
        rows = rows.groupBy("user_id", "event_type").agg(F.expr(_STATE).alias("status"), F.expr(_PROOF).alias("evidence"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
        return rows

    day = F.dayofmonth("ts")
    merged = S.merge_newness(side(day <= 10), side(day > 20), ["user_id", "event_type"], _ts("2024-02-01"))
    return merged.select("user_id", "event_type", "status", "evidence", "first_at")


@query("""
WITH s AS (SELECT l_partkey AS family, l_suppkey AS source, l_shipdate >= TIMESTAMP '1998-01-01' AS side, min(l_shipdate) AS f, max(l_shipdate) AS l, max(l_returnflag) AS label, CASE WHEN max(l_quantity) > 30 THEN max(l_linestatus) END AS category FROM lineitem GROUP BY ALL)
SELECT family, source, min(f) AS first_seen, max(l) AS last_seen, arg_max(label, side) AS label, arg_max(category, side) FILTER (category IS NOT NULL) AS category FROM s GROUP BY ALL""")
def sighting_merge(spark, sf):
    def side(rows):
        return rows.groupBy(F.col("l_partkey").alias("family"), F.col("l_suppkey").alias("source")).agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.max("l_returnflag").alias("label"), F.when(F.max("l_quantity") > 30, F.max("l_linestatus")).alias("category"))

    lines, cut = _read(spark, sf, "lineitem"), _ts("1998-01-01")
    return S.merge_sightings(side(lines.filter(F.col("l_shipdate") < cut)), side(lines.filter(F.col("l_shipdate") >= cut)), ["family", "source"])


@query(f"""
WITH s AS (SELECT l_partkey AS family, l_suppkey AS source, {_VERIFIED['status']} AS status, {_VERIFIED['evidence']} AS evidence, max(l_shipdate) AS last_at FROM lineitem GROUP BY ALL)
SELECT family, source, count(*) AS n, count(*) FILTER (status = 'VERIFIED_NEW' AND NOT (evidence = 'NEW_BADGE' AND family % 4 = 0 AND last_at <= TIMESTAMP '1999-01-01')) AS still_new FROM s GROUP BY ALL""")
def revoked_badges(spark, sf):
    rows = _of(spark, sf, "lineitem", "l_partkey AS family", "l_suppkey AS source", f"{_VERIFIED['status']} AS status", f"{_VERIFIED['evidence']} AS evidence", "l_shipdate").groupBy("family", "source", "status", "evidence").agg(F.max("l_shipdate").alias("last_at"))
    out = S.revoke_badges(rows, rows.filter("family % 4 = 0"), _ts("1999-01-01"))
    return out.groupBy("family", "source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "VERIFIED_NEW").alias("still_new"))


@query("SELECT c_custkey, min(o_orderdate) AS before, min(o_orderdate) IS NULL AS is_new FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') ON o_custkey = c_custkey GROUP BY c_custkey")
def known_before(spark, sf):
    seen = _of(spark, sf, "orders", "o_custkey AS c_custkey", "o_orderdate AS seen").filter(F.col("seen") < _ts("1996-01-01"))
    return S.known_before(_of(spark, sf, "customer", "c_custkey"), seen, "c_custkey")


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) AS is_new, p_size > 20 AS kept_new FROM part")
def membership_refresh(spark, sf):
    rows = _of(spark, sf, "part", "p_partkey", "p_size > 20 AS is_new")
    scan = _of(spark, sf, "lineitem", "l_partkey AS p_partkey", "'new-' || l_returnflag AS path", "l_quantity").filter("l_quantity > 40")
    whole = S.refresh_membership(rows, scan, ["new-A", "new-N"], "p_partkey")
    partial = S.refresh_membership(rows, scan, ["new-A", "gone"], "p_partkey").select("p_partkey", F.col("is_new").alias("kept_new"))
    return whole.join(partial, "p_partkey")


# Names: a part's name with something added by its size.
_NAME = "CASE p_size % 8 WHEN 0 THEN 'SS27 ' || p_name WHEN 1 THEN p_name || ' Black Suede' WHEN 2 THEN p_name || ' high heel 2' WHEN 3 THEN p_name || ' v3' WHEN 4 THEN p_name || ' ' || p_name WHEN 5 THEN 'Mary Jane ' || p_name WHEN 6 THEN p_name || ' Red Boot IV' ELSE 'red pump' END"


@query(f"""
WITH n AS (SELECT p_partkey, p_size, p_name, {_NAME} AS t FROM part)
SELECT p_partkey, CASE p_size % 8 WHEN 7 THEN '' WHEN 2 THEN trim(regexp_replace(p_name, '\\b(red|blue)\\b', '', 'g')) || ' 2' WHEN 3 THEN trim(regexp_replace(p_name, '\\b(red|blue)\\b', '', 'g')) || ' v3' WHEN 4 THEN trim(regexp_replace(regexp_replace(p_name || ' ' || p_name, '\\b(red|blue)\\b', '', 'g'), ' +', ' ', 'g')) WHEN 5 THEN 'mary jane ' || trim(regexp_replace(p_name, '\\b(red|blue)\\b', '', 'g'))
  WHEN 6 THEN trim(regexp_replace(p_name, '\\b(red|blue)\\b', '', 'g')) || ' iv' ELSE trim(regexp_replace(p_name, '\\b(red|blue)\\b', '', 'g')) END AS family_key FROM n""")
def radar_family_keys(spark, sf):
    return _of(spark, sf, "part", "p_partkey", f"{_NAME} AS t").select("p_partkey", N.radar_family_key("t").alias("family_key"))


@query(f"""
WITH n AS (SELECT p_partkey, {_NAME} AS t FROM part), w AS (SELECT *, string_split(t, ' ') AS w FROM n)
SELECT p_partkey, array_to_string(list_transform(w, lambda x: CASE WHEN length(x) <= 2 THEN upper(x) ELSE upper(x[1]) || lower(x[2:]) END), ' ') AS display,
  array_to_string(list_transform(list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'w': w[i], 'i': i}}), lambda x: list_position(list_transform(w, lambda y: lower(y)), lower(x.w)) = x.i), lambda x: x.w), ' ') AS label,
  len(list_filter(w, lambda x: lower(x) NOT IN ('red', 'pump', 'new', 'old', 'boot', 'ring'))) = 0 AS generic FROM w""")
def display_names(spark, sf):
    t = _of(spark, sf, "part", "p_partkey", f"{_NAME} AS t")
    return t.select("p_partkey", N.display_name("t").alias("display"), N.dedupe_words("t").alias("label"), N.is_generic("t", ["red", "pump", "new", "old", "boot", "ring"]).alias("generic"))


@query(f"""
WITH n AS (SELECT p_partkey, lower({_NAME}) AS t FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(t, ' (2|v3|iv)$') THEN regexp_replace(t, ' (2|v3|iv)$', '') ELSE t END AS base, nullif(regexp_extract(t, ' (2|v3|iv)$', 1), '') AS version, regexp_matches(t, ' (v3|iv)$') AS distinct_from_2
FROM n""")
def model_versions(spark, sf):
    t = _of(spark, sf, "part", "p_partkey", f"{_NAME} AS t")
    base, version = N.version_of("t")
    return t.select("p_partkey", base.alias("base"), version.alias("version"), (N.distinct_versions((base, version), (base, F.lit("2"))) & version.isNotNull()).alias("distinct_from_2"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'style:ST-' || p_size WHEN p_size % 6 = 1 THEN 'sku:K' || p_partkey WHEN p_size % 6 = 2 THEN 'product:' || p_partkey WHEN p_size % 6 = 3 THEN 'handle:' || replace(p_name, ' ', '-') WHEN p_size % 6 = 4 THEN 'url:http://h/' || p_partkey ELSE 'name:' || p_name END AS identity,
  CASE WHEN p_type = 'PROMO' THEN '-' ELSE p_type END || '|' || upper(string_split(p_name, ' ')[1]) || '|' || CASE WHEN p_size > 20 THEN '-' ELSE 'LOW' END AS signature FROM part""")
def listing_identities(spark, sf):
    p = _of(spark, sf, "part", "p_partkey", "p_name", "split(p_name, ' ')[0] AS w", "CASE WHEN p_type = 'PROMO' THEN 'unknown' ELSE p_type END AS kind", "CASE WHEN p_size <= 20 THEN 'low' END AS size", "CASE WHEN p_size % 6 = 0 THEN ' st-' || p_size END AS style", "CASE WHEN p_size % 6 = 1 THEN 'k' || p_partkey ELSE '' END AS sku", "CASE WHEN p_size % 6 = 2 THEN CAST(p_partkey AS STRING) END AS product", "CASE WHEN p_size % 6 = 3 THEN replace(p_name, ' ', '-') END AS handle", "CASE WHEN p_size % 6 = 4 THEN 'http://H/' || p_partkey || '//' END AS url")
    c = F.col
    return p.select("p_partkey", N.listing_identity(c("style"), c("sku"), c("product"), c("handle"), c("url"), c("p_name")).alias("identity"), N.structural_signature("kind", "w", "size").alias("signature"))


_FLAGS = {"RING": "ring", "BOLT": "bolt", "WARM": "hot|red"}


@query("SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN contains(p_name, 'ring') THEN 'RING' END, CASE WHEN contains(p_name, 'bolt') THEN 'BOLT' END, CASE WHEN regexp_matches(p_name, 'hot|red') THEN 'WARM' END], lambda x: x IS NOT NULL)), '+') AS flags, CASE WHEN p_type = 'PROMO' THEN 'PATENT' WHEN p_type = 'LARGE' OR contains(p_name, 'gear') THEN 'WOVEN' WHEN p_type = 'SMALL' THEN 'METALLIC' END AS effect FROM part")
def construction_keys(spark, sf):
    p = _of(spark, sf, "part", "p_partkey", "p_name", "CASE p_type WHEN 'PROMO' THEN 'PATENT' WHEN 'LARGE' THEN 'WOVEN_LEATHER' WHEN 'SMALL' THEN 'METALLIC_LEATHER' ELSE 'SUEDE' END AS m")
    details = F.when(F.col("p_name").contains("gear"), F.array(F.lit("WOVEN"))).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", N.construction_key("p_name", _FLAGS).alias("flags"), N.surface_effect("m", details).alias("effect"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a_front.jpg' WHEN p_size % 3 = 1 THEN 'c.jpg' ELSE 'b_side.jpg' END AS cover, CASE WHEN p_size % 4 = 0 THEN 'old.jpg' ELSE 'x.jpg' END AS gallery FROM part""")
def covers(spark, sf):
    p = _of(spark, sf, "part", "p_partkey", "p_size")
    urls = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("b_side.jpg"), F.lit("a_front.jpg"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("b_side.jpg"), F.lit("c.jpg"), F.lit("d.jpg"))).otherwise(F.array(F.lit("b_side.jpg")))
    fresh = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("logo.svg"))).otherwise(F.array(F.lit("x.jpg"), F.lit("logo.svg"), F.lit("x.jpg")))
    return p.select("p_partkey", N.best_cover(urls, ["front"], ["side"]).alias("cover"), F.array_join(N.gallery(fresh, F.array(F.lit("old.jpg")), r"logo|\.svg"), ",").alias("gallery"))


_PRIMARY = "CASE p_type WHEN 'PROMO' THEN 'BALLET_FLAT' WHEN 'SMALL' THEN 'BOOT' WHEN 'LARGE' THEN 'PUMP' WHEN 'MEDIUM' THEN 'SANDAL' ELSE 'UNCLASSIFIED' END"
_SAID = "p_name || CASE p_size % 6 WHEN 0 THEN ' chelsea boots' WHEN 1 THEN ' slingback pump' WHEN 2 THEN ' thong sandal mules' WHEN 3 THEN ' heels' WHEN 4 THEN ' Mary-Jane' ELSE '' END"


@query(f"""
WITH n AS (SELECT p_partkey, p_size % 6 AS k, {_PRIMARY} AS c FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN k = 4 OR (c = 'BALLET_FLAT' AND k = 5) THEN 'MARY_JANE' END, CASE WHEN c = 'BOOT' AND k = 0 THEN 'CHELSEA_BOOT' END, CASE WHEN c = 'PUMP' AND k = 1 THEN 'SLINGBACK_PUMP' END, CASE WHEN c = 'SANDAL' AND k = 2 THEN 'THONG_SANDAL' END], lambda x: x IS NOT NULL), ',') AS tags,
  CASE c WHEN 'BALLET_FLAT' THEN 'babet' WHEN 'BOOT' THEN 'bot-cizme' WHEN 'PUMP' THEN 'topuklu' WHEN 'SANDAL' THEN 'sandal' ELSE CASE k WHEN 0 THEN 'bot-cizme' WHEN 1 THEN 'topuklu' WHEN 3 THEN 'topuklu' WHEN 4 THEN 'babet' ELSE 'diger' END END AS shown FROM n""")
def style_and_shown(spark, sf):
    p = _of(spark, sf, "part", "p_partkey", f"{_PRIMARY} AS c", f"{_SAID} AS t", "CASE WHEN p_size % 6 = 5 THEN 'instep strap' END AS strap")
    return p.select("p_partkey", F.array_join(N.style_tags(F.col("c"), F.col("t"), F.col("strap")), ",").alias("tags"), N.shown_category(F.col("c"), F.array(N.visual_category("t"))).alias("shown"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'farfetch' ELSE 'magaza-' || c_custkey END AS source, 'ecole' || c_custkey AS key, c_custkey % 4 = 0 AS badge FROM customer")
def marketplace_ids(spark, sf):
    c = _of(spark, sf, "customer", "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'Far Fetch' ELSE 'Mağaza ' || c_custkey END AS name", "'École ' || c_custkey AS brand", "CASE WHEN c_custkey % 4 = 0 THEN ' NEW-in ' ELSE 'brand new in store' END AS label")
    return c.select("c_custkey", N.marketplace_id("name", {"far-fetch": "farfetch"}).alias("source"), N.brand_key("brand").alias("key"), N.is_new_badge("label").alias("badge"))
