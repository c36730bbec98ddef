"""Classifications and merges over the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from trendloom.operators import classify as K
from trendloom.operators import resolve as R
from trendloom.operators import scopes as P
from trendloom.operators import sightings as S
from trendloom.plans.market import _read, _ts
from trendloom.plans.scoped import _of, _seen, _SEEN

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    """Register a function under its name with the SQL for it."""

    def add(run: Callable) -> Callable:
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


_COLLECTION = "CASE s_suppkey % 7 WHEN 0 THEN 'mens-boots' WHEN 1 THEN 'women-mens-style' WHEN 2 THEN 'hand-bags' WHEN 3 THEN 'new-arrivals-' || s_suppkey WHEN 4 THEN 'whats-new' WHEN 5 THEN 'new-socks' ELSE 'shoes' END"


@query("SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'MENS' WHEN 2 THEN 'MERCHANDISE' WHEN 3 THEN 'NEW_ARRIVALS' WHEN 4 THEN 'NEW_ARRIVALS' WHEN 5 THEN 'MERCHANDISE' ELSE 'CATALOG' END AS kind FROM supplier")
def collection_kinds(spark, sf):
    s = _of(spark, sf, "supplier", "s_suppkey", f"{_COLLECTION} AS handle")
    return s.select("s_suppkey", K.collection_kind(F.col("handle"), F.lit("all")).alias("kind"))


_OFFICIAL = {"id": "s_suppkey", "errors": "s_suppkey % 4", "exhausted": "CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 3 > 0 END", "hit_cap": "CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 2 = 0 END", "urls": "CASE WHEN s_suppkey % 11 > 0 THEN s_suppkey % 30 END", "reported": "CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 25 END", "accepted": "s_suppkey % 20"}


@query(f"""WITH c AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _OFFICIAL.items())} FROM supplier), k AS (SELECT *, coalesce(reported > 0, false) AS known FROM c)
SELECT id, array_to_string(list_filter([CASE WHEN errors > 0 THEN 'COLLECTOR_ERRORS' END, CASE WHEN NOT coalesce(exhausted, false) THEN 'PAGINATION_NOT_PROVEN' END, CASE WHEN coalesce(hit_cap, true) THEN 'CRAWL_CAP_NOT_EXCLUDED' END, CASE WHEN coalesce(urls, 0) <= 0 THEN 'NO_SOURCE_URLS' END, CASE WHEN NOT known THEN 'NO_REPORTED_TOTAL' END, CASE WHEN known AND coalesce(urls, 0) < reported THEN 'URLS_BELOW_TOTAL' END, CASE WHEN known AND accepted < reported THEN 'ACCEPTED_BELOW_TOTAL' END], lambda x: x IS NOT NULL), ',') AS reasons FROM k""")
def official_coverage(spark, sf):
    return _of(spark, sf, "supplier", *(f"{e} AS {c}" for c, e in _OFFICIAL.items())).select("id", F.array_join(K.official_coverage_reasons(), ",").alias("reasons"))


@query("SELECT p_name, bool_or(p_size % 4 = 0) AND bool_or(p_size % 4 = 1) OR bool_or(p_size % 7 = 0) AND bool_or(p_size % 7 = 6) AS conflict FROM part GROUP BY p_name")
def architecture_conflicts(spark, sf):
    flags = F.array(F.expr("CASE p_size % 4 WHEN 0 THEN 'mule' WHEN 1 THEN 'sandal' ELSE 'other' END"), F.expr("CASE p_size % 7 WHEN 0 THEN 'mid' WHEN 6 THEN 'high' ELSE 'low' END"))
    each = _read(spark, sf, "part").select("p_name", F.explode(flags).alias("f")).groupBy("p_name").agg(F.collect_set("f").alias("flags"))
    return each.select("p_name", K.architecture_conflict(F.col("flags")).alias("conflict"))


@query("SELECT s_suppkey, s_acctbal > 0 AND s_suppkey % 5 > 0 AND s_suppkey % 3 > 0 AS in_cloud, s_acctbal > 0 AND s_suppkey % 5 > 0 AND s_suppkey % 3 > 0 AND s_suppkey % 5 < 3 AS membership FROM supplier")
def refresh_plan(spark, sf):
    s = _of(spark, sf, "supplier", "s_suppkey", "s_acctbal > 0 AS active", "CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'SHOPIFY_PUBLIC' WHEN 2 THEN 'SHOPIFY_JSON' ELSE 'HTML' END AS collector", "array(CASE WHEN s_suppkey % 3 = 0 THEN ' Wave50' ELSE 'seed' END) AS discovery")
    cloud, member = K.refresh_plan(F.col("active"), F.col("collector"), F.col("discovery"))
    return s.select("s_suppkey", cloud.alias("in_cloud"), member.alias("membership"))


@query("""
WITH r AS (SELECT o_custkey, o_orderpriority, o_orderdate >= TIMESTAMP '1998-01-01' AS side, max(o_orderkey) AS sku, CASE WHEN max(o_totalprice) > 200000 THEN max(o_orderstatus) ELSE '' END AS title FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority, arg_max(sku, side) AS sku, arg_max(title, side) FILTER (title <> '') AS title, count(*) AS sides FROM r GROUP BY ALL""")
def variant_merge(spark, sf):
    def side(rows):
        return rows.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderkey").alias("sku"), F.when(F.max("o_totalprice") > 200000, F.max("o_orderstatus")).otherwise("").alias("title"))

    o, cut = _read(spark, sf, "orders"), _ts("1998-01-01")
    return R.merge_variants(side(o.filter(F.col("o_orderdate") < cut)), side(o.filter(F.col("o_orderdate") >= cut)), ["o_custkey", "o_orderpriority"], ["sku", "title"])


@query("""
WITH v AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (value >= 90)) AS sure, list_sort(list(DISTINCT event_type)) AS a FROM events GROUP BY user_id), t AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN ['click', 'text'] ELSE [] END AS t FROM v)
SELECT user_id, array_to_string(CASE WHEN len(sure) > 0 THEN sure WHEN len(t) > 0 THEN t ELSE a END, ',') AS tags, CASE WHEN len(sure) > 0 THEN 'vision' WHEN len(t) > 0 THEN 'text' ELSE 'vision' END AS origin, coalesce(len(list_filter(sure, lambda x: NOT list_contains(t, x))), 0) AS fresh FROM t""")
def tag_resolution(spark, sf):
    best = _read(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("tag")).agg((F.max("value") / 100).alias("confidence"))
    v = best.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("tag", "confidence"))).alias("vision"))
    text = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("click"), F.lit("text"))).otherwise(F.array().cast("array<string>"))
    tags, origin = R.resolve_tags(F.col("vision"), text, 0.9)
    return v.select("user_id", F.array_join(tags, ",").alias("tags"), origin.alias("origin"), F.size(R.new_tags(F.col("vision"), text, 0.9)).cast("long").alias("fresh"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 > 0 THEN 'mine' WHEN c_custkey % 5 > 0 THEN 'theirs' END AS note, NOT (c_custkey % 2 = 0 AND c_custkey % 3 > 0) AND c_custkey % 5 > 0 AS changed FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 > 0")
def imported_states(spark, sf):
    local = _of(spark, sf, "customer", "c_custkey", "CASE WHEN c_custkey % 3 > 0 THEN 'mine' END AS note").filter("c_custkey % 2 = 0")
    incoming = _of(spark, sf, "customer", "c_custkey", "'theirs' AS note").filter("c_custkey % 5 > 0")
    return R.import_states(local, incoming, "c_custkey", ["note"])


@query("""
WITH i AS (SELECT CASE WHEN o_orderkey % 97 > 0 THEN 'k' || (o_orderkey % 1000) ELSE ' ' END AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' END AS d FROM orders),
e AS (SELECT key, count(*) AS n, count(*) FILTER (d IS NOT NULL) AS b FROM i GROUP BY key) SELECT count(*) FILTER (trim(key) = '') AS no_id, count(*) FILTER (n > 1) AS repeated, sum(b)::BIGINT AS bad_dates, 0::BIGINT AS long_notes, sum(n) > 50000 AS too_many FROM e""")
def backup_faults(spark, sf):
    i = _of(spark, sf, "orders", "CASE WHEN o_orderkey % 97 > 0 THEN 'k' || (o_orderkey % 1000) ELSE ' ' END AS key", "CASE WHEN o_orderkey % 7 = 0 THEN 'soon' WHEN o_orderkey % 7 = 1 THEN CAST(o_orderdate AS STRING) END AS saved", "o_orderpriority AS note")
    return R.backup_faults(i, "key", ["saved"], "note")


@query("SELECT p_partkey, CASE WHEN p_size > 30 THEN 'fresh' ELSE 'archived' END AS reason FROM part WHERE (p_size > 30 OR p_size % 2 = 0) AND p_type <> 'PROMO'")
def quarantine(spark, sf):
    p = _of(spark, sf, "part", "p_partkey", "p_size", "p_type")
    fresh, old = p.filter("p_size > 30").select("p_partkey", F.lit("fresh").alias("reason")), p.filter("p_size % 2 = 0").select("p_partkey", F.lit("archived").alias("reason"))
    return R.merge_quarantine(old, fresh, "p_partkey", p.filter("p_type = 'PROMO'"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'new' WHEN p_size % 2 = 0 THEN 'old' ELSE '' END AS images, CASE WHEN p_size % 3 > 0 THEN 'ok' WHEN p_size % 2 = 0 THEN 'kept' ELSE 'ok' END AS status FROM part")
def kept_images(spark, sf):
    none, one = F.array().cast("array<string>"), lambda s: F.array(F.lit(s))
    fresh = _of(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", F.when(F.col("p_size") % 3 > 0, one("new")).otherwise(none).alias("images"), F.lit("ok").alias("status"))
    old = _of(spark, sf, "part", "p_partkey", "p_size").filter("p_size % 2 = 0").select("p_partkey", one("old").alias("images"), F.lit("kept").alias("status"))
    return R.last_good_images(fresh, old, ["p_partkey"]).select("p_partkey", F.array_join("images", ",").alias("images"), "status")


@query("""
WITH c AS (SELECT p_type || '|' || split_part(p_name, ' ', 1) AS combo, p_size % 3 > 0 AS t, p_size % 4 = 0 AS v FROM part), n AS (SELECT count(*) AS n, count(*) FILTER (p_size % 4 = 0) AS w FROM part)
SELECT combo, count(*) FILTER (t) AS text, count(*) FILTER (v) AS vision, count(*) FILTER (t AND v) AS hybrid, floor((CASE WHEN combo LIKE 'PROMO%' THEN count(*) FILTER (v) / any_value(w) ELSE count(*) FILTER (t) / any_value(n) END) * 1000000.0 + 0.5) / 1000000.0 AS coverage FROM c, n GROUP BY combo""")
def evidence_coverage(spark, sf):
    from trendloom.functions.expr import half_up

    p = _read(spark, sf, "part").withColumn("combo", F.concat_ws("|", "p_type", F.element_at(F.split("p_name", " "), 1)))
    total = p.agg(F.count("*").alias("n"), F.count_if(F.col("p_size") % 4 == 0).alias("w")).first()
    out = R.evidence_coverage(p, F.col("p_size") % 3 > 0, F.col("p_size") % 4 == 0, F.col("combo").startswith("PROMO"), total["n"], total["w"])
    return out.select("combo", "text", "vision", "hybrid", half_up("coverage", 6).alias("coverage"))


@query("""
WITH t AS (SELECT 'type' AS dimension, p_type AS tag, count(*) AS products, count(DISTINCT p_brand) AS brands FROM part GROUP BY 2 UNION ALL SELECT 'word', split_part(p_name, ' ', 2), count(*), count(DISTINCT p_brand) FROM part GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY products DESC, brands DESC, tag) AS rank FROM t WHERE brands >= 2 AND tag <> 'OTHER') SELECT * FROM r WHERE rank <= 3 ORDER BY products DESC, brands DESC, tag LIMIT 12""")
def signal_clusters(spark, sf):
    pairs = F.array(F.struct(F.lit("type").alias("dimension"), F.col("p_type").alias("tag")), F.struct(F.lit("word").alias("dimension"), F.element_at(F.split("p_name", " "), 2).alias("tag")))
    tags = _read(spark, sf, "part").select("p_brand", F.explode(pairs).alias("p")).groupBy("p.dimension", "p.tag").agg(F.count("*").alias("products"), F.countDistinct("p_brand").alias("brands"))
    return R.signal_clusters(tags)


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_type <> 'PROMO' THEN 'Type: ' || p_type END, CASE WHEN p_size <= 25 THEN 'Size: low' END], lambda x: x IS NOT NULL), ';') AS chips, trim(replace(CASE WHEN p_size % 2 = 0 THEN replace(' ' || p_name || ' suede ', ' ' || split_part(p_name, ' ', 1) || ' ', ' ') ELSE ' ' || p_name || ' suede ' END, ' suede ', ' ')) AS model FROM part")
def grid_items(spark, sf):
    p = _of(spark, sf, "part", "p_partkey", "p_size", "p_name || '  Suede' AS title", "CASE WHEN p_size % 2 = 0 THEN split(p_name, ' ')[0] END AS color", "CASE WHEN p_type = 'PROMO' THEN 'UNKNOWN' ELSE p_type END AS type", "CASE WHEN p_size <= 25 THEN 'low' END AS size")
    return p.select("p_partkey", F.array_join(R.chips({"t": F.col("type"), "s": F.col("size")}, {"t": "Type", "s": "Size"}), ";").alias("chips"), R.without_colorway(F.col("title"), F.col("color"), ("suede", "leather")).alias("model"))


@query(f"WITH {_SEEN}, m AS (SELECT DISTINCT p_partkey, p_brand FROM x WHERE source = 's6') SELECT p_brand, count(*) AS n FROM m GROUP BY p_brand")
def marketplace_brands(spark, sf):
    return _seen(spark, sf).filter(P.on_marketplace(F.col("sightings"), F.col("p_brand"), "s6")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS family, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen FROM lineitem GROUP BY 1 HAVING epoch_us(TIMESTAMP '1995-07-01') - epoch_us(min(l_shipdate)) <= 30 * 86400000000")
def discovered_arrivals(spark, sf):
    from trendloom.operators.catalog import new_arrivals

    first = _read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("family")).agg(F.min("l_shipdate").alias("first_seen"))
    return new_arrivals(first, "first_seen", _ts("1995-07-01"), "30D").select("family", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


@query("SELECT l_suppkey, count(*) AS n, count(*) FILTER (e = 'NEW_ARRIVALS_COLLECTION') AS by_collection FROM (SELECT l_suppkey, CASE WHEN l_quantity > 25 THEN 'NEW_ARRIVALS_COLLECTION' ELSE CASE WHEN l_discount > 0.05 THEN 'CATALOG_DIFF' ELSE 'NEW_BADGE' END END AS e FROM lineitem) GROUP BY l_suppkey")
def strongest_evidence(spark, sf):
    rows = _of(spark, sf, "lineitem", "l_suppkey", "CASE WHEN l_quantity > 25 THEN 'NEW_ARRIVALS_COLLECTION' END AS a", "CASE WHEN l_discount > 0.05 THEN 'CATALOG_DIFF' ELSE 'NEW_BADGE' END AS b")
    best = S.stronger(F.col("a"), F.col("b"))
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(best == "NEW_ARRIVALS_COLLECTION").alias("by_collection"))


# Rules on what a part's name and stand-in fields say.
_HEEL = "CASE p_size % 6 WHEN 0 THEN 'Block Heel' WHEN 1 THEN 'kitten' WHEN 2 THEN 'round' ELSE '' END"


@query(f"""
WITH t AS (SELECT p_partkey, p_type, p_size % 6 AS k, {_HEEL} AS heel FROM part)
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'WEDGE' WHEN k = 0 THEN 'BLOCK' WHEN k = 1 THEN 'KITTEN' WHEN k = 2 THEN 'OTHER' ELSE 'UNKNOWN' END AS heel, CASE k WHEN 0 THEN 'POINTED' WHEN 1 THEN 'SQUARE' ELSE 'UNKNOWN' END AS toe,
  array_to_string(list_filter([CASE WHEN p_type = 'PROMO' THEN 'BACKLESS' END, CASE WHEN k = 2 THEN 'SLINGBACK' END, CASE WHEN k = 3 THEN 'T_STRAP' END], lambda x: x IS NOT NULL), ',') AS construction FROM t""")
def heel_toe_construction(spark, sf):
    from trendloom.functions import rules as T

    p = _of(spark, sf, "part", "p_partkey", "CASE WHEN p_type = 'PROMO' THEN 'WEDGE' END AS c", "CASE WHEN p_type = 'PROMO' THEN 'MULE' END AS m", f"{_HEEL} AS heel", "CASE p_size % 6 WHEN 0 THEN 'pointed toe' WHEN 1 THEN 'Square Toe' WHEN 2 THEN 'a Slingback' WHEN 3 THEN 't-strap' ELSE '' END AS said", "'' AS none")
    return p.select("p_partkey", T.heel_type("heel", "none", "none", "c").alias("heel"), T.toe_shape("said", "none", "none").alias("toe"), F.array_join(T.construction("m", "said"), ",").alias("construction"))


@query("""
WITH q AS (SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'DONE' ELSE 'WAITING' END AS s, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS r, o_orderkey % 50 = 49 AS fresh, o_totalprice FROM orders), d AS (SELECT * FROM q WHERE s <> 'DONE' AND (r IS NULL OR r <= TIMESTAMP '1998-01-01')),
b AS (SELECT * FROM d ORDER BY o_totalprice DESC, key LIMIT 9), l AS (SELECT * FROM d WHERE key NOT IN (SELECT key FROM b) ORDER BY (NOT (fresh AND NOT (SELECT bool_or(fresh) FROM b)))::INT, o_totalprice DESC, key LIMIT 1)
SELECT key FROM b UNION ALL SELECT key FROM l""")
def onboarding_candidates(spark, sf):
    from trendloom.operators import schedule

    q = _of(spark, sf, "orders", "o_orderkey AS key", "CASE o_orderstatus WHEN 'F' THEN 'DONE' ELSE 'WAITING' END AS s", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS r", "o_totalprice")
    ready = q.filter(schedule.due(F.col("s"), F.col("r"), _ts("1998-01-01")))
    return schedule.select_candidates(ready, [F.desc("o_totalprice"), F.asc("key")], 10, F.col("key") % 50 == 49).select("key")


@query(r"""SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<img\b[^>]*?\bsrc\s*=\s*["'']([^"'']*)["'']', 1))) AS images FROM pages""")
def html_images(spark, sf):
    from trendloom.sources import extract

    return _read(spark, sf, "pages").select("page_id", F.size(extract.images(F.col("html"))).cast("long").alias("images"))


@query("SELECT o_custkey, array_to_string(list_distinct_in_order, ',') AS statuses FROM (SELECT o_custkey, list_filter(['F', 'O', 'P'], lambda x: list_contains(a, x) AND x <> 'P') || list_filter(['P', 'F', 'O'], lambda x: x = 'P') AS list_distinct_in_order FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS a FROM orders GROUP BY 1))")
def ordered_union(spark, sf):
    from trendloom.functions.expr import union_keep_order

    o = _read(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("a"))
    own = F.filter("a", lambda x: x != "P")
    return o.select("o_custkey", F.array_join(union_keep_order(own, F.array(F.lit("P")), own), ",").alias("statuses"))


@query("SELECT user_id, CASE WHEN arg_max(event_type = 'signup', (ts, event_type = 'signup')) THEN 'VERIFIED_NEW' WHEN bool_or(event_type = 'signup') THEN 'FORMERLY_NEW' ELSE 'NOT_VERIFIED' END AS status, min(ts) FILTER (event_type = 'signup') AS first_verified FROM events GROUP BY user_id")
def stream_newness(spark, sf):
    from trendloom.plans.history import _drain
    from trendloom.streaming import stateful

    rows = _drain(spark, sf, lambda e: stateful.newness(e.withColumn("verified", F.col("event_type") == "signup"), "user_id", "ts", "verified"), ["user_id"])
    return rows.select("user_id", "status", "first_verified")


@query("SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY 1, 2) GROUP BY user_id")
def sessions(spark, sf):
    """The session windows of the stream on the whole table at once."""
    from trendloom.streaming import stateful

    e = _read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.sessions(e, "ts", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


_RUN = {"state": "CASE s_suppkey % 9 WHEN 0 THEN 'NEEDS_PROBE' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'NEEDS_CUSTOM_ADAPTER' ELSE 'OK' END", "collected": "CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey % 50 END", "reported": "CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 48 END", "exhausted": "s_suppkey % 3 > 0", "errors": "s_suppkey % 2", "capped": "s_suppkey % 11 = 0", "root": "CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 13 > 0 END"}


@query(f"""
WITH r AS (SELECT s_suppkey, {', '.join(f'{e} AS {c}' for c, e in _RUN.items())} FROM supplier)
SELECT s_suppkey, CASE WHEN state LIKE 'NEEDS%' THEN state WHEN collected = 0 AND (state = 'FAILED' OR errors > 0) THEN 'FAILED' WHEN collected > 0 AND coalesce(exhausted AND coalesce(root, true) AND NOT capped AND reported > 0 AND collected >= reported * 0.9::DOUBLE AND collected <= reported * 1.25::DOUBLE, false) THEN 'FULL' ELSE 'PARTIAL' END AS status FROM r""")
def collection_status(spark, sf):
    from trendloom.operators import gates

    r = _of(spark, sf, "supplier", "s_suppkey", *(f"{e} AS {c}" for c, e in _RUN.items()))
    return r.select("s_suppkey", gates.collection_status(*(F.col(c) for c in _RUN)).alias("status"))


@query("""
WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS g FROM part WHERE p_size = 50 AND p_type = 'PROMO'),
o AS (SELECT p_partkey, row_number() OVER (ORDER BY (g > 1)::INT, p_retailprice DESC, p_partkey) - 1 AS place FROM r), f AS (SELECT * FROM o WHERE place < 60), n AS (SELECT greatest(count(*), 1) AS n FROM f)
SELECT i::BIGINT AS place, p_partkey FROM range(60) t(i), n, f WHERE i % n = f.place""")
def cycled_pick(spark, sf):
    from trendloom.operators import catalog

    p = _of(spark, sf, "part", "p_brand", "p_partkey", "p_retailprice", "p_size", "p_type").filter("p_size = 50 AND p_type = 'PROMO'")
    return catalog.cycled(p, "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 60).select("place", "p_partkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate - INTERVAL 1 DAY END) DESC NULLS LAST, o_orderpriority, o_orderkey) AS place FROM orders")
def newest_known_date(spark, sf):
    from pyspark.sql.window import Window

    from trendloom.operators import catalog

    o = _of(spark, sf, "orders", "o_orderkey", "o_custkey", "lower(o_orderpriority) AS name", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS published", "CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate - INTERVAL 1 DAY END AS created")
    order = catalog.newest_by([F.col("published"), F.col("created")], F.col("name"))
    return o.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order, "o_orderkey")).alias("place"))


@query("WITH l AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1), g AS (SELECT o_custkey, max(o_orderdate) AS last_good FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_custkey, o_orderkey, last_good FROM l LEFT JOIN g USING (o_custkey)")
def attempts_with_last_good(spark, sf):
    from trendloom.operators import snapshots

    o = _read(spark, sf, "orders")
    return snapshots.with_last_good(o, o.filter("o_orderstatus = 'F'"), ["o_custkey"], "o_orderdate", [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "last_good")


@query("SELECT p_type AS trend, count(DISTINCT CASE WHEN p_size % 2 = 0 THEN 'group-' || (p_size % 10) ELSE lower(p_brand) END) AS entities, count(DISTINCT p_brand) AS brands, count(DISTINCT l_suppkey || '::' || l_orderkey) AS publications FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type")
def independent_entities(spark, sf):
    from trendloom.operators import trend

    rows = _read(spark, sf, "lineitem").join(_of(spark, sf, "part", "p_partkey AS l_partkey", "p_type AS trend", "p_brand AS brand", "CASE WHEN p_size % 2 = 0 THEN 'Group  ' || (p_size % 10) END AS corporate_group"), "l_partkey")
    rows = rows.withColumns({"source_id": F.col("l_suppkey"), "publication": F.col("l_orderkey").cast("string")})
    return rows.groupBy("trend").agg(F.countDistinct(trend.entity_key()).alias("entities"), F.countDistinct(trend.entity_key(False)).alias("brands"), F.countDistinct(trend.publication_key()).alias("publications"))


_WRITTEN = ("mocassinos preta", "stilettos x", "sandaliasx", "oxford derby", "Running Shoes", "sandália", "sapatilha tenis", "sapatilha preta", "slipper 85", "slippers house", "lace tie", "jute sole", "plain", "sola baixa fivela", "slingback")
_NAMED = ("LOAFER", "PUMP", "SANDAL", "OXFORD_DERBY", "SNEAKER", "SANDAL", "SNEAKER", "BALLET_FLAT", "MULE", "LOAFER", "BALLET_FLAT", "ESPADRILLE", None, "LOAFER", "PUMP")
_SAYS = "CASE p_size % 15 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_WRITTEN)) + " END"
_NAMES = "CASE p_size % 15 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_NAMED) if c) + " END"


@query(f"""SELECT p_partkey, coalesce({_NAMES}, CASE p_partkey % 4 WHEN 0 THEN 'LOAFER' WHEN 1 THEN 'SANDAL' END, CASE WHEN p_partkey % 4 = 2 THEN 'BOOT' END) AS category, p_partkey % 5 = 0 AS other FROM part""")
def official_categories(spark, sf):
    p = _of(spark, sf, "part", "p_partkey", f"p_name || ' ' || {_SAYS} AS title", "CASE p_partkey % 4 WHEN 0 THEN ' Boat  Shoe' WHEN 1 THEN 'Sandals/Slides' ELSE 'Chaussures' END AS kind", "CASE WHEN p_partkey % 4 = 2 THEN 'type:boots|x' ELSE '' END AS tags", "CASE WHEN p_partkey % 5 = 0 THEN 'wool socks' ELSE p_name END AS ware")
    return p.select("p_partkey", K.official_category(F.col("title"), F.col("kind"), F.lit(None).cast("string"), F.col("tags")).alias("category"), K.is_other_ware(F.col("ware")).alias("other"))


@query("""
WITH p AS (SELECT p_partkey, p_size % 4 AS l, p_size % 3 AS t, p_partkey % 7 = 0 AS other, p_type = 'PROMO' AS d FROM part)
SELECT p_partkey, CASE WHEN l > 1 OR other OR NOT (t = 0 OR d) THEN 'REVIEW' ELSE 'RESOLVED' END AS status, CASE WHEN l > 1 OR other THEN NULL WHEN t = 0 THEN 'BOOT' WHEN d THEN 'SANDAL' END AS category, CASE WHEN l > 1 OR other THEN NULL WHEN t = 0 THEN 'title' WHEN d THEN 'description' END AS field FROM p""")
def confirmed_categories(spark, sf):
    p = _of(spark, sf, "part", "p_partkey", "CASE p_size % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'pt' WHEN 2 THEN 'xx' END AS locale", "CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 'a Boot' ELSE 'uma bota' END ELSE p_name END AS title", "CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_size % 4 = 0 THEN 'sandals' ELSE 'rasteira' END ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ' socks' ELSE '' END AS description")
    lexicon = {"en": {"BOOT": "boots?", "SANDAL": "sandals?"}, "pt": {"BOOT": "botas?", "SANDAL": "rasteiras?"}}
    status, category, field = K.confirm_category({"title": F.col("title"), "description": F.col("description")}, lexicon, F.col("locale"), K.NOT_FOOTWEAR)
    return p.select("p_partkey", status.alias("status"), category.alias("category"), field.alias("field"))
