"""Snapshot, merge, identity, extraction and stream queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from trendloom import stars
from trendloom.functions import expr as X
from trendloom.operators import identity as I
from trendloom.operators import snapshots as S
from trendloom.plans.market import _read, _ts
from trendloom.sources import extract as E

NOW_MONTH, BEFORE_MONTH = ("1998-02-01", "1998-03-01"), ("1998-01-01", "1998-02-01")


def _orders(spark, sf, bounds):
    return _read(spark, sf, "orders").filter((F.col("o_orderdate") >= _ts(bounds[0])) & (F.col("o_orderdate") < _ts(bounds[1])))


def _month(bounds):
    return f"(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{bounds[0]}' AND o_orderdate < TIMESTAMP '{bounds[1]}')"


def new_products(spark, sf):
    return S.new_rows(_orders(spark, sf, NOW_MONTH).select("o_custkey").distinct(), _orders(spark, sf, BEFORE_MONTH), ["o_custkey"])


def removed_products(spark, sf):
    return S.removed_rows(_orders(spark, sf, NOW_MONTH), _orders(spark, sf, BEFORE_MONTH).select("o_custkey").distinct(), ["o_custkey"])


def signal_changes(spark, sf):
    def rows(bounds):
        return _orders(spark, sf, bounds).select("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string").alias("brand"))

    c = S.signal_changes(rows(NOW_MONTH), rows(BEFORE_MONTH), ["o_orderpriority", "o_orderstatus"], "brand")
    return c.select("o_orderpriority", "o_orderstatus", F.col("now").alias("products_now"), F.col("before").alias("products_before"), "delta", "brand_delta", "change_percent", "new_brands", "gone_brands", F.substring(F.sha2(F.array_join("first_new", ","), 256), 1, 8).alias("first_new"))


_SIGNAL_SQL = f"""
WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, list(DISTINCT o_custkey::VARCHAR) AS b FROM {_month(NOW_MONTH)} GROUP BY ALL),
p AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, list(DISTINCT o_custkey::VARCHAR) AS b FROM {_month(BEFORE_MONTH)} GROUP BY ALL),
j AS (SELECT o_orderpriority, o_orderstatus, coalesce(c.n, 0) AS a, coalesce(p.n, 0) AS z, coalesce(c.b, []::VARCHAR[]) AS ab, coalesce(p.b, []::VARCHAR[]) AS zb FROM c FULL JOIN p USING (o_orderpriority, o_orderstatus))
SELECT o_orderpriority, o_orderstatus, a::BIGINT AS products_now, z::BIGINT AS products_before, (a - z)::BIGINT AS delta, (len(ab) - len(zb))::BIGINT AS brand_delta,
  CASE WHEN z > 0 THEN floor((a - z)::DOUBLE / z * 100.0 * 10.0 + 0.5) / 10.0 END AS change_percent,
  len(list_filter(ab, lambda x: NOT list_contains(zb, x)))::BIGINT AS new_brands, len(list_filter(zb, lambda x: NOT list_contains(ab, x)))::BIGINT AS gone_brands,
  sha256(array_to_string(list_sort(list_filter(ab, lambda x: NOT list_contains(zb, x)))[1:24], ','))[1:8] AS first_new FROM j"""


def _catalog(spark, sf, lo, hi):
    lines = _read(spark, sf, "lineitem").filter((F.col("l_shipdate") >= _ts(lo)) & (F.col("l_shipdate") < _ts(hi)))
    # hardly two lines are of one item, so they are dealt as they are
    lines = stars.spread(lines.select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity"), "l_suppkey", "l_partkey", "l_returnflag")
    return lines.groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("model"), F.col("l_returnflag").alias("color")).agg((F.sum(F.col("l_quantity").cast("decimal(12,2)")) > 30).alias("in_stock"), F.max("l_quantity").alias("price")).withColumn("model", F.concat_ws("-", "s", "model")).drop("s").withColumn("item", F.concat_ws("-", "model", "color"))


def catalog_events(spark, sf):
    e = S.catalog_events(_catalog(spark, sf, "1997-01-01", "1998-01-01"), _catalog(spark, sf, "1996-01-01", "1997-01-01"), ["item"], "model", "color")
    return e


def _cat_sql(lo, hi):
    return f"(SELECT l_suppkey || '-' || l_partkey AS model, l_returnflag AS color, l_suppkey || '-' || l_partkey || '-' || l_returnflag AS item, sum(l_quantity::DECIMAL(12,2)) > 30 AS in_stock, max(l_quantity) AS price FROM lineitem WHERE l_shipdate >= TIMESTAMP '{lo}' AND l_shipdate < TIMESTAMP '{hi}' GROUP BY l_suppkey, l_partkey, l_returnflag)"


_EVENTS_SQL = f"""
WITH c AS {_cat_sql('1997-01-01', '1998-01-01')}, p AS {_cat_sql('1996-01-01', '1997-01-01')},
j AS (SELECT coalesce(c.item, p.item) AS item, c.item IS NOT NULL AS isn, p.item IS NOT NULL AS was, c.in_stock AS sn, p.in_stock AS sb, c.price AS price_now, p.price AS price_before,
  c.model IN (SELECT model FROM p) AS mk, (c.model, c.color) IN (SELECT (model, color) FROM p) AS ck FROM c FULL JOIN p ON c.item = p.item),
e AS (SELECT *, unnest(list_filter([CASE WHEN isn AND was AND sn AND NOT sb THEN 'RESTOCK' END, CASE WHEN isn AND was AND price_now <> price_before THEN 'PRICE_CHANGE' END,
  CASE WHEN isn AND NOT was AND mk AND NOT ck THEN 'NEW_COLOR' END, CASE WHEN isn AND NOT was AND NOT mk THEN 'NEW_MODEL' END, CASE WHEN isn AND NOT was AND mk AND ck THEN 'RESTOCK' END, CASE WHEN isn AND was AND NOT (sn AND NOT sb) AND price_now = price_before THEN 'UNCHANGED' END, CASE WHEN NOT isn THEN 'REMOVED' END], lambda x: x IS NOT NULL)) AS event FROM j)
SELECT item, event, price_before, price_now FROM e"""


def first_last_seen(spark, sf):
    return S.first_last_seen(_read(spark, sf, "lineitem"), ["l_partkey"], "l_shipdate")


def latest_attempt(spark, sf):
    o = _read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return S.latest_per_key(o, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey", "status")


def retention_gate(spark, sf):
    l = _read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count_if(F.col("l_returnflag") != "R").alias("collected"), F.count_if(F.col("l_returnflag") != "A").alias("expected"), F.count("*").alias("previous"))
    return S.last_good(l, most_drop_percent=33.0).select("source", "coverage_percent", "drop_percent", F.array_join("problems", ",").alias("problems"), "publish")


_RETENTION_SQL = """
WITH s AS (SELECT l_suppkey AS source, count(*) FILTER (l_returnflag <> 'R') AS c, count(*) FILTER (l_returnflag <> 'A') AS e, count(*) AS p FROM lineitem GROUP BY 1),
r AS (SELECT *, floor(c / e * 100.0 * 10.0 + 0.5) / 10.0 AS cov, floor((p - c) / p * 100.0 * 10.0 + 0.5) / 10.0 AS dr FROM s),
x AS (SELECT *, list_filter([CASE WHEN c = 0 THEN 'EMPTY' END, CASE WHEN cov < 95 THEN 'LOW_COVERAGE' END, CASE WHEN dr > 33 THEN 'SHARP_DROP' END], lambda x: x IS NOT NULL) AS l FROM r)
SELECT source, cov::DOUBLE AS coverage_percent, dr::DOUBLE AS drop_percent, coalesce(array_to_string(l, ','), '') AS problems, len(l) = 0 AS publish FROM x"""


def failed_source_preserve(spark, sf):
    l = _read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    fresh, old = l.filter((F.col("l_shipdate") >= _ts("2001-01-01")) & (F.col("l_suppkey") % 5 != 0)), l.filter(F.col("l_shipdate") < _ts("1995-06-01"))
    failed = _read(spark, sf, "supplier").filter(F.col("s_suppkey") % 5 == 0).select(F.col("s_suppkey").alias("l_suppkey"))
    return S.preserve_failed(fresh, old, failed, "l_suppkey").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


def merge_catalog(spark, sf):
    def side(lo, hi):
        return _read(spark, sf, "lineitem").filter((F.col("l_shipdate") >= _ts(lo)) & (F.col("l_shipdate") < _ts(hi))).groupBy("l_partkey").agg(F.min("l_shipdate").alias("seen"), F.max("l_quantity").alias("quantity"), F.max("l_returnflag").alias("flag"), (F.max("l_discount") > 0.08).alias("badge"))

    return S.merge_catalog(side("1995-01-01", "1996-01-01"), side("1996-01-01", "1996-04-01"), ["l_partkey"], {"seen": "min", "quantity": "coalesce", "flag": "keep", "badge": "or"})


def _side_sql(lo, hi):
    return f"(SELECT l_partkey, min(l_shipdate) AS seen, max(l_quantity) AS quantity, max(l_returnflag) AS flag, max(l_discount) > 0.08 AS badge FROM lineitem WHERE l_shipdate >= TIMESTAMP '{lo}' AND l_shipdate < TIMESTAMP '{hi}' GROUP BY l_partkey)"


def keyed_union(spark, sf):
    o = lambda b: _orders(spark, sf, b).groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return S.keyed_union(o(BEFORE_MONTH), o(NOW_MONTH), ["o_custkey"])


def newness_states(spark, sf):
    e = _read(spark, sf, "events").withColumn("verified", F.col("event_type") == "signup")
    return S.newness_state(e, "user_id", "ts", "verified")


def global_dedupe(spark, sf):
    return S.first_of_each(_read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h")), ["h"], "doc_id").select("doc_id")


def canonical_urls(spark, sf):
    p = _read(spark, sf, "pages").select("page_id", X.strip_tracking(X.canonical_url("url")).alias("url"), X.token("url").alias("token"), X.slug("url").alias("slug"))
    return p


def html_titles(spark, sf):
    return _read(spark, sf, "pages").select("page_id", E.title(F.col("html")).alias("title"))


def html_links(spark, sf):
    p = _read(spark, sf, "pages").select("page_id", F.explode(E.links(F.col("html"))).alias("link"))
    return p.groupBy("page_id").agg(F.count("*").alias("links"), F.min("link").alias("first_link"))


def html_fields(spark, sf):
    spec = E.Spec({"heading": r"(?is)<h1[^>]*>(.*?)</h1>", "language": r'(?i)<html[^>]*\blang="([^"]*)"'})
    return E.extract(_read(spark, sf, "pages"), "html", spec).select("page_id", "heading", "language")


def absolute_links(spark, sf):
    p = _read(spark, sf, "pages").select("page_id", "url", F.explode(E.links(F.col("html"))).alias("link"))
    return p.select("page_id", E.absolute(F.col("link"), F.col("url")).alias("link"))


def json_props(spark, sf):
    e = _read(spark, sf, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("known"), F.sum("k").alias("total"), F.max("k").alias("largest"))


def model_names(spark, sf):
    name = I.model_name(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("Nails - Red")), ("cold", "blue"), ("widget", "bolt", "nail"))
    return _read(spark, sf, "part").select("p_partkey", name.alias("model_name"))


_MODEL_SQL = """
WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' nails'), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('cold','blue','spring','summer','fall','winter','resort','ss','fw','new')) AS l FROM part),
s AS (SELECT p_partkey, list_transform(l, lambda x: CASE WHEN len(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END) AS l FROM w),
a AS (SELECT *, list_min(list_filter([list_position(l, 'widget'), list_position(l, 'bolt'), list_position(l, 'nail')], lambda x: x > 0)) AS k FROM s)
SELECT p_partkey, array_to_string(CASE WHEN k IS NOT NULL THEN l[1:k] ELSE l END, ' ') AS model_name FROM a"""


def _keyed(spark, sf):
    p = _read(spark, sf, "part")
    style = F.when(F.col("p_size") % 3 == 0, F.concat_ws("-", F.substring("p_type", 1, 2), F.col("p_size").cast("string")))
    handle = F.when(F.col("p_size") % 3 == 1, X.strip_tail_tokens(X.slug("p_name"), ["widget", "bolt", "rod"]))
    return I.family_keys(p, style, handle, F.lower("p_name"))


def families_blocking(spark, sf):
    return I.families(_keyed(spark, sf), "p_brand", "p_partkey")


_FAMILY_KEY = """CASE WHEN p_size % 3 = 0 THEN 'style:' || p_type[1:2] || '-' || p_size WHEN p_size % 3 = 1 THEN 'handle:' || regexp_replace(replace(lower(p_name), ' ', '-'), '([^-])(-(widget|bolt|rod))+$', '\\1') ELSE 'name:' || lower(p_name) END"""


def families_components(spark, sf):
    """Parts that one supplier and brand deliver belong together; the whole table, so there is no SQL for the closure."""
    brands = _read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    items = _read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").join(brands, "l_partkey")
    return I.block_components(items.withColumnRenamed("l_partkey", "node"), ["l_suppkey", "p_brand"], "node")


_OLD = "o_orderdate < TIMESTAMP '1998-06-01'"
_VARIANT = {"id": "concat('c', o_custkey % 60, '-', o_orderkey % 3)", "brand": "concat(' B', o_custkey % 7, ' ')", "url": "concat('HTTP://x/P', o_orderkey % 211, CASE WHEN o_orderkey % 5 = 0 THEN '//' ELSE '' END)"}


def reanchored(spark, sf):
    old = _read(spark, sf, "orders").selectExpr("cast(o_orderdate as timestamp) AS o_orderdate", *(f"{v} AS {k}" for k, v in _VARIANT.items()))
    prior = old.filter(_OLD).select(F.when(F.col("id").endswith("2"), F.concat("id", F.lit("--fresh"))).otherwise(F.col("id")).alias("old_id"), F.lower(F.trim("brand")).alias("brand"), "url")
    # Equal variants go the same way: they are counted first.
    fresh = old.filter(f"NOT {_OLD}").groupBy(F.col("id").alias("fresh_id"), "brand", "url").agg(F.count("*").alias("n"))
    return I.reanchor(fresh, prior).groupBy("anchored_id", "fresh_id").agg(F.sum("n").alias("variants"))


def conversation_sequence(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _read(spark, sf, "conversations").withColumn("before", F.lag("role").over(w))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("before") != F.col("role")).alias("changes"), F.min_by("role", "turn").alias("opens"))


def jaccard_overlap(spark, sf):
    p = _read(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("names"))
    a, b = p.alias("a"), p.alias("b")
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("int")
    near = a.withColumn("next", F.concat(F.lit("Brand#"), number(F.col("p_brand")) + 1)).join(b.select(F.col("p_brand").alias("next"), F.col("names").alias("other")), "next")
    return near.select("p_brand", "next", X.half_up(X.jaccard(F.col("names"), F.col("other")), 6).alias("jaccard"), X.half_up(X.containment(F.col("names"), F.col("other")), 6).alias("containment"))


def stream_daily(spark, sf):
    """The windowed count as a stream: the events file read as a stream, run to its end."""
    from trendloom.streaming import stateful

    return _drain(spark, sf, lambda e: stateful.windowed_counts(e, "ts", "event_type").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n"), ["day", "event_type"])


def stream_seen(spark, sf):
    from trendloom.streaming import stateful

    return _drain(spark, sf, lambda e: stateful.seen_range(e, "user_id", "ts"), ["user_id"])


def stream_item_events(spark, sf):
    """The same two catalogs as snapshots of a stream, each by a query of its own from one checkpoint; events of the second."""
    from trendloom.sources.shards import read_lane
    from trendloom.streaming import stateful

    folder = stream_folder(spark)
    run = stateful.item_events(f"{folder}/lane")
    for since, until in (("1996-01-01", "1997-01-01"), ("1997-01-01", "1998-01-01")):
        snapshot = _catalog(spark, sf, since, until).select(F.lit("shop").alias("source"), "item", "model", "color", "in_stock", "price")
        snapshot.write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(snapshot.schema).parquet(f"{folder}/in")
        rows.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read_lane(spark, f"{folder}/lane", "events").select("item", "event", "price_before", "price_now")


def stream_folder(spark) -> str:
    """A new folder that all executors see."""
    import uuid

    stars.durable(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _drain(spark, sf, build, key):
    from trendloom.streaming import stateful

    # Only this file of the folder is the stream.
    source = spark.readStream.schema(_read(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return stateful.latest_rows(build(source), stream_folder(spark), key)


def _decoded(sql: str) -> str:
    for name, char in E.ENTITIES.items():
        sql = f"replace({sql}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return sql


_REANCHOR_SQL = f"""
WITH v AS (SELECT o_orderdate, {', '.join(f'{v} AS {k}' for k, v in _VARIANT.items())}, upper(trim(brand)) AS b, rtrim(lower(trim(url)), '/') AS k FROM orders),
p AS (SELECT DISTINCT CASE WHEN id LIKE '%2' THEN id || '--fresh' ELSE id END AS old_id, b, k FROM v WHERE {_OLD}),
m AS (SELECT id AS fresh_id, old_id FROM v LEFT JOIN p USING (b, k) WHERE NOT {_OLD}),
n AS (SELECT fresh_id, count(DISTINCT old_id) AS anchors, min(old_id) AS sole FROM m GROUP BY ALL),
f AS (SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM p WHERE old_id = fresh_id) THEN fresh_id WHEN NOT EXISTS (SELECT 1 FROM p WHERE old_id = fresh_id || '--fresh') THEN fresh_id || '--fresh' ELSE fresh_id || '--fresh--fresh' END AS free_id FROM n)
SELECT coalesce(old_id, CASE anchors WHEN 0 THEN fresh_id WHEN 1 THEN sole ELSE free_id END) AS anchored_id, fresh_id, count(*) AS variants FROM m JOIN f USING (fresh_id) GROUP BY ALL"""


QUERIES: dict[str, tuple[Callable, str | None]] = {
    "new_products": (new_products, f"SELECT o_custkey FROM {_month(NOW_MONTH)} EXCEPT SELECT o_custkey FROM {_month(BEFORE_MONTH)}"),
    "removed_products": (removed_products, f"SELECT o_custkey FROM {_month(BEFORE_MONTH)} EXCEPT SELECT o_custkey FROM {_month(NOW_MONTH)}"),
    "signal_changes": (signal_changes, _SIGNAL_SQL),
    "catalog_events": (catalog_events, _EVENTS_SQL),
    "stream_item_events": (stream_item_events, _EVENTS_SQL),
    "first_last_seen": (first_last_seen, "SELECT l_partkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) AS sightings FROM lineitem GROUP BY l_partkey"),
    "latest_attempt": (latest_attempt, "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1 THEN 'CURRENT' ELSE 'SUPERSEDED' END AS status FROM orders"),
    "retention_gate": (retention_gate, _RETENTION_SQL),
    "failed_source_preserve": (failed_source_preserve, "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_shipdate >= TIMESTAMP '2001-01-01' AND l_suppkey % 5 <> 0) OR (l_shipdate < TIMESTAMP '1995-06-01' AND l_suppkey % 5 = 0)"),
    "merge_catalog": (merge_catalog, f"SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, least(a.seen, b.seen) AS seen, coalesce(b.quantity, a.quantity) AS quantity, coalesce(a.flag, b.flag) AS flag, coalesce(a.badge, false) OR coalesce(b.badge, false) AS badge FROM {_side_sql('1995-01-01', '1996-01-01')} a FULL JOIN {_side_sql('1996-01-01', '1996-04-01')} b ON a.l_partkey = b.l_partkey"),
    "keyed_union": (keyed_union, f"WITH n AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM {_month(NOW_MONTH)} GROUP BY 1), o AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM {_month(BEFORE_MONTH)} GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n)"),
    "newness_states": (newness_states, "SELECT user_id, CASE WHEN arg_max(event_type, ts) = 'signup' THEN 'VERIFIED_NEW' WHEN bool_or(event_type = 'signup') THEN 'FORMERLY_NEW' ELSE 'NOT_VERIFIED' END AS status, min(ts) FILTER (event_type = 'signup') AS first_verified, max(ts) FILTER (event_type = 'signup') AS last_verified FROM events GROUP BY user_id"),
    "global_dedupe": (global_dedupe, "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text"),
    "canonical_url": (canonical_urls, r"SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(url, '/$', '')), 'utm_[^&#]*&?', '', 'g'), '[?&]$', '') AS url, lower(trim(url)) AS token, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages"),
    "html_title": (html_titles, rf"SELECT page_id, trim(regexp_replace({_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) AS title FROM pages"),
    "html_links": (html_links, r"""SELECT page_id, count(DISTINCT link) AS links, min(link) AS first_link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS link FROM pages) GROUP BY page_id"""),
    "html_fields": (html_fields, rf"""SELECT page_id, trim(regexp_replace({_decoded("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '\s+', ' ', 'g')) AS heading, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS language FROM pages"""),
    "absolute_links": (absolute_links, r"""SELECT DISTINCT page_id, CASE WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || link WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link ELSE regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/' || link END AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS link FROM pages)"""),
    "json_props": (json_props, "SELECT event_type, count(k) AS known, sum(k)::BIGINT AS total, max(k) AS largest FROM (SELECT event_type, (props::JSON->>'$.k')::BIGINT AS k FROM events) GROUP BY event_type"),
    "model_name_normalize": (model_names, _MODEL_SQL),
    "families_blocking": (families_blocking, f"SELECT p_brand, {_FAMILY_KEY} AS family_key, min(p_partkey) AS representative, count(*) AS variants, CASE min(p_size % 3) WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM part GROUP BY 1, 2"),
    "families_components": (families_components, None),
    "reanchor_ids": (reanchored, _REANCHOR_SQL),
    "conversation_sequence": (conversation_sequence, "SELECT conv_id, count(*) AS turns, count(*) FILTER (b <> role) AS changes, arg_min(role, turn) AS opens FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) GROUP BY conv_id"),
    "cluster_jaccard": (jaccard_overlap, "WITH p AS (SELECT p_brand, list(DISTINCT p_name) AS n, regexp_extract(p_brand, '(\\d+)$', 1)::INT AS k FROM part GROUP BY p_brand) SELECT a.p_brand, b.p_brand AS next, floor(len(list_intersect(a.n, b.n)) / len(list_distinct(a.n || b.n)) * 1000000.0 + 0.5) / 1000000.0 AS jaccard, floor(len(list_intersect(a.n, b.n)) / len(a.n) * 1000000.0 + 0.5) / 1000000.0 AS containment FROM p a JOIN p b ON b.k = a.k + 1"),
    "stream_daily_counts": (stream_daily, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_first_last_seen": (stream_seen, "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings FROM events GROUP BY user_id"),
}
