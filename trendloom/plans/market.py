"""Market, catalog and gate queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from trendloom.functions import expr as X
from trendloom.functions import rules as R
from trendloom.operators import catalog as C
from trendloom.operators import gates as G
from trendloom.operators import market as M
from trendloom.operators import merge as V
from trendloom.operators import radar as D
from trendloom.operators import schedule as S


def _read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def tag_counts(spark, sf):
    t = M.tag_counts(_read(spark, sf, "part"), F.split("p_name", " "), "p_brand")
    return t.select("tag", "product_count", "brand_count", F.array_join("brands", ",").alias("brands"))


def tag_counts_single(spark, sf):
    t = M.value_counts(_read(spark, sf, "part"), F.col("p_type"), "p_brand", unknown="PROMO")
    return t.select("tag", "product_count", "brand_count")


def brand_breakdown(spark, sf):
    return M.brand_breakdown(_read(spark, sf, "part"), "p_brand", "p_type")


def top_signals(spark, sf):
    dims = {"category": F.col("p_type"), "size": F.col("p_size"), "word": F.element_at(F.split("p_name", " "), 1)}
    return M.top_signals(_read(spark, sf, "part"), dims, "p_brand")


def unknown_counts(spark, sf):
    docs = _read(spark, sf, "documents").join(_read(spark, sf, "labels"), "doc_id", "left")
    return M.unknown_counts(docs, {"quality": F.col("quality").cast("string"), "lang": F.col("lang")})


def provenance_counts(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", "lang").join(_read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    source = F.when(F.col("quality") == 1, "hybrid").when(F.col("quality") == 0, "vision").otherwise("text")
    return M.provenance_counts(docs.withColumn("source", source), "lang", "source")


def most_common_type(spark, sf):
    return M.most_common(_read(spark, sf, "part"), "p_brand", "p_type")


def rollup_counts(spark, sf):
    return M.counts_with_total(_read(spark, sf, "part"), "p_type")


def registry_report(spark, sf):
    return M.registry_report(_read(spark, sf, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("string")), ["c_mktsegment", "c_nationkey"])


def date_shares(spark, sf):
    return M.date_shares(_read(spark, sf, "events"), F.date_format("ts", "yyyy-MM-dd"))


def _first_ship(spark, sf):
    seen = _read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("first_seen"))
    return _read(spark, sf, "part").join(seen, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_brand", "p_type", "p_name", "first_seen")


def new_arrivals(period, brand=None):
    def run(spark, sf):
        scope = C.brand_scope("p_brand", brand) if brand else None
        return C.new_arrivals(_first_ship(spark, sf), "first_seen", _ts("1995-04-01"), period, scope).select("p_partkey", "p_brand", "first_seen")

    return run


def _arrivals_sql(days, brand=None):
    extra = f" AND upper(trim(p_brand)) = '{brand.strip().upper()}'" if brand else ""
    return f"SELECT p_partkey, p_brand, first_seen FROM part JOIN (SELECT l_partkey, min(l_shipdate) AS first_seen FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE (epoch_us(TIMESTAMP '1995-04-01') - epoch_us(first_seen)) / 86400000000.0 <= {days}{extra}"


def facet_counts(spark, sf):
    fields = {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": X.height_group(F.col("p_size") / 5.0)}
    return C.facet_counts(_read(spark, sf, "part"), fields, {"brand": "Brand#11", "type": "STANDARD"})


_SIZE_SQL = "CASE WHEN p_size / 5.0 <= 2 THEN 'FLAT' WHEN p_size / 5.0 <= 5 THEN 'LOW' WHEN p_size / 5.0 <= 8 THEN 'MID' ELSE 'HIGH' END"


def field_coverage(spark, sf):
    docs = _read(spark, sf, "documents").join(_read(spark, sf, "labels"), "doc_id", "left")
    fields = {"quality": F.col("quality"), "toxic": F.col("toxic"), "lang": F.when(F.col("lang") == "en", "NOT_APPLICABLE").otherwise(F.col("lang"))}
    return C.field_coverage(docs, fields, "source")


def search_parts(spark, sf):
    return C.search(_read(spark, sf, "part"), "  BLUE ", "p_brand", "p_name").select("p_partkey", "p_name")


def unreviewed(spark, sf):
    return C.without_state(_read(spark, sf, "documents").select("doc_id", "source"), _read(spark, sf, "labels"), "doc_id", "quality")


def saved(spark, sf):
    return C.with_state(_read(spark, sf, "documents").select("doc_id", "source"), _read(spark, sf, "labels").withColumn("mark", F.when(F.col("quality") == 1, 1)), "doc_id", "mark")


def next_unreviewed(spark, sf):
    items = C.without_state(_read(spark, sf, "documents").select("doc_id", "source"), _read(spark, sf, "labels"), "doc_id", "quality")
    return C.next_unreviewed(items, "doc_id", 150, 10_000_000)


def newest_per_user(spark, sf):
    return C.newest_per_key(_read(spark, sf, "events"), ["user_id"], "ts", [F.asc("event_id")]).select("user_id", "event_id", "event_type")


def optional_equals(spark, sf):
    return C.optional_equals(_read(spark, sf, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": None}).select("c_custkey", "c_name")


def second_page(spark, sf):
    return C.page(_read(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 48, 1)


def capped_pick(spark, sf):
    return C.capped_pick(_read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")], 2, 20).select("s_suppkey", "s_nationkey")


def one_per_nation(spark, sf):
    return C.one_per_group_then_fill(_read(spark, sf, "supplier"), "s_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")], 30).select("s_suppkey", "s_nationkey")


def size_bins(spark, sf):
    p = _read(spark, sf, "part").withColumn("bin", X.height_group(F.col("p_size") / 5.0))
    return p.groupBy("p_brand", "bin").agg(F.count("*").alias("n"))


def color_families(spark, sf):
    p = _read(spark, sf, "part").withColumn("family", R.color_family(F.lit(None).cast("string"), F.col("p_name")))
    return p.select("p_partkey", "family")


def _color_sql():
    cases = " ".join(f"WHEN regexp_matches(' ' || p_name || ' ', '(?i)(?:^|[\\s/,-])(?:{'|'.join(words)})(?:$|[\\s/,-])') THEN '{family}'" for family, words in R.COLOR_FAMILIES)
    return f"SELECT p_partkey, CASE {cases} ELSE 'UNKNOWN' END AS family FROM part"


def material_families(spark, sf):
    return _read(spark, sf, "part").select("p_partkey", R.material_family(F.col("p_type"), F.col("p_name")).alias("family"))


def _material_sql():
    cases = " ".join(f"WHEN {' OR '.join(f'contains(t, $${w}$$)' for w in words)} THEN '{family}'" for family, words in R.MATERIAL_FAMILIES)
    return f"SELECT p_partkey, CASE {cases} ELSE 'OTHER' END AS family FROM (SELECT p_partkey, lower(p_type || ' ' || p_name) AS t FROM part)"


def text_details(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", R.details(F.col("text")).alias("tags"))
    return d.select("doc_id", F.array_join("tags", "+").alias("tags"))


def _details_sql():
    parts = ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, $${w}$$)' for w in words)} THEN '{tag}' END" for tag, words in R.DETAILS)
    return f"SELECT doc_id, array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), '+') AS tags FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents)"


def _supplier_counts(spark, sf):
    lines = _read(spark, sf, "lineitem")
    got = lines.groupBy(F.col("l_suppkey").alias("source")).agg(F.count_if(F.col("l_returnflag") != "R").alias("collected"), F.count("*").alias("expected"), F.count_if(F.col("l_linestatus") == "O").alias("previous"), F.count_if(F.col("l_extendedprice") <= 0).alias("bad_prices"), (F.count_if(F.col("l_discount") > 0.09) * (F.col("l_suppkey") % 7 == 0).cast("int")).alias("duplicates"))
    return got


_SUPPLIER_SQL = "(SELECT l_suppkey AS source, count(*) FILTER (l_returnflag <> 'R') AS collected, count(*) AS expected, count(*) FILTER (l_linestatus = 'O') AS previous, count(*) FILTER (l_extendedprice <= 0) AS bad_prices, count(*) FILTER (l_discount > 0.09) * (l_suppkey % 7 = 0)::INT AS duplicates FROM lineitem GROUP BY l_suppkey)"


def refresh_health(spark, sf):
    return G.refresh_health(_supplier_counts(spark, sf), least_coverage=66.0).select("source", "coverage", "drop", "status")


def coverage_status(spark, sf):
    s = _supplier_counts(spark, sf)
    return s.select("source", G.coverage_status(F.col("collected"), F.when(F.col("source") % 5 != 0, F.col("expected")), F.col("source") % 2 == 0, least=0.67).alias("status"), G.retained(F.col("collected"), F.col("expected"), 0.66).alias("retained"))


def marketplace_gate(spark, sf):
    s = _supplier_counts(spark, sf)
    g = G.gate(s, (F.col("collected") < 0.66 * F.col("expected"), "LOW_COVERAGE"), (F.col("duplicates") > 0, "DUPLICATE_IDS"), (F.col("previous") > F.col("collected"), "SHRUNK"), (F.col("expected") < 500, "TOO_FEW"))
    return g.select("source", F.array_join("reasons", ",").alias("reasons"), "accepted")


def gate_report(spark, sf):
    verdict = F.when(F.col("p_size") > 40, "EXCLUDE").when(F.col("p_size") > 30, "UNCERTAIN").otherwise("ACCEPT")
    return G.gate_report(_read(spark, sf, "part").withColumn("verdict", verdict).withColumn("name", F.concat_ws("-", "p_name", F.lpad(F.col("p_partkey").cast("string"), 9, "0"))), "p_type", "verdict", "name")


def lanes_missing(spark, sf):
    lines = _read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), "l_shipdate")
    return G.assert_none_missing(lines.filter(F.col("l_shipdate") < _ts("1996-01-01")), lines.filter(F.col("l_shipdate") >= _ts("1996-01-01")), ["s", "p"])


def text_vision(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(_read(spark, sf, "labels"), "doc_id", "left")
    text = F.when(F.col("n_chars") % 3 == 0, "UNKNOWN").otherwise(F.when(F.col("n_chars") > 1500, "long").otherwise("short"))
    vision = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 1, "short").otherwise("long")).when(F.col("quality") == 0, "UNKNOWN")
    value, origin = V.resolve(text, vision, F.col("doc_id") % 10 / 10.0)
    return docs.select("doc_id", value.alias("value"), origin.alias("origin"), F.coalesce(V.conflicts(text, vision), F.lit(False)).alias("conflict"))


_TEXT_VISION_SQL = """
WITH a AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'UNKNOWN' WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS t,
  CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'short' ELSE 'long' END WHEN quality = 0 THEN 'UNKNOWN' END AS v, doc_id % 10 / 10.0 AS c FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT *, t <> 'UNKNOWN' AS kt, coalesce(v <> 'UNKNOWN', false) AS kv FROM a)
SELECT doc_id, CASE WHEN kv AND c >= 0.5 THEN v WHEN kt THEN t WHEN kv THEN v ELSE 'UNKNOWN' END AS value,
  CASE WHEN kv AND c >= 0.5 AND kt AND t = v THEN 'hybrid' WHEN kv AND c >= 0.5 THEN 'vision' WHEN kt THEN 'text' WHEN kv THEN 'vision' ELSE 'none' END AS origin, kt AND kv AND t <> v AS conflict FROM b"""


def stability_classes(spark, sf):
    e = _read(spark, sf, "events").withColumn("run", F.col("event_id") % 3)
    seen = e.groupBy("user_id", "event_type", "run").agg(F.when(F.max("value") > 30, "YES").otherwise("NO").alias("value"))
    users = e.select("user_id").distinct().withColumn("event_type", F.explode(F.array(*map(F.lit, ("click", "view", "purchase", "error", "absent")))))
    return V.stability(seen, users, ["user_id", "event_type"], "run", "value", 3).select("user_id", "event_type", "runs", "verdict")


_STABILITY_SQL = """
WITH u AS (SELECT DISTINCT user_id, unnest(['click','view','purchase','error','absent']) AS event_type FROM events),
r AS (SELECT user_id, event_type, event_id % 3 AS run, max(value) > 30 AS yes FROM events GROUP BY ALL),
s AS (SELECT user_id, event_type, count(*) AS runs, bool_and(yes) AS y, bool_or(yes) AS o FROM r GROUP BY ALL)
SELECT user_id, event_type, coalesce(runs, 0) AS runs, CASE WHEN runs IS NULL OR runs < 3 THEN 'INCOMPLETE_RUN' WHEN y THEN 'STABLE_YES' WHEN NOT o THEN 'STABLE_NO' ELSE 'UNSTABLE' END AS verdict FROM u LEFT JOIN s USING (user_id, event_type)"""


def _combos(spark, sf):
    dims = {"CATEGORY": F.col("p_type"), "HEEL_TYPE": X.height_group(F.col("p_size") / 5.0), "MATERIAL": F.element_at(F.split("p_name", " "), 1)}
    return D.combinations(_read(spark, sf, "part"), dims, [("CATEGORY", "HEEL_TYPE"), ("CATEGORY", "MATERIAL"), ("CATEGORY", "HEEL_TYPE", "MATERIAL")], ["p_partkey", "p_name", "p_brand"])


def cluster_buckets(spark, sf):
    return D.buckets(_combos(spark, sf), "p_partkey", "p_name", "p_brand")


_COMBO_SQL = f"""
p AS (SELECT p_partkey, p_name, p_brand, 'CATEGORY:' || p_type AS a, 'HEEL_TYPE:' || {_SIZE_SQL} AS b, 'MATERIAL:' || split_part(p_name, ' ', 1) AS c FROM part),
combos AS (SELECT p_partkey, p_name, p_brand, unnest([a || '|' || b, a || '|' || c, a || '|' || b || '|' || c]) AS combo FROM p),
bucket AS (SELECT combo, count(DISTINCT p_partkey) AS products, count(DISTINCT p_name) AS families, count(DISTINCT p_brand) AS brands FROM combos GROUP BY combo HAVING count(DISTINCT p_brand) >= 2 AND count(DISTINCT p_name) >= 2)"""


def _scored(spark, sf):
    combos = _combos(spark, sf)
    totals = _read(spark, sf, "part").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("b")).first()
    share = combos.select("p_partkey", F.explode(F.split("combo", r"\|")).alias("attribute")).groupBy("attribute").agg((F.countDistinct("p_partkey") / F.lit(totals["n"])).alias("share"))
    return D.distinctiveness(D.buckets(combos, "p_partkey", "p_name", "p_brand"), share, totals["b"], totals["n"]), combos


def cluster_scores(spark, sf):
    return _scored(spark, sf)[0].select("combo", "products", "penalty", "score", "strength")


_SCORES_SQL = f"""
WITH {_COMBO_SQL},
t AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT p_brand)::DOUBLE AS b FROM part),
share AS (SELECT attribute, count(DISTINCT p_partkey) / (SELECT n FROM t) AS share FROM (SELECT p_partkey, unnest(string_split(combo, '|')) AS attribute FROM combos) GROUP BY attribute),
pen AS (SELECT combo, least(45.0, sum(CASE WHEN share > 0.45 THEN 12.0 WHEN share > 0.3 THEN 6.0 ELSE 0.0 END) + CASE WHEN count(*) = 2 AND min(share) > 0.3 THEN 10.0 ELSE 0.0 END)::DOUBLE AS penalty FROM (SELECT combo, unnest(string_split(combo, '|')) AS attribute FROM bucket) JOIN share USING (attribute) GROUP BY combo),
s AS (SELECT combo, products, families, brands, penalty, products / n AS cov,
  least(brands / b, 1.0::DOUBLE) * 46.0::DOUBLE + least(families / 5.0::DOUBLE, 1.0::DOUBLE) * 14.0::DOUBLE + least(brands / products, 1.0::DOUBLE) * 12.0::DOUBLE + products / n * 10.0::DOUBLE
  + CASE WHEN len(string_split(combo, '|')) = 3 THEN 8 + 8 + 10 + 12 WHEN contains(combo, 'HEEL_TYPE:') THEN 8 + 8 + 8 ELSE 8 END - penalty - CASE WHEN brands <= 2 THEN 10.0 ELSE 0.0 END AS raw FROM bucket JOIN pen USING (combo) CROSS JOIN t),
g AS (SELECT *, CASE WHEN brands >= 5 THEN 'STRONG' WHEN brands >= 3 THEN 'MEDIUM' ELSE 'WEAK' END AS s1 FROM s),
h AS (SELECT *, CASE WHEN s1 = 'STRONG' AND (families < 4 OR cov < 0.12::DOUBLE) THEN 'MEDIUM' ELSE s1 END AS s2 FROM g),
i AS (SELECT *, CASE WHEN s2 = 'MEDIUM' AND (families < 2 OR cov < 0.06::DOUBLE) THEN 'WEAK' ELSE s2 END AS s3 FROM h)
SELECT combo, products, penalty, greatest(0.0, least(100.0, floor(raw::DOUBLE + 0.5)))::DOUBLE AS score, CASE WHEN s3 = 'WEAK' AND brands >= 3 AND families >= 3 AND cov >= 0.1::DOUBLE THEN 'MEDIUM' ELSE s3 END AS strength FROM i WHERE floor(raw::DOUBLE + 0.5) >= 20"""


def cluster_select(spark, sf):
    scored, combos = _scored(spark, sf)
    totals = _read(spark, sf, "part").count()
    candidates = scored.select(F.col("combo").alias("key"), F.col("combo").alias("label"), D.meaningful(F.split("combo", r"\|")).alias("attributes"), "score", "brands", "families", (F.col("products") / F.lit(totals)).alias("coverage"))
    members = combos.select(F.col("combo").alias("key"), F.col("p_partkey").alias("member"))
    return D.select_distinct(candidates, members).select("place", "key", "score", "size")


def task_order(spark, sf):
    o = _read(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("p"))
    return S.task_order(o, S.priority_rank(F.col("p")), "o_orderdate", "o_orderkey").select("o_orderkey", F.col("place").cast("long").alias("place"))


def queue_select(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_orderdate", F.array(F.col("o_custkey"), F.col("o_custkey") % 40 - 40).alias("locks"))
    return S.without_conflicts(o, ["o_orderdate", "key"], "key", "locks", 20).select("key", "o_orderdate")


_QUEUE_SQL = """
WITH RECURSIVE t AS (SELECT o_orderkey AS key, o_orderdate, [o_custkey, o_custkey % 40 - 40] AS locks FROM orders),
g AS (SELECT 0 AS n, []::BIGINT[] AS taken, NULL::BIGINT AS key, NULL::TIMESTAMP AS o_orderdate
  UNION ALL
  SELECT n + 1, taken || best.locks, best.key, best.o_orderdate FROM (SELECT g.n, g.taken, min({'o_orderdate': t.o_orderdate, 'key': t.key, 'locks': t.locks}) AS best FROM g, t WHERE g.n < 20 AND NOT list_has_any(t.locks, g.taken) GROUP BY g.n, g.taken))
SELECT key, o_orderdate FROM g WHERE n > 0"""


QUERIES: dict[str, tuple[Callable, str | None]] = {
    "tag_counts": (tag_counts, "SELECT tag, count(*) AS product_count, count(DISTINCT p_brand) AS brand_count, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS brands FROM (SELECT p_brand, unnest(list_distinct(string_split(p_name, ' '))) AS tag FROM part) GROUP BY tag"),
    "tag_counts_single": (tag_counts_single, "SELECT p_type AS tag, count(*) AS product_count, count(DISTINCT p_brand) AS brand_count FROM part WHERE p_type <> 'PROMO' GROUP BY 1"),
    "brand_breakdown_top5": (brand_breakdown, "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM c) SELECT p_brand, sum(n)::BIGINT AS product_count, array_to_string(list(p_type ORDER BY k) FILTER (k <= 5), ',') AS top_values FROM r GROUP BY p_brand"),
    "top_signals": (top_signals, "WITH e AS (SELECT 0 AS pl, 'category' AS dimension, p_type AS tag, p_brand FROM part UNION ALL SELECT 1, 'size', p_size::VARCHAR, p_brand FROM part UNION ALL SELECT 2, 'word', split_part(p_name, ' ', 1), p_brand FROM part) SELECT dimension, tag, count(*) AS product_count, count(DISTINCT p_brand) AS brand_count FROM e GROUP BY pl, dimension, tag ORDER BY product_count DESC, brand_count DESC, pl, tag LIMIT 12"),
    "unknown_counts": (unknown_counts, "SELECT count(*) AS products, count(*) FILTER (quality IS NULL) AS unknown_quality, count(*) FILTER (coalesce(lang, 'UNKNOWN') = 'UNKNOWN') AS unknown_lang FROM documents LEFT JOIN labels USING (doc_id)"),
    "provenance_counts": (provenance_counts, "SELECT lang, count(*) AS total, count(*) FILTER (quality IS NULL) AS text_count, count(*) FILTER (quality = 0) AS vision_count, count(*) FILTER (quality = 1) AS hybrid_count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"),
    "most_common_type": (most_common_type, "SELECT p_brand, p_type AS most_common, n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1"),
    "rollup_category_counts": (rollup_counts, "SELECT CASE WHEN grouping(p_type) = 1 THEN 'TOTAL' ELSE p_type END AS value, count(*) AS n FROM part GROUP BY ROLLUP (p_type)"),
    "registry_grouping_sets": (registry_report, "SELECT 'c_mktsegment' AS field, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY 2"),
    "date_histogram_share": (date_shares, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, floor(count(*) / (SELECT count(*) FROM events) * 1000 + 0.5) / 10 AS share_percent FROM events GROUP BY 1 ORDER BY n DESC, day LIMIT 10"),
    "new_arrivals_24h": (new_arrivals("24H"), _arrivals_sql(1)),
    "new_arrivals_7d": (new_arrivals("7D"), _arrivals_sql(7)),
    "new_arrivals_30d": (new_arrivals("30D"), _arrivals_sql(30)),
    "new_arrivals_90d": (new_arrivals("90D"), _arrivals_sql(90)),
    "new_arrivals_brand": (new_arrivals("90D", " brand#11"), _arrivals_sql(90, "Brand#11")),
    "facet_counts": (facet_counts, f"WITH p AS (SELECT *, {_SIZE_SQL} AS size, p_brand = 'Brand#11' AS b, p_type = 'STANDARD' AS t FROM part) SELECT 'brand' AS field, p_brand AS value, count(*) AS n FROM p WHERE t GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM p WHERE b GROUP BY 2 UNION ALL SELECT 'size', size, count(*) FROM p WHERE b AND t GROUP BY 2"),
    "field_coverage": (field_coverage, "WITH l AS (SELECT source AS \"group\", unnest(['quality', 'toxic', 'lang']) AS field, unnest([quality::VARCHAR, toxic::VARCHAR, CASE WHEN lang = 'en' THEN 'NOT_APPLICABLE' ELSE lang END]) AS v FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT \"group\", field, count(*) FILTER (v IS NOT NULL AND v NOT IN ('UNKNOWN', 'NOT_APPLICABLE')) AS known, count(*) FILTER (coalesce(v <> 'NOT_APPLICABLE', true)) AS applicable FROM l GROUP BY ALL) SELECT *, CASE WHEN applicable > 0 THEN floor(known / applicable * 100.0 * 10.0 + 0.5) / 10.0 ELSE 0.0 END::DOUBLE AS percent FROM c"),
    "search": (search_parts, "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_brand), 'blue') OR contains(lower(p_name), 'blue')"),
    "anti_unreviewed": (unreviewed, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)"),
    "semi_saved": (saved, "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "next_unreviewed": (next_unreviewed, "SELECT doc_id, source FROM documents WHERE doc_id <> 150 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) ORDER BY (doc_id - 151 + 10000000) % 10000000 LIMIT 1"),
    "newest_nulls_last": (newest_per_user, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) = 1"),
    "optional_equals": (optional_equals, "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "second_page": (second_page, "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 48 OFFSET 48"),
    "capped_pick": (capped_pick, "WITH r AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) SELECT s_suppkey, s_nationkey FROM r WHERE k <= 3 ORDER BY (k > 2)::INT, s_acctbal DESC, s_suppkey LIMIT 20"),
    "one_per_group_then_fill": (one_per_nation, "WITH r AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) SELECT s_suppkey, s_nationkey FROM r ORDER BY (k > 1)::INT, s_acctbal DESC, s_suppkey LIMIT 30"),
    "size_bins": (size_bins, f"SELECT p_brand, {_SIZE_SQL} AS bin, count(*) AS n FROM part GROUP BY ALL"),
    "color_family": (color_families, _color_sql()),
    "material_family": (material_families, _material_sql()),
    "detail_tags": (text_details, _details_sql()),
    "refresh_health": (refresh_health, f"WITH s AS {_SUPPLIER_SQL}, c AS (SELECT *, floor(collected / expected * 100.0 * 10.0 + 0.5) / 10.0 AS coverage, CASE WHEN previous > 0 THEN greatest(0.0, floor((previous - collected) / previous * 100.0 * 10.0 + 0.5) / 10.0) ELSE 0.0 END AS \"drop\" FROM s) SELECT source, coverage::DOUBLE AS coverage, \"drop\"::DOUBLE AS \"drop\", CASE WHEN collected = 0 THEN 'FAILED' WHEN duplicates > 0 THEN 'INVALID_DUPLICATES' WHEN bad_prices > 0 THEN 'INVALID_PRICES' WHEN coverage < 66 THEN 'PARTIAL' WHEN \"drop\" > 40 THEN 'REJECTED_DROP' ELSE 'HEALTHY' END AS status FROM c"),
    "coverage_status": (coverage_status, f"WITH s AS {_SUPPLIER_SQL} SELECT source, CASE WHEN collected = 0 THEN 'FAILED' WHEN source % 5 <> 0 AND source % 2 = 0 AND collected >= expected * 0.67::DOUBLE AND collected <= expected * 1.25 THEN 'FULL' ELSE 'PARTIAL' END AS status, collected >= ceil(expected * 0.66::DOUBLE) AS retained FROM s"),
    "marketplace_gate": (marketplace_gate, f"WITH s AS {_SUPPLIER_SQL}, r AS (SELECT source, list_filter([CASE WHEN collected < 0.66::DOUBLE * expected THEN 'LOW_COVERAGE' END, CASE WHEN duplicates > 0 THEN 'DUPLICATE_IDS' END, CASE WHEN previous > collected THEN 'SHRUNK' END, CASE WHEN expected < 500 THEN 'TOO_FEW' END], lambda x: x IS NOT NULL) AS l FROM s) SELECT source, coalesce(array_to_string(l, ','), '') AS reasons, len(l) = 0 AS accepted FROM r"),
    "gate_report": (gate_report, "WITH p AS (SELECT p_type, CASE WHEN p_size > 40 THEN 'EXCLUDE' WHEN p_size > 30 THEN 'UNCERTAIN' ELSE 'ACCEPT' END AS v, p_name || '-' || lpad(p_partkey::VARCHAR, 9, '0') AS name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type, v ORDER BY name) AS k FROM p) SELECT p_type, count(*) FILTER (v = 'ACCEPT') AS accept, count(*) FILTER (v = 'EXCLUDE') AS exclude, count(*) FILTER (v = 'UNCERTAIN') AS uncertain, coalesce(array_to_string(list(name ORDER BY name) FILTER (v = 'EXCLUDE' AND k <= 10), ','), '') AS first_excluded FROM r GROUP BY p_type"),
    "missing_previous": (lanes_missing, "SELECT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'"),
    "text_vision_merge": (text_vision, _TEXT_VISION_SQL),
    "stability_classes": (stability_classes, _STABILITY_SQL),
    "cluster_buckets": (cluster_buckets, f"WITH {_COMBO_SQL} SELECT * FROM bucket"),
    "cluster_scores": (cluster_scores, _SCORES_SQL),
    "cluster_select": (cluster_select, None),
    "task_order": (task_order, "SELECT o_orderkey, row_number() OVER (ORDER BY least(4, o_orderpriority[1]::INT - 1), o_orderdate, o_orderkey) AS place FROM orders"),
    "queue_select": (queue_select, _QUEUE_SQL),
}
