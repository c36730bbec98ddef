"""Registry and report queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from trendloom.operators import identity as I
from trendloom.operators import registry as G
from trendloom.plans.history import _FAMILY_KEY, _keyed
from trendloom.plans.market import _read, _ts
from trendloom.sources import extract as E


def enriched_labels(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).cast("int").alias("quality"))
    return G.enrich(docs, _read(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), ["doc_id"], ["quality"])


def retained_archive(spark, sf):
    def side(month, after):
        return _read(spark, sf, "orders").filter((F.col("o_orderdate") >= _ts(month)) & (F.col("o_orderdate") < _ts(after))).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("variants"))

    out = G.retain_archive(side("1998-01-01", "1998-02-01"), side("1998-02-01", "1998-03-01"), ["o_custkey"], "variants")
    return out.select("o_custkey", F.array_join(F.sort_array("variants"), ",").alias("variants"), "archived")


_ARCHIVE = "(SELECT o_custkey, list(DISTINCT o_orderpriority) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '{}' AND o_orderdate < TIMESTAMP '{}' GROUP BY o_custkey)"


def url_collisions(spark, sf):
    l = _read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("url")).distinct()
    return G.collisions(l, "source", "url").groupBy("source").agg(F.count("*").alias("shared"), F.max("sources").alias("most"))


def discovered_parts(spark, sf):
    p = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    universe = p.filter(F.col("id") % 7 == 0).select("id", F.lit(None).cast("string").alias("name")).unionByName(p.filter(F.col("id") < 20).select(F.lit(None).cast("long").alias("id"), "name"))
    return G.discover(p, universe, ["id", "name"])


def queued_customers(spark, sf):
    c = _read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    queue = c.filter(F.col("id") % 2 == 0).select("id", "name", F.col("id").alias("position"))
    return G.append_to_queue(queue, c, ["id", "name"], {"hundreds": -F.floor(F.col("c_acctbal") / 100)}, [F.desc("c_acctbal"), F.asc("id")]).select("id", "position")


def link_coverage(spark, sf):
    host = F.regexp_extract("url", r"^https?://(?:[^/.]+\.)?([^/.]+\.[^/]+)/", 1)
    p = _read(spark, sf, "pages").select(host.alias("host"), (F.size(E.links(F.col("html"))) - 4).alias("n"))
    return G.coverage_histogram(p, "host", F.greatest(F.col("n"), F.lit(0)))


def suspicious_fields(spark, sf):
    d = _read(spark, sf, "documents").join(_read(spark, sf, "labels"), "doc_id", "left")
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("UNKNOWN")).alias("value")) for f in ("lang", "source", "quality", "toxic")])
    return G.suspicious_values(d.select(F.explode(values).alias("v")).select("v.field", "v.value"), "field", "value", share=0.8)


def family_report(spark, sf):
    return G.family_report(I.families(_keyed(spark, sf), "p_brand", "p_partkey"), "variants")


def source_report(spark, sf):
    d = _read(spark, sf, "documents").join(_read(spark, sf, "labels"), "doc_id", "left")
    return G.source_report(d, "source", F.col("n_chars") > 50, F.col("quality") == 1)


def collection_verdicts(spark, sf):
    return G.collection_verdicts(_read(spark, sf, "part"), "p_name", F.col("p_size") < 36)


def seasons(spark, sf):
    now = _ts("2001-06-30")
    ships = _read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    p = _read(spark, sf, "part").join(ships, "p_partkey")
    text = F.concat_ws(" ", "p_name", F.when(F.col("p_size") == 7, "SS 27"), F.when(F.col("p_size") == 9, "FW-26"), F.when(F.col("p_size") == 11, "outlet"), F.when(F.col("p_size") % 5 == 0, "snow"), F.when(F.col("p_size") % 6 == 0, "straw"))
    category = F.when(F.col("p_type") == "SMALL", "SANDAL").when(F.col("p_type") == "LARGE", "BOOT").otherwise(F.col("p_type"))
    seen = F.when(F.col("p_size") % 2 == 0, F.col("b")).otherwise(F.col("a"))
    stage = G.lifecycle(text, F.col("p_size") % 4 == 0, F.col("b"), now)
    season, score = G.season(text, category, stage, seen, now)
    return p.select("p_partkey", season.alias("season"), score.cast("int").alias("score"), stage.alias("lifecycle"))


_SEASON_SQL = """
WITH s AS (SELECT l_partkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY l_partkey),
p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 0 THEN b ELSE a END AS seen, p_size = 7 AS sl, p_size = 9 AS wl, CASE WHEN p_size = 11 THEN 'SALE' WHEN p_size % 4 = 0 THEN 'NEW_ARRIVAL' WHEN epoch_us(TIMESTAMP '2001-06-30') - epoch_us(b) > 120 * 86400000000 THEN 'ARCHIVE' ELSE 'CURRENT' END AS lifecycle,
  p_type = 'SMALL' AS sc, p_type = 'LARGE' AS wc, p_size % 6 = 0 AS st, p_size % 5 = 0 AS wt FROM part JOIN s ON l_partkey = p_partkey),
r AS (SELECT *, CASE WHEN sl THEN 1 WHEN wl THEN 2 WHEN lifecycle <> 'NEW_ARRIVAL' AND epoch_us(TIMESTAMP '2001-06-30') - epoch_us(seen) > 180 * 86400000000 THEN 3 WHEN (sc OR st) AND NOT (wc OR wt) THEN 4 WHEN (wc OR wt) AND NOT (sc OR st) THEN 5 WHEN lifecycle = 'NEW_ARRIVAL' AND month(seen) BETWEEN 3 AND 8 THEN 6 WHEN lifecycle = 'NEW_ARRIVAL' THEN 7 ELSE 8 END AS k FROM p)
SELECT p_partkey, CASE WHEN k IN (1, 4, 6) THEN 'SS27' WHEN k IN (2, 5, 7) THEN 'AW26_27' ELSE 'CARRY_OVER' END AS season, CASE k WHEN 1 THEN 100 WHEN 2 THEN 100 WHEN 3 THEN 88 WHEN 4 THEN CASE WHEN sc AND st THEN 92 ELSE 84 END WHEN 5 THEN CASE WHEN wc AND wt THEN 92 ELSE 84 END WHEN 6 THEN 68 WHEN 7 THEN 68 ELSE 55 END AS score, lifecycle FROM r"""


def lock_pairs(spark, sf):
    s = _read(spark, sf, "supplier").select("s_suppkey", F.array(F.col("s_nationkey"), F.col("s_nationkey") + 1).alias("locks"))
    return G.lock_holders(s, "s_suppkey", "locks")


def paged_reads(spark, sf):
    e = _read(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("page")).agg(F.count("*").alias("n"))
    return G.page_runs(e.withColumn("n", F.when(F.col("n") == 1, 0).otherwise(F.col("n"))), "user_id", "page", "n")


QUERIES: dict[str, tuple[Callable, str | None]] = {
    "sidecar_enrichment": (enriched_labels, "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 1 END, quality)::INT AS quality FROM documents LEFT JOIN labels USING (doc_id)"),
    "archive_retention": (retained_archive, f"SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, array_to_string(list_sort(list_distinct(coalesce(b.v, []::VARCHAR[]) || coalesce(a.v, []::VARCHAR[]))), ',') AS variants, b.v IS NULL AS archived FROM {_ARCHIVE.format('1998-01-01', '1998-02-01')} a FULL JOIN {_ARCHIVE.format('1998-02-01', '1998-03-01')} b ON a.o_custkey = b.o_custkey"),
    "url_collisions": (url_collisions, "WITH l AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS url FROM lineitem), s AS (SELECT url, count(DISTINCT source) AS sources FROM l GROUP BY url HAVING count(DISTINCT source) > 1) SELECT source, count(*) AS shared, max(sources) AS most FROM l JOIN s USING (url) GROUP BY source"),
    "brand_discovery": (discovered_parts, "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 7 <> 0 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey < 20)"),
    "queue_merge": (queued_customers, "SELECT c_custkey AS id, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0) + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer WHERE c_custkey % 2 <> 0"),
    "image_coverage": (link_coverage, r"""WITH p AS (SELECT regexp_extract(url, '^https?://(?:[^/.]+\.)?([^/.]+\.[^/]+)/', 1) AS host, greatest(0, len(list_distinct(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1))) - 4) AS c FROM pages) SELECT host, count(*) AS items, count(*) FILTER (c = 0) AS "none", count(*) FILTER (c = 1) AS one, count(*) FILTER (c >= 2) AS two_or_more, count(*) FILTER (c >= 3) AS three_or_more, floor(avg(c) * 100.0 + 0.5) / 100.0 AS mean FROM p GROUP BY host"""),
    "suspicious_values": (suspicious_fields, "WITH l AS (SELECT unnest(['lang','source','quality','toxic']) AS field, unnest([coalesce(lang,'UNKNOWN'), coalesce(source,'UNKNOWN'), coalesce(quality::VARCHAR,'UNKNOWN'), coalesce(toxic::VARCHAR,'UNKNOWN')]) AS value FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT field, value, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT field, coalesce(sum(n) FILTER (value <> 'UNKNOWN'), 0)::BIGINT AS known, sum(n)::BIGINT AS total, arg_max(value, (n, value)) FILTER (value <> 'UNKNOWN') AS top_value, max(n) FILTER (value <> 'UNKNOWN') AS top FROM c GROUP BY field) SELECT field, known, total, top_value, CASE WHEN known >= 50 AND top / known > 0.8::DOUBLE THEN 'ONE_VALUE' WHEN known = total AND total >= 100 THEN 'ALL_KNOWN' ELSE 'OK' END AS verdict FROM k"),
    "family_report": (family_report, f"WITH f AS (SELECT p_brand, {_FAMILY_KEY} AS k, count(*) AS v FROM part GROUP BY 1, 2) SELECT count(*) AS families, sum(v)::BIGINT AS items, count(*) FILTER (v > 1) AS multi, floor((1 - count(*) / sum(v)) * 100.0 * 10.0 + 0.5) / 10.0 AS reduction_percent, max(v) AS largest FROM f"),
    "source_report": (source_report, "WITH s AS (SELECT source, count(*) AS \"rows\", count(*) FILTER (n_chars > 50) AS complete, count(*) FILTER (quality = 1) AS usable FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) SELECT *, CASE WHEN complete = \"rows\" THEN 'success' WHEN usable > 0 THEN 'partial' ELSE 'failed' END AS status FROM s"),
    "collection_discovery": (collection_verdicts, "WITH p AS (SELECT p_name, count(*) AS products, avg((p_size < 36)::INT::DOUBLE) AS share FROM part GROUP BY p_name) SELECT p_name, products, floor(share * 10000.0 + 0.5) / 10000.0 AS share, CASE WHEN share >= 0.8::DOUBLE THEN 'VERIFIED' WHEN share > 0.5 THEN 'AUTO_DISCOVERED' ELSE 'REJECT' END AS verdict FROM p"),
    "season_lifecycle": (seasons, _SEASON_SQL),
    "lock_conflicts": (lock_pairs, "SELECT lock, count(*) AS tasks, min(s_suppkey) AS first FROM (SELECT s_suppkey, unnest([s_nationkey, s_nationkey + 1]) AS lock FROM supplier) GROUP BY lock HAVING count(*) > 1"),
    "paged_source": (paged_reads, "WITH e AS (SELECT user_id, day(ts) AS page, count(*) AS n FROM events GROUP BY ALL), z AS (SELECT user_id, page, CASE WHEN n = 1 THEN 0 ELSE n END AS n FROM e), o AS (SELECT *, max((n = 0)::INT) OVER (PARTITION BY user_id ORDER BY page) AS ended FROM z) SELECT user_id, count(*) FILTER (ended = 0) AS pages, coalesce(sum(n) FILTER (ended = 0), 0)::BIGINT AS \"rows\", max(ended) = 1 AS exhausted FROM o GROUP BY user_id"),
}
