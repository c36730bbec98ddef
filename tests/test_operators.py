from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trendloom.operators import identity, market, merge, radar, registry, schedule, snapshots, trend
from trendloom.sources import extract, files

NOW = datetime(2026, 8, 18, 12)


def obs(spark, rows):
    kinds = "trend string, source_id long, brand string, corporate_group string, model_family string, color string, material string, publication string, country string, confidence decimal(10,4), segment int, signature string, first_seen timestamp, observed_at timestamp"
    base = {"trend": "t", "source_id": 1, "brand": "A", "corporate_group": None, "model_family": "f", "color": "black", "material": "m", "publication": "p", "country": "IT", "confidence": 0.9, "segment": 1, "signature": "s", "first_seen": NOW - timedelta(days=5), "observed_at": NOW - timedelta(days=5)}
    from decimal import Decimal

    full = [base | r for r in rows]
    return spark.createDataFrame([tuple(Decimal(str(v)) if k == "confidence" else v for k, v in r.items()) for r in full], kinds)


def sources(spark):
    return spark.sql("select 1L source_id, cast(0.8 as decimal(10,4)) weight, 'LEADER' role, true is_active union all select 2L, 0.5, 'PRODUCTION_SIGNAL', true union all select 3L, 0.5, 'MARKET', false")


def test_variants_are_one_adoption_unit(spark):
    o = obs(spark, [{"publication": str(i), "color": c} for i, c in enumerate(["black", "red", "white", "teal"])])
    d = trend.dedupe_observations(o)
    assert d.count() == 4 and d.select("unit").distinct().count() == 1
    assert trend.dedupe_observations(o, "color").select("unit").distinct().count() == 4


def test_best_confidence_wins_and_ineligible_sources_go(spark):
    o = obs(spark, [{"confidence": 0.5}, {"confidence": 0.7}, {"source_id": 2}, {"source_id": 3}, {"country": "China", "publication": "q"}])
    kept = trend.eligible(trend.dedupe_observations(o), sources(spark)).collect()
    assert [float(r.confidence) for r in kept] == [0.7]


def test_momentum_is_null_on_short_history(spark):
    o = obs(spark, [{"publication": str(i)} for i in range(5)])
    m = trend.trend_metrics(o, sources(spark), F.lit(NOW.isoformat()).cast("timestamp")).first()
    assert m.momentum is None and m.change_30d is None and m.strength > 0


def test_acceleration_counts_day_30_once(spark):
    o = obs(spark, [{"publication": str(i), "observed_at": NOW - timedelta(days=d)} for i, d in enumerate((0, 30, 45, 100))])
    e = trend.evidence(trend.eligible(trend.dedupe_observations(o), sources(spark)), F.lit(NOW.isoformat()).cast("timestamp")).first()
    assert (e.recent30, e.in_30_60, e.previous30) == (2, 2, 1)


def test_tag_counts_count_a_product_once(spark):
    p = spark.createDataFrame([("A", ["x", "x", "y"]), ("B", ["x"]), ("A", ["x"])], "brand string, tags array<string>")
    assert {r.tag: (r.product_count, r.brands) for r in market.tag_counts(p, F.col("tags"), "brand").collect()} == {"x": (3, ["A", "B"]), "y": (1, ["A"])}


def catalog(spark, rows):
    return spark.createDataFrame(rows, "item string, model string, color string, in_stock boolean, price double")


def test_catalog_events(spark):
    before = catalog(spark, [("a-black", "a", "black", False, 100.0), ("gone", "g", "red", True, 1.0)])
    now = catalog(spark, [("a-black", "a", "black", True, 120.0), ("a-red", "a", "red", True, 5.0), ("b-black", "b", "black", True, 5.0)])
    got = sorted((r.item, r.event) for r in snapshots.catalog_events(now, before, ["item"], "model", "color").collect())
    assert got == [("a-black", "PRICE_CHANGE"), ("a-black", "RESTOCK"), ("a-red", "NEW_COLOR"), ("b-black", "NEW_MODEL"), ("gone", "REMOVED")]
    assert {r.event for r in snapshots.catalog_events(now, before.limit(0), ["item"], "model", "color", baseline=True).collect()} == {"BASELINE"}
    again = snapshots.catalog_events(now, before, ["item"], "model", "color", seen=now).collect()
    assert ("b-black", "RESTOCK") in {(r.item, r.event) for r in again}


def test_last_good_keeps_empty_and_shrunken_states_back(spark):
    s = spark.createDataFrame([(0, 10, 10), (5, 5, 10), (9, 9, 10)], "collected long, expected long, previous long")
    assert [r.problems for r in snapshots.last_good(s).orderBy("collected").collect()] == [["EMPTY", "LOW_COVERAGE", "SHARP_DROP"], ["SHARP_DROP"], []]


def test_components(spark):
    nodes = spark.range(1, 8).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "u long, v long")
    got = {r.node: r.component for r in identity.components(nodes, edges, "node").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}


def test_components_of_a_long_chain(spark):
    """The smallest node hangs at the far end of 1, 2 ... 39."""
    nodes = spark.range(40).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 39)] + [(39, 0)], "u long, v long").coalesce(1)
    assert {r.component for r in identity.components(nodes, edges, "node").collect()} == {0}


def test_links_of_blocks(spark):
    items = spark.range(10).select(F.col("id").alias("item"), F.lit("x").alias("block"))
    assert identity.star_links(items, ["block"], "item").count() == 9
    apart = F.abs(F.col("a.item") - F.col("b.item")) == 3
    many = spark.range(1000).select(F.col("id").alias("item"), F.lit("x").alias("block"))
    assert identity.pairs_within(items, ["block"], "item", apart).count() == 7
    assert identity.pairs_within(many, ["block"], "item", apart).count() == 997  # a large block asks the predicate too


def reached(memberships):
    """The smallest item that each item reaches, one block after the other."""
    of, before, blocks = {i: i for _, i in memberships}, None, {}
    for b, i in memberships:
        blocks.setdefault(b, []).append(i)
    blocks.pop(None, None)
    while of != before:
        before = dict(of)
        for mine in blocks.values():
            of |= dict.fromkeys(mine, min(of[i] for i in mine))
    return of


def test_components_of_blocks(spark):
    chain = [(f"c{i}", j) for i in range(30) for j in (100 + i, 101 + i)] + [("far", 130), ("far", 7)]
    hot = [("hot", 200 + i) for i in range(300)] + [("hot", 200)] * 50
    loose = [("one", 900), (None, 901), (None, 902), ("two", 902), ("two", 903)]
    rows = chain + hot + loose
    items = spark.createDataFrame(rows, "block string, item long").repartition(3)
    got = {r.item: r.component for r in identity.block_components(items, ["block"], "item").collect()}
    assert got == reached(rows) and got[100] == 7 and got[901] == 901 and got[903] == 902


def test_rounds_see_little_more_than_a_row_for_each_item(spark, tmp_path, monkeypatch):
    """Not the pairs of supplier and part, of which each part has ten."""
    import random

    from trendloom import stars
    from trendloom.plans import history

    draw, parts = random.Random(5), 400
    lines = [(s, p) for p in range(parts) for s in draw.sample(range(100), 10)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(parts).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 2).alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    seen, rounds = [], stars.connected_components

    def counted(edges, *rest):
        seen.append(edges.filter("u <> v").select(F.least("u", "v"), F.greatest("u", "v")).distinct().count())
        return rounds(edges, *rest)

    monkeypatch.setattr(stars, "connected_components", counted)
    got = {r.node: r.component for r in history.families_components(spark, str(tmp_path)).collect()}
    assert got == reached([((s, p % 2), p) for s, p in lines]) and len(got) == parts
    assert seen[0] < 2 * parts


def test_rows_are_numbered_like_one_sorted_list(spark):
    t = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("b"))
    got = [r.id for r in schedule.numbered(t, {"a": F.col("a")}, [F.col("b"), F.col("id")]).orderBy("place").collect()]
    assert got == [r.id for r in t.orderBy("a", "b", "id").collect()]


def test_conflict_free_choice_goes_on_beyond_a_block(spark):
    rows = [(i, [0, 1000 + i]) for i in range(50)] + [(50 + i, [1 + i % 3]) for i in range(9)] + [(99, [])]
    tasks = spark.createDataFrame(rows, "key long, locks array<long>")
    got = sorted(r.key for r in schedule.without_conflicts(tasks, ["key"], "key", "locks", 5, block=4).collect())
    assert got == [0, 50, 51, 52, 99]
    assert [r.key for r in schedule.without_conflicts(tasks, ["key"], "key", "locks", 1).collect()] == [0]


def test_last_place_goes_to_a_fresh_candidate(spark):
    queue = spark.createDataFrame([(i, i, i == 7) for i in range(10)], "key long, rank long, fresh boolean")
    got = {r.key for r in schedule.select_candidates(queue, [F.col("rank")], 3, F.col("fresh")).collect()}
    assert got == {0, 1, 7}
    early = {r.key for r in schedule.select_candidates(queue, [F.col("rank")], 3, F.col("key") < 2).collect()}
    assert early == {0, 1, 2}


def test_path_locks_bar_what_lies_below(spark):
    tasks = spark.createDataFrame([(1, ["src/a/x"]), (2, ["src/ab"]), (3, ["src"]), (4, ["src/a"])], "key long, locks array<string>")
    running = spark.createDataFrame([(["src/a"],)], "locks array<string>")
    assert sorted(r.key for r in registry.conflicts_of(tasks, running, "key", "locks").collect()) == [1, 4]
    assert [(r.lock, r.tasks) for r in registry.lock_holders(tasks.union(tasks.limit(0)), "key", "locks").collect()] == []


def test_radar_choice(spark):
    rows = [("CATEGORY:A|COLOR:X", 90.0), ("CATEGORY:A|COLOR:X|TOE:P", 80.0), ("CATEGORY:A|COLOR:Y", 70.0), ("CATEGORY:B|COLOR:X", 60.0), ("CATEGORY:B|COLOR:Z", 50.0)]
    own = {rows[0][0]: range(0, 10), rows[1][0]: range(0, 8), rows[2][0]: range(5, 40), rows[3][0]: range(5, 39), rows[4][0]: range(100, 110)}
    scored = spark.createDataFrame(rows, "key string, score double").withColumns({"label": F.col("key"), "attributes": radar.meaningful(F.split("key", r"\|")), "brands": F.lit(3), "families": F.lit(3), "coverage": F.lit(0.1)})
    members = spark.createDataFrame([(k, m) for k, ms in own.items() for m in ms], "key string, member long")
    want = ["CATEGORY:A|COLOR:Y", "CATEGORY:B|COLOR:Z"]
    for block in (1, 2, 64):
        got = [r.key for r in radar.select_distinct(scored, members, block=block).orderBy("place").collect()]
        # The second has 0.8 of the first's members: too much in common; the fourth has nearly all of the third's.
        assert got == [rows[0][0], *want]
    special = radar.choose([{"key": "w", "label": "w", "attributes": ["a", "b"], "size": 10, "brands": 3, "families": 3}, {"key": "p", "label": "p", "attributes": ["a", "b", "c"], "size": 6, "brands": 3, "families": 3}], {("p", "w"): 6}, [], 12)
    assert [c["key"] for c in special] == ["p"]  # the more special one replaces its whole


def test_implied_attributes_say_nothing(spark):
    a = spark.createDataFrame([(["CATEGORY:MULE", "CONSTRUCTION:BACKLESS", "COLOR:RED"],), (["CONSTRUCTION:BACKLESS", "COLOR:RED"],)], "a array<string>")
    assert [r.m for r in a.select(radar.meaningful(F.col("a")).alias("m")).collect()] == [["CATEGORY:MULE", "COLOR:RED"], ["CONSTRUCTION:BACKLESS", "COLOR:RED"]]


def test_resolution(spark):
    value, origin = merge.resolve(F.col("t"), F.col("v"), F.col("c"))
    rows = spark.createDataFrame([("a", "b", 0.9), ("a", "b", 0.1), ("UNKNOWN", "b", 0.1), (None, None, 0.0), ("a", "a", 0.9)], "t string, v string, c double")
    assert [(r.a, r.b) for r in rows.select(value.alias("a"), origin.alias("b")).collect()] == [("b", "vision"), ("a", "text"), ("b", "vision"), ("UNKNOWN", "none"), ("a", "hybrid")]


def test_json_ld(spark):
    html = """<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"P1","offers":{"price":"10"}},{"@type":"Other"}]}</script>
    <script type='application/ld+json'>{broken</script><script type="application/ld+json">{"@type":"Product","name":"P2"}</script>"""
    got = spark.createDataFrame([(html,)], "h string").select(F.explode(extract.json_ld(F.col("h"))).alias("p")).select("p.name", "p.offers.price").collect()
    assert [(r.name, r.price) for r in got] == [("P1", "10"), ("P2", None)]


def test_sitemap_and_absolute_links(spark):
    row = spark.createDataFrame([("<loc> http://a/p/1?x=1&amp;y=2 </loc><loc>http://a/about</loc>", "https://h.io/x/y")], "x string, base string")
    assert row.select(extract.sitemap_urls(F.col("x"), "/p/").alias("u")).first().u == ["http://a/p/1?x=1&y=2"]
    assert row.select(extract.absolute(F.lit("//c.d/e"), F.col("base")).alias("u")).first().u == "https://c.d/e"


def test_publish_is_compare_and_set(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert files.publish(spark.range(3), path, "s1", None)
    assert not files.publish(spark.range(9), path, "s2", "other")
    assert files.read_published(spark, path).count() == 3
    assert files.publish(spark.range(4), path, "s2", "s1") and files.current_snapshot(spark, path) == "s2"
    assert not files._claim(spark, path, 2, "s3")  # another writer has been there
    assert files.current_snapshot(spark, path) == "s2"


def test_missing_file_is_an_empty_table(spark, tmp_path):
    assert files.read_json(spark, f"file://{tmp_path}/none.json", "a int").count() == 0
    assert files.seal(spark.range(5)) == files.seal(spark.range(5).repartition(3))


def test_turkish_order_and_folding(spark):
    from trendloom.functions import names
    from trendloom.operators import scopes

    words = ["İnci", "Ipek", "Dal", "Çanta", "Cep", "Şal", "Su"]
    t = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.w for r in t.orderBy(scopes.turkish("w")).collect()] == ["Cep", "Çanta", "Dal", "Ipek", "İnci", "Su", "Şal"]
    row = spark.createDataFrame([("Ça\u0301vė Ōst",)], "w string").select(names.without_marks("w").alias("p"), names.brand_key("w").alias("k")).first()
    assert (row.p, row.k) == ("Cave Ost", "caveost")


def test_manifest_shards_and_single_file(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    assert files.read_manifest(spark, path, "id long").count() == 0
    assert files.write_sorted_shards(spark.range(1000), f"{path}/out", "id", shard_bytes=4000) > 1
    (tmp_path / "set/b.json").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "set/a.json").write_text('{"id": 3}\n')
    (tmp_path / "set/all.json").write_text('[{"id": 9}]')
    assert [(r.id, r.shard) for r in files.read_manifest(spark, path, "id long").collect()] == [(9, 0)]
    (tmp_path / "set/manifest.json").write_text('{"shards": ["b.json", "a.json"]}')
    assert sorted((r.id, r.shard) for r in files.read_manifest(spark, path, "id long").collect()) == [(1, 0), (2, 0), (3, 1)]


def test_paged_source(spark, tmp_path):
    from trendloom.sources.paged import JsonPages

    (tmp_path / "p1.json").write_text('[{"id": "a", "title": "x"}, {"id": "b"}]')
    (tmp_path / "p2.json").write_text('[{"id": "c", "title": "y"}]')
    spark.dataSource.register(JsonPages)
    got = spark.read.format("json_pages").option("path", f"{tmp_path}/p{{page}}.json").option("pages", "5").load().collect()
    assert sorted((r.page, r.id, r.title) for r in got) == [(1, "a", "x"), (1, "b", None), (2, "c", "y")]
    for n in range(3, 8):  # a listing of more pages than partitions ends with its last page
        (tmp_path / f"p{n}.json").write_text(f'[{{"id": "i{n}"}}]')
    got = spark.read.format("json_pages").option("path", f"{tmp_path}/p{{page}}.json").option("pages", "3").load().collect()
    assert sorted(r.page for r in got) == [1, 1, 2, 3, 4, 5, 6, 7]


def test_fields_and_images_of_pages(spark):
    html = """<html lang="en"><meta property="og:image" content="//c.d/m.jpg"><h1>A &amp; B</h1><img src="/i.jpg"><img src="/i.jpg"></html>"""
    page = spark.createDataFrame([(html, "https://h.io/x", "Upper: Calf | Toe Shape: round\nHeel Height: 5 cm")], "h string, u string, d string")
    fields = extract.described(F.col("d"))
    row = extract.extract(page, "h", extract.SPECS["plain"]).select("title", "language", extract.product_images(F.col("h"), F.col("u")).alias("images"), *(c.alias(k) for k, c in fields.items())).first()
    assert (row.title, row.language, row.images) == ("A & B", "en", ["https://c.d/m.jpg"])
    assert (row.material, row.toe, row.height, row.details) == ("Calf", "round", "5 cm", None)


def test_repeated_batches_are_left(spark):
    from trendloom.streaming import stateful

    seen: dict = {}
    sink = stateful.last_good_sink(lambda b, i: seen.setdefault(i, b.count()), lambda b: b.count() > 0, seen.__contains__)
    for batch, n in ((0, 3), (1, 0), (0, 9), (2, 2)):
        sink(spark.range(n), batch)
    assert seen == {0: 3, 2: 2}


def test_rows_of_much_work_are_dealt_over_all_partitions(spark, tmp_path):
    """A file of one row group is one task for a scan; the queries with much work in a row deal its rows out first."""
    from trendloom.operators import radar
    from trendloom.plans import features, footwear

    sf = tmp_path / "sf"
    spark.createDataFrame([(i, f"name {i % 3}", f"Brand#{i % 5}", "PROMO", i % 50, 1.0) for i in range(400)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(sf / "part.parquet"))
    for rows in (features.look_buckets, features.direction_candidates, features.taxonomy_features, footwear.stored_reviews, footwear.scope_decisions):
        assert "REPARTITION_BY_NUM" in rows(spark, str(sf))._jdf.queryExecution().executedPlan().toString(), rows.__name__
    combos = spark.createDataFrame([("a|b", 1, "f", "x"), ("a|b", 1, "g", "x"), ("a|b", 2, "f", "y"), ("a|b", 2, "f", "y"), ("a|b", None, "h", None), ("c|d", 3, "f", "x")], "combo string, product long, family string, brand string")
    assert [tuple(r) for r in radar.buckets(combos, "product", "family", "brand").collect()] == [("a|b", 2, 3, 2)]


def test_literals_are_what_a_match_needs():
    from trendloom.functions.rules import literals

    assert literals(r"\bflip[- ]flops?\b|\bChinelo\b") == ("flip", "chinelo") and literals(r"\bjewell?ery") == ("jewel",)
    assert literals(r"^b-") == ("b-",) and literals(r"\bt[eé]nis\b") == ("nis",) and literals("sandália") is None and literals(r"[ab]+|cd") is None


def test_catalog_events_meet_the_previous_items_once(spark):
    fields = "item string, model string, color string, in_stock boolean, price double"
    now, before = (spark.createDataFrame(rows, fields) for rows in ([("a", "m", "x", True, 1.0), ("b", "m", "y", True, 1.0), ("c", "n", "x", True, 1.0), ("d", "m", "x", True, 1.0)], [("a", "m", "x", False, 1.0), ("e", "m", "x", True, 1.0)]))
    out = snapshots.catalog_events(now, before, ["item"], "model", "color")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    assert sorted((r.item, r.event) for r in out.collect()) == [("a", "RESTOCK"), ("b", "NEW_COLOR"), ("c", "NEW_MODEL"), ("d", "RESTOCK"), ("e", "REMOVED")]
