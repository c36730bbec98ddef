"""Categories, features, straps and directions over the driver's tables, each with SQL or values that say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from trendloom import stars
from trendloom.operators import directions as R
from trendloom.operators import straps as S
from trendloom.operators import taxonomy as X
from trendloom.plans.footwear import _q
from trendloom.plans.market import _read
from trendloom.plans.scoped import _of

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    """Register a function under its name with the SQL for it."""

    def add(run: Callable) -> Callable:
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


#: Products that the parts take in turn: name, older category, construction, height group, cleaned height, toe, details,
#: material family, source text, heel, raw material; and what they are: category, influences, reason, provenance, tags.
PRODUCTS = (
    (("Nova", None, (), None, None, None, (), None, "Women Ballet Pumps", None, None), ("BALLET_FLAT", "", "exact-source-product-category", "SOURCE_CATEGORY", "")),
    (("Nova trainer", None, (), None, None, None, (), None, "/uk/shopping/women/espadrilles-1/items.aspx", None, None), ("ESPADRILLE", "", "exact-source-product-category", "SOURCE_CATEGORY", "")),
    (("Nova", None, (), None, None, None, (), None, " Sneakers ", None, None), ("SNEAKER", "", "exact-source-product-category", "SOURCE_CATEGORY", "")),
    (("Nova", "LOAFER", (), None, None, None, (), None, "New sneakers", None, None), ("LOAFER", "", "legacy-category:LOAFER", "LEGACY_CATEGORY", "")),
    (("Leather Ballerina Sneaker high-top runner", None, (), None, None, None, (), "LEATHER", None, None, "Leather"), ("SNEAKER", "BALLET", "sneaker-dominant-construction", "PRODUCT_EVIDENCE", "BALLET_SNEAKER")),
    (("Jute  Wedge rope sole", None, (), None, None, None, (), None, None, "WEDGE", None), ("ESPADRILLE", "", "espadrille-sole-architecture", "PRODUCT_EVIDENCE", "ESPADRILLE_WEDGE")),
    (("Wooden Clog", None, (), None, None, None, (), None, None, None, None), ("CLOG", "", "clog-base-architecture", "PRODUCT_EVIDENCE", "")),
    (("Platform Derby", None, (), None, None, None, (), None, None, None, None), ("OXFORD_DERBY", "DERBY", "lace-up-dress-shoe", "PRODUCT_EVIDENCE", "PLATFORM_DERBY")),
    (("Brogue", None, (), None, None, None, (), None, None, None, None), ("OXFORD_DERBY", "OXFORD", "lace-up-dress-shoe", "PRODUCT_EVIDENCE", "")),
    (("Chelsea biker ankle boot", None, (), None, None, "ROUND", (), None, None, "BLOCK", None), ("BOOT", "", "boot-shaft-architecture", "PRODUCT_EVIDENCE", "BIKER_BOOT,CHELSEA_BOOT")),
    (("Nova", "ANKLE_BOOT", (), None, None, None, (), None, None, None, None), ("BOOT", "", "boot-shaft-architecture", "PRODUCT_EVIDENCE", "")),
    (("Strappy sandal flip flop", None, (), "FLAT", None, None, (), None, None, "FLAT", None), ("SANDAL", "", "open-strap-footwear", "PRODUCT_EVIDENCE", "THONG_SANDAL")),
    (("Sandal pumps", None, (), None, None, None, (), None, None, None, None), ("SANDAL", "", "open-strap-footwear", "PRODUCT_EVIDENCE", "")),
    (("Thong pumps", None, (), None, None, None, (), None, None, None, None), ("PUMP", "", "raised-heel-pump-upper", "PRODUCT_EVIDENCE", "")),
    (("Nova", "THONG", (), None, None, None, (), None, None, None, None), ("SANDAL", "", "open-strap-footwear", "PRODUCT_EVIDENCE", "")),
    (("Closed toe sandal", None, ("BACKLESS", "CLOSED_TOE"), None, None, None, (), None, None, None, None), ("UNCLASSIFIED", "", "insufficient-evidence", "INSUFFICIENT", "")),
    (("Nova mule sandal", None, (), None, None, None, (), None, None, None, None), ("UNCLASSIFIED", "", "insufficient-evidence", "INSUFFICIENT", "")),
    (("Horsebit loafer mule", None, (), None, None, None, (), None, None, None, None), ("MULE", "LOAFER", "backless-loafer-architecture", "PRODUCT_EVIDENCE", "HORSEBIT_LOAFER")),
    (("Nova mule 55 mm", None, (), None, None, "POINTED", (), None, None, None, None), ("MULE", "PUMP", "backless-covered-vamp-heeled", "PRODUCT_EVIDENCE", "")),
    (("Ballet mule", None, (), None, None, None, (), None, None, None, None), ("MULE", "BALLET", "backless-ballet-upper", "PRODUCT_EVIDENCE", "")),
    (("Nova mule", "MULE", (), None, None, None, (), None, None, None, None), ("MULE", "", "backless-covered-vamp", "PRODUCT_EVIDENCE", "")),
    (("Nova slingback", None, (), None, "10mm", None, (), None, None, None, None), ("BALLET_FLAT", "", "low-slingback-flat", "PRODUCT_EVIDENCE", "")),
    (("Nova slingback", None, ("SLINGBACK", "ANKLE_STRAP"), "HIGH", "85 mm", "SQUARE", (), "SATIN", None, "STILETTO", None), ("PUMP", "", "slingback-pump", "PRODUCT_EVIDENCE", "SLINGBACK_PUMP")),
    (("Nova sling back mary jane", None, (), "LOW", None, None, (), None, None, None, None), ("BALLET_FLAT", "", "slingback-ballet-flat", "PRODUCT_EVIDENCE", "MARY_JANE")),
    (("Ballerina heeled", None, (), None, None, None, (), None, None, "KITTEN", None), ("PUMP", "BALLET", "raised-heel-pump-upper", "PRODUCT_EVIDENCE", "")),
    (("Penny loafer with tassel", None, (), "LOW", None, None, (), None, None, None, None), ("LOAFER", "", "loafer-architecture", "PRODUCT_EVIDENCE", "")),
    (("Nova ballet", None, (), "FLAT", None, None, (), None, None, None, None), ("BALLET_FLAT", "", "ballet-flat-architecture", "PRODUCT_EVIDENCE", "")),
    (("Sapatilha preta", "BALLERINA", (), None, None, None, (), None, "Sapatilhas e Ténis", None, None), ("UNCLASSIFIED", "", "sapatilha-mixed-tenis-collection-conservative", "INSUFFICIENT", "")),
    (("Sapatilha preta", "BALLERINA", (), None, None, None, (), None, "Sapatilhas", None, None), ("BALLET_FLAT", "", "legacy-category:BALLERINA", "LEGACY_CATEGORY", "")),
    (("Nova", "OTHER_FOOTWEAR", (), None, None, None, (), None, None, None, None), ("UNCLASSIFIED", "", "insufficient-evidence", "INSUFFICIENT", "")),
    (("Nova", "WEDGE", (), None, None, None, (), None, None, "WEDGE", None), ("SANDAL", "", "legacy-category:WEDGE", "LEGACY_CATEGORY", "")),
    (("Backless closed toe peep toe", None, (), None, None, None, (), None, None, None, None), ("MULE", "", "backless-covered-vamp", "PRODUCT_EVIDENCE", "")),
    (("Nova", "MULE", (), None, None, None, (), None, None, None, None), ("MULE", "", "legacy-category:MULE", "LEGACY_CATEGORY", "")),
)
#: Known features of those products: number of the product, field, values, source, confidence.
KNOWN = (
    (4, "materialFamily", "LEATHER", "DERIVED", 0.75),
    (4, "styleArchetype", "RETRO_RUNNER", "PRODUCT_TEXT", 0.75),
    (4, "sneakerHeight", "HIGH_TOP", "PRODUCT_TEXT", 0.75),
    (5, "heelType", "WEDGE", "DERIVED", 0.75),
    (5, "espadrilleSoleHeight", "WEDGE", "PRODUCT_TEXT", 0.75),
    (6, "baseConstruction", "WOOD", "PRODUCT_TEXT", 0.75),
    (7, "lacingConstruction", "DERBY", "PRODUCT_TEXT", 0.75),
    (9, "toeShape", "ROUND", "DERIVED", 0.75),
    (9, "heelType", "BLOCK", "DERIVED", 0.75),
    (9, "bootStyleFeatures", "CHELSEA+BIKER", "PRODUCT_TEXT", 0.75),
    (9, "shaftHeight", "ANKLE", "PRODUCT_TEXT", 0.75),
    (11, "heelHeightClass", "FLAT", "DERIVED", 0.75),
    (11, "heelType", "NONE", "DERIVED", 0.75),
    (15, "backConstruction", "BACKLESS", "PRODUCT_TEXT", 0.75),
    (16, "backConstruction", "BACKLESS", "PRODUCT_TEXT", 0.75),
    (17, "backConstruction", "BACKLESS", "PRODUCT_TEXT", 0.75),
    (17, "loaferDetail", "HORSEBIT", "PRODUCT_TEXT", 0.75),
    (18, "toeShape", "POINTED", "DERIVED", 0.75),
    (18, "backConstruction", "BACKLESS", "PRODUCT_TEXT", 0.75),
    (18, "heelHeightMm", "55", "PRODUCT_TEXT", 0.95),
    (19, "backConstruction", "BACKLESS", "PRODUCT_TEXT", 0.75),
    (20, "backConstruction", "BACKLESS", "PRODUCT_TEXT", 0.75),
    (21, "backConstruction", "SLINGBACK", "PRODUCT_TEXT", 0.75),
    (21, "heelHeightMm", "10", "PRODUCT_TEXT", 0.95),
    (22, "toeShape", "SQUARE", "DERIVED", 0.75),
    (22, "backConstruction", "SLINGBACK", "PRODUCT_TEXT", 0.75),
    (22, "heelHeightClass", "HIGH", "DERIVED", 0.75),
    (22, "heelHeightMm", "85", "PRODUCT_TEXT", 0.95),
    (22, "heelType", "STILETTO", "DERIVED", 0.75),
    (22, "materialFamily", "SATIN", "DERIVED", 0.75),
    (22, "strapFeatures", "ANKLE_STRAP+SLINGBACK", "PRODUCT_TEXT", 0.75),
    (22, "strapConfiguration", "SLINGBACK+ANKLE_STRAP", "PRODUCT_TEXT", 0.75),
    (23, "backConstruction", "SLINGBACK", "PRODUCT_TEXT", 0.75),
    (23, "heelHeightClass", "LOW", "DERIVED", 0.75),
    (23, "strapConfiguration", "SINGLE_INSTEP", "PRODUCT_TEXT", 0.75),
    (24, "heelType", "KITTEN", "DERIVED", 0.75),
    (25, "heelHeightClass", "LOW", "DERIVED", 0.75),
    (25, "loaferDetail", "PENNY_STRAP+TASSEL", "PRODUCT_TEXT", 0.75),
    (26, "heelHeightClass", "FLAT", "DERIVED", 0.75),
    (30, "heelType", "WEDGE", "DERIVED", 0.75),
    (31, "toeOpening", "PEEP", "PRODUCT_TEXT", 0.75),
    (31, "backConstruction", "BACKLESS", "PRODUCT_TEXT", 0.75),
    (32, "backConstruction", "BACKLESS", "DERIVED", 0.85),
)
_KINDS = "i long, name string, legacy string, construction array<string>, height string, cleaned string, toe string, details array<string>, material string, source string, heel string, raw string"


def _products(spark, sf):
    """Every part with its own name before that of a product, and what the operators say of it."""
    cases = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(PRODUCTS)], _KINDS)
    part = stars.spread(_read(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    p = part.withColumn("i", F.col("p_partkey") % len(PRODUCTS)).join(F.broadcast(cases), "i")
    p = p.withColumn("name", F.concat_ws(" ", "p_name", "name"))
    c = F.col
    x = X.Product(c("name"), c("legacy"), c("construction"), c("height"), c("cleaned"), c("toe"), c("details"), c("material"), c("source"), c("heel"))
    p = p.withColumn("primary", X.primary_category(x))
    p = p.withColumn("features", X.features(x, c("primary"), c("raw")))
    return p.withColumn("tags", X.style_tags(c("primary"), c("features"), c("name")))


@query(f"""
WITH want (i, category, influences, reason, provenance, tags) AS (VALUES {', '.join(f"({', '.join(map(_q, (i, *w)))})" for i, (_, w) in enumerate(PRODUCTS))})
SELECT p_partkey, category, influences, reason, provenance, tags FROM part JOIN want ON i = p_partkey % {len(PRODUCTS)}""")
def primary_categories(spark, sf):
    p = _products(spark, sf)
    return p.select("p_partkey", "primary.category", F.array_join("primary.influences", ",").alias("influences"), "primary.reason", "primary.provenance", F.array_join("tags", ",").alias("tags"))


@query(f"""
WITH known (i, field, value, source, confidence) AS (VALUES {', '.join(f"({i}, {_q(f)}, {_q(v)}, {_q(s)}, {c}::DOUBLE)" for i, f, v, s, c in KNOWN)})
SELECT p_partkey, field, value, source, confidence FROM part JOIN known ON i = p_partkey % {len(PRODUCTS)}""")
def taxonomy_features(spark, sf):
    # Outer: for an inner explode the optimizer infers a filter that computes all features, and the category in each, again.
    p = _products(spark, sf).select("p_partkey", F.explode_outer("features").alias("f")).filter("f.status = 'KNOWN'")
    return p.select("p_partkey", "f.field", F.array_join("f.value", "+").alias("value"), "f.source", "f.confidence")


_ELEMENT = {
    "type": "(['ANKLE_STRAP', 'ANKLE_WRAP_LACE', 'HEEL_SLING', 'BACK_STRAP', 'TOE_POST', 'MARY_JANE_STRAP', 'INSTEP_STRAP', 'T_STRAP_VERTICAL'])[l_partkey % 8 + 1]",
    "location": "(['ANKLE', 'HEEL', 'TOE', 'INSTEP', 'FOREFOOT'])[l_suppkey % 5 + 1]",
    "wraps": "(['ANKLE', 'FOOT', NULL])[l_linenumber % 3 + 1]",
    "confidence": "(60 + l_quantity::INT % 40)",
    "image": "l_linenumber % 4",
}


def _elements(spark, sf):
    """The lines of an order as the strap elements of one picture set."""
    e = {k: v.replace("([", "element_at(array(").replace("])[", "), cast(").replace("+ 1]", "+ 1 as int))").replace("l_quantity::INT", "cast(l_quantity as int)") for k, v in _ELEMENT.items()}
    rows = _of(spark, sf, "lineitem", "l_orderkey", "l_linenumber", *(f"{v} AS {k}" for k, v in e.items()))
    element = F.struct("l_linenumber", "type", "location", "wraps", F.col("confidence").cast("int").alias("confidence"), F.array(F.col("image").cast("int"), F.lit(5)).alias("images"))
    return stars.spread(rows, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(element)).alias("elements"))


_LINES = f"SELECT l_orderkey, l_linenumber, {', '.join(f'{v} AS {k}' for k, v in _ELEMENT.items())} FROM lineitem"
_NEEDS = "VALUES " + ", ".join(f"({_q(n)}, {_q(t)}, {_q(p)}, {_q(a)})" for n, (t, p, a) in S.SUPPORT.items())
_STRAPS = f"""
WITH e AS ({_LINES}), need (feature, types, places, around) AS ({_NEEDS}),
x AS (SELECT e.*, feature, list_contains(types, type) AND list_contains(places, location) AND confidence >= 70 AND (len(around) = 0 OR coalesce(list_contains(around, wraps), false)) AS fits FROM e CROSS JOIN need),
g AS (SELECT l_orderkey, feature, bool_or(fits) AS seen, count(*) AS n, max(confidence) FILTER (fits) AS best, list_sort(list_distinct(flatten(list([image, 5]) FILTER (fits)))) AS mine, list_sort(list_distinct(flatten(list([image, 5])))) AS every, string_agg(type, ', ' ORDER BY l_linenumber, type, location, wraps NULLS FIRST, confidence, image) FILTER (fits) AS types FROM x GROUP BY ALL),
r AS (SELECT l_orderkey, feature, CASE WHEN seen THEN 'YES' WHEN n >= 2 THEN 'NO' ELSE 'UNKNOWN' END AS value, CASE WHEN seen THEN best WHEN n >= 2 THEN 78 ELSE 35 END AS confidence, CASE WHEN seen THEN mine WHEN n >= 2 THEN every ELSE [] END AS images,
  CASE WHEN seen THEN 'Derived from strap topology: ' || types WHEN n >= 2 THEN 'No matching strap element in topology map' ELSE 'Insufficient strap topology evidence' END AS why, seen FROM g)"""


@query(f"{_STRAPS} SELECT l_orderkey, feature, value, confidence, array_to_string(images, ',') AS images, why, CASE WHEN confidence >= 85 THEN 'RADAR_ELIGIBLE' WHEN confidence >= 70 THEN 'VISION_UNCERTAIN' ELSE 'NOT_USABLE_FOR_RADAR' END AS usability FROM r")
def strap_features(spark, sf):
    d = _elements(spark, sf).select("l_orderkey", F.explode_outer(S.derived(F.col("elements"))).alias("d"))
    return d.select("l_orderkey", "d.feature", "d.value", F.col("d.confidence").cast("long").alias("confidence"), F.array_join("d.images", ",").alias("images"), "d.why", "d.usability")


@query(f"""{_STRAPS}, v AS (SELECT *, l_orderkey % 3 > 0 AS verified, l_orderkey % 7 = 0 AS contradicts FROM r)
SELECT l_orderkey, feature, CASE WHEN contradicts THEN 'CONTRADICTION' WHEN confidence >= 90 THEN 'RADAR_ELIGIBLE' WHEN confidence >= 70 THEN 'VISION_UNCERTAIN' ELSE 'NOT_USABLE_FOR_RADAR' END AS usability, value = 'YES' AND confidence >= 90 AND verified AND len(images) > 0 AND seen AND NOT contradicts AS eligible FROM v""")
def strap_eligibility(spark, sf):
    e = _elements(spark, sf)
    d = e.select("l_orderkey", "elements", F.explode_outer(S.derived(F.col("elements"))).alias("d"))
    verifier = F.when(F.col("l_orderkey") % 3 > 0, "VERIFIED").otherwise("SKIPPED")
    out = S.eligibility(F.col("d.feature"), F.col("d.value"), F.col("d.confidence"), F.col("d.images"), verifier, F.col("l_orderkey") % 7 == 0, F.col("elements"))
    return d.select("l_orderkey", "d.feature", out.alias("o")).select("l_orderkey", "feature", "o.usability", "o.eligible")


_LOOK = {
    "category": "CASE p_type WHEN 'ECONOMY' THEN 'PUMP' WHEN 'SMALL' THEN 'SANDAL' WHEN 'PROMO' THEN 'MULE' WHEN 'LARGE' THEN 'OTHER_FOOTWEAR' ELSE 'BOOT' END",
    "toe": "CASE p_size % 4 WHEN 0 THEN 'POINTED' WHEN 1 THEN 'SQUARE' WHEN 2 THEN 'ALMOND' ELSE 'UNKNOWN' END",
    "heel": "CASE p_partkey % 3 WHEN 0 THEN 'KITTEN' WHEN 1 THEN 'BLOCK' ELSE 'OTHER' END",
    "detail": "CASE p_size % 3 WHEN 0 THEN 'BOW' WHEN 1 THEN 'BUCKLE' END",
    "second": "CASE WHEN p_partkey % 2 = 0 THEN 'STUDS' END",
    "construction": "CASE p_size % 5 WHEN 0 THEN 'SLINGBACK' WHEN 1 THEN 'T_STRAP' WHEN 2 THEN 'PLATFORM' END",
    "surface": "CASE WHEN p_size % 7 = 0 THEN 'PATENT' END",
    "vision": "p_partkey % 4 > 0",
}
_PROFILE = {
    "segment": "CASE {n} % 6 WHEN 0 THEN 'MASS_MARKET' WHEN 1 THEN 'CONTEMPORARY' WHEN 2 THEN 'PREMIUM' WHEN 3 THEN 'DIRECTIONAL' WHEN 4 THEN 'LUXURY' ELSE 'UNKNOWN' END",
    "role": "CASE {n} % 4 WHEN 0 THEN 'LEADER' WHEN 1 THEN 'EARLY_ADOPTER' WHEN 2 THEN 'MARKET' ELSE 'RETAIL' END",
    "directional": "{n} * 7 % 101",
    "commercial": "{n} * 13 % 101",
}


def _radar(spark, sf):
    number = "cast(substring(p_brand, 7) as int)"
    families = _of(spark, sf, "part", "p_partkey AS family", "p_brand AS brand", *(f"{v} AS {k}" for k, v in _LOOK.items()))
    profiles = _of(spark, sf, "part", "p_brand AS brand", *(f"{v.format(n=number)} AS {k}" for k, v in _PROFILE.items())).distinct().filter("brand <> 'Brand#7'")
    values = {"TOE_SHAPE": F.array("toe"), "HEEL_TYPE": F.array("heel"), "DETAIL": F.array("detail", "second"), "CONSTRUCTION": F.array("construction"), "SURFACE_EFFECT": F.array("surface")}
    return R.candidates(families, values, profiles)


_VALUES = {"TOE_SHAPE": ("toe",), "HEEL_TYPE": ("heel",), "DETAIL": ("detail", "second"), "CONSTRUCTION": ("construction",), "SURFACE_EFFECT": ("surface",)}


def _combo_sql() -> str:
    from itertools import product

    out = []
    for dims in R.FAMILIES:
        for columns in product(*[_VALUES[d] for d in dims]):
            held = " AND ".join(f"{c} IS NOT NULL AND {c} NOT IN ('UNKNOWN', 'OTHER')" for c in columns)
            pairs = ", ".join(f"'{d}:' || {c}" for d, c in zip(dims, columns))
            out.append(f"SELECT category, family, brand, vision, [{pairs}] AS a FROM f WHERE {held}")
    return " UNION ".join(out)


_N = "p_brand[7:]::INT"
_CANDIDATES = f"""
WITH f AS (SELECT p_partkey AS family, p_brand AS brand, {', '.join(f'{v} AS {k}' for k, v in _LOOK.items())} FROM part WHERE category <> 'OTHER_FOOTWEAR'),
prof AS (SELECT DISTINCT p_brand AS brand, {', '.join(f'{v.format(n=_N)} AS {k}' for k, v in _PROFILE.items())} FROM part WHERE p_brand <> 'Brand#7'),
c AS ({_combo_sql()}),
s AS (SELECT c.*, coalesce(segment, 'UNKNOWN') AS segment, CASE WHEN coalesce(segment, 'UNKNOWN') = 'UNKNOWN' THEN NULL WHEN segment = 'MASS_MARKET' THEN 'DOYGUN_GEC' WHEN segment = 'CONTEMPORARY' AND role IN ('MARKET', 'RETAIL') THEN 'NUMUNEYE_GIR' WHEN segment IN ('CONTEMPORARY', 'PREMIUM') AND commercial >= 55 THEN 'HAZIRLAN' WHEN segment IN ('DIRECTIONAL', 'LUXURY') AND role IN ('LEADER', 'EARLY_ADOPTER') AND directional >= 60 THEN 'COK_ERKEN' WHEN directional >= 45 THEN 'ERKEN_SINYAL' END AS stage, greatest(directional, commercial) AS best FROM c LEFT JOIN prof USING (brand)),
b AS (SELECT category, a, brand, any_value(stage) AS stage, any_value(CASE WHEN segment = 'UNKNOWN' THEN 0 ELSE best END) AS q FROM s WHERE vision GROUP BY ALL),
t AS (SELECT category, a, count(DISTINCT family) FILTER (vision) AS families FROM s GROUP BY ALL),
u AS (SELECT t.category, t.a, families, count(b.brand) AS brands, coalesce(avg(q), 0) AS quality, list_sort(list(DISTINCT stage) FILTER (stage IS NOT NULL)) AS stages FROM t LEFT JOIN b ON b.category = t.category AND b.a = t.a GROUP BY ALL),
w AS (SELECT *, len(a) AS n, CASE WHEN split_part(a[1], ':', 2) IN {R.GENERIC_VALUES} THEN 0.8 ELSE 0 END AS generic FROM u)
SELECT category || '::' || array_to_string(list_sort(a), '|') AS key, families, brands, coalesce(array_to_string(stages, ','), '') AS stages, brands * 12 + families * 8 + quality * 0.35 + n * 15 - generic * 40 AS score, CASE WHEN families < 2 OR brands < 2 THEN {_q(R.THIN)} WHEN generic > 0 AND n < 3 THEN {_q(R.GENERIC)} END AS reason FROM w"""


@query(_CANDIDATES)
def direction_candidates(spark, sf):
    return _radar(spark, sf).select("key", "families", "brands", F.array_join(F.array_sort("stages"), ",").alias("stages"), "score", "reason")


@query(None)
def master_directions(spark, sf):
    told = R.signals(R.without_nested(_radar(spark, sf).filter(F.col("reason").isNull())))
    return R.directions(told).select("category", "radar", "place", "key", "stage", "confidence", "families", "brands", "score")


@query(None)
def direction_audit(spark, sf):
    found = _radar(spark, sf)
    return R.audit(found, R.signals(R.without_nested(found.filter(F.col("reason").isNull()))))


_LOOK8 = {**_LOOK, "category": "CASE p_type WHEN 'ECONOMY' THEN 'PUMP' WHEN 'SMALL' THEN 'SLINGBACK' WHEN 'PROMO' THEN 'MULE' WHEN 'LARGE' THEN 'OTHER_FOOTWEAR' ELSE 'WEDGE' END", "heel": "CASE p_partkey % 4 WHEN 0 THEN 'KITTEN' WHEN 1 THEN 'WEDGE' WHEN 2 THEN 'BLOCK' ELSE 'OTHER' END", "construction": "CASE p_size % 5 WHEN 0 THEN 'SLINGBACK' WHEN 1 THEN 'BACKLESS' WHEN 2 THEN 'PLATFORM' END", "material": "CASE p_size % 6 WHEN 0 THEN 'SUEDE' WHEN 1 THEN 'UNKNOWN' ELSE 'LEATHER' END", "color": "CASE p_partkey % 5 WHEN 0 THEN 'BLACK' WHEN 1 THEN 'RED' END"}
_DIMENSIONS = {**_VALUES, "CATEGORY": ("category",), "MATERIAL": ("material",), "COLOR": ("color",)}


def _looks_sql() -> str:
    from itertools import product

    from trendloom.operators import radar

    implied = " OR ".join(f"(category = '{c}' AND split_part(x, ':', 2) IN ({', '.join(map(_q, v))}))" for c, v in radar.IMPLIED.items())
    out = []
    for dims in radar.LOOKS:
        for columns in product(*[_DIMENSIONS[d] for d in dims]):
            held = " AND ".join(f"{c} IS NOT NULL AND {c} NOT IN ('UNKNOWN', 'OTHER', 'OTHER_FOOTWEAR')" for c in columns)
            out.append(f"SELECT p_partkey, p_name, p_brand, {repr('CATEGORY' in dims).lower()} AS named, category, [{', '.join(f'{chr(39)}{d}:{chr(39)} || {c}' for d, c in zip(dims, columns))}] AS a FROM f WHERE {held}")
    kept = f"list_filter(a, lambda x: x LIKE 'CATEGORY:%' OR NOT (named AND ({implied})))"
    return f"""WITH f AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _LOOK8.items())} FROM part), c AS ({' UNION '.join(out)})
SELECT array_to_string(list_sort(a), '|') AS combo, count(DISTINCT p_partkey) AS products, count(DISTINCT p_name) AS families, count(DISTINCT p_brand) AS brands FROM c WHERE len({kept}) >= 2 GROUP BY ALL HAVING count(DISTINCT p_brand) >= 2 AND count(DISTINCT p_name) >= 2"""


@query(_looks_sql())
def look_buckets(spark, sf):
    from trendloom.operators import radar

    rows = stars.spread(_of(spark, sf, "part", "p_partkey", "p_name", "p_brand", *(f"{v} AS {k}" for k, v in _LOOK8.items())), "p_partkey")
    values = {d: F.array(*columns) for d, columns in _DIMENSIONS.items()}
    return radar.buckets(radar.looks(rows, values, ["p_partkey", "p_name", "p_brand"]), "p_partkey", "p_name", "p_brand")


def _listings(spark, sf):
    """Every part as a listing of a shop: title, URL and what comparisons read."""
    from trendloom.functions import model_names as M
    from trendloom.functions.styles import style_identity

    pick = lambda values, by: f"element_at(array({', '.join(map(_q, values))}), cast({by} as int))"
    p = _of(
        spark, sf, "part", "p_partkey AS number", "p_brand AS brand",
        f"{pick(('x-shop', 'zara', 'farfetch', 'alohas', 'x-shop'), 'p_partkey % 5 + 1')} AS source",
        f"{pick(('Black', 'Ecru', 'Wood', 'Tan'), 'p_partkey % 4 + 1')} AS color",
        f"{pick(('Julie', 'Teddy', 'Leather', 'Stella Mesh'), 'p_size % 4 + 1')} AS model",
        f"{pick(('Pump', 'Slingback', 'Mule', 'High Sandal', 'Ballet Flat', 'Boots'), 'p_size % 6 + 1')} AS kind_word",
        f"{pick(('UNKNOWN', 'MID', 'HIGH', 'FLAT', 'LOW'), 'p_size % 5 + 1')} AS height",
        f"{pick(('UNKNOWN', 'BLOCK', 'STILETTO', 'FLAT'), 'p_partkey % 4 + 1')} AS kind",
        "CASE WHEN p_partkey % 3 = 0 THEN concat('S', 100000 + p_size % 6, '-', 1000 + p_partkey % 9) END AS sku",
    )
    c = F.col
    title = F.concat_ws(" ", "model", "kind_word", F.when(c("number") % 2 == 0, F.concat(F.lit("- "), c("color"))).otherwise(c("color")))
    handle = F.lower(F.concat_ws("-", F.regexp_replace("model", " ", "-"), F.regexp_replace("kind_word", " ", "-"), "color"))
    url = F.when(c("source") == "zara", F.concat(F.lit("https://z/shoe-p"), F.lit(12340) + c("number") % 10, F.lit(".html"))).when(c("source") == "farfetch", F.concat(F.lit("https://f/item-"), c("number") % 50)).otherwise(F.concat(F.lit("https://x/products/"), handle))
    listed = p.withColumns({"title": title, "url": url})
    # What a listing says decides all that is read of it: many say the same, and each text is read once.
    said = ["source", "color", "height", "kind", "sku", "title", "url"]
    p = stars.spread(listed.select(*said).distinct(), *said)
    style, verified = style_identity("sku", "source", "url")
    listing = M.listing_key(c("source"), c("url"), c("sku"))
    name = M.model_name(c("title"), c("color"))
    x = X.Product(c("title"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), c("height"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    p = p.withColumns({"style": style, "verified": verified, "listing": listing, "name": name, "bare": M.colorless_title(c("title"), c("color")), "handle": M.handle_key(c("url")), "flags": M.construction_flags(F.concat_ws(" ", "title", "url")), "heel": M.heel_bucket(c("kind"), c("height")), "wood": M.wood_is_a_color(c("title"), c("url"), c("color")), "category": X.primary_category(x)["category"], "marketplace": c("source") == "farfetch"})
    p = p.withColumns({"safe": M.is_distinctive(c("name")), "own_listing": F.when(c("source") == "zara", c("listing"))})
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in said]
    return listed.alias("l").join(p.alias("r"), same).select("l.number", "l.brand", *(f"r.{k}" for k in p.columns))


@query(None)
def model_families(spark, sf):
    from trendloom.operators import families as Y

    return Y.model_families(_listings(spark, sf), "number", "listing").select("number", "brand", "family_id", "confidence", "reason")
