"""Radar: attribute combinations that stand out, and the greedy choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom import stars
from trendloom.functions.expr import clamp, half_up
from trendloom.operators import directions


# Pairs that say nothing, and the dimensions that set a look apart.
GENERIC_PAIRS = (
    "CATEGORY:SANDAL|MATERIAL:LEATHER",
    "CATEGORY:PUMP|COLOR:BLACK",
    "CATEGORY:PUMP|MATERIAL:LEATHER",
    "HEEL_TYPE:FLAT|MATERIAL:LEATHER",
    "CATEGORY:SANDAL|COLOR:BLACK",
    "CATEGORY:BALLERINA|MATERIAL:LEATHER",
    "COLOR:BLACK|MATERIAL:LEATHER",
    "COLOR:BLACK|MATERIAL:SUEDE",
    "COLOR:BROWN|MATERIAL:LEATHER",
    "COLOR:BROWN|MATERIAL:SUEDE",
    "COLOR:BLACK|MATERIAL:SYNTHETIC",
)
DISTINCTIVE = ("DETAIL", "CONSTRUCTION", "TOE_SHAPE", "SURFACE_EFFECT", "HEEL_TYPE")


def combinations(products: DataFrame, dimensions: dict[str, Column], families: list[tuple[str, ...]], keep: list[str], skip: tuple[str, ...] = ("UNKNOWN", "OTHER")) -> DataFrame:
    """One row per product and family of dimensions whose values are all known, keyed DIM:value|DIM:value. One scan."""

    def attribute(d: str) -> Column:
        value = dimensions[d].cast("string")
        return F.when(~value.isin(*skip), F.concat(F.lit(f"{d}:"), value))

    def combo(family: tuple[str, ...]) -> Column:
        found = F.array_compact(F.array(*map(attribute, sorted(family))))
        return F.when(F.size(found) == len(family), F.array_join(found, "|"))

    return products.select(*keep, F.explode(F.array_compact(F.array(*map(combo, families)))).alias("combo"))


def buckets(combos: DataFrame, product: str, family: str, brand: str, least_brands: int = 2, least_families: int = 2) -> DataFrame:
    """Support of each combination: distinct products, families and brands; thin ones are left out."""
    # A product's rows come together first, without an exchange where they already lie so; what is left is few.
    each = combos.groupBy("combo", product).agg(F.collect_set(F.struct(F.col(family).alias("family"), F.col(brand).alias("brand"))).alias("held"))
    each = each.select("combo", F.col(product).isNotNull().alias("known"), F.posexplode_outer("held").alias("at", "h"))
    few = each.groupBy("combo", "h.family", "h.brand").agg(F.count_if(F.col("known") & (F.col("at") == 0)).alias("n"))
    out = few.groupBy("combo").agg(F.sum("n").alias("products"), F.countDistinct("family").alias("families"), F.countDistinct("brand").alias("brands"))
    return out.filter((F.col("brands") >= least_brands) & (F.col("families") >= least_families))


# Brands for a level; families and share of evidence that a level needs; what lifts a weak one.
STRONG_BRANDS, MEDIUM_BRANDS = 5, 3
NEEDS = {"STRONG": (4, 0.12), "MEDIUM": (2, 0.06)}
LIFT = (3, 3, 0.1)


def strength(brands: Column, families: Column, coverage: Column) -> Column:
    """STRONG, MEDIUM or WEAK by brands, one level lower for each need that is not met, lifted if enough agree."""

    def short(level: str) -> Column:
        least, share = NEEDS[level]
        return (families < least) | (coverage < share)

    first = F.when(brands >= STRONG_BRANDS, "STRONG").when(brands >= MEDIUM_BRANDS, "MEDIUM").otherwise("WEAK")
    second = F.when((first == "STRONG") & short("STRONG"), "MEDIUM").otherwise(first)
    third = F.when((second == "MEDIUM") & short("MEDIUM"), "WEAK").otherwise(second)
    return F.when((third == "WEAK") & (brands >= LIFT[0]) & (families >= LIFT[1]) & (coverage >= LIFT[2]), "MEDIUM").otherwise(third)


def specificity(attributes: Column) -> Column:
    """Bonus for what a combination is made of, and four for each of its attributes."""
    n = F.size(attributes)
    has = lambda d: F.exists(attributes, lambda x: x.startswith(f"{d}:"))
    apart = F.size(F.filter(attributes, lambda x: F.substring_index(x, ":", 1).isin(*DISTINCTIVE)))
    bonus = apart * 8 + F.when(has("CATEGORY") & (apart >= 1), 8).otherwise(0) + F.when(n >= 3, 10).otherwise(0)
    return bonus - F.when((n == 2) & has("COLOR") & (has("MATERIAL") | has("CATEGORY")), 14).otherwise(0) + n * 4


def distinctiveness(bucket: DataFrame, attribute_share: DataFrame, total_brands: int, total_products: int, least: float = 20.0) -> DataFrame:
    """Score of each bucket (0..100) from breadth, evidence and specificity less its genericity; low ones are dropped.

    attribute_share: attribute, share of all products that have it."""
    parts = bucket.select("combo", F.explode(F.split("combo", r"\|")).alias("attribute")).join(attribute_share, "attribute")
    each = F.when(F.col("share") > 0.45, 12.0).when(F.col("share") > 0.3, 6.0).otherwise(0.0)
    summed = F.sum(each) + F.when((F.count("*") == 2) & (F.min("share") > 0.3), 10.0).otherwise(0.0)
    penalty = parts.groupBy("combo").agg(F.least(F.lit(45.0), summed).alias("sum")).select("combo", F.when(F.col("combo").isin(*GENERIC_PAIRS), 35.0).otherwise(F.col("sum")).alias("penalty"))
    brands, families, products = F.col("brands"), F.col("families"), F.col("products")
    coverage = products / float(max(total_products, 1))
    raw = F.least(brands / float(max(total_brands, 1)), F.lit(1.0)) * 46.0 + F.least(families / 5.0, F.lit(1.0)) * 14.0 + F.least(brands / products, F.lit(1.0)) * 12.0 + coverage * 10.0
    raw = raw + specificity(F.split("combo", r"\|")) - F.col("penalty") - F.when(brands <= 2, 10.0).otherwise(0.0)
    return bucket.join(penalty, "combo").withColumn("score", clamp(half_up(raw))).withColumn("strength", strength(brands, families, coverage)).filter(F.col("score") >= least)


#: What a category already says, so that the attribute adds nothing beside it.
IMPLIED = {
    "THONG": ("OPEN_TOE", "THONG", "THONG_DETAIL"),
    "MULE": ("BACKLESS",),
    "SLINGBACK": ("SLINGBACK", "ANKLE_STRAP"),
    "WEDGE": ("WEDGE",),
    "BALLERINA": ("CLOSED_TOE",),
}
# The pairs and triples of dimensions that make a look.
LOOKS = (
    ("CATEGORY", "TOE_SHAPE"),
    ("CATEGORY", "HEEL_TYPE"),
    ("CATEGORY", "MATERIAL"),
    ("CATEGORY", "SURFACE_EFFECT"),
    ("CATEGORY", "DETAIL"),
    ("CATEGORY", "CONSTRUCTION"),
    ("TOE_SHAPE", "HEEL_TYPE"),
    ("HEEL_TYPE", "CONSTRUCTION"),
    ("MATERIAL", "DETAIL"),
    ("DETAIL", "CONSTRUCTION"),
    ("CATEGORY", "COLOR"),
    ("MATERIAL", "COLOR"),
    ("SURFACE_EFFECT", "COLOR"),
    ("CATEGORY", "DETAIL", "CONSTRUCTION"),
    ("CATEGORY", "MATERIAL", "DETAIL"),
    ("CATEGORY", "TOE_SHAPE", "HEEL_TYPE"),
    ("CATEGORY", "SURFACE_EFFECT", "CONSTRUCTION"),
)
#: Fixed values of the selection: members shared by two equals, and by a part and its whole; how many are chosen.
SAME, PART, MOST = 0.7, 0.6, 12


def meaningful(attributes: Column) -> Column:
    """The attributes (DIM:value) without those that the category implies."""
    category = F.get(F.filter(attributes, lambda a: a.startswith("CATEGORY:")), F.lit(0))
    implied = F.create_map(*[x for c, values in IMPLIED.items() for x in (F.lit(f"CATEGORY:{c}"), F.array(*map(F.lit, values)))])
    said = F.coalesce(F.element_at(implied, category), F.array().cast("array<string>"))
    return F.filter(attributes, lambda a: a.startswith("CATEGORY:") | ~F.array_contains(said, F.substring_index(a, ":", -1)))


def looks(products: DataFrame, values: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row for each product and each look that it has, keyed DIM:value|DIM:value, where at least two of its attributes say
    something beside the category. values: an array for each of the eight dimensions; arrays of several values give a look for
    each of them. What a category implies is left out by its value, on whichever dimension it stands."""
    # Outer: for an inner explode the optimizer infers a filter that makes all combinations once more.
    each = products.select(*keep, F.explode_outer(directions.combos(values, LOOKS)).alias("attributes")).filter(F.col("attributes").isNotNull() & (F.size(meaningful(F.col("attributes"))) >= 2))
    return each.select(*keep, F.array_join(F.array_sort("attributes"), "|").alias("combo"))


def choose(ordered: list[dict], shared: dict[tuple[str, str], int], chosen: list[dict], most: int) -> list[dict]:
    """Go through candidates in order: one with a label or most members of a chosen one is passed over; a more special
    one takes the place of its chosen whole if it adds something, and is passed over if not; a whole whose chosen part
    covers it is passed over too. `shared` has the common members of pairs of keys."""

    def common(a: dict, b: dict) -> int:
        return shared.get((a["key"], b["key"]), shared.get((b["key"], a["key"]), 0))

    def part_of(a: dict, b: dict) -> bool:
        return len(b["attributes"]) < len(a["attributes"]) and set(b["attributes"]) <= set(a["attributes"])

    def adds(part: dict, whole: dict) -> bool:
        gains = part["size"] <= 0.85 * max(whole["size"], 1), part["brands"] > whole["brands"], part["families"] >= whole["families"] + 2, len(part["attributes"]) > len(whole["attributes"])
        return part["brands"] >= 2 and any(gains)

    chosen = list(chosen)
    for c in ordered:
        if len(chosen) >= most:
            break
        either = lambda x, c=c: c["size"] + x["size"] - common(c, x)
        if any(x["label"] == c["label"] or (either(x) and common(c, x) >= SAME * either(x)) for x in chosen):
            continue
        whole = next((x for x in chosen if part_of(c, x) and x["size"] and common(c, x) >= PART * x["size"]), None)
        if whole and not adds(c, whole):
            continue
        if whole:
            chosen.remove(whole)
        if any(part_of(x, c) and c["size"] and common(c, x) >= PART * c["size"] and adds(x, c) for x in chosen):
            continue
        chosen.append(c)
    return chosen


def select_distinct(candidates: DataFrame, members: DataFrame, most: int = MOST, block: int = 64) -> DataFrame:
    """The greedy choice among scored candidates (key, label, attributes, score, brands, families, coverage), with the
    members (key, member) they stand on.

    The order is the meaning, so candidates are taken block by block from the best on, until enough are chosen or none
    is left: Spark counts the members that a block and the chosen ones have in common, the driver holds the numbers of
    one block. Candidates beyond a block are never lost.
    """
    spark = candidates.sparkSession
    sizes = members.groupBy("key").agg(F.countDistinct("member").alias("size"))
    order = [F.desc("score"), F.desc("brands"), F.desc(F.size("attributes")), F.desc("families"), F.desc("coverage"), F.asc("key")]
    stars.durable(spark)
    ranked = candidates.join(sizes, "key").checkpoint().orderBy(*order)
    chosen: list[dict] = []
    start = 0
    while len(chosen) < most:
        rows = [r.asDict() for r in ranked.offset(start).limit(block).collect()]
        if not rows:
            break
        start += block
        keys = [r["key"] for r in (*chosen, *rows)]
        own = members.filter(F.col("key").isin(keys)).distinct()
        # A member is in a few candidates only (one for each family of dimensions), so this does not pair members.
        pairs = own.alias("a").join(own.alias("b"), (F.col("a.member") == F.col("b.member")) & (F.col("a.key") < F.col("b.key")))
        shared = {(r[0], r[1]): r[2] for r in pairs.groupBy("a.key", "b.key").count().collect()}
        chosen = choose(rows, shared, chosen, most)
    kinds = "key string, place int"
    places = spark.createDataFrame([(c["key"], i + 1) for i, c in enumerate(chosen)], kinds)
    return ranked.join(places, "key").select("place", "key", "label", "score", "brands", "families", "size")
