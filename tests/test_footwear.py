"""The footwear gate and the review of stored products, listing by listing."""

import pytest

from pyspark.sql import functions as F
from trendloom.operators import footwear as W

FIELDS = "title string, kind string, tags array<string>, handle string, url string, collection string, verified boolean"


@pytest.fixture(scope="module")
def gated(spark):
    from trendloom.plans.footwear import LISTINGS

    extra = [("Eau de Parfum", "Fragrance", ("PERFUME",), "parfum", "", False), ("Ribbed waist skirt", "Skirt", ("Skirts",), "", "", False), ("Leather ballerina sneakers", "Sneakers", (), "", "", True), ("Phoebe Sandal", "Sandals", ("Sandals",), "", "", False), ("", None, None, None, None, None)]
    rows = [(t, k, list(g) if g is not None else None, h, None, c, v) for t, k, g, h, c, v in [*LISTINGS, *extra]]
    x = W.Listing(*(F.col(n) for n in ("title", "kind", "tags", "handle", "url", "collection", "verified")))
    frame = spark.createDataFrame(rows, FIELDS).select("title", "kind", "collection", W.gate(x).alias("g"), W.womens_scope(x).alias("s"))
    return [((r.title, r.kind, r.collection), r.g, r.s) for r in frame.collect()]


def of(gated, title, kind=..., collection=...):
    return next(g for (t, k, c), g, _ in gated if t == title and kind in (..., k) and collection in (..., c))


def test_shoes_are_accepted_with_their_category(gated):
    want = {"Ingels": "BOOT", "Flora boots suede navy": "BOOT", "Valerie Low Pump": "PUMP", "Phoebe Sandal": "SANDAL", "Soca Lisboa": "MULE", "Double Belt Sandal": "SANDAL", "TÉNIS EXE RUNNER": "SNEAKER", "Leather ballerina sneakers": "SNEAKER", "Toe ring sandals": "SANDAL", "Lisboa Preto": "MULE", "Scarf nappa slingbacks black": "SLINGBACK", "Ring ballerinas": "BALLERINA", "Belt Cavalier": "BOOT"}
    assert {t: of(gated, t).category for t in want} == want and all(of(gated, t).decision == "ACCEPT_FOOTWEAR" for t in want)


def test_a_mixed_collection_proves_no_kind(gated):
    assert [g.category for (t, _, _), g, _ in gated if t == "SAPATILHA EXE"] == ["OTHER_FOOTWEAR", "BALLERINA"]


def test_other_ware_is_excluded_with_its_signal(gated):
    want = {"Silk Top": r"\btop\b", "Shoe Care Kit": r"\bshoe care", "Leather Sneakers": r"\bhandbag", "Alys Black Suede": "handle:bag", "Eau de Parfum": r"\bperfume", "Ribbed waist skirt": r"\bskirt\b", "Shipping Protection by Route": "shipping-protection", "Sheer Thermal Tights": r"\bthermal tights\b", "Sun visor": "tag:CAP", "Makeup pouch": "makeup", "Gift card": "gift-card", "Gold ring": r"\bring\b", "B Bag": "handle:bag-prefix", "Boots for men": "mens-only", "Lipstick duo": "lipstick"}
    assert {t: of(gated, t).signals[0] for t in want} == want and all(of(gated, t).decision == "EXCLUDE_NON_FOOTWEAR" for t in want)


def test_spans_are_masked_only_in_their_scope(gated):
    assert of(gated, "Bag-embellished leather pumps", "Shoes").decision == "ACCEPT_FOOTWEAR" and of(gated, "Bag-embellished leather pumps", "Bags").decision == "EXCLUDE_NON_FOOTWEAR"
    assert of(gated, "Leather boots with pouch", collection="/other").signals == [r"\bpouch\b"]
    for title in ("Leather boots with pouch", "30mm pouch boots", "Sweater letter boots", "bag-detail ankle boots", "Low-top suede sneakers", "High-sock sneaks", "Dress-up sneakers", "Blazer Mid sneakers", "Black jeans sneaker", "Tommy Jeans court sneakers", 'Runner "Grand Bag" sneakers'):
        assert of(gated, title).decision == "ACCEPT_FOOTWEAR", title
    assert of(gated, 'Runner "Bag" bag sneakers').decision == "EXCLUDE_NON_FOOTWEAR"


def test_nothing_known_is_uncertain(gated):
    assert of(gated, "").decision == of(gated, "Mystery", None).decision == "EXCLUDE_UNCERTAIN_PRODUCT_TYPE"


def test_scope_needs_a_type_or_a_category_or_a_proven_collection(gated):
    scope = {(t, k): (s.category, s.reason) for (t, k, _), _, s in gated}
    assert scope["Mystery", ""] == (None, "missing-product-type") and scope["Lisboa Preto", ""] == ("MULE", None)
    assert scope["Mystery", "Flats"][0] == "OTHER_FOOTWEAR" and scope["Mystery", "Gear"] == (None, "not-womens-footwear")
    assert scope["Mystery", "Shoe  Care"] == (None, "product_type:shoe care") and scope["Kids boots", "Boots"] == (None, "childrens-only")


def test_official_words_keep_their_open_ends(spark):
    from trendloom.operators.classify import named_by_shop

    texts = ["mocassinos preta", "stilettos x", "sandaliasx", "bootx", "laces", "laces slipper", "lace\nslipper", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(named_by_shop(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == ["LOAFER", "PUMP", "SANDAL", None, "BALLET_FLAT", "LOAFER", "LOAFER", None]
