"""First-fit families against a plain sequential rendering, names of models, and re-anchoring."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import model_names as M
from trendloom.operators import families as Y
from trendloom.operators import identity as I


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("c")).first().c


# A plain rendering, listing by listing.
def flags_fit(a, b, ignored):
    for x, y in (("mule", "sandal"), ("mid", "high")):
        for p, q in ((a, b), (b, a)):
            if x in p["flags"] and y in q["flags"] and y not in p["flags"] and x not in q["flags"]:
                return False
    firm = {f for f, _ in M.FLAGS} - set(ignored)
    if {f for f in a["flags"] if f in firm} != {f for f in b["flags"] if f in firm}:
        return False
    return "unknown" in (a["heel"], b["heel"]) or a["heel"] == b["heel"]


def by_style(a, b):
    if (a["source"], a["marketplace"]) != (b["source"], b["marketplace"]) or not (a["verified"] and b["verified"] and a["style"] and a["style"] == b["style"]) or a["category"] != b["category"]:
        return False
    if a["source"] == "zara" and a["own_listing"] != b["own_listing"]:
        return False
    return flags_fit(a, b, ["vinyl", "wood"] if a["wood"] or b["wood"] else ["vinyl"])


def own(a, b):
    if a["source"] != b["source"] or a["marketplace"] or b["marketplace"] or a["source"] == "zara" or a["category"] != b["category"]:
        return False
    raised = {"STILETTO", "WEDGE", "BLOCK", "SCULPTURAL", "PLATFORM"}
    for p, q in ((a, b), (b, a)):
        if p["kind"] == "FLAT" and q["kind"] in raised or p["height"] in ("FLAT", "LOW") and q["height"] in ("MID", "HIGH"):
            return False
    return flags_fit(a, b, [])


def by_handle(a, b):
    if not own(a, b) or not a["handle"] or a["handle"] != b["handle"] or (a["verified"] and b["verified"] and a["style"] != b["style"]):
        return False
    return not (a["name"] and b["name"] and a["name"] != b["name"] and a["bare"] != b["bare"] and (a["safe"] or b["safe"]))


def by_name(a, b):
    return own(a, b) and not a["verified"] and not b["verified"] and bool(a["name"]) and a["name"] == b["name"] and a["safe"] and a["bare"] == b["bare"]


def plain_families(rows):
    groups, gone = [], set()
    for s in rows:
        if s["number"] in gone:
            continue
        for way, joins in (("style", by_style), ("handle", by_handle), ("name", by_name)):
            clusters = []
            for r in rows:
                if r["number"] in gone or not joins(s, r):
                    continue
                home = next((c for c in clusters if all(flags_fit(m, r, []) for m in c)), None)
                clusters.append([r]) if home is None else home.append(r)
            mine = next((c for c in clusters if len(c) > 1 and s in c), None)
            if mine:
                label = {"style": s["style"], "handle": s["handle"], "name": s["name"]}[way]
                groups.append({"rows": mine, "high": True, "key": (way, s["source"], label, s["category"], "+".join(s["flags"]), s["name"] if way == "handle" else "")})
                break
        else:
            mine = [s]
            groups.append({"rows": mine, "high": False, "key": ("id", s["listing"], s["category"], "+".join(s["flags"]))})
        gone |= {r["number"] for r in mine}
    merged = {}
    for g in groups:
        if (g["high"], g["key"]) in merged:
            merged[g["high"], g["key"]]["rows"] += g["rows"]
        else:
            merged[g["high"], g["key"]] = g
    groups = list(merged.values())

    def compatible(a, b):
        sa, sb = ({r["style"] for r in g["rows"] if r["verified"] and r["style"]} for g in (a, b))
        pairs = [(x, y) for x in a["rows"] for y in b["rows"]]
        loose = lambda x, y: flags_fit(x, y, ["vinyl", "wood"] if x["wood"] or y["wood"] else ["vinyl"])
        if len(sa) == 1 and sa == sb and a["rows"][0]["source"] == b["rows"][0]["source"] and all(x["category"] == y["category"] and loose(x, y) for x, y in pairs):
            return True
        if not (a["high"] or b["high"]) or (sa and sb and not sa & sb):
            return False
        return all(by_style(x, y) or by_handle(x, y) or by_name(x, y) for x, y in pairs)

    while True:
        pair = next(((a, b) for a, b in combinations(groups, 2) if compatible(a, b)), None)
        if pair is None:
            return {frozenset(r["number"] for r in g["rows"]) for g in groups}
        pair[0]["rows"] += pair[1]["rows"]
        pair[0]["high"] = True
        groups.remove(pair[1])


KINDS = "number long, brand string, source string, marketplace boolean, style string, verified boolean, name string, safe boolean, bare string, handle string, category string, flags array<string>, heel string, kind string, height string, wood boolean, own_listing string, listing string"


def random_listings(rng, n, brand):
    pick = lambda *v: v[int(rng.integers(0, len(v)))]
    rows = []
    for _ in range(n):
        source = pick("a", "a", "a", "zara", "market")
        verified = bool(rng.random() < 0.4)
        kind, height = pick("UNKNOWN", "FLAT", "BLOCK", "STILETTO"), pick("UNKNOWN", "LOW", "MID")
        heel = "flat" if height == "LOW" or kind == "FLAT" else "raised" if height == "MID" or kind == "STILETTO" else "unknown"
        name = pick("julie", "teddy", "pump", "")
        listing = pick("l1", "l2", "l3", "l4")
        flags = sorted({f for f in ("mesh", "mid", "high", "mule", "sandal", "vinyl", "wood") if rng.random() < 0.06})
        rows.append(dict(number=0, brand=brand, source=source, marketplace=source == "market", style=pick("s1", "s2") if verified or rng.random() < 0.3 else "", verified=verified, name=name, safe=name in ("julie", "teddy"), bare=pick("julie", "x"), handle=pick("h1", "h2", ""), category=pick("PUMP", "PUMP", "BOOT"), flags=flags, heel=heel, kind=kind, height=height, wood=bool(rng.random() < 0.2), own_listing=listing if source == "zara" else "", listing=f"{source}-{listing}-{rng.integers(0, 10**9)}"))
    return rows


def test_families_equal_a_plain_rendering(spark):
    rng = np.random.default_rng(5)
    rows = [r for b in range(12) for r in random_listings(rng, int(rng.integers(1, 45)), f"B{b}")]
    for i, j in enumerate(rng.permutation(len(rows))):
        rows[j]["number"] = i
    names = [k.split()[0] for k in KINDS.split(", ")]
    frame = spark.createDataFrame([tuple(r[k] for k in names) for r in rows], KINDS).repartition(5)
    got = {}
    out = Y.model_families(frame, "number", "listing").collect()
    assert sorted(r.number for r in out) == list(range(len(rows)))
    for r in out:
        got.setdefault((r.brand, r.family_id), set()).add(r.number)
    want = set()
    for b in {r["brand"] for r in rows}:
        want |= plain_families(sorted((r for r in rows if r["brand"] == b), key=lambda r: r["number"]))
    mine = {frozenset(v) for v in got.values()}
    assert sorted(map(sorted, mine - want)) == sorted(map(sorted, want - mine)) and any(len(v) > 2 for v in want)


def test_equal_listings_are_one_profile_however_many(spark):
    rng = np.random.default_rng(6)
    base = random_listings(rng, 6, "B")
    rows = [dict(r, number=i, listing=f"l{i}") for i, r in enumerate(base * 200)]
    names = [k.split()[0] for k in KINDS.split(", ")]
    frame = spark.createDataFrame([tuple(r[k] for k in names) for r in rows], KINDS)
    out = Y.model_families(frame, "number", "listing").collect()
    got = {}
    for r in out:
        got.setdefault(r.family_id, set()).add(r.number)
    assert {frozenset(v) for v in got.values()} == plain_families(rows)


def test_families_of_nulls_and_nothing(spark):
    row = (1, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, "l")
    frame = spark.createDataFrame([row, (2, *row[1:])], KINDS)
    out = Y.model_families(frame, "number", "listing").collect()
    assert {r.confidence for r in out} == {"MEDIUM"} and len({r.family_id for r in out}) == 1
    assert Y.model_families(frame.limit(0), "number", "listing").count() == 0


@pytest.mark.parametrize("title,color,want", [("Julie Suede Pump", None, "julie pump"), ("Teddy Heel - Ecru", None, "teddy heel"), ("Stella Sneaker Teal Suede", "Teal", "stella sneaker"), ("Low/High Wedge Sandals Rust-Red", "Rust-Red", "low high wedge"), ("Ana Booties Boots women's", None, "ana bootie"), ("C++ (one) mule", "(one)", "c one mule"), (None, None, "")])
def test_model_names_are_normalised(spark, title, color, want):
    assert one(spark, M.model_name(F.col("t"), F.col("c")), t=title, c=color) == want


def test_names_handles_and_constructions(spark):
    got = lambda column, **v: one(spark, column, **v)
    t, u, c = F.col("t"), F.col("u"), F.col("c")
    assert [got(M.is_distinctive(t), t=x) for x in ("julie pump", "ankle boot", "mary jane", "al pump", "")] == [True, False, False, False, False]
    assert got(M.colorless_title(t, c), t="Léa Calf Hair Pumps in Bleu Ciel", c="Bleu Ciel") == "lea" and got(M.colorless_title(t, c), t="Lea Mules Rouge", c=None) == "lea mule"
    keys = [got(M.handle_key(u), u=f"https://x/products/{h}") for h in ("julie-pump-black-suede", "Julie-Pump-s1234567890", "black-suede", "ankle-boot", "teddy-mesh-ss24", "julie--pump")]
    assert keys == ["julie", "julie", None, None, "teddy-mesh", "julie"] and got(M.handle_key(u), u="https://x/p/julie") is None
    assert got(M.construction_flags(t), t="Ana Mules sandal heel-height-mid High heel") == ["mid", "mule"] and got(M.construction_flags(t), t="Résille lace-up sandals high") == ["laceup", "mesh", "sandal"]
    assert got(M.wood_is_a_color(t, u, c), t="Ana Mule", u="https://x/products/ana-mule-wood", c="Wood") and not got(M.wood_is_a_color(t, u, c), t="Ana wood heel", u="https://x/products/ana-wood", c="wood")
    keys = [got(M.listing_key(c, u, t), c=s, u=x, t="1234567_a") for s, x in (("zara", "http://z/a-p12345.html"), ("farfetch", "http://f/item-77"), ("level-shoes", "http://l/A/b/"), ("free-people", "http://q"), ("s", "http://s/products/Ab%20C?x"), ("s", "http://s/q"))]
    assert keys == ["zara:12345", "farfetch:77", "level-shoes:/a/b", "free-people:1234567", "shopify:s:ab c", "url:http://s/q"]


def test_reanchoring_fans_out_and_keeps_every_variant_once_per_old_id(spark):
    prior = spark.createDataFrame([("a", "B", "http://x/1"), ("a", "B", "http://x/2"), ("b", "b ", "http://x/2/"), ("c", "B", "http://x/3"), ("n1", "Q", "u"), ("n1--fresh", "Q", "u")], "old_id string, brand string, url string")
    fresh = spark.createDataFrame([("n1", "b", "HTTP://x/1"), ("n1", "b", "http://x/2"), ("n1", "b", "http://x/9"), ("n2", "B", "http://x/3"), ("n2", "B", "http://x/8"), ("n3", "B", "http://x/7"), ("n3", "B", None)], "fresh_id string, brand string, url string")
    got = sorted((r.fresh_id, r.url or "", r.anchored_id) for r in I.reanchor(fresh, prior).collect())
    assert got == sorted([("n1", "HTTP://x/1", "a"), ("n1", "http://x/2", "a"), ("n1", "http://x/2", "b"), ("n1", "http://x/9", "n1--fresh--fresh"), ("n2", "http://x/3", "c"), ("n2", "http://x/8", "c"), ("n3", "http://x/7", "n3"), ("n3", "", "n3")])
    assert I.reanchor(fresh.limit(0), prior).count() == 0 and {r.anchored_id for r in I.reanchor(fresh, prior.limit(0)).collect()} == {"n1", "n2", "n3"}


def test_each_text_of_a_listing_is_read_once(spark, sf_dir):
    from trendloom.plans import features

    frame = features._listings(spark, sf_dir)
    assert "Aggregate" in frame._jdf.queryExecution().optimizedPlan().toString()
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert frame.select("number").distinct().count() == frame.count() == part.count()
    # listings without a number of their own, too
    assert frame.filter("sku is null").count() == part.filter("p_partkey % 3 <> 0").count() > 0
