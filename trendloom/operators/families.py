"""Model families by first fit: listings join the first family all of whose members they are compatible with.

Everything that a comparison reads is a column of the listing; listings with the same columns are interchangeable, so they
are first counted together as one profile, however many they are. Profiles that can meet at all share a key (style, handle
or name, with category and construction), so the connected components of those keys are independent of each other. Each
component, as many profiles as its columns have combinations, is one Arrow group in which the order of the listings is
followed: style, then handle, then name, each cluster by complete link, then families with one key are merged and
compatible ones reconciled until nothing changes. Listings that nothing can join are families of their own, or share one with
the listings of the same listing key.

Names never join listings with a proven style, so no name family has one to be split by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom import stars
from trendloom.functions.expr import slug

#: What a comparison reads, besides brand. `listing` matters to comparisons in shops whose styles are listings only.
COLUMNS = ("source", "marketplace", "style", "verified", "name", "safe", "bare", "handle", "category", "flags", "heel", "kind", "height", "wood", "own_listing")
# Flags that a family has or has not as a whole, those that exclude each other, and shops apart.
EXCLUSIVE = (("mule", "sandal"), ("mid", "high"))
SOFT = ("vinyl", "wood")
RAISED, FLAT_HEIGHTS, HIGH_HEIGHTS = ("STILETTO", "WEDGE", "BLOCK", "SCULPTURAL", "PLATFORM"), ("FLAT", "LOW"), ("MID", "HIGH")
STYLES_ARE_LISTINGS = "zara"


def _pair_flags_fit(a: set, b: set) -> bool:
    return not any((x in a and y in b and y not in a and x not in b) or (x in b and y in a and y not in b and x not in a) for x, y in EXCLUSIVE)


def _fits(a, b, ignored: tuple[str, ...] = ()) -> bool:
    """Constructions that one family can have."""
    loose = {x for pair in EXCLUSIVE for x in pair}
    if not _pair_flags_fit(a.flagset, b.flagset) or {f for f in a.flagset ^ b.flagset if f not in loose and f not in ignored}:
        return False
    return not {a.heel, b.heel}.isdisjoint({"unknown", ""}) or a.heel == b.heel


def _loosely_fits(a, b) -> bool:
    return _fits(a, b, SOFT if a.wood or b.wood else SOFT[:1])


def _same_shop(a, b) -> bool:
    return a.source == b.source and a.marketplace == b.marketplace


def _by_style(a, b) -> bool:
    same = _same_shop(a, b) and a.verified and b.verified and a.style and a.style == b.style and a.category == b.category
    listed = a.own_listing == b.own_listing or not (a.source == STYLES_ARE_LISTINGS or a.style.startswith(STYLES_ARE_LISTINGS.upper() + "-")) if same else False
    return bool(same and listed and _loosely_fits(a, b))


def _heels_fit(a, b) -> bool:
    kinds, heights = {a.kind, b.kind}, (a.height, b.height)
    if "FLAT" in kinds and kinds & set(RAISED):
        return False
    return not (any(h in FLAT_HEIGHTS for h in heights) and any(h in HIGH_HEIGHTS for h in heights))


def _own_shop(a, b) -> bool:
    return _same_shop(a, b) and not a.marketplace and a.source != STYLES_ARE_LISTINGS and a.category == b.category and _heels_fit(a, b) and _fits(a, b)


def _by_handle(a, b) -> bool:
    if not a.handle or a.handle != b.handle or not _own_shop(a, b) or (a.verified and b.verified and a.style != b.style):
        return False
    apart = a.name and b.name and a.name != b.name and not (a.bare and a.bare == b.bare) and (a.safe or b.safe)
    return not apart


def _by_name(a, b) -> bool:
    return bool(_own_shop(a, b) and not a.verified and not b.verified and a.name and a.name == b.name and a.safe and a.bare and a.bare == b.bare)


#: The ways to join, with the name of the reason and of the column that it names.
WAYS = (("styleCode", "style", _by_style), ("handleFamily", "handle", _by_handle), ("safeNameColorway", "name", _by_name))


class _Group:
    def __init__(self, members: list, key: str, reason: str, high: bool):
        self.members, self.key, self.reason, self.high, self.lead = members, key, reason, high, members[0].first

    def join(self, other: _Group) -> None:
        self.members += other.members
        self.reason, self.high = f"{self.reason} + {other.reason}", self.high or other.high


def _key(way: str, seed) -> str:
    at = f"{seed.category}-{'+'.join(sorted(seed.flagset)) or 'base'}"
    if way == "styleCode":
        return f"style-{seed.source}-{seed.style}-{at}"
    return f"handle-{seed.source}-{seed.handle}-{at}-{seed.name}" if way == "handleFamily" else f"name-{seed.source}-{seed.name}-{at}"


def _seeded(profiles: list) -> list[_Group]:
    """Groups in the order of the first listing of each."""
    free, out = dict.fromkeys(range(len(profiles))), []
    while free:
        i = next(iter(free))
        seed, taken = profiles[i], None
        for way, column, joins in WAYS:
            clusters: list[list[int]] = []
            for j in [j for j in free if joins(seed, profiles[j])]:
                home = next((c for c in clusters if all(_fits(profiles[m], profiles[j]) for m in c)), None)
                clusters.append([j]) if home is None else home.append(j)
            mine = next((c for c in clusters if i in c), [])
            if len(mine) > 1 or (mine and seed.n > 1):
                taken = _Group([profiles[m] for m in mine], _key(way, seed), f"{way}:{getattr(seed, column)}", True)
                break
        if taken is None:
            mine, taken = [i], _Group([seed], "", "singleton", False)
        for m in mine:
            free.pop(m)
        out.append(taken)
    return out


def _one_style(group: _Group) -> set:
    return {m.style for m in group.members if m.verified and m.style}


def _compatible(a: _Group, b: _Group) -> bool:
    sa, sb = _one_style(a), _one_style(b)
    pairs = [(x, y) for x in a.members for y in b.members]
    if len(sa) == 1 and sa == sb and _same_shop(a.members[0], b.members[0]) and all(x.category == y.category and _loosely_fits(x, y) for x, y in pairs):
        return True
    if not (a.high or b.high) or (sa and sb and not sa & sb):
        return False
    return all(any(joins(x, y) for _, _, joins in WAYS) for x, y in pairs)


def first_fit(profiles: list) -> list[_Group]:
    """Families of one component's profiles, which stand in the order of their first listing."""
    groups: list[_Group] = []
    known: dict[str, _Group] = {}
    for g in _seeded(profiles):
        if g.high and g.key in known:
            known[g.key].join(g)
        else:
            known[g.key] = g
            groups.append(g)
    while True:
        pair = next(((a, b) for a, b in combinations(groups, 2) if _compatible(a, b)), None)
        if pair is None:
            return groups
        a, b = pair
        a.join(b)
        a.high = True
        groups.remove(b)


def _profiled(listings: DataFrame, order: str) -> DataFrame:
    return listings.groupBy("brand", *COLUMNS).agg(F.min(order).alias("first"), F.count("*").alias("n"))


def _links(profiles: DataFrame) -> DataFrame:
    """Stars that join the profiles which may meet: one of the ways can hold only where its column, shop, category and firm
    flags are the same."""
    firm = F.array_join(F.filter("flags", lambda f: ~f.isin(*SOFT, *[x for pair in EXCLUSIVE for x in pair])), "+")
    can = {"style": F.col("verified") & (F.col("style") != ""), "handle": ~F.col("marketplace") & (F.col("handle") != ""), "name": ~F.col("marketplace") & ~F.col("verified") & F.col("safe") & (F.col("name") != "")}
    met = [F.when(cond, F.concat_ws("\x01", F.lit(way), "brand", "source", "category", firm, way)) for way, cond in can.items()]
    keyed = profiles.select("id", F.explode(F.array_compact(F.array(*met))).alias("met"))
    return keyed.join(keyed.groupBy("met").agg(F.min("id").alias("u")), "met").filter("id <> u").select("u", F.col("id").alias("v")).distinct()


def model_families(listings: DataFrame, order: str, listing: str) -> DataFrame:
    """Each listing with family_id, confidence and reason. listings: brand, COLUMNS (flags: sorted array), the number that
    orders them, and what a listing is known by in its shop. Null columns count as unknown or empty."""
    spark = listings.sparkSession
    stars.durable(spark)
    filled = {c: F.coalesce(c, F.lit("")) for c in COLUMNS if c not in ("marketplace", "verified", "safe", "wood", "flags")} | {c: F.coalesce(c, F.lit(False)) for c in ("marketplace", "verified", "safe", "wood")}
    rows = listings.withColumns({**filled, "flags": F.coalesce("flags", F.array().cast("array<string>")), "brand": F.coalesce("brand", F.lit(""))}).checkpoint()
    # ids are first orders: the least listing of a profile belongs to it alone
    profiles = _profiled(rows, order).withColumn("id", F.col("first")).checkpoint()
    joined = stars.connected_components(_links(profiles), lambda e: e.checkpoint()).select(F.col("node").alias("id"), "component")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        items = [type("Profile", (), dict(r, flagset=set(r["flags"])))() for r in pdf.to_dict("records")]
        out = [(m.id, g.key or None, g.lead, g.reason, len(g.members) > 1 or g.high) for g in first_fit(items) for m in g.members]
        return pd.DataFrame(out, columns=["id", "group_key", "leader", "reason", "joined"])

    def fit_each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.concat([fit(pdf[:0]), *(fit(pdf[i : i + 1]) for i in range(len(pdf)))])

    fitted = "id long, group_key string, leader long, reason string, joined boolean"
    found = profiles.join(joined, "id").groupBy("component").applyInPandas(fit, fitted)
    alone = profiles.join(joined, "id", "left_anti")
    # a profile that meets no other is a family of its own if several listings share it and a way joins them
    found = found.unionByName(alone.mapInPandas(fit_each, fitted))
    tagged = rows.join(profiles.select("id", "brand", *COLUMNS), ["brand", *COLUMNS]).join(found, "id")
    at = F.concat_ws("-", "category", F.when(F.size("flags") > 0, F.array_join("flags", "+")).otherwise("base"))
    own = F.concat(F.lit("id-"), F.col(listing), F.lit("-"), at)
    # a family that began with a single listing is named by that one
    leads = rows.select(F.col(order).alias("leader"), own.alias("lead_key"))
    key = F.when(F.col("joined"), F.coalesce("group_key", "lead_key")).otherwise(own)
    named = F.concat(slug(F.col("brand")), F.lit("--"), slug(key))
    return tagged.join(leads, "leader").withColumns({"family_id": named, "confidence": F.when(F.col("joined"), "HIGH").otherwise("MEDIUM")})
