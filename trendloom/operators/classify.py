"""Rule chains: what a collection is, what an official shop calls a product, and what a source's coverage proves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.expr import AFTER, BEFORE, borders, ladder
from trendloom.functions.rules import bound

MEN, WOMEN = r"men|mens|men's|man|homme|uomo", r"women|womens|women's|woman|ladies|femme|donna"
MERCHANDISE = r"bags?|handbags?|jewelry|jewellery|sunglasses|underwear|socks?|shoe care|shoe accessories|hats?|apparel|clothing|activewear|swimwear|gift card|accessories"
NEW_NAMES = r"new arrivals?|new in|just in|whats new|novedades"


def says(text: Column, pattern: str, whole: bool = True) -> Column:
    """The pattern at the beginning of a word, or as whole words."""
    return F.coalesce(F.lower(text).rlike(rf"{BEFORE}(?:{pattern}){AFTER if whole else ''}"), F.lit(False))


def collection_kind(handle: Column, title: Column) -> Column:
    """MENS, MERCHANDISE, NEW_ARRIVALS or CATALOG, by the handle and title of a collection."""
    hay = F.regexp_replace(F.concat_ws(" ", handle, title), "-", " ")
    return ladder((says(hay, MEN) & ~says(hay, WOMEN), "MENS"), (says(hay, MERCHANDISE), "MERCHANDISE"), (says(hay, NEW_NAMES), "NEW_ARRIVALS"), default="CATALOG")


def official_coverage_reasons() -> Column:
    """Why an official source is not proven whole. Columns: errors, exhausted, hit_cap, urls, reported, accepted."""
    from trendloom.functions.expr import reasons

    c = F.col
    known = F.coalesce(c("reported") > 0, F.lit(False))
    return reasons(
        (c("errors") > 0, "COLLECTOR_ERRORS"),
        (~F.coalesce(c("exhausted"), F.lit(False)), "PAGINATION_NOT_PROVEN"),
        (F.coalesce(c("hit_cap"), F.lit(True)), "CRAWL_CAP_NOT_EXCLUDED"),
        (F.coalesce(c("urls"), F.lit(0)) <= 0, "NO_SOURCE_URLS"),
        (~known, "NO_REPORTED_TOTAL"),
        (known & (F.coalesce(c("urls"), F.lit(0)) < c("reported")), "URLS_BELOW_TOTAL"),
        (known & (F.coalesce(c("accepted"), F.lit(0)) < c("reported")), "ACCEPTED_BELOW_TOTAL"),
    )


# Pairs of construction flags that one family cannot have.
CONFLICTS = (("mule", "sandal"), ("mid", "high"), ("wood", "clear"))


def architecture_conflict(flags: Column) -> Column:
    """A family whose items' flags (an array) exclude each other."""
    out = F.lit(False)
    for a, b in CONFLICTS:
        out = out | (F.array_contains(flags, a) & F.array_contains(flags, b))
    return out


def refresh_plan(active: Column, collector: Column, discovery: Column, owned: tuple[str, ...] = ("wave50", "brand-automation")) -> tuple[Column, Column]:
    """Whether a brand is in the cloud refresh (active, with a collector, not owned by another automation), and whether
    its membership is refreshed too (a shop that lists its collections). discovery: array of names."""
    in_cloud = active & collector.isNotNull() & ~F.exists(discovery, lambda d: F.lower(F.trim(d)).isin(*owned))
    return in_cloud, in_cloud & collector.isin("SHOPIFY_PUBLIC", "SHOPIFY_JSON")


# What official shops write, in order: category, pattern, and a second pattern that must hold too.
OFFICIAL_RULES = (
    ("OXFORD_DERBY", r"\b(?:derb(?:y|ie|ies)|oxfords?|brogues?|bluchers?)\b", None),
    ("SNEAKER", r"\bsneakers?\b|\btrainers?\b|\brunning shoes?\b|\bbaskets?\b", None),
    ("LOAFER", r"\bmonk shoes?\b", None),
    ("BOOT", r"\bbot[ií]n(?:es)?\b|\bbotines?\b", None),
    ("BALLET_FLAT", r"\bmerceditas?\b|\bbailarinas?\b", None),
    ("LOAFER", r"\bmocas[ií]n(?:es)?\b", None),
    ("CLOG", r"\bzuecos?\b", None),
    ("ESPADRILLE", r"\balpargatas?\b", None),
    ("LOAFER", r"\bwallabees?\b", None),
    ("LOAFER", r"mocassi[mn]", None),
    ("SANDAL", r"\bsandals?\b|sand[aá]lias?", None),
    ("BOOT", r"\bbotas?\b|\bbottes?\b|\bbottines?\b|\bboot(?:s|ies?)?\b|\bwell(?:y|ies)\b|\bwellingtons?\b", None),
    ("SNEAKER", r"sapatilhas?", r"t[eé]nis|sneaker|trainer"),
    ("BALLET_FLAT", r"sapatilhas?", None),
    ("BALLET_FLAT", r"\bmary[\s-]?janes?\b", None),
    ("LOAFER", r"\bbelgians?\b", None),
    ("BALLET_FLAT", r"\bballerinas?\b|\bbabies\b", None),
    ("LOAFER", r"\bboat[\s-]shoes?\b|\bmoccasins?\b", None),
    ("LOAFER", r"\bloafers?\b", None),
    ("SNEAKER", r"\btennis\b", None),
    ("MULE", r"\bslippers?\s+(?:[5-9]\d|1[0-4]\d)\b", None),
    ("MULE", r"\bslippers?\b", r"stiletto|block heel|\d+\s*mm|\bopen[\s-]toe\b"),
    ("MULE", r"\bmules?\b", None),
    ("PUMP", r"\bslingbacks?\b|\bslings?\b", None),
    ("PUMP", r"stiletto|\bsabrina\b|\bsalto\b", None),
    ("LOAFER", r"sola baixa", r"pala|fivela|met[aá]lico"),
    ("BALLET_FLAT", r"sola baixa", None),
    ("LOAFER", r"detalhe cl[aá]ssico na parte superior", None),
    ("LOAFER", r"\bslip[\s-]?ons?\b", None),
    ("PUMP", r"\bpumps?\b", None),
    ("BALLET_FLAT", r"\bflats?\b", None),
    ("ESPADRILLE", r"\bespadrilles?\b|\bjute sole\b", None),
    ("BALLET_FLAT", r"\blaces?\b", r"^(?!.*\bslippers?\b)"),
    ("LOAFER", r"\bslippers?\b|\bhouse shoes?\b", None),
)
# What an official product type stands for.
OFFICIAL_TYPES = {
    "boot": "BOOT",
    "boots": "BOOT",
    "flat": "BALLET_FLAT",
    "flats": "BALLET_FLAT",
    "heel": "PUMP",
    "heels": "PUMP",
    "loafer": "LOAFER",
    "loafers": "LOAFER",
    "sneaker": "SNEAKER",
    "sneakers": "SNEAKER",
    "mule": "MULE",
    "mules": "MULE",
    "sandal": "SANDAL",
    "sandals": "SANDAL",
    "slide": "SANDAL",
    "slides": "SANDAL",
    "sandals/slides": "SANDAL",
    "slipper": "LOAFER",
    "slippers": "LOAFER",
    "mocassim": "LOAFER",
    "mocassins": "LOAFER",
    "mocassin": "LOAFER",
    "pump": "PUMP",
    "pumps": "PUMP",
    "boat shoe": "LOAFER",
    "mary jane": "BALLET_FLAT",
    "belgian": "LOAFER",
    "sapato": "PUMP",
    "sapatos": "PUMP",
}
NOT_FOOTWEAR = r"chaussettes?|socks?|sac|hand\s?bags?|tote bag|shoulder bag"


def named_by_shop(text: Column) -> Column:
    """The category that a shop's own words name, by the first rule that holds."""

    def holds(t: Column, pattern: str, also: str | None) -> Column:
        hit = t.rlike(borders(pattern))
        return hit if also is None else hit & t.rlike("(?s)" + borders(also))

    return bound(F.lower(text), lambda t: ladder(*[(holds(t, p, also), c) for c, p, also in OFFICIAL_RULES]))


def official_category(title: Column, kind: Column, description: Column, tags: Column) -> Column:
    """Title and description first, then the product type, then the tags."""
    of = F.regexp_replace(F.lower(F.trim(F.coalesce(kind, F.lit("")))), r"\s+", " ")
    types = F.create_map(*[F.lit(x) for pair in OFFICIAL_TYPES.items() for x in pair])
    return F.coalesce(named_by_shop(F.concat_ws(" ", title, description)), F.element_at(types, of), named_by_shop(F.regexp_replace(tags, r"[_|:]+", " ")))


def is_other_ware(title: Column) -> Column:
    """Socks and bags that share a generic product type with shoes."""
    return says(title, NOT_FOOTWEAR)


def confirm_category(fields: dict[str, Column], lexicon: dict[str, dict[str, str]], locale: Column, other: str) -> tuple[Column, Column, Column]:
    """Status, category and the field that decides: evidence fields in order, in the words of the locale's lexicon only.

    Without a locale or its lexicon, with words of other ware, or without any match the answer is REVIEW, never a guess."""
    everything = F.concat_ws(" ", *fields.values())

    def found(c: Column) -> Column:
        each = [(locale == place, ladder(*[(says(c, p), k) for k, p in words.items()])) for place, words in lexicon.items()]
        return ladder(*each)

    known = F.coalesce(locale.isin(*lexicon), F.lit(False)) & ~says(everything, other)
    category = F.when(known, F.coalesce(*map(found, fields.values())))
    field = F.when(known, F.coalesce(*[F.when(found(c).isNotNull(), F.lit(name)) for name, c in fields.items()]))
    return F.when(category.isNotNull(), "RESOLVED").otherwise("REVIEW"), category, field
