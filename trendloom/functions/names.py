"""Names of products, sources, countries and categories: folding, identities, labels and what they give away."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.expr import AFTER, BEFORE, col, ladder, slug

#: Letters whose canonical decomposition is one ASCII letter and marks, by rule over the Latin blocks.
_MARKED = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(lo, hi) if unicodedata.normalize("NFKD", chr(c))[0].isascii() and unicodedata.normalize("NFKD", chr(c))[0].isalpha()}


def without_marks(c: str | Column) -> Column:
    """Canonical decomposition without the marks, composed or combining."""
    plain = F.translate(col(c), "".join(_MARKED), "".join(_MARKED.values()))
    return F.regexp_replace(plain, r"[\x{300}-\x{36F}]", "")


def brand_key(c: str | Column) -> Column:
    """Letters and digits of a name, lower case, without marks."""
    return F.regexp_replace(F.lower(without_marks(c)), "[^a-z0-9]", "")


def marketplace_id(c: str | Column, aliases: Mapping[str, str] | None = None) -> Column:
    """The slug of a marketplace; an alias counts with and without its dashes."""
    key = slug(without_marks(c))
    if not aliases:
        return key
    known = F.create_map(*[F.lit(x) for a, name in aliases.items() for x in (a.replace("-", ""), name)])
    return F.coalesce(F.element_at(known, F.regexp_replace(key, "-", "")), key)


# Countries that are none.
NO_COUNTRY = ("global", "worldwide", "international")


def country_key(c: str | Column) -> Column:
    return without_marks(F.regexp_replace(F.lower(F.trim(col(c))), "[ıİ]", "i"))


def country_group(c: str | Column, display: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    """The group id and label of a country: mapped names share a group, missing ones are `unknown`."""
    key = F.coalesce(country_key(c), F.lit(""))
    missing = (key == "") | key.isin(*NO_COUNTRY)
    names = F.element_at(F.create_map(*[F.lit(x) for pair in (display or {"": ""}).items() for x in pair]), key)
    label = F.when(missing, "unknown").otherwise(F.coalesce(names, F.trim(col(c))))
    return F.when(missing, "unknown").otherwise(F.regexp_replace(country_key(label), "[^a-z0-9]+", "-")), label


# What a path or a label of new arrivals looks like.
NEW_PATHS = (r"new[-_]?arrivals?", r"new[-_]?in", r"whats[-_]?new", r"new[-_]?season", r"latest", r"new[-_]?shoes?", r"new[-_]?footwear", r"just[-_]?in", r"/new(?:\.html)?(?:/|$)")
NEW_LABELS = r"^(?:new|new in|just in|new arrivals?|novedades)$"


def is_new_arrivals_path(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike("(?i)" + "|".join(NEW_PATHS)), F.lit(False))


def is_new_badge(c: str | Column) -> Column:
    """A label that stands for itself; text that only mentions something new is none."""
    plain = F.regexp_replace(F.lower(F.trim(col(c))), r"[-_\s]+", " ")
    return F.coalesce(plain.rlike(NEW_LABELS), F.lit(False))


# Words that a family key of the radar leaves out.
KEY_NOISE = (
    ("p26", r"p\d+", r"s\d+", r"ss\d+", r"fw\d+", r"aw\d+"),
    ("black", "white", "brown", "tan", "nude", "gold", "silver", "burgundy", "red", "blue", "pink", "beige", "cream", "espresso", "platinum", "metallic"),
    ("leather", "suede", "patent", "nappa", "metallic", "sandal", "pump", "mule", "loafer", "sneaker", "boot"),
    ("high", "mid", "low", "heel", "flat", "block", "stiletto"),
)


def radar_family_key(name: str | Column) -> Column:
    """A name without season codes, colours, materials, categories and heel words."""
    out = F.regexp_replace(F.lower(col(name)), r"\s+", " ")
    for words in KEY_NOISE:
        out = F.regexp_replace(out, rf"{BEFORE}({'|'.join(words)}){AFTER}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9 ]+", " "), r"\s+", " "))


def display_name(words: str | Column) -> Column:
    """Title case; words of up to two characters are upper case."""
    each = F.split(F.trim(col(words)), r"\s+")
    return F.array_join(F.transform(each, lambda w: F.when(F.length(w) <= 2, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000))))), " ")


def humanise(handle: str | Column) -> Column:
    """A handle as words, each with a capital."""
    return F.array_join(F.transform(F.split(col(handle), "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))), " ")


def dedupe_words(label: str | Column) -> Column:
    """A label with each word once, the first of those that differ by case only."""
    words = F.filter(F.split(col(label), r"\s+"), lambda w: w != "")
    low = F.transform(words, F.lower)
    return F.array_join(F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), " ")


def is_generic(title: str | Column, generic: Sequence[str]) -> Column:
    """A title all of whose words are generic."""
    words = F.filter(F.split(F.lower(col(title)), "[^a-z0-9]+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*generic))


def version_of(name: str | Column) -> tuple[Column, Column]:
    """The base of a model name and its version: a number, `v2`, or a Roman numeral at the end."""
    plain = F.trim(F.regexp_replace(F.lower(col(name)), r"\s+", " "))
    pattern = r"^(.*\S)\s+(v?\d+(?:\.\d+)?|i{1,3}|iv|v)$"
    base, version = F.regexp_extract(plain, pattern, 1), F.regexp_extract(plain, pattern, 2)
    return F.when(base == "", plain).otherwise(base), F.when(version != "", version)


def distinct_versions(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] == b[0]) & (a[0] != "") & ~a[1].eqNullSafe(b[1])


def listing_identity(style: Column, sku: Column, product: Column, handle: Column, url: Column, name: Column) -> Column:
    """The strongest thing a listing can be known by, with its kind."""
    known = [("style", F.upper(F.trim(style))), ("sku", F.upper(F.trim(sku))), ("product", F.trim(product)), ("handle", F.lower(F.trim(handle))), ("url", F.lower(F.regexp_replace(url, "/+$", "")))]
    rungs = [F.when(v != "", F.concat(F.lit(f"{kind}:"), v)) for kind, v in known]
    return F.coalesce(*rungs, F.concat(F.lit("name:"), F.lower(F.trim(name))))


def construction_key(text: str | Column, flags: Mapping[str, str]) -> Column:
    """The flags whose pattern the text matches, sorted and joined by a plus."""
    plain = without_marks(F.lower(col(text)))
    return F.array_join(F.sort_array(F.array_compact(F.array(*[F.when(plain.rlike(p), F.lit(f)) for f, p in flags.items()]))), "+")


def structural_signature(*parts: str | Column) -> Column:
    """Known parts in a fixed order, unknown ones as a dash."""
    return F.concat_ws("|", *[F.coalesce(F.when(~F.upper(col(p)).isin("", "UNKNOWN"), F.upper(col(p))), F.lit("-")) for p in parts])


def surface_effect(material: str | Column, details: Column) -> Column:
    m = col(material)
    return ladder((m == "PATENT", "PATENT"), (m == "CROC_EFFECT", "CROC_EFFECT"), ((m == "WOVEN_LEATHER") | F.array_contains(details, "WOVEN"), "WOVEN"), (m == "METALLIC_LEATHER", "METALLIC"))


def cover_score(url: Column, good: Sequence[str], bad: Sequence[str]) -> Column:
    """Ten for each hint of a clean product view in the URL, less ten for each hint of a detail or a model."""
    low = F.lower(url)
    score = F.lit(0)
    for words, worth in ((good, 10), (bad, -10)):
        for w in words:
            score = score + F.when(low.contains(w), worth).otherwise(0)
    return score


def best_cover(urls: Column, good: Sequence[str], bad: Sequence[str]) -> Column:
    """The image with the best score, the first of equals."""
    scored = F.transform(urls, lambda u, i: F.struct((-cover_score(u, good, bad)).alias("s"), i.alias("i"), u.alias("u")))
    return F.array_min(scored)["u"]


def gallery(fresh: Column, last_good: Column, junk: str) -> Column:
    """Images without junk, each once; where none is left the last good ones stay."""
    clean = F.array_distinct(F.filter(fresh, lambda u: ~F.lower(u).rlike(junk)))
    return F.when(F.size(clean) > 0, clean).otherwise(F.coalesce(last_good, clean))


# Style tags by category and by what the name or a feature says.
STYLE_TAGS = (
    ("MARY_JANE", None, ("mary jane", "mary-jane"), None),
    ("MARY_JANE", "BALLET_FLAT", (), "INSTEP"),
    ("HORSEBIT_LOAFER", "LOAFER", ("horsebit",), "HORSEBIT"),
    ("BIKER_BOOT", "BOOT", ("biker",), "BIKER"),
    ("CHELSEA_BOOT", "BOOT", ("chelsea",), "CHELSEA"),
    ("SLINGBACK_PUMP", "PUMP", ("slingback",), "SLINGBACK"),
    ("THONG_SANDAL", "SANDAL", ("thong", "flip flop"), None),
    ("PLATFORM_DERBY", "OXFORD_DERBY", ("platform", "flatform"), None),
    ("ESPADRILLE_WEDGE", "ESPADRILLE", ("wedge",), None),
)


def style_tags(category: Column, name: Column, feature: Column) -> Column:
    """Tags of a style, each once, in the order of the table."""
    low = F.lower(F.coalesce(name, F.lit("")))

    def holds(of: str | None, words: tuple[str, ...], says: str | None) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        if says:
            hit = hit | F.coalesce(F.upper(feature).contains(says), F.lit(False))
        return hit if of is None else hit & (category == of)

    return F.array_distinct(F.array_compact(F.array(*[F.when(holds(of, words, says), F.lit(tag)) for tag, of, words, says in STYLE_TAGS])))


# What a shop's own category says about the shown one; shapes are stronger than heels.
VISUAL_RULES = (
    ("babet", r"ballet flats?|ballerinas?|ballets?|mary[- ]janes?|closed[- ]toe flats?"),
    ("loafer", r"loafers?"),
    ("mule", r"mules?"),
    ("sandal", r"sandals?|sand[aá]lias?"),
    ("sneaker", r"sneakers?|trainers?"),
    ("espadril", r"espadrilles?"),
    ("oxford-derby", r"oxfords?|derbys?|brogues?"),
    ("clog", r"clogs?"),
    ("bot-cizme", r"boots?|booties?|wellingtons?"),
    ("topuklu", r"court shoes?|pumps?|heels?"),
)
VISUAL_OF_PRIMARY = {"BALLET_FLAT": "babet", "LOAFER": "loafer", "PUMP": "topuklu", "SANDAL": "sandal", "MULE": "mule", "BOOT": "bot-cizme", "SNEAKER": "sneaker", "ESPADRILLE": "espadril", "OXFORD_DERBY": "oxford-derby", "CLOG": "clog"}


def visual_category(text: str | Column) -> Column:
    """One shape named: that; several: none; only heels: heels."""
    hits = F.array_compact(F.array(*[F.when(F.lower(col(text)).rlike(rf"{BEFORE}(?:{p}){AFTER}"), F.lit(k)) for k, p in VISUAL_RULES]))
    shapes = F.filter(hits, lambda h: h != "topuklu")
    return F.when(F.size(shapes) == 1, F.get(shapes, F.lit(0))).when((F.size(shapes) == 0) & (F.size(hits) > 0), "topuklu")


def shown_category(primary: Column, hints: Column) -> Column:
    """The primary category if it is known, else the one thing that the shop's categories agree on, heels aside."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in VISUAL_OF_PRIMARY.items() for x in pair]), primary)
    hint = F.array_distinct(F.array_compact(hints))
    shapes = F.filter(hint, lambda h: h != "topuklu")
    agreed = F.when(F.size(hint) == 1, F.get(hint, F.lit(0))).when(F.size(shapes) == 1, F.get(shapes, F.lit(0)))
    return F.coalesce(known, agreed, F.lit("diger"))
