"""Rule tables: ordered keyword rules as data, turned into one nested expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.expr import col, color_from_name, combine_text

Rules = Sequence[tuple[str, Sequence[str]]]

# Colour families and the keywords that name them, in order.
COLOR_FAMILIES: Rules = (
    ("MULTICOLOR", ("multi", "multicolor", "two-tone", "bicolor")),
    ("BURGUNDY", ("burgundy", "wine", "vino", "oxblood", "maroon")),
    ("ESPRESSO", ("espresso",)),
    ("SILVER", ("silver", "platinum", "chrome")),
    ("GOLD", ("gold", "golden")),
    ("METALLIC_OTHER", ("metallic",)),
    ("BLACK", ("black", "noir", "onyx", "ebony")),
    ("WHITE", ("white", "off white", "off-white")),
    ("CREAM", ("cream", "ivory", "ecru", "papyrus", "vanilla", "milk")),
    ("BEIGE", ("beige", "taupe", "sand", "nude", "almond", "savannah")),
    ("TAN", ("tan", "camel", "cognac")),
    ("BROWN", ("brown", "chestnut", "chocolate", "choc", "coffee", "toffee", "rock", "willow", "peru")),
    ("RED", ("red", "crimson", "scarlet")),
    ("PINK", ("pink", "blush", "petal", "rose")),
    ("ORANGE", ("orange", "coral", "apricot")),
    ("YELLOW", ("yellow", "lemon", "mustard")),
    ("GREEN", ("green", "olive", "mint", "sage", "dark olive")),
    ("BLUE", ("blue", "sky", "turquoise", "indigo", "denim", "navy", "teal")),
    ("PURPLE", ("purple", "violet", "lilac", "lavender")),
)
# Material families and the keywords that name them, in order.
MATERIAL_FAMILIES: Rules = (
    ("WOVEN_LEATHER", ("woven leather", "woven nappa", "woven")),
    ("CROC_EFFECT", ("croco", "croc effect", "crocodile")),
    ("METALLIC_LEATHER", ("metallic leather", "chrome leather")),
    ("PATENT", ("patent",)),
    ("NAPPA", ("nappa",)),
    ("SUEDE", ("suede",)),
    ("NUBUCK", ("nubuck",)),
    ("SATIN", ("satin",)),
    ("MESH", ("mesh",)),
    ("VINYL_TPU", ("vinyl", "tpu", "pvc")),
    ("TEXTILE", ("brocade", "nylon", "textile", "fabric", "denim")),
    ("SYNTHETIC", ("synthetic", "faux", "pu leather", "vegan")),
    ("LEATHER", ("leather", "sheep leather", "bovine", "capretto", "vintage", "lambskin", "calf")),
)
# Heel types and the keywords that name them, in order.
HEEL_TYPES: Rules = (
    ("WEDGE", ("wedge",)),
    ("STILETTO", ("stiletto", "stileto")),
    ("KITTEN", ("kitten",)),
    ("BLOCK", ("block heel", "block")),
    ("PLATFORM", ("platform",)),
    ("SCULPTURAL", ("sculptural", "opanka")),
    ("FLAT", ("flat heel", "flat sole", "no heel", "flat")),
)
# Toe shapes and the keywords that name them, in order.
TOE_SHAPES: Rules = (
    ("POINTED", ("pointed toe", "point toe")),
    ("SQUARE", ("square toe",)),
    ("ROUND", ("round toe", "toe-shape: round")),
    ("OPEN", ("open toe",)),
)
# Details (all that match) and the keywords that name them, in order.
DETAILS: Rules = (
    ("THONG", ("thong",)),
    ("BRAIDED", ("braided", "braid")),
    ("WOVEN", ("woven",)),
    ("FRINGE", ("fringe",)),
    ("BUCKLE", ("buckle",)),
    ("BOW", (" bow", "bow detail", "bow ")),
    ("RUCHED", ("ruched", "gathered")),
    ("FLOWER", ("flower", "floral")),
    ("PEARL", ("pearl", "beaded")),
    ("STONE", ("stone", "crystal", "gem")),
    ("METAL_HARDWARE", ("metal hardware", "hardware", "chrome")),
    ("CHAIN", ("chain",)),
    ("LACE_UP", ("lace up", "lace-up", "tie up", "tie-up")),
    ("STUD", ("stud",)),
    ("CUT_OUT", ("cut out", "cut-out", "cutout")),
    ("ASYMMETRIC", ("asymmetric", "asymmetrical")),
)
# Constructions (all that match) and the keywords that name them, in order.
CONSTRUCTIONS: Rules = (
    ("SLINGBACK", ("slingback", "sling back", "sling-back")),
    ("OPEN_TOE", ("open toe", "opened toe", "open-toe")),
    ("PEEP_TOE", ("peep toe", "peep-toe")),
    ("T_STRAP", ("t-strap", "t strap")),
    ("ANKLE_STRAP", ("ankle strap", "multi strap", "strap heel", "strap slide", "strap sandal")),
    ("BACKLESS", ("backless", "mule heel", " mule")),
    ("CLOSED_TOE", ("closed toe", "round toe closure")),
    ("HIGH_VAMP", ("high vamp",)),
    ("LOW_VAMP", ("low vamp", "ballet flat", "ballerina flat")),
)
# Constructions that a category implies.
CONSTRUCTION_OF_CATEGORY = {"SLINGBACK": "SLINGBACK", "MULE": "BACKLESS", "THONG": "OPEN_TOE"}


def bound(text: Column, body: Callable[[Column], Column]) -> Column:
    """body(text) with the text computed once, however often body reads it."""
    return F.get(F.transform(F.array(text), body), F.lit(0))


@cache
def literals(pattern: str) -> tuple[str, ...] | None:
    """Strings in lower case of which every text that the pattern matches, in any case, contains one; null if none is known."""
    from re import _constants as K
    from re import _parser

    def of(parsed) -> tuple[str, ...] | None:
        found, run = [], ""
        for op, arg in [*parsed, (None, None)]:
            if op is K.LITERAL:
                run += chr(arg)
                continue
            found, run = [*found, (run,)] if run else found, ""
            if op is K.SUBPATTERN:
                inner = of(arg[3])
            elif op is K.MAX_REPEAT and arg[0] > 0:
                inner = of(arg[2])
            elif op is K.BRANCH:
                each = [of(branch) for branch in arg[1]]
                inner = None if None in each else tuple(dict.fromkeys(x for e in each for x in e))
            else:
                inner = None
            if inner:
                found.append(inner)
        return max(found, key=lambda f: min(map(len, f)), default=None)

    # letters beyond ASCII have no case in these patterns, so only what is lower case there serves
    out = of(_parser.parse(pattern))
    if out is None or any(len(x) < 2 or not x.isascii() for x in out):
        return None
    return tuple(dict.fromkeys(x.lower() for x in out))


def may_match(low: Column, pattern: str) -> Column | None:
    """Whether a text in lower case holds what a match of the pattern needs: far cheaper than the pattern itself."""
    needed = literals(pattern)
    return None if needed is None else _any(low, needed)


def _any(text: Column, keywords: Sequence[str]) -> Column:
    out = text.contains(keywords[0])
    for k in keywords[1:]:
        out = out | text.contains(k)
    return out


def first_match(text: str | Column, rules: Rules) -> Column:
    """The tag of the first rule with a keyword in the text; null if there is none."""

    def chain(t: Column) -> Column:
        out = None
        for tag, keywords in rules:
            out = F.when(_any(t, keywords), tag) if out is None else out.when(_any(t, keywords), tag)
        return out

    return bound(col(text), chain)


def first_word_match(text: str | Column, rules: Rules) -> Column:
    """The tag of the first rule with a keyword that stands between white space, slashes, commas, dashes or the ends;
    case does not matter. One pass of one pattern finds all keywords, a map gives each the place of its rule."""
    place = {k.lower(): i for i, (_, keywords) in reversed(list(enumerate(rules))) for k in keywords}
    words = "|".join(re.escape(k) for k in sorted(place, key=len, reverse=True))
    found = F.regexp_extract_all(F.lower(col(text)), F.lit(rf"(?<=^|[\s/,-])(?=({words})(?:$|[\s/,-]))"), F.lit(1))
    places = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    least = F.array_min(F.transform(found, lambda k: F.element_at(places, k)))
    return F.get(F.array(*[F.lit(tag) for tag, _ in rules]), least)


def all_matches(text: str | Column, rules: Rules) -> Column:
    """The tags of all rules with a keyword in the text, in rule order."""
    return bound(col(text), lambda t: F.array_compact(F.array(*[F.when(_any(t, keywords), F.lit(tag)) for tag, keywords in rules])))


def color_family(color: str | Column, name: str | Column) -> Column:
    """Colour field first, then the colour at the end of the name, then the name. Two families around a slash: MULTICOLOR."""

    def of(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, "/"), F.trim), lambda p: p != "")
        families = F.array_distinct(F.array_compact(F.transform(parts, lambda p: first_word_match(p, COLOR_FAMILIES))))
        split = F.when(text.contains("/") & (F.size(parts) >= 2), F.when(F.size(families) >= 2, F.lit("MULTICOLOR")).when(F.size(families) == 1, F.get(families, F.lit(0))))
        return F.coalesce(split, first_word_match(text, COLOR_FAMILIES))

    return F.coalesce(of(col(color)), of(color_from_name(name)), of(col(name)), F.lit("UNKNOWN"))


def material_family(material: str | Column, name: str | Column) -> Column:
    found = first_match(combine_text(material, name), MATERIAL_FAMILIES)
    return F.coalesce(found, F.when(F.trim(col(material)) != "", "OTHER"), F.lit("UNKNOWN"))


def heel_type(heel: str | Column, height: str | Column, name: str | Column, category: str | Column) -> Column:
    found = first_match(combine_text(heel, height, name), HEEL_TYPES)
    return F.coalesce(F.when(col(category) == "WEDGE", "WEDGE"), found, F.when(F.trim(col(heel)) != "", "OTHER"), F.lit("UNKNOWN"))


def toe_shape(toe: str | Column, material: str | Column, name: str | Column) -> Column:
    text = combine_text(toe, material, name)
    out = None
    for tag, keywords in TOE_SHAPES:
        hit = text.rlike("|".join(rf"(?<![A-Za-z0-9_]){k}(?![A-Za-z0-9_])" for k in keywords))
        out = F.when(hit, tag) if out is None else out.when(hit, tag)
    return out.otherwise("UNKNOWN")


def details(*texts: str | Column) -> Column:
    return all_matches(F.concat(F.lit(" "), combine_text(*texts), F.lit(" ")), DETAILS)


def construction(category: str | Column, *texts: str | Column) -> Column:
    """Tags that the category implies, then those of the text."""
    implied = F.create_map(*[F.lit(x) for pair in CONSTRUCTION_OF_CATEGORY.items() for x in pair])[col(category)]
    return F.array_distinct(F.array_compact(F.concat(F.array(implied), all_matches(F.concat(F.lit(" "), combine_text(*texts), F.lit(" ")), CONSTRUCTIONS))))
