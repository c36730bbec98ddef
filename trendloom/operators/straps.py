"""Strap topology: what the straps seen in a picture say about a shoe. All higher-order functions over one row.

Elements are an array of (type, location, wraps, confidence, images); a feature needs an element of one of its types at one of
its places, seen surely enough, and some features an element that goes around a part of the foot.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.expr import ladder
from trendloom.functions.rules import bound

# Types and places that support a feature, and what an element must go around.
SUPPORT = {
    "ankleStrap": (("ANKLE_STRAP", "ANKLE_WRAP_LACE"), ("ANKLE",), ("ANKLE", "FOOT")),
    "slingback": (("HEEL_SLING", "BACK_STRAP"), ("HEEL",), ()),
    "thong": (("TOE_POST",), ("TOE",), ()),
    "maryJaneStrap": (("MARY_JANE_STRAP", "INSTEP_STRAP"), ("INSTEP",), ()),
    "tStrap": (("T_STRAP_VERTICAL",), ("INSTEP", "FOREFOOT"), ()),
}
# Confidence from which an element counts, a feature is eligible, and a strap is.
UNCERTAIN, ELIGIBLE, STRAP_ELIGIBLE = 70, 85, 90
FIELDS = {"type": "string", "location": "string", "wraps": "string", "confidence": "int", "images": "array<int>"}
# Elements that prove an absence, and the confidence of an absence and of not knowing.
ENOUGH, ABSENT, UNSURE = 2, 78, 35


def supporting(name: str, elements: Column) -> Column:
    """The elements that support a feature."""
    types, places, around = SUPPORT[name]

    def supports(e: Column) -> Column:
        fits = e["type"].isin(*types) & e["location"].isin(*places) & (e["confidence"] >= UNCERTAIN)
        return F.coalesce(fits & e["wraps"].isin(*around) if around else fits, F.lit(False))

    return F.filter(elements, supports)


def images_of(elements: Column) -> Column:
    """All images of the elements, each once, in order."""
    every = F.array_distinct(F.flatten(F.transform(elements, lambda e: F.coalesce(e["images"], F.array().cast("array<int>")))))
    # sort_array compares values, array_sort calls a function for each comparison; a null comes last.
    return bound(every, lambda i: F.when(F.array_contains(F.transform(i, lambda n: n.isNull()), True), F.array_sort(i)).otherwise(F.sort_array(i)))


def status(confidence: Column, least: int, contradicts: Column | None = None) -> Column:
    first = [] if contradicts is None else [(F.coalesce(contradicts, F.lit(False)), "CONTRADICTION")]
    return ladder(*first, (confidence >= least, "RADAR_ELIGIBLE"), (confidence >= UNCERTAIN, "VISION_UNCERTAIN"), default="NOT_USABLE_FOR_RADAR")


def derived(elements: Column) -> Column:
    """An array with each strap feature: value, confidence, images and why; a null topology counts as one without elements."""
    plain = F.transform(elements, lambda e: F.struct(*[e[f].cast(kind).alias(f) for f, kind in FIELDS.items()]))
    every = F.coalesce(plain, F.array().cast(f"array<struct<{','.join(f'{f}:{kind}' for f, kind in FIELDS.items())}>>"))

    def one(name: str, every: Column, all_images: Column) -> Column:
        return bound(supporting(name, every), lambda found: told(name, found, every, all_images))

    def told(name: str, found: Column, every: Column, all_images: Column) -> Column:
        seen, many = F.size(found) > 0, F.size(every) >= ENOUGH
        confidence = F.when(seen, F.array_max(F.transform(found, lambda e: e["confidence"]))).when(many, F.lit(ABSENT)).otherwise(F.lit(UNSURE))
        images = F.when(seen, images_of(found)).when(many, all_images).otherwise(F.array().cast("array<int>"))
        why = F.when(seen, F.concat(F.lit("Derived from strap topology: "), F.array_join(F.transform(found, lambda e: e["type"]), ", "))).when(many, "No matching strap element in topology map").otherwise("Insufficient strap topology evidence")
        value = F.when(seen, "YES").when(many, "NO").otherwise("UNKNOWN")
        return F.struct(F.lit(name).alias("feature"), value.alias("value"), confidence.alias("confidence"), images.alias("images"), why.alias("why"), status(confidence, ELIGIBLE).alias("usability"))

    return bound(every, lambda e: bound(images_of(e), lambda i: F.array(*[one(name, e, i) for name in SUPPORT])))


def eligibility(name: Column, value: Column, confidence: Column, images: Column, verifier: Column, contradicts: Column, elements: Column) -> Column:
    """usability and eligible of a strap feature once it is verified: it must be seen, sure, verified, with an image, with the
    topology behind it and without a contradiction."""
    backed = ladder(*[(name == n, F.size(supporting(n, elements)) > 0) for n in SUPPORT], default=False)
    eligible = (value == "YES") & (confidence >= STRAP_ELIGIBLE) & (verifier == "VERIFIED") & (F.size(images) >= 1) & backed & ~F.coalesce(contradicts, F.lit(False))
    return F.struct(status(confidence, STRAP_ELIGIBLE, contradicts).alias("usability"), F.coalesce(eligible, F.lit(False)).alias("eligible"))
