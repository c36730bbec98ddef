"""Primary categories and the features behind them, each with its status, source and confidence.

Facts are read off a product's words and construction once; rules are rows in order, the first that holds decides. All is
built-in expressions over one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.expr import borders, ladder
from trendloom.functions.rules import bound

# The words that each fact is read from; they stand anywhere in the product's text.
FACT_WORDS = {
    "backless": ("backless", " mule", "slide mule", "heeled mule"),
    "slingback": ("slingback", "sling back", "sling-back"),
    "sneaker": ("sneaker", "trainer", "cupsole", "running shoe", "court shoe", "skate shoe", "tennis shoe", "tenis", "ténis"),
    "ballet_sneaker": ("ballet sneaker", "ballerina sneaker", "mary jane sneaker"),
    "espadrille": ("espadrille", "jute sole", "jute wedge", "rope sole", "raffia sole"),
    "clog": (" clog", "clogs", "wooden clog", "molded clog"),
    "laced": (" oxford", " derby", "brogue", "lace-up dress", "cap toe oxford", "wholecut"),
    "derby": ("derby",),
    "boot": (" boot", "bootie", "ankle boot", "knee boot", "chelsea boot", "combat boot", "biker boot", "riding boot"),
    "other_shape": ("pump", "loafer", "ballet", "ballerina", "mule", "bootie", "sneaker", "trainer", "mary jane", "mary-jane", "clog", "oxford", "derby"),
    "open": ("thong", "flip flop", "flip-flop", "strappy", "t-strap", "ankle strap", "toe ring", "toe-post", "toe post", "slide sandal", "gladiator"),
    "mules": (" mule", "mules"),
    "sandals": (" sandal", "sandals"),
    "named_sandal": (" sandal", "slide sandal", "strappy sandal", " thong", "flip flop", "flip-flop", "t-strap sandal"),
    "loafer": ("loafer", "penny loafer", "horsebit", "tassel loafer", "moc toe", "moccasin", "mocassim", "mocassins", "apron toe loafer"),
    "heeled": ("pump", " stiletto", " kitten heel", " heeled"),
    "mary_jane": ("mary jane", "mary-jane", "maryjanes"),
    "pointed_flat": ("pointed-toe flat", "pointed toe flat", "pointed flat"),
    "low_ballet": ("ballet", "ballerina", "slipper flat", "flat shoe"),
    "ballet": ("ballet", "ballerina"),
    "covered": ("closed toe", "pointed mule", "covered vamp", "vamp mule"),
}
# What a shop's own category proves, in order: category, what its text is, and what it holds.
EXACT_SOURCES = (
    ("BALLET_FLAT", None, ("ballet pumps", "/women/shoes/ballet-pumps")),
    ("ESPADRILLE", None, ("/uk/shopping/women/espadrilles-1/items.aspx",)),
    ("OXFORD_DERBY", None, ("/uk/shopping/women/derby-oxford-shoes-1/items.aspx",)),
    ("LOAFER", None, ("/uk/shopping/women/slippers-1/items.aspx",)),
    ("SANDAL", None, ("/uk/shopping/women/flip-flops-slides-1/items.aspx",)),
    ("OXFORD_DERBY", None, ("oxfords & derbies", "/women/shoes/oxfords-derbies")),
    ("SNEAKER", "sneakers", ("/women/shoes/sneakers",)),
    ("LOAFER", "loafers", ("/women/shoes/loafers",)),
)
# Categories of the older kind.
LEGACY = {"BALLERINA": "BALLET_FLAT", "MARY_JANE": "BALLET_FLAT", "LOAFER": "LOAFER", "PUMP": "PUMP", "SLINGBACK": "PUMP", "SANDAL": "SANDAL", "THONG": "SANDAL", "MULE": "MULE", "BOOT": "BOOT", "ANKLE_BOOT": "BOOT", "SNEAKER": "SNEAKER", "WEDGE": "SANDAL"}
MIXED_SOURCE = r"sapatilhas?\s*e\s*t[eé]nis|t[eé]nis\s*e\s*sapatilhas?"
# Millimetres from which a heel is raised, and up to which a shoe is flat.
RAISED_MM, FLAT_MM = 30, 15
#: Rules in order: category, reason, condition on the facts, influence of another shape (None: none).
Fact = Callable[[Column], Column]
RULES: tuple[tuple[str, str, Fact, Fact | None], ...] = (
    ("SNEAKER", "sneaker-dominant-construction", lambda f: f["sneaker"], lambda f: F.when(f["ballet_sneaker"], "BALLET")),
    ("ESPADRILLE", "espadrille-sole-architecture", lambda f: f["espadrille"], None),
    ("CLOG", "clog-base-architecture", lambda f: f["clog"], None),
    ("OXFORD_DERBY", "lace-up-dress-shoe", lambda f: f["laced"], lambda f: F.when(f["derby"], "DERBY").otherwise("OXFORD")),
    ("BOOT", "boot-shaft-architecture", lambda f: f["boot"] | f["legacy"].isin("BOOT", "ANKLE_BOOT"), None),
    ("SANDAL", "open-strap-footwear", lambda f: is_sandal(f), None),
    ("MULE", "backless-loafer-architecture", lambda f: is_backless(f) & f["loafer"], lambda f: F.lit("LOAFER")),
    ("MULE", "backless-covered-vamp-heeled", lambda f: is_backless(f) & is_raised(f), lambda f: F.lit("PUMP")),
    ("MULE", "backless-ballet-upper", lambda f: is_backless(f) & is_ballet(f), lambda f: F.lit("BALLET")),
    ("MULE", "backless-covered-vamp", lambda f: is_backless(f) & ((f["backless"] & f["covered"]) | (f["legacy"] == "MULE")), None),
    ("BALLET_FLAT", "low-slingback-flat", lambda f: is_slingback(f) & (f["mm"] <= FLAT_MM), None),
    ("PUMP", "slingback-pump", lambda f: is_slingback(f) & is_raised(f), None),
    ("BALLET_FLAT", "slingback-ballet-flat", lambda f: is_slingback(f) & is_ballet(f), None),
    ("PUMP", "raised-heel-pump-upper", lambda f: is_raised(f), lambda f: F.when(f["ballet"], "BALLET")),
    ("LOAFER", "loafer-architecture", lambda f: f["loafer"] & ~is_backless(f), None),
    ("BALLET_FLAT", "ballet-flat-architecture", lambda f: is_ballet(f), None),
)


def is_backless(f: Column) -> Column:
    return f["backless"] | F.array_contains(f["construction"], "BACKLESS")


def is_slingback(f: Column) -> Column:
    return f["slingback"] | F.array_contains(f["construction"], "SLINGBACK")


def is_raised(f: Column) -> Column:
    return F.coalesce(f["mm"] >= RAISED_MM, F.lit(False)) | f["height"].isin("MID", "HIGH") | f["heeled"]


def is_ballet(f: Column) -> Column:
    by_words = F.when(f["height"].isin("FLAT", "LOW"), f["low_ballet"]).otherwise(f["ballet"])
    return f["mary_jane"] | f["pointed_flat"] | F.coalesce(f["mm"] <= FLAT_MM, F.lit(False)) | by_words


def is_sandal(f: Column) -> Column:
    """Named a sandal, or stored as one with no other shape named; a pump that names no sandal is none, nor is a mule."""
    open_ = f["open"] | F.arrays_overlap(f["construction"], F.array(F.lit("OPEN_TOE"), F.lit("TOE_POST"), F.lit("THONG")))
    mule = is_backless(f) & ~open_ & (F.array_contains(f["construction"], "CLOSED_TOE") | (f["legacy"] == "MULE") | f["mules"])
    return ~(f["pump"] & ~f["sandals"]) & ~mule & (f["named_sandal"] | (~f["other_shape"] & f["legacy"].isin("SANDAL", "THONG")))


@dataclass
class Product:
    """Columns of a product; details and construction are arrays, source is the text of its place in the shop."""

    name: Column
    legacy: Column
    construction: Column
    height: Column
    cleaned_height: Column
    toe: Column
    details: Column
    material: Column
    source: Column
    heel: Column | None = None
    color: Column | None = None

    def __post_init__(self) -> None:
        self.heel, self.color = (F.lit(None).cast("string") if c is None else c for c in (self.heel, self.color))
        for c in ("construction", "details"):
            setattr(self, c, F.coalesce(getattr(self, c), F.array().cast("array<string>")))


def text_of(*parts: Column) -> Column:
    """Parts in lower case, one space between words."""
    return F.trim(F.regexp_replace(F.lower(F.array_join(F.filter(F.concat(*parts), lambda p: p != ""), " ")), r"\s+", " "))


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def millimetres(text: Column) -> Column:
    return F.regexp_extract(text, "(?i)" + borders(r"\b(\d{1,3})\s*mm\b"), 1).try_cast("int")


def primary_category(x: Product) -> Column:
    """category, influences, reason and provenance. A shop's exact category comes first, then the rules, then the older
    category; what nothing proves is UNCLASSIFIED."""
    cleaned = F.coalesce(x.cleaned_height, F.lit(""))
    words = text_of(F.array(x.name, cleaned, x.toe, x.material), x.details)
    source = text_of(F.array(x.source))
    none = F.array().cast("array<string>")

    def answer(category: Column, influences: Column, reason: Column, provenance: str) -> Column:
        return F.struct(category.alias("category"), influences.alias("influences"), reason.alias("reason"), F.lit(provenance).alias("provenance"))

    def facts(t: Column) -> Column:
        read = [holds_any(t, w).alias(name) for name, w in FACT_WORDS.items()]
        known = [t.rlike(borders(r"\bpumps?\b")).alias("pump"), t.rlike(borders(r"\bsapatilha")).alias("sapatilha"), millimetres(F.concat_ws(" ", t, cleaned)).alias("mm")]
        given = [F.coalesce(x.legacy, F.lit("")).alias("legacy"), F.coalesce(x.height, F.lit("")).alias("height"), x.construction.alias("construction")]
        return F.struct(*read, *known, *given)

    def decide(f: Column) -> Column:
        exact = bound(source, lambda s: ladder(*[((s == F.lit(same)) | holds_any(s, held) if same else holds_any(s, held), c) for c, same, held in EXACT_SOURCES]))
        rows = [(held(f), answer(F.lit(c), F.array_compact(F.array(by(f))) if by else none, F.lit(reason), "PRODUCT_EVIDENCE")) for c, reason, held, by in RULES]
        old = F.element_at(F.create_map(*[F.lit(v) for pair in LEGACY.items() for v in pair]), f["legacy"])
        doubtful = f["legacy"].isin("BALLERINA", "MARY_JANE") & f["sapatilha"] & source.rlike(MIXED_SOURCE)
        return ladder(
            (exact.isNotNull(), answer(exact, none, F.lit("exact-source-product-category"), "SOURCE_CATEGORY")),
            *rows,
            (doubtful, answer(F.lit("UNCLASSIFIED"), none, F.lit("sapatilha-mixed-tenis-collection-conservative"), "INSUFFICIENT")),
            (old.isNotNull(), answer(old, none, F.concat(F.lit("legacy-category:"), f["legacy"]), "LEGACY_CATEGORY")),
            default=answer(F.lit("UNCLASSIFIED"), none, F.lit("insufficient-evidence"), "INSUFFICIENT"),
        )

    return bound(bound(words, facts), decide)


# How the values of other vocabularies are named here.
TOES = ("POINTED", "ROUND", "SQUARE")
HEIGHTS = ("FLAT", "LOW", "MID", "HIGH")
HEELS = {"FLAT": "NONE", "KITTEN": "KITTEN", "BLOCK": "BLOCK", "STILETTO": "STILETTO", "WEDGE": "WEDGE", "SCULPTURAL": "SCULPTURAL", "PLATFORM": "OTHER", "OTHER": "OTHER"}
# Features by words, for the categories that have them; "first" takes the first that holds, "all" takes all.
WORD_FEATURES = (
    ("loaferDetail", ("LOAFER", "MULE"), "all", (("HORSEBIT", ("horsebit",)), ("PENNY_STRAP", ("penny",)), ("TASSEL", ("tassel",)))),
    ("apronConstruction", ("LOAFER", "MULE"), "first", (("APRON", ("apron", "moc toe")),)),
    ("bootStyleFeatures", ("BOOT",), "all", (("CHELSEA", ("chelsea",)), ("BIKER", ("biker", "moto")))),
    ("shaftHeight", ("BOOT",), "first", (("OVER_THE_KNEE", ("over the knee",)), ("KNEE_HIGH", ("knee high", "knee-high", " knee boot")), ("MID_CALF", ("mid calf", "mid-calf")), ("ANKLE", ("ankle boot", "ankle-boot", " bootie")))),
    ("styleArchetype", ("SNEAKER",), "first", (("COURT", ("court",)), ("RETRO_RUNNER", ("runner", "running")), ("SKATE", ("skate",)), ("BALLET_INSPIRED", ("ballet sneaker",)))),
    ("sneakerHeight", ("SNEAKER",), "first", (("HIGH_TOP", ("high top", "high-top")), ("MID_TOP", ("mid top", "mid-top")), ("LOW_TOP", ("low top", "low-top")))),
    ("espadrilleSoleHeight", ("ESPADRILLE",), "first", (("WEDGE", ("wedge",)), ("PLATFORM", ("platform espadrille", "platform wedge")), ("FLAT", ("flat espadrille",)))),
    ("lacingConstruction", ("OXFORD_DERBY",), "first", (("DERBY", ("derby",)), ("MONK", ("monk",)), ("OXFORD", (" oxford", "oxford shoe", "wholecut")))),
    ("baseConstruction", ("CLOG",), "first", (("WOOD", ("wood",)),)),
)
# A mule has loafer features only with these words; categories with a strap configuration; straps by construction.
MULE_LOAFER_WORDS = ("loafer", "horsebit")
STRAPPED = ("BALLET_FLAT", "PUMP", "SANDAL", "MULE")
INSTEP_WORDS = ("instep strap", "mary jane")
# Confidence of what is read, of a height in millimetres, and of what a category implies.
READ, MEASURED, IMPLIED = 0.75, 0.95, 0.85


def feature(field: str, values: Column, source: str = "PRODUCT_TEXT", confidence: float = READ, applies: Column | None = None) -> Column:
    """A feature with its provenance: values is an array, empty or null where nothing is known."""
    known = F.coalesce(F.size(values) > 0, F.lit(False))
    known = known if applies is None else known & applies
    status = F.when(known, "KNOWN").otherwise("UNKNOWN")
    status = status if applies is None else F.when(~applies, "NOT_APPLICABLE").otherwise(status)
    return F.struct(F.lit(field).alias("field"), F.when(known, values).alias("value"), status.alias("status"), F.when(known, F.lit(source)).otherwise("UNKNOWN").alias("source"), F.when(known, F.lit(confidence)).alias("confidence"))


def features(x: Product, primary: Column, raw_material: Column) -> Column:
    """Features of a product as an array: what all categories have, then what its category has. primary: as
    `primary_category` gives it; raw_material: the material as the shop writes it."""
    has = lambda flag: F.array_contains(x.construction, flag)
    one = lambda c: F.array_compact(F.array(c))
    category, material, color = primary["category"], x.material, x.color

    def all_of(t: Column) -> Column:
        back = ladder((has("SLINGBACK") | holds_any(t, FACT_WORDS["slingback"]), "SLINGBACK"), (has("BACKLESS") | holds_any(t, FACT_WORDS["backless"]), "BACKLESS"))
        toe = ladder((has("PEEP_TOE") | t.contains("peep toe"), "PEEP"), (has("OPEN_TOE") | t.contains("open toe"), "OPEN"))
        straps = F.array_compact(F.array(*[F.when(has(s), F.lit(s)) for s in ("T_STRAP", "ANKLE_STRAP", "SLINGBACK")]))
        parts = F.array_compact(F.array(*[F.when(has(s), F.lit(s)) for s in ("SLINGBACK", "T_STRAP", "ANKLE_STRAP")], F.when(holds_any(t, INSTEP_WORDS), F.lit("SINGLE_INSTEP"))))
        implied = F.when(back.isNull() & (category == "MULE"), feature("backConstruction", F.array(F.lit("BACKLESS")), "DERIVED", IMPLIED)).otherwise(feature("backConstruction", one(back)))
        known = lambda c: F.when(c != "UNKNOWN", c)
        shared = [
            feature("toeShape", one(F.when(x.toe.isin(*TOES), x.toe)), "DERIVED"),
            feature("toeOpening", one(toe)),
            implied,
            feature("heelHeightClass", one(F.when(x.height.isin(*HEIGHTS), x.height)), "DERIVED"),
            # no heel of 0 mm
            feature("heelHeightMm", one(F.nullif(millimetres(F.concat_ws(" ", x.name, x.cleaned_height)), F.lit(0)).cast("string")), confidence=MEASURED),
            feature("heelType", one(F.element_at(F.create_map(*[F.lit(v) for pair in HEELS.items() for v in pair]), x.heel)), "DERIVED"),
            feature("materialFamily", one(known(material)), "DERIVED"),
            feature("colorFamily", one(known(color)), "DERIVED"),
            feature("strapFeatures", straps),
            feature("strapConfiguration", one(F.when(F.size(parts) > 0, F.array_join(parts, "+"))), applies=category.isin(*STRAPPED)),
        ]
        own = []
        for field, of, how, words in WORD_FEATURES:
            hits = F.array_compact(F.array(*[F.when(holds_any(t, w), F.lit(v)) for v, w in words]))
            mine = category.isin(*of) if "MULE" not in of else (category == "LOAFER") | ((category == "MULE") & holds_any(t, MULE_LOAFER_WORDS))
            own.append(F.when(mine, feature(field, hits if how == "all" else F.slice(hits, 1, 1))))
        return F.array_compact(F.array(*shared, *own))

    return bound(text_of(F.array(x.name, x.cleaned_height, raw_material)), all_of)


def style_tags(primary: Column, found: Column, name: Column) -> Column:
    """Tags of a style by category, influences, features and name, each once."""
    value = lambda field: F.get(F.filter(found, lambda s: s["field"] == field), F.lit(0))["value"]
    has = lambda field, v: F.coalesce(F.array_contains(value(field), v), F.lit(False))
    strap = F.coalesce(F.get(value("strapConfiguration"), F.lit(0)), F.lit(""))
    category, influences = primary["category"], primary["influences"]

    def tags(low: Column) -> Column:
        loafer = (category == "LOAFER") | ((category == "MULE") & F.array_contains(influences, "LOAFER"))
        rows = (
            ("MARY_JANE", ((category == "BALLET_FLAT") & strap.contains("INSTEP")) | low.contains("mary jane") | low.contains("mary-jane")),
            ("HORSEBIT_LOAFER", loafer & (has("loaferDetail", "HORSEBIT") | low.contains("horsebit"))),
            ("BIKER_BOOT", (category == "BOOT") & (has("bootStyleFeatures", "BIKER") | low.contains("biker"))),
            ("CHELSEA_BOOT", (category == "BOOT") & (has("bootStyleFeatures", "CHELSEA") | low.contains("chelsea"))),
            ("BALLET_SNEAKER", (category == "SNEAKER") & F.array_contains(influences, "BALLET")),
            ("SLINGBACK_PUMP", (category == "PUMP") & (low.contains("slingback") | strap.contains("SLINGBACK"))),
            ("THONG_SANDAL", (category == "SANDAL") & (low.contains("thong") | low.contains("flip flop"))),
            ("PLATFORM_DERBY", (category == "OXFORD_DERBY") & (low.contains("platform") | low.contains("flatform"))),
            ("ESPADRILLE_WEDGE", (category == "ESPADRILLE") & low.contains("wedge")),
        )
        return F.array_compact(F.array(*[F.when(held, F.lit(tag)) for tag, held in rows]))

    return bound(F.lower(F.coalesce(name, F.lit(""))), tags)
