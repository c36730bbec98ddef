"""Names of models: what is left of a title or handle without colours, materials, seasons and noise, and what it tells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.expr import borders, ladder
from trendloom.functions.names import without_marks
from trendloom.functions.rules import bound

# Words that a title loses: colours, materials, seasons and sizes.
COLORS = (
    "black", "white", "brown", "tan", "nude", "gold", "silver", "platinum", "burgundy", "red", "blue", "pink", "beige", "cream",
    "espresso", "chocolate", "chestnut", "olive", "olivine", "ecru", "ivory", "navy", "grey", "gray", "milk", "turquoise",
    "denim", "sky", "metallic", "chrome", "vintage", "mocha", "cognac", "camel", "sand", "rose", "blush", "coral", "lilac",
    "purple", "green", "yellow", "orange", "multicolor", "multi", "teal", "tulip", "oyster", "eggplant", "mushroom", "lipstick",
    "seaweed", "puff", "champagne", "natural", "moon", "specchio", "choc", "bordo", "bordeaux", "maroon", "wine", "pearl",
    "copper", "bronze", "charcoal", "stone", "sage", "mint", "lavender", "fuchsia", "magenta", "mustard", "rust", "terracotta",
    "aubergine", "deep", "light", "dark", "bright", "pale", "soft", "rich", "warm", "cool", "buff", "leopard", "ebony",
    "embossed", "printed", "print", "heeled",
)
MATERIALS = (
    "leather", "suede", "patent", "nappa", "metallic", "velvet", "satin", "mesh", "snake", "croco", "croc", "woven", "knit",
    "boucle", "wool", "cashmere", "denim", "canvas", "synthetic", "rubber", "capretto", "venice", "vintage", "raffia", "vinyl",
    "grosgrain", "specchio", "kid", "naplack", "brocat", "brocade", "tpu", "clear", "calf", "hair", "ponyhair",
)
SEASONS = (r"p26", r"p25", r"p24", r"p\d+", r"s\d+", r"ss\d+", r"fw\d+", r"aw\d+", r"women'?s", r"mens", r"unisex", r"new", r"sale", r"in")
# What a model is; a title ends after the first of these.
KINDS = (r"ballet flat", r"ankle boot", r"knee boot", r"chelsea boot", r"platform sandal", r"wedge mule", r"wedge sandal", r"low sandal", r"high sandal", r"slingbacks?", r"ballerinas?", r"flats?", r"heels?", r"pumps?", r"sandals?", r"mules?", r"loafers?", r"boots?", r"booties?", r"sneakers?", r"slides?", r"wedges?", r"thongs?")
PLURALS = (
    "slingbacks", "ballerinas", "flats", "heels", "pumps", "sandals", "mules", "loafers", "booties", "boots", "sneakers",
    "slides", "wedges", "thongs",
)
# Titles and words that name no model.
GENERIC_PHRASES = (
    "ankle boot", "ballet flat", "ballerina flat", "chelsea boot", "combat boot", "court shoe", "cowboy boot",
    "cowboy ankle boot", "flip flop", "flip flops", "heeled sandal", "heeled sandals", "high heel", "high heels", "knee boot",
    "knee high boot", "mary jane", "platform sandal", "platform pump", "wedge sandal", "wedge mule", "wedge boot",
    "flat sandal", "flat shoe", "flat shoes", "leather boot", "leather pump", "nappa ankle boot", "suede ankle boot",
    "suede pump", "patent leather pump",
)
GENERIC_WORDS = (
    "boot", "boots", "ankle", "knee", "flat", "flats", "ballet", "ballerina", "ballerinas", "slingback", "slingbacks", "mule",
    "mules", "sandal", "sandals", "pump", "pumps", "heel", "heels", "heeled", "wedge", "wedges", "sneaker", "sneakers",
    "loafer", "loafers", "espadrille", "espadrilles", "clog", "clogs", "oxford", "derby", "mary", "jane", "slide", "slides",
    "flip", "flop", "flops", "thong", "thongs", "platform", "platforms", "court", "shoe", "shoes", "footwear", "bootie",
    "booties", "slipper", "slippers", "trainer", "trainers", "chelsea", "cowboy", "combat", "biker", "high", "low", "mid",
    "view", "all", "new", "in", "women", "womens", "woman", "zapatos", "sandalias", "botas", "sapatos", "escarpins",
    "ballerines", "bottines", "sandales", "chaussures", "print", "effect", "classic", "vintage", "sporty", "soft", "contrast",
    "leather", "nappa", "suede", "patent", "pointed", "round", "square", "almond", "open", "closed", "block", "stiletto", "toe",
    "cap", "strap", "cut",
)
# What colourways differ by in titles: colours, harmless materials, noise; and plurals there.
COLORWAY_COLORS = (
    "black", "white", "brown", "tan", "nude", "gold", "silver", "platinum", "platine", "burgundy", "red", "blue", "bleu",
    "pink", "beige", "cream", "espresso", "chocolate", "chestnut", "olive", "olivine", "ecru", "ivory", "ivoire", "navy",
    "grey", "gray", "milk", "turquoise", "denim", "sky", "metallic", "chrome", "vintage", "mocha", "cognac", "camel", "sand",
    "rose", "blush", "coral", "lilac", "purple", "green", "yellow", "orange", "multicolor", "multi", "teal", "tulip", "oyster",
    "eggplant", "mushroom", "lipstick", "seaweed", "puff", "champagne", "natural", "moon", "specchio", "choc", "bordo",
    "bordeaux", "maroon", "wine", "pearl", "copper", "bronze", "charcoal", "stone", "sage", "mint", "lavender", "fuchsia",
    "magenta", "mustard", "rust", "terracotta", "aubergine", "deep", "light", "dark", "bright", "pale", "soft", "rich", "warm",
    "cool", "crystal", "smoke", "tortoise", "chili", "saddle", "hazelnut", "moka", "port", "cloud", "taupe", "khaki", "maya",
    "cactus", "plum", "lobster", "burnt", "umber", "french", "striped", "printed", "print", "distressed", "embossed", "croc",
    "croco", "snake", "python", "blanc", "noir", "rouge", "caramel", "marine", "brut", "jean", "petrol", "ballet", "bone",
    "tumble", "argent", "argente", "leopard", "marron", "ciel", "noisette", "chocolat", "bourgogne", "abysse", "perfore",
    "lamine", "buff", "olive", "eggshell", "greige", "cedar", "oatmeal", "oat", "chalk", "parchment", "butter", "pewter",
    "merlot", "oxblood", "ink",
)
COLORWAY_MATERIALS = (
    "leather", "suede", "patent", "nappa", "lambskin", "calf", "nubuck", "cuir", "verni", "vernis", "vernies", "velours",
    "tissu", "grosgrain", "kid", "capretto", "naplack",
)
COLORWAY_HAIR = (r"calf\s+hair", r"pony\s*hair", r"ponyhair")
COLORWAY_NOISE = (r"women'?s", "womens", "mens", "unisex", "new", "sale", "in", "the", "and", "with", "x", "babies", "baby", "avec", "brides", "bride", "et", "escarpins", "ballerines", "bottines", "mocassins", "bottes", "pumps", "heeled", "hair")
COLORWAY_PLURALS = (
    "slingbacks", "ballerines", "ballerinas", "flats", "heels", "pumps", "sandals", "mules", "loafers", "booties", "boots",
    "sneakers", "slides", "wedges", "thongs", "escarpins", "bottines", "mocassins", "bottes",
)
# What a handle loses at its end.
HANDLE_COLORS = (
    "black", "white", "brown", "tan", "beige", "red", "blue", "green", "silver", "gold", "cream", "creamy", "ivory", "nude",
    "navy", "grey", "gray", "pink", "camel", "cognac", "olive", "ecru", "mocha", "moka", "port", "cloud", "taupe", "khaki",
    "burgundy", "wine", "rose", "blush", "coral", "lilac", "purple", "yellow", "orange", "teal", "mint", "sage", "stone",
    "sand", "chocolate", "espresso", "chestnut", "natural", "offwhite", "off", "multi", "metallic", "dusty", "dark", "light",
    "deep", "glass", "moss", "tobacco", "scarlet", "hazelnut", "mahogany", "oxblood", "cranberry", "crimson", "walnut", "cocoa",
    "pine", "smoke", "bone", "cherry", "honey", "praline", "whiskey", "tortoise", "crystal", "platinum", "limewash", "onyx",
    "midnight", "lemon", "noir", "embossed", "caramel", "argent", "argente", "platine", "leopard", "marron", "ivoire",
    "bordeaux", "cognac", "abysse", "buff", "eggshell", "greige", "cedar", "oatmeal", "oat", "chalk", "parchment", "butter",
    "champagne", "rust", "terracotta", "mushroom", "pewter", "bronze", "copper", "merlot", "oxblood", "ink", "python",
)
HANDLE_MATERIALS = (
    "suede", "leather", "nappa", "patent", "lambskin", "calf", "snake", "nubuck", "croc", "croco", "python", "ponyhair",
    "calfskin", "laminated", "lamine", "laminé", "naplack", "verni", "vernis", "velours", "cuir",
)
HANDLE_NOISE = (
    "heel", "height", "mid", "high", "low", "flat", "flats", "dk", "lt", "mini", "and", "the", "x", "loafer", "loafers",
    "mocassin", "mocassins", "ballerine", "ballerines", "escarpin", "escarpins", "bottine", "bottines", "pump", "pumps",
    "sandal", "sandals", "sneaker", "sneakers", "boot", "boots", "babies", "baby", "avec", "brides", "bride",
)
HANDLE_CODES = (r"(?:p|u|r|s|ss|fw|aw)\d{2}", r"s\d{10,}")
# Constructions by words of title and URL.
FLAGS = (
    ("mesh", r"\bmesh\b|\br[eé]sille\b"),
    ("shearling", r"\bshearling\b"),
    ("platform", r"\bplatform\b"),
    ("wood", r"\b(?:x[- ]?wood|\bwood)\b"),
    ("clear", r"\b(?:x[- ]?clear|clear (?:sandal|heel|pump|mule|platform)|lucite)\b"),
    ("slingback", r"\bslingbacks?\b|\bsling\b"),
    ("lite", r"\blite\b|\bnylon\b"),
    ("broderie", r"\bbroderie\b"),
    ("macrame", r"\bmacrame\b"),
    ("wedge", r"\bwedges?\b"),
    ("sequin", r"\bsequin"),
    ("satin", r"\bsatin\b"),
    ("raffia", r"\braffia\b"),
    ("cracked", r"\bcracked\b"),
    ("vinyl", r"\bvinyl\b|\bjelly\b"),
    ("laceup", r"\blace[- ]?ups?\b"),
    ("braided", r"\btresse\b|\bbraided\b|\bwoven\b"),
)
WOODEN = r"\bx[- ]?wood\b|\bwood[- ]?platform\b|\bplatform[- ]?wood\b|\bwooden\b|\bwood heel\b|\bwood block\b|\bwood sole\b"


def words(alternatives) -> str:
    return borders(rf"(?i)\b(?:{'|'.join(alternatives)})\b")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _literal(text: Column) -> Column:
    """A text as a pattern that matches it alone."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def _without(text: Column, known: Column) -> Column:
    """The text without a known phrase, in any case, where it stands between word borders."""
    pattern = F.concat(F.lit(borders(r"(?i)\b")), _literal(known), F.lit(borders(r"\b")))
    return F.when(F.trim(known) != "", F.regexp_replace(text, pattern, F.lit(" "))).otherwise(text)


def singular(text: Column, plurals) -> Column:
    return F.regexp_replace(text, borders(rf"(?i)\b({'|'.join(p[:-1] for p in plurals)})s\b"), "$1")


def model_name(title: Column, color: Column) -> Column:
    """A title without its colour, materials, season and what follows the kind of shoe, in lower case and singular."""
    known = F.trim(F.coalesce(color, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s[-–—]\s+.+$", ""), "/", " ")
    parts = F.filter(F.split(known, r"\s+"), lambda p: F.length(p) >= 2)
    text = F.aggregate(parts, _without(text, known), _without)
    for lost in (COLORS, MATERIALS, SEASONS):
        text = F.regexp_replace(text, words(lost), " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9\s'-]", " "), r"(^|\s)-+(?=\s|$)", " ")
    # a longer kind before a shorter one: of two that begin at one place the longer ends the title
    end = borders(rf"(?i)^(.*?\b(?:{'|'.join(sorted(KINDS, key=len, reverse=True))})\b)")
    return bound(squeeze(text), lambda t: F.lower(singular(squeeze(F.when(F.regexp_extract(t, end, 1) != "", F.regexp_extract(t, end, 1)).otherwise(t)), PLURALS)))


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def is_generic(name: Column) -> Column:
    return bound(plain_words(name), lambda w: (F.size(w) == 0) | F.array_join(w, " ").isin(*GENERIC_PHRASES) | F.forall(w, lambda x: x.isin(*GENERIC_WORDS)))


def is_distinctive(name: Column) -> Column:
    """A name with a word of three letters or more that is no generic one."""
    return ~is_generic(name) & F.exists(plain_words(name), lambda x: ~x.isin(*GENERIC_WORDS) & (F.length(x) >= 3))


def colorless_title(title: Column, color: Column) -> Column:
    """A title without what colourways of one model differ by."""
    flat = lambda c: squeeze(F.regexp_replace(F.lower(without_marks(c)), "[^a-z0-9]+", " "))
    text = _without(flat(F.coalesce(title, F.lit(""))), flat(F.coalesce(color, F.lit(""))))
    for lost in (COLORWAY_COLORS, COLORWAY_MATERIALS, COLORWAY_HAIR, COLORWAY_NOISE):
        text = F.regexp_replace(text, words(lost), " ")
    return singular(squeeze(text), COLORWAY_PLURALS)


def handle_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?i)/products/([^/?#]+)", 1)
    return F.when(found != "", F.lower(F.coalesce(F.try_url_decode(found), found)))


def handle_key(url: Column) -> Column:
    """The handle of a product URL without colours, materials and noise at its end; null if what is left names no model. Its
    first word always stays."""
    lost = "|".join([*HANDLE_COLORS, *HANDLE_MATERIALS, *HANDLE_NOISE, *HANDLE_CODES])

    def stem(h: Column) -> Column:
        tokens = F.split(h, "-")
        tells = F.exists(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*HANDLE_COLORS, *HANDLE_MATERIALS))
        return F.when(is_distinctive(F.translate(h, "-", " ")) & tells, h)

    joined = F.array_join(F.filter(F.transform(F.split(handle_of(url), "-"), F.trim), lambda t: t != ""), "-")
    return bound(F.regexp_replace(joined, rf"(?<=[^-])(?:-(?:{lost}))+$", ""), stem)


def construction_flags(text: Column) -> Column:
    """All constructions that a text names, sorted. Mule comes before sandal; a heel height in a URL before one in words."""

    def flags(t: Column) -> Column:
        low = F.lower(t)
        slug = F.regexp_extract(low, borders(r"heel[-_]?height[-_]?(low|mid|high)\b"), 1)
        mule = low.rlike(borders(r"\bmules?\b"))
        mid = F.when(slug != "", slug == "mid").otherwise(low.rlike(borders(r"\bmid\b")))
        high = F.when(slug != "", slug == "high").otherwise(low.rlike(borders(r"\bhigh\b")) & low.rlike(borders(r"\b(?:heel|pump|sandal|boot)\b")))
        found = [F.when(t.rlike("(?i)" + borders(p)), F.lit(f)) for f, p in FLAGS]
        more = [F.when(mule, F.lit("mule")), F.when(low.rlike(borders(r"\bsandals?\b")) & ~mule, F.lit("sandal")), F.when(mid, F.lit("mid")), F.when(high, F.lit("high"))]
        return F.array_sort(F.array_compact(F.array(*found, *more)))

    return bound(without_marks(text), flags)


def wood_is_a_color(title: Column, url: Column, color: Column) -> Column:
    """A colourway named wood whose handle ends in it, and nothing that names a wooden part."""
    text = F.lower(without_marks(F.concat_ws(" ", title, url)))
    return F.coalesce((F.lower(F.trim(color)) == "wood") & handle_of(url).endswith("-wood"), F.lit(False)) & ~text.rlike(borders(WOODEN)) & ~F.lower(without_marks(title)).rlike(borders(r"\bwood\b"))


def heel_bucket(kind: Column, height: Column) -> Column:
    return ladder((height.isin("FLAT", "LOW") | (kind == "FLAT"), "flat"), (height.isin("MID", "HIGH") | kind.isin("STILETTO", "WEDGE", "SCULPTURAL", "PLATFORM"), "raised"), default="unknown")


def listing_key(source: Column, url: Column, sku: Column) -> Column:
    """What a listing is known by in its shop."""
    part = lambda pattern, text: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    path = F.lower(F.regexp_replace(F.coalesce(part(r"^[A-Za-z]+://[^/?#]+(/[^?#]+)", url), F.lit("")), "/$", ""))
    own = F.when(source == "zara", F.concat(F.lit("zara:"), part(r"(?i)-p(\d{5,})(?:\.html|$|\?)", url)))
    own = own.when(source == "farfetch", F.concat(F.lit("farfetch:"), part(r"(?i)item-(\d+)", url)))
    own = own.when(source == "level-shoes", F.concat(F.lit("level-shoes:"), F.nullif(path, F.lit(""))))
    own = own.when(source == "free-people", F.concat(F.lit("free-people:"), part(r"^(\d{6,})(?:[_-]|$)", F.coalesce(sku, F.lit("")))))
    return F.coalesce(own, F.concat(F.lit("shopify:"), source, F.lit(":"), handle_of(url)), F.concat(F.lit("url:"), url))
