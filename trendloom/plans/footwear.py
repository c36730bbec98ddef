"""The footwear gate over the parts as listings, with SQL that applies the same fixed words by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from trendloom import stars
from trendloom.operators import footwear as W
from trendloom.plans.market import _read

QUERIES: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None):
    """Register a function under its name with the SQL for it."""

    def add(run: Callable) -> Callable:
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


BOOTS, TRAINERS = "/uk/shopping/women/boots-1/items.aspx", "/uk/shopping/women/trainers-1/items.aspx"
#: Listings that the parts take in turn: title, type, tags, handle, collection, from a proven collection.
LISTINGS = (
    ("Ingels", "Boot", ("TOP VENTAS",), "ingels", "", False),
    ("Silk Top", "Top", ("TOP VENTAS",), "silk-top", "", False),
    ("Mystery", None, ("TOP VENTAS",), None, None, None),
    ("Flora boots suede navy", "SHOES", ("ACCESSORIES", "FW26"), "flora-boots", "", False),
    ("Shoe Care Kit", "SHOES", ("ACCESSORIES",), "", "", True),
    ("Leather Sneakers", "SHOES", ("ACCESSORIES", "HANDBAG"), "leather-sneakers", "", True),
    ("Alys Black Suede", "Clutch", ("Category~Handbags",), "bagalys-black-suede", "", False),
    ("Valerie Low Pump", "Pumps", ("Heels",), "valerie-low-pump", "", False),
    ("Scarf nappa slingbacks black", "Shoes", ("Slingbacks",), "scarf-nappa-slingbacks", "", False),
    ("Soca Lisboa", "Socas", ("Calçado",), "soca-lisboa", "", False),
    ("Lisboa Preto", "", None, "lisboa-preto", "/collections/socas-e-mules", True),
    ("Shipping Protection by Route", "", (), "routeins", "", True),
    ("Sheer Thermal Tights", "", (), "thermal-tights", "", True),
    ("Double Belt Sandal", "", (), "double-belt-sandal", "", True),
    ("Cap Toe Oxford", "", ("cap toe",), "cap-toe-oxford", "", True),
    ("Sun visor", "", ("cap",), "sun-visor", "", True),
    ("Nappa boots bark", "Shoes", ("collection:tote", "collection: New in"), "nappa-boots-bark", "", True),
    ("TÉNIS EXE RUNNER", "Shoes", ("SAPATILHAS E TÉNIS",), "tenis-exe", "/collections/sapatilhas-e-tenis", True),
    ("SAPATILHA EXE", "Shoes", ("SAPATILHAS E TÉNIS",), "sapatilha-exe", "/collections/sapatilhas-e-tenis", True),
    ("SAPATILHA EXE", "Shoes", (), "sapatilha-exe", "", True),
    ("Bag-embellished leather pumps", "Shoes", ("women",), "leather-pumps-bag-embellished", "", True),
    ("Bag-embellished leather pumps", "Bags", ("women",), "leather-pumps-bag-embellished", "", True),
    ("Leather boots with pouch", "Shoes", ("women",), "leather-boots-with-pouch", BOOTS, True),
    ("Leather boots with pouch", "Shoes", ("women",), "leather-boots-with-pouch", "/other", True),
    ("30mm pouch boots", "Shoes", (), "30mm-pouch-boots", BOOTS, True),
    ("Sweater letter boots", "Shoes", (), "sweater-letter-boots", BOOTS, True),
    ("bag-detail ankle boots", "Shoes", (), "bag-detail-ankle-boots", BOOTS, True),
    ("Low-top suede sneakers", "Shoes", (), "low-top-suede", TRAINERS, True),
    ("High-sock sneaks", "Shoes", (), "high-sock-sneaks", TRAINERS, True),
    ("Dress-up sneakers", "Shoes", (), "dress-up-sneakers", TRAINERS, True),
    ("Blazer Mid sneakers", "Shoes", (), "blazer-mid-sneakers", TRAINERS, True),
    ("Black jeans sneaker", "Shoes", (), "black-jeans-sneaker", TRAINERS, True),
    ("Tommy Jeans court sneakers", "Shoes", (), "tommy-jeans-court", TRAINERS, True),
    ('Runner "Grand Bag" sneakers', "Shoes", (), "runner-grand-bag-sneakers", TRAINERS, True),
    ('Runner "Bag" bag sneakers', "Shoes", (), "runner-bag-bag-sneakers", TRAINERS, True),
    ("Lipstick ballet flats", "Shoes", (), "lipstick-ballet-flats", "", True),
    ("Lipstick duo", "Shoes", (), "lipstick-duo", "", True),
    ("Makeup pouch", "", (), "makeup-pouch", "", True),
    ("Gift card", "", (), "gift-card", "", False),
    ("Ring ballerinas", "Shoes", (), "ring-ballerinas", "", True),
    ("Toe ring sandals", "", (), "toe-ring-sandals", "", True),
    ("Gold ring", "Jewelry", (), "gold-ring", "", True),
    ("B Bag", "Boots", (), "b-bag", "", False),
    ("Boots for men", "Boots", (), "boots-for-men", "", False),
    ("Boots for men and women", "Boots", (), "boots-unisex", "", False),
    ("Belt Cavalier", "SS26 (Boots)", (), "https://coperni.com/products/copsh12-black", "", False),
    ("Belt Cavalier", "Belts", (), "https://coperni.com/products/copsh12-black", "", False),
    ("Espadrille wedge", "Espadrilles", (), "espadrille-wedge", "", False),
    ("Terry slipper", "", ("Slippers",), "terry-slipper", "", False),
    ("Mystery", "Sapatos", (), "", "", False),
    ("Kids boots", "Boots", (), "kids-boots", "", False),
    ("Mystery", "Gear", (), "", "", False),
    ("Mystery", "Shoe  Care", (), "", "", False),
    ("Mystery", "Hand Bags", (), "", "", False),
    ("Mystery", "Flats", (), "", "", False),
    ("Mystery", "", ("Shoes",), "", "", False),
)


def _cases(spark, part):
    """Parts in turn with each listing; two of three have the part's own name before the title."""
    rows = [(i, *x) for i, x in enumerate(LISTINGS)]
    cases = spark.createDataFrame(rows, "i long, title string, kind string, tags array<string>, handle string, collection string, verified boolean")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("title")).otherwise(F.concat_ws(" ", "p_name", "title"))
    dealt = stars.spread(part.select("p_partkey", "p_name"), "p_partkey")
    return dealt.withColumn("i", F.col("p_partkey") % len(LISTINGS)).join(F.broadcast(cases), "i").withColumn("title", name)


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, tuple):
        return "[" + ", ".join(map(_q, v)) + "]::VARCHAR[]"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _hit(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q('(?i)' + pattern)})"


def _term(text: str, terms) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q(chr(92) + 'b' + t.replace('-', chr(92) + '-') + chr(92) + 'b')}) THEN {_q(t)}" for t in terms) + " END"


def _words(*parts: str) -> str:
    return f"array_to_string(list_filter(list_concat({', '.join(parts)}), lambda w: coalesce(w, '') <> ''), ' ')"


def _mask() -> str:
    """A column for each exception, made of the one before."""
    out = []
    for i, (scope, guard, span, instead) in enumerate(W.EXCEPTIONS):
        out.append(f"CASE WHEN {scope} AND {_hit('title', guard) if guard else 'true'} THEN regexp_replace(hay{i}, {_q('(?i)' + span)}, {_q(instead.replace('$', chr(92)))}, 'g') ELSE hay{i} END AS hay{i + 1}")
    return ", ".join(out) + f", hay{len(W.EXCEPTIONS)} AS hay"


def _denials() -> str:
    out = [f"WHEN {_hit('handle', '^bag')} THEN 'handle:bag'", f"WHEN {_hit('handle', '^b-')} AND {_hit('hay', chr(92) + 'bbag' + chr(92) + 'b')} THEN 'handle:bag-prefix'"]
    out += [f"WHEN {_hit('hay', p)} THEN {_q(s)}" for p, s in W.FIRST_DENIALS]
    out += [f"WHEN {_hit('hay', chr(92) + 'blipstick')} AND NOT lipstick THEN 'lipstick'", f"WHEN {_hit('hay', chr(92) + 'bmakeup')} THEN 'makeup'"]
    for p in W.DENIED_PATTERNS:
        spared = "word IS NOT NULL" if any(w in p for w in W.OVERRULED) else "(word IS NOT NULL AND lipstick)" if "lipstick" in p else "false"
        out.append(f"WHEN {_hit('hay', p)} AND NOT {spared} THEN {_q(p)}")
    return "CASE " + " ".join(out) + " END"


def _category() -> str:
    rows = " ".join(f"WHEN regexp_matches({'everything' if of == 'all' else 'named'}, {_q(p)}){f' AND regexp_matches(everything, {_q(W.MIXED)})' if c == 'MIXED' else ''} THEN {_q('OTHER_FOOTWEAR' if c == 'MIXED' else c)}" for c, of, p in W.CATEGORIES)
    return f"CASE {rows} WHEN term IS NOT NULL OR tag_term IS NOT NULL THEN 'OTHER_FOOTWEAR' END"


_BELT = "CASE WHEN " + _hit("handle", W.BELT_URL) + " THEN CASE " + " ".join(f"WHEN {_hit('trim(title)', t)} AND {_hit('bare', k)} THEN {_q(c)}" for c, t, k in W.BELT_SHOES) + " END END"
# RE2 has no look-around, so a nickname's slug is counted between its borders by hand: the handle is padded and slugs are short.
_GATE = f"""
WITH listing (i, title, kind, tags, handle, collection, verified) AS (VALUES {', '.join(f"({', '.join(map(_q, (i, *x)))})" for i, x in enumerate(LISTINGS))}),
a AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN title ELSE p_name || ' ' || title END AS title, coalesce(kind, '') AS kind, coalesce(tags, []) AS tags, coalesce(handle, '') AS handle, coalesce(collection, '') AS collection, coalesce(verified, false) AS verified FROM part JOIN listing ON i = p_partkey % {len(LISTINGS)}),
b AS (SELECT *, lower(trim(kind)) = 'shoes' AS typed, typed AND verified AS shoes, shoes AND regexp_matches(collection, {_q(W.BOOT_COLLECTION)}) AS boots, shoes AND regexp_matches(collection, {_q(W.TRAINER_COLLECTION)}) AS trainers,
  list_filter(tags, lambda t: NOT regexp_matches(trim(t), {_q(W.BADGE_TAGS)})) AS told, list_filter(told, lambda t: NOT (typed AND lower(trim(t)) = 'accessories')) AS evidence,
  trainers AND {_hit('title', chr(92) + 'b(?:sneakers?|trainers?)' + chr(92) + 's*$')} AS nicknamed, regexp_extract(title, '"([^"]+)"', 1) AS nick, trim(regexp_replace(lower(nick), '[^a-z0-9]+', '-', 'g'), '-') AS mark FROM a),
c AS (SELECT *, {_words("[CASE WHEN nicknamed THEN regexp_replace(title, '" + chr(34) + "[^" + chr(34) + "]+" + chr(34) + "', '', 'g') ELSE title END, kind]", 'evidence', "[CASE WHEN nicknamed AND mark <> '' AND len(string_split('-' || handle || '-', '-' || mark || '-')) = 2 THEN regexp_replace(handle, '(^|-)' || mark || '(-|$)', '" + chr(92) + "1" + chr(92) + "2') ELSE handle END]")} AS hay0,
  shoes AND {_hit('title', W.LIPSTICK_SHOE)} AS lipstick, CASE WHEN verified AND lower(kind) = 'shoes' AND {_hit('title', chr(92) + 'bballerinas?' + chr(92) + 's*$')} THEN 'terminal-ballerina' ELSE CASE {' '.join(f"WHEN {_hit(_words('[title, handle]'), p)} THEN {_q(p)}" for p in W.SHOE_WORDS)} END END AS word,
  coalesce(nullif(regexp_extract(kind, {_q(W.BELT_TYPE)}, 1), ''), kind) AS bare FROM b),
d AS (SELECT *, {_mask()}, {_words('[title, kind]', 'tags', '[handle]')} AS all_words, lower({_words('[title, kind]', 'tags', '[collection]')}) AS everything, lower({_words('[title, kind, handle]')}) AS named,
  upper(trim(kind)) AS upper_kind, {_term('upper(trim(kind))', W.ALLOWED_TERMS)} AS term, list_filter(list_transform(told, lambda t: {_term('upper(trim(t))', W.ALLOWED_TERMS)}), lambda t: t IS NOT NULL)[1] AS tag_term FROM c),
e AS (SELECT *, {_BELT} AS belt, coalesce({_denials()}, 'product_type:' || {_term('upper_kind', W.DENIED_TERMS)}, 'tag:' || list_filter(list_transform(evidence, lambda t: CASE WHEN {_term('upper(trim(t))', W.DENIED_TERMS)} = 'CAP' AND regexp_matches(trim(t), '(?i)^cap[- ]toe$') THEN NULL ELSE {_term('upper(trim(t))', W.DENIED_TERMS)} END), lambda t: t IS NOT NULL)[1]) AS denied,
  {_hit('all_words', W.MEN)} AND NOT {_hit('all_words', W.WOMEN)} AS mens, {_category()} AS named_category FROM d)
SELECT p_partkey, CASE WHEN belt IS NOT NULL THEN 'ACCEPT_FOOTWEAR' WHEN denied IS NOT NULL OR mens THEN 'EXCLUDE_NON_FOOTWEAR' WHEN term IS NOT NULL OR tag_term IS NOT NULL OR verified THEN 'ACCEPT_FOOTWEAR' ELSE 'EXCLUDE_UNCERTAIN_PRODUCT_TYPE' END AS decision,
  CASE WHEN belt IS NOT NULL THEN belt WHEN denied IS NOT NULL OR mens THEN NULL WHEN term IS NOT NULL OR tag_term IS NOT NULL THEN named_category WHEN verified THEN coalesce(named_category, 'OTHER_FOOTWEAR') END AS category,
  CASE WHEN belt IS NOT NULL THEN 'PRODUCT_TYPE' WHEN denied IS NOT NULL OR mens THEN 'NONE' WHEN term IS NOT NULL THEN 'PRODUCT_TYPE' WHEN tag_term IS NOT NULL THEN 'TAGS' WHEN verified THEN 'VERIFIED_FOOTWEAR_COLLECTION' ELSE 'NONE' END AS method,
  CASE WHEN belt IS NOT NULL THEN {_q(W.BELT_SIGNAL)} WHEN denied IS NOT NULL THEN denied WHEN mens THEN 'mens-only' WHEN term IS NOT NULL THEN 'PRODUCT_TYPE:' || term WHEN tag_term IS NOT NULL THEN 'TAGS:' || tag_term WHEN verified THEN 'verified-footwear-collection' ELSE '' END AS signals
FROM e"""


@query(_GATE)
def footwear_gate(spark, sf):
    c = _cases(spark, _read(spark, sf, "part"))
    x = W.Listing(*(F.col(n) for n in ("title", "kind", "tags", "handle")), F.lit(None).cast("string"), F.col("collection"), F.col("verified"))
    g = c.select("p_partkey", W.gate(x).alias("g"))
    return g.select("p_partkey", "g.decision", "g.category", "g.method", F.array_join("g.signals", ",").alias("signals"))


_KIND = "trim(regexp_replace(lower(kind), '\\s+', ' ', 'g'))"


@query(f"""
WITH gate AS ({_GATE}), listing (i, title, kind, tags, handle, verified) AS (VALUES {', '.join(f"({', '.join(map(_q, (i, *x[:4], x[5])))})" for i, x in enumerate(LISTINGS))}),
a AS (SELECT part.p_partkey, CASE WHEN part.p_partkey % 3 = 0 THEN title ELSE p_name || ' ' || title END AS title, coalesce(kind, '') AS kind, coalesce(tags, []) AS tags, coalesce(handle, '') AS handle, coalesce(verified, false) AS verified, gate.decision, gate.category AS named, gate.signals FROM part JOIN listing ON i = p_partkey % {len(LISTINGS)} JOIN gate ON gate.p_partkey = part.p_partkey),
b AS (SELECT *, {_KIND} AS of, {_words('[title, kind]', 'tags', '[handle]')} AS words FROM a),
c AS (SELECT *, CASE WHEN of IN {W.DENIED_TYPES} THEN 'product_type:' || of WHEN {_hit("title || ' ' || handle || ' ' || array_to_string(tags, ' ')", W.CHILDREN)} THEN 'childrens-only' WHEN {_hit('words', W.MEN)} AND NOT {_hit('words', W.WOMEN)} THEN 'mens-only'
  WHEN of IN {W.ALLOWED_TYPES} THEN NULL WHEN of = '' THEN CASE WHEN decision = 'ACCEPT_FOOTWEAR' AND (verified OR named <> 'OTHER_FOOTWEAR') THEN NULL ELSE 'missing-product-type' END WHEN decision = 'ACCEPT_FOOTWEAR' THEN NULL ELSE coalesce(nullif(signals, ''), 'not-womens-footwear') END AS reason FROM b)
SELECT p_partkey, CASE WHEN reason IS NULL THEN coalesce(named, 'OTHER_FOOTWEAR') END AS category, reason FROM c""")
def scope_decisions(spark, sf):
    c = _cases(spark, _read(spark, sf, "part"))
    x = W.Listing(*(F.col(n) for n in ("title", "kind", "tags", "handle")), F.lit(None).cast("string"), F.col("collection"), F.col("verified"))
    return c.select("p_partkey", W.womens_scope(x).alias("s")).select("p_partkey", "s.category", "s.reason")


#: Stored products that the parts take in turn, and what the review says: name, url, category, path, category url, description.
STORED = (
    (("T-lock python crossbody", "https://x.com/products/t-lock-crossbody", "PUMP", None, None, None), ("EXCLUDE_NON_FOOTWEAR", None, r"\bcrossbody")),
    (("Soie Malaquais", "https://x.com/products/001-099009", "OTHER_FOOTWEAR", None, None, None), ("EXCLUDE_UNCERTAIN_PRODUCT_TYPE", None, "insufficient-footwear-evidence")),
    (("Awar lace up", "https://www.y.com/p", "OTHER_FOOTWEAR", "/en-us/women/shoes/oxfords-derbies", None, None), ("ACCEPT_FOOTWEAR", "OTHER_FOOTWEAR", "exact-source-product-category")),
    (("Ponti", "https://www.y.com/p", "OTHER_FOOTWEAR", "/en-us/women/shoes", None, None), ("EXCLUDE_UNCERTAIN_PRODUCT_TYPE", None, "insufficient-footwear-evidence")),
    (("Lipstick duo set", "https://x.com/products/lipstick-set", "OTHER_FOOTWEAR", None, None, None), ("EXCLUDE_NON_FOOTWEAR", None, "lipstick")),
    (("Ponti", "https://x.com/products/ponti", "LOAFER", None, None, None), ("ACCEPT_FOOTWEAR", "LOAFER", "stored-footwear-category")),
    (("Ponti loafer", "https://x.com/products/ponti", "OTHER_FOOTWEAR", None, None, None), ("ACCEPT_FOOTWEAR", "OTHER_FOOTWEAR", r"stored-category-with-title:\bloafer")),
    (("Ponti", "https://x.com/p", "OTHER_FOOTWEAR", None, None, "<p>Almond toe,</p> rubber  outsole, lace-up"), ("ACCEPT_FOOTWEAR", "OTHER_FOOTWEAR", "description:toe+sole+lace-up")),
    (("Ponti sandal", "https://x.com/products/ponti", None, None, None, None), ("ACCEPT_FOOTWEAR", None, r"title:\bsandal")),
    (("Belt Cavalier", "https://www.coperni.com/products/copsh12-black", "BOOT", None, None, None), ("ACCEPT_FOOTWEAR", "BOOT", W.BELT_SIGNAL)),
    (("Belt Cavalier", "https://www.coperni.com/products/copsh12-black", "PUMP", None, None, None), ("EXCLUDE_NON_FOOTWEAR", None, r"\bbelt\b")),
    (("Ring ballerina", "https://www.jilsander.com/en-us/ring-ballerina/J15WZ0012P1.html", "BALLERINA", None, None, None), ("ACCEPT_FOOTWEAR", "BALLERINA", "stored-footwear-category")),
    (("Ring ballerina", "https://x.com/p", "BALLERINA", None, None, None), ("EXCLUDE_NON_FOOTWEAR", None, r"\bring\b")),
    (("Low-top sneakers", "https://www.farfetch.com/uk/shopping/women/low-item-12.aspx", "SNEAKER", "/uk/shopping/women/trainers-1/items.aspx", "https://www.farfetch.com/uk/shopping/women/trainers-1/items.aspx", None), ("ACCEPT_FOOTWEAR", "SNEAKER", "stored-footwear-category")),
)


@query(f"""
WITH stored (i, decision, category, signals) AS (VALUES {', '.join(f"({', '.join(map(_q, (i, *want)))})" for i, (_, want) in enumerate(STORED))})
SELECT p_partkey, decision, category, 'STORED_PRODUCT_REVIEW' AS method, signals FROM part JOIN stored ON i = p_partkey % {len(STORED)}""")
def stored_reviews(spark, sf):
    cases = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(STORED)], "i long, name string, url string, stored string, path string, place string, described string")
    part = stars.spread(_read(spark, sf, "part").select("p_partkey"), "p_partkey").withColumn("i", F.col("p_partkey") % len(STORED)).join(F.broadcast(cases), "i")
    g = part.select("p_partkey", W.stored_review(*(F.col(c) for c in ("name", "url", "stored", "path", "place", "described"))).alias("g"))
    return g.select("p_partkey", "g.decision", "g.category", "g.method", F.array_join("g.signals", ",").alias("signals"))
