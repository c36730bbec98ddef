"""Extraction from HTML by specification: what differs between sources is data, the operator is one."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = {"&amp;": "&", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " "}
JSON_LD = r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'


def decode_entities(c: Column) -> Column:
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), r"\s+", " "))


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(found != "", strip_tags(decode_entities(found)))


def links(html: Column) -> Column:
    """Distinct link targets in page order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1)))


def _found(html: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), decode_entities))


def images(html: Column) -> Column:
    """Image sources in page order."""
    return _found(html, r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']([^"']*)["']""")


def product_images(html: Column, base: Column) -> Column:
    """The images of a product page by the first strategy that finds any: structured data, a gallery's data attributes,
    the page's own preview image, image tags. Full links, each once."""
    structured = F.filter(F.transform(json_ld(html), lambda p: p["image"]), lambda u: u.isNotNull() & (u != ""))
    gallery = _found(html, r"""(?i)\bdata-(?:zoom|large|full|gallery)[a-z-]*\s*=\s*["']([^"']+)["']""")
    preview = _found(html, r"""(?i)<meta\b[^>]*?\bproperty\s*=\s*["']og:image["'][^>]*?\bcontent\s*=\s*["']([^"']+)["']""")
    return F.array_distinct(F.transform(with_fallback(structured, gallery, preview, images(html)), lambda u: absolute(u, base)))


def absolute(url: Column, base: Column) -> Column:
    """A link against its page: full links stay, //host gets the scheme, paths get scheme and host."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    return F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(scheme, F.lit(":"), url)).when(url.startswith("/"), F.concat(root, url)).otherwise(F.concat(root, F.lit("/"), url))


def json_ld(html: Column) -> Column:
    """Product objects of all JSON-LD blocks of a page: graphs and lists are flattened, broken blocks are skipped."""
    item = "struct<`@type`:string,name:string,url:string,sku:string,image:string,brand:struct<name:string>,offers:struct<price:string,priceCurrency:string>>"
    shape = f"struct<`@type`:string,name:string,url:string,sku:string,image:string,brand:struct<name:string>,offers:struct<price:string,priceCurrency:string>,`@graph`:array<{item}>,itemListElement:array<struct<item:{item}>>>"
    blocks = F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.from_json(b, shape))
    same = lambda x: F.struct(x["@type"].alias("@type"), x["name"].alias("name"), x["url"].alias("url"), x["sku"].alias("sku"), x["image"].alias("image"), x["brand"].alias("brand"), x["offers"].alias("offers"))
    none = F.array().cast(f"array<{item}>")
    flat = F.transform(parsed, lambda x: F.concat(F.array(same(x)), F.coalesce(x["@graph"], none), F.coalesce(F.transform(x["itemListElement"], lambda y: y["item"]), none)))
    return F.filter(F.flatten(F.filter(flat, lambda a: a.isNotNull())), lambda x: x["@type"] == "Product")


def sitemap_urls(xml: Column, wanted: str = "") -> Column:
    urls = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), decode_entities)
    return F.filter(urls, lambda u: u.rlike(wanted)) if wanted else urls


@dataclass
class Spec:
    """How a source's pages are read: a pattern with one group for each field, and the pattern of a listing's links."""

    fields: dict[str, str] = field(default_factory=dict)
    link: str = ""


# The labels that introduce a field in a product's description, first match wins.
LABELS = {
    "material": ("Materials", "Material", "Fab~", "Upper"),
    "toe": ("Toe Style", "Toe-shape", "Toe~", "Toe Shape"),
    "heel": ("Heel Style", "Heel Type", "Features", "Heel~"),
    "height": ("Heel Height", "Heel:", "Sole height", "Heel~"),
    "details": ("Closure Type", "Features", "Garment Details"),
}


def described(text: Column) -> dict[str, Column]:
    """The fields of a description in plain text: what follows a label up to a line's end or a bar."""

    def of(label: str) -> Column:
        value = F.trim(F.regexp_extract(text, rf"(?i){re.escape(label)}\s*:?\s*([^\n|]+)", 1))
        return F.when(value != "", value)

    return {name: F.coalesce(*map(of, labels)) for name, labels in LABELS.items()}


#: Specifications of common page layouts; a source that needs others adds its own.
SPECS = {
    "plain": Spec({"title": r"(?is)<h1[^>]*>(.*?)</h1>", "language": r"""(?i)<html[^>]*\blang=["']([^"']*)["']"""}, r"/p(?:roduct)?s?/"),
    "open_graph": Spec({"title": r"""(?i)<meta\b[^>]*?og:title["'][^>]*?content=["']([^"']+)["']""", "image": r"""(?i)<meta\b[^>]*?og:image["'][^>]*?content=["']([^"']+)["']""", "price": r"""(?i)<meta\b[^>]*?price:amount["'][^>]*?content=["']([^"']+)["']"""}, r"/products/"),
    "microdata": Spec({"title": r"""(?is)itemprop=["']name["'][^>]*>(.*?)<""", "price": r"""(?i)itemprop=["']price["'][^>]*?content=["']([^"']+)["']""", "sku": r"""(?is)itemprop=["']sku["'][^>]*>(.*?)<"""}, r"/product/"),
}


def extract(pages: DataFrame, html: str, spec: Spec) -> DataFrame:
    """Add the fields of the specification; a pattern that does not match gives null."""
    out = {name: F.when(F.regexp_extract(F.col(html), pattern, 1) != "", strip_tags(decode_entities(F.regexp_extract(F.col(html), pattern, 1)))) for name, pattern in spec.fields.items()}
    return pages.withColumns(out)


def with_fallback(*candidates: Column) -> Column:
    """The first strategy that found anything."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in candidates], candidates[-1])
