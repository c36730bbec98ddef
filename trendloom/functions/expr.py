"""Scalar expressions. All are built-in Spark functions, so they stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII borders of a word: `\b` of Java counts accented letters as word characters.
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_BORDER = f"(?:{BEFORE}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]){AFTER})"
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝşŞğĞıİ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYsSgGiI"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def borders(pattern: str) -> str:
    r"""A pattern with each \b as a border of ASCII words."""
    return pattern.replace(r"\b", _BORDER)


def half_up(c: str | Column, digits: int = 0) -> Column:
    """Rounding where halves go up, also below zero: floor(x + 0.5)."""
    scale = float(10**digits)
    return F.floor(col(c).cast("double") * scale + 0.5) / scale


def clamp(c: str | Column, least: float = 0.0, most: float = 100.0) -> Column:
    return F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), col(c)))


def days_between(start: str | Column, end: str | Column) -> Column:
    """Fractional days from start to end; negative if end is earlier."""
    return (F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / F.lit(86_400_000_000.0)


def in_window(ts: str | Column, now: Column, oldest_days: float, newest_days: float) -> Column:
    """Age in days within [newest, oldest], both ends included."""
    return days_between(ts, now).between(newest_days, oldest_days)


def within_period(ts: str | Column, reference: Column, days: float) -> Column:
    """At most so many days old. Dates after the reference pass; missing ones do not."""
    return F.coalesce(days_between(ts, reference) <= days, F.lit(False))


def is_strict_iso(c: str | Column) -> Column:
    """True if the text is exactly the millisecond UTC form of the instant it names."""
    form = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return F.coalesce(F.date_format(F.try_to_timestamp(col(c), F.lit(form)), form) == col(c), F.lit(False))


def canonical_url(c: str | Column) -> Column:
    """Lower case without one trailing slash."""
    return F.lower(F.regexp_replace(col(c), "/$", ""))


def loose_url(c: str | Column) -> Column:
    """Trimmed, lower case, without any trailing slashes."""
    return F.lower(F.regexp_replace(F.trim(col(c)), "/+$", ""))


def strip_tracking(c: str | Column, prefix: str = "utm_") -> Column:
    """Drop query parameters whose name begins with prefix, and what is left empty by that."""
    kept = F.regexp_replace(col(c), rf"(?<=[?&]){prefix}[^&#]*&?", "")
    return F.regexp_replace(kept, r"[?&](?=#|$)", "")


def slug(c: str | Column, trim: bool = True) -> Column:
    out = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")
    return F.regexp_replace(out, "^-+|-+$", "") if trim else out


def token(c: str | Column) -> Column:
    """Trimmed, lower case, white space to dashes."""
    return F.regexp_replace(F.lower(F.trim(col(c))), r"\s+", "-")


def strip_accents(c: str | Column) -> Column:
    """Latin and Turkish letters without their marks, by table."""
    return F.translate(col(c), _ACCENTED, _PLAIN)


def combine_text(*parts: str | Column) -> Column:
    """Non-empty parts joined by a space, lower case."""
    return F.lower(F.concat_ws(" ", *[F.when(col(p) != "", col(p)) for p in parts]))


def color_from_name(name: str | Column, most: int = 60) -> Column:
    """The last segment after a spaced dash, if there is one and it is short."""
    parts = F.split(col(name), r"\s-\s")
    last = F.trim(F.element_at(parts, -1))
    return F.when((F.size(parts) > 1) & (last != "") & (F.length(last) <= most), last)


def clean_height(c: str | Column) -> Column:
    """A height with its unit, at the start of the text or after a heel label."""
    text = F.trim(col(c))
    head = F.regexp_extract(text, r'(?i)^(\d+(?:\.\d+)?\s*(?:cm|mm|inches|in|"))', 1)
    label = F.regexp_extract(text, r'(?i)(?:heel(?:\s*height)?|sole height|height)[:\s]+(\d+(?:\.\d+)?\s*(?:cm|mm|inches|in|"))', 1)
    return F.coalesce(F.when(head != "", F.trim(head)), F.when(label != "", F.trim(label)))


def height_cm(c: str | Column) -> Column:
    """Centimetres of a cleaned height."""
    number = F.regexp_extract(col(c), r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(col(c), r'^\d+(?:\.\d+)?\s*(?i)(cm|mm|inches|in|")', 1))
    return F.when(unit == "cm", number).when(unit == "mm", number / 10).when(unit.isin("in", "inches", '"'), number * 2.54)


def height_group(cm: str | Column) -> Column:
    c = col(cm)
    return F.when(c.isNull(), "UNKNOWN").when(c <= 2, "FLAT").when(c <= 5, "LOW").when(c <= 8, "MID").otherwise("HIGH")


def has_word(text: str | Column, keyword: str) -> Column:
    """The keyword between white space, slashes, commas, dashes or the ends; case does not matter."""
    import re

    return F.concat(F.lit(" "), col(text), F.lit(" ")).rlike(rf"(?i)(?:^|[\s/,-]){re.escape(keyword)}(?:$|[\s/,-])")


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of all conditions that hold, in order; a condition that is null does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in rules]))


def ladder(*rules: tuple[Column, object], default: object = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for c, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(c, value) if out is None else out.when(c, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def mean_of_known(*cols: Column) -> Column:
    """The mean of the values that are not null; null if there are none."""
    known = F.array_compact(F.array(*cols))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def union_keep_order(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array()) for a in arrays]))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def containment(part: Column, whole: Column) -> Column:
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(0.0)


def strict_subset(part: Column, whole: Column) -> Column:
    return (F.size(F.array_except(part, whole)) == 0) & (F.size(part) < F.size(whole))


def strip_tail_tokens(handle: str | Column, tokens: list[str]) -> Column:
    """Remove trailing dash-joined tokens, but never the first token."""
    import re

    alternatives = "|".join(map(re.escape, sorted(tokens, key=len, reverse=True)))
    return F.regexp_replace(col(handle), rf"(?<=[^-])(?:-(?:{alternatives}))+$", "")


def parameterless_image(c: str | Column) -> Column:
    """An image URL without sizes: resize suffix, and width, height and crop parameters."""
    out = F.regexp_replace(col(c), r"_(?:\d+x\d*|x\d+)(?=\.[A-Za-z]+(?:\?|$))", "")
    out = F.regexp_replace(out, r"(?<=[?&])(?:width|height|crop|w|h)=[^&#]*&?", "")
    return F.regexp_replace(out, r"[?&](?=#|$)", "")
