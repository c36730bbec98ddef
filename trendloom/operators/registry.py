"""Registries and reports: enrichment, retention, discovery, queues, coverage of images, suspicious values, seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.expr import days_between, half_up, ladder
from trendloom.operators.schedule import numbered


def enrich(products: DataFrame, sidecar: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Fill missing values from a sidecar table; what the product has stays. Of several sidecar rows of a key the largest
    counts, by the columns in their order."""
    side = sidecar.groupBy(*key).agg(F.max(F.struct(*[F.col(c).alias(f"side_{c}") for c in columns])).alias("side")).select(*key, "side.*")
    out = products.join(side, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"side_{c}")) for c in columns}).drop(*(f"side_{c}" for c in columns))


def retain_archive(old: DataFrame, new: DataFrame, key: list[str], variants: str) -> DataFrame:
    """Full outer by key: absent old rows stay, variant arrays are united, new ones first."""
    a = old.select(*key, F.col(variants).alias("old_variants"))
    b = new.select(*key, F.col(variants).alias("new_variants"))
    none = F.array().cast(old.schema[variants].dataType)
    united = F.array_distinct(F.concat(F.coalesce("new_variants", none), F.coalesce("old_variants", none)))
    return a.join(b, key, "full").select(*key, united.alias(variants), F.col("new_variants").isNull().alias("archived"))


def collisions(listings: DataFrame, source: str, url: str) -> DataFrame:
    """Listings whose URL another source has too, without a self-join: sources per URL, counted once each."""
    shared = listings.groupBy(url).agg(F.countDistinct(source).alias("sources")).filter("sources > 1")
    return listings.join(shared, url)


def discover(products: DataFrame, universe: DataFrame, by: list[str]) -> DataFrame:
    """Products unknown to the universe by every one of the keys."""
    out = products
    for k in by:
        out = out.join(universe.filter(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return out


def append_to_queue(queue: DataFrame, candidates: DataFrame, keys: list[str], coarse: dict[str, Column], order: list[Column]) -> DataFrame:
    """Candidates not in the queue by any key, placed after its last position, by `coarse`, then `order`."""
    last = queue.agg(F.coalesce(F.max("position"), F.lit(0)).alias("last")).first()["last"]
    fresh = numbered(discover(candidates, queue, keys), coarse, order)
    return fresh.withColumn("position", (F.lit(last) + F.col("place")).cast("long")).drop("place")


def coverage_histogram(items: DataFrame, group: str, count: Column) -> DataFrame:
    """Per group: items with none, one, two or more, three or more, and the mean, to two decimals."""
    c = items.withColumn("c", count)
    return c.groupBy(group).agg(
        F.count("*").alias("items"),
        F.count_if(F.col("c") == 0).alias("none"),
        F.count_if(F.col("c") == 1).alias("one"),
        F.count_if(F.col("c") >= 2).alias("two_or_more"),
        F.count_if(F.col("c") >= 3).alias("three_or_more"),
        half_up(F.avg("c"), 2).alias("mean"),
    )


def suspicious_values(long: DataFrame, field: str, value: str, unknown: str = "UNKNOWN", share: float = 0.95, least: int = 50) -> DataFrame:
    """Fields where one value has nearly all known rows, or where nothing at all is unknown."""
    counts = long.groupBy(field, value).agg(F.count("*").alias("n"))
    known = F.sum(F.when(F.col(value) != unknown, F.col("n")).otherwise(0))
    total = F.sum("n")
    top = F.max(F.when(F.col(value) != unknown, F.struct("n", value)))
    out = counts.groupBy(field).agg(known.alias("known"), total.alias("total"), top.alias("top"))
    verdict = ladder(((F.col("known") >= least) & (F.col("top.n") / F.col("known") > share), "ONE_VALUE"), ((F.col("known") == F.col("total")) & (F.col("total") >= 2 * least), "ALL_KNOWN"), default="OK")
    return out.select(field, "known", "total", F.col(f"top.{value}").alias("top_value"), verdict.alias("verdict"))


def family_report(families: DataFrame, variants: str) -> DataFrame:
    """One row: families, items, families of several, reduction in percent and the largest family."""
    v = F.col(variants)
    return families.agg(F.count("*").alias("families"), F.sum(v).alias("items"), F.count_if(v > 1).alias("multi"), half_up((1 - F.count("*") / F.sum(v)) * 100.0, 1).alias("reduction_percent"), F.max(v).alias("largest"))


def source_report(rows: DataFrame, source: str, ok: Column, partial: Column) -> DataFrame:
    """Per source: rows, rows that are complete, and success, partial or failed."""
    out = rows.groupBy(source).agg(F.count("*").alias("rows"), F.count_if(ok).alias("complete"), F.count_if(partial).alias("usable"))
    return out.withColumn("status", ladder((F.col("complete") == F.col("rows"), "success"), (F.col("usable") > 0, "partial"), default="failed"))


def collection_verdicts(products: DataFrame, path: str, accepted: Column, least: float = 0.8) -> DataFrame:
    """Candidate paths by the share of accepted products: VERIFIED, AUTO_DISCOVERED or REJECT."""
    out = products.groupBy(path).agg(F.count("*").alias("products"), F.avg(accepted.cast("double")).alias("share"))
    return out.select(path, "products", half_up("share", 4).alias("share"), ladder((F.col("share") >= least, "VERIFIED"), (F.col("share") > 0.5, "AUTO_DISCOVERED"), default="REJECT").alias("verdict"))


# What names a season or a sale outright, and what hints at one.
_W, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
SUMMER_LABEL = rf"(?i){_W}(?:ss\s*[-/]?\s*\d{{2}}|spring\s*[/&-]?\s*summer(?:\s*20\d{{2}})?|spring(?:\s*20\d{{2}})?|summer(?:\s*20\d{{2}})?|yaz(?:\s*20\d{{2}})?|ilkbahar\s*[/&-]?\s*yaz(?:\s*20\d{{2}})?){_E}"
WINTER_LABEL = rf"(?i){_W}(?:(?:aw|fw)\s*[-/]?\s*\d{{2}}(?:\s*[-/]\s*\d{{2}})?|autumn\s*[/&-]?\s*winter|fall\s*[/&-]?\s*winter|sonbahar\s*[/&-]?\s*kış){_E}"
SALE_LABEL = rf"(?i){_W}(?:sale|outlet|indirim|reduced|last chance){_E}"
SUMMER_HINT = rf"(?i){_W}(?:sandal|sandals|slide|slides|espadrille|espadrilles|raffia|rafia|straw|jute|beach|summer|yaz){_E}"
WINTER_HINT = rf"(?i){_W}(?:boot|boots|bootie|booties|ankle boot|knee boot|snow|shearling|winter|kış|çizme|bot){_E}"
SUMMER_CATEGORIES, WINTER_CATEGORIES = ("SANDAL", "MULE", "ESPADRILLE"), ("BOOT",)


def lifecycle(text: Column, verified_new: Column, last_seen: Column, now: Column) -> Column:
    """SALE by label, NEW_ARRIVAL if verified, ARCHIVE if not seen for over 120 days, else CURRENT."""
    return ladder((text.rlike(SALE_LABEL), "SALE"), (verified_new, "NEW_ARRIVAL"), (days_between(last_seen, now) > 120, "ARCHIVE"), default="CURRENT")


def season(text: Column, category: Column, stage: Column, seen: Column, now: Column, summer: str = "SS27", winter: str = "AW26_27") -> tuple[Column, Column]:
    """Season and confidence score: a label first, then age, then category and text hints, then the month of arrival."""
    age = days_between(seen, now)
    of_summer, of_winter = category.isin(*SUMMER_CATEGORIES), category.isin(*WINTER_CATEGORIES)
    says_summer, says_winter = text.rlike(SUMMER_HINT), text.rlike(WINTER_HINT)
    is_summer, is_winter = of_summer | says_summer, of_winter | says_winter
    arrived = (stage == "NEW_ARRIVAL") & seen.isNotNull()
    rungs = [
        (text.rlike(SUMMER_LABEL), summer, F.lit(100)),
        (text.rlike(WINTER_LABEL), winter, F.lit(100)),
        ((stage != "NEW_ARRIVAL") & (age > 180), "CARRY_OVER", F.lit(88)),
        (is_summer & ~is_winter, summer, F.when(of_summer & says_summer, 92).otherwise(84)),
        (is_winter & ~is_summer, winter, F.when(of_winter & says_winter, 92).otherwise(84)),
        (arrived & F.month(seen).between(3, 8), summer, F.lit(68)),
        (arrived, winter, F.lit(68)),
    ]
    return ladder(*[(c, v) for c, v, _ in rungs], default="CARRY_OVER"), ladder(*[(c, n) for c, _, n in rungs], default=55)


def lock_holders(tasks: DataFrame, key: str, locks: str) -> DataFrame:
    """Locks that several tasks want: how many, and the first of them. Tasks that share a lock conflict, so a row for each
    lock says all conflicts without a row for each pair; a task that half of all others bar stays one row."""
    each = tasks.select(key, F.explode(F.array_distinct(locks)).alias("lock"))
    return each.groupBy("lock").agg(F.count("*").alias("tasks"), F.min(key).alias("first")).filter("tasks > 1")


def conflicts_of(tasks: DataFrame, running: DataFrame, key: str, locks: str) -> DataFrame:
    """Tasks that a running task's lock bars, with the number of those locks. A lock that is a path bars all below it."""
    held = running.select(F.explode(F.array_distinct(locks)).alias("held")).distinct()
    each = tasks.select(key, F.explode(F.array_distinct(locks)).alias("lock"))
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("lock", "/"))), lambda n: F.array_join(F.slice(F.split("lock", "/"), F.lit(1), n), "/")))
    return each.select(key, "lock", above.alias("held")).join(held, "held").groupBy(key).agg(F.countDistinct("lock").alias("barred"))


def page_runs(pages: DataFrame, source: str, page: str, rows: str) -> DataFrame:
    """Paged reads per source up to the first empty page: pages read, rows, and whether the end was reached."""
    ordered = pages.withColumn("ended", F.max((F.col(rows) == 0).cast("int")).over(Window.partitionBy(source).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)))
    return ordered.groupBy(source).agg(F.count_if(F.col("ended") == 0).alias("pages"), F.sum(F.when(F.col("ended") == 0, F.col(rows)).otherwise(0)).alias("rows"), (F.max("ended") == 1).alias("exhausted"))
