"""Sightings: where and since when a family is seen, what proves it new, and the queries over that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.expr import ladder, within_period
from trendloom.functions.names import is_new_arrivals_path
from trendloom.operators.catalog import PERIOD_DAYS, verified_new

#: Proofs of newness, strongest first, and how sure the two that hints give are.
EVIDENCE = ("EXPLICIT_DATE", "NEW_ARRIVALS_COLLECTION", "CATALOG_DIFF", "NEW_BADGE")
SURE = {"NEW_ARRIVALS_COLLECTION": 0.9, "NEW_BADGE": 0.85}


def from_hints(rows: DataFrame, verified_at: Column) -> DataFrame:
    """Newness from hints of a listing (path, in_collection, badge, published, created): a collection before a badge. Adds
    status, evidence, confidence and new_at, the listing's own date if it parses."""
    by_path = F.coalesce(F.col("in_collection"), F.lit(False)) | is_new_arrivals_path("path")
    evidence = ladder((by_path, "NEW_ARRIVALS_COLLECTION"), (F.coalesce("badge", F.lit(False)), "NEW_BADGE"))
    out = rows.withColumn("evidence", evidence)
    own = F.coalesce(F.col("published"), F.col("created"))
    known = F.col("evidence").isNotNull()
    return out.withColumns({
        "status": F.when(known, "VERIFIED_NEW").otherwise("NOT_VERIFIED"),
        "confidence": F.element_at(F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair]), F.col("evidence")),
        "new_at": F.when(known, F.coalesce(F.try_to_timestamp(own), verified_at)),
    })


def stronger(a: Column, b: Column) -> Column:
    """The stronger of two proofs; one that is missing yields."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, EVIDENCE)), c)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.when(rank(a) <= rank(b), a).otherwise(b))


def merge_newness(existing: DataFrame, incoming: DataFrame, key: list[str], now: Column) -> DataFrame:
    """One step of the newness machine, for all keys at once. Both sides: key, status, evidence, first_at, last_at.

    Verified again keeps the first date; verified before and not any more is FORMERLY_NEW, but an explicit date alone
    leaves nothing behind; what is not on the incoming side stays as it is. Records that were verified by a mere
    difference of catalogs count as not verified."""

    def side(t: DataFrame, prefix: str) -> DataFrame:
        real = (F.col("status") != "VERIFIED_NEW") | F.col("evidence").isin("NEW_ARRIVALS_COLLECTION", "NEW_BADGE")
        blank = lambda c: F.when(real, F.col(c)).alias(f"{prefix}_{c}")
        return t.select(*key, F.when(real, F.col("status")).otherwise("NOT_VERIFIED").alias(f"{prefix}_status"), *map(blank, ("evidence", "first_at", "last_at")))

    both = side(existing, "old").join(side(incoming, "new"), key, "full")
    old, new = F.col("old_status"), F.col("new_status")
    again = F.coalesce(new == "VERIFIED_NEW", F.lit(False))
    was = F.coalesce(old.isin("VERIFIED_NEW", "FORMERLY_NEW"), F.lit(False))
    lost = F.coalesce((old == "VERIFIED_NEW") & (new == "NOT_VERIFIED"), F.lit(False))
    status = ladder((again, "VERIFIED_NEW"), (lost, "FORMERLY_NEW"), default=F.coalesce(old, new))
    first = F.when(again, F.when(was, F.coalesce("old_first_at", "new_first_at", now)).otherwise(F.coalesce("new_first_at", now))).otherwise(F.coalesce("old_first_at", F.when(old.isNull(), F.col("new_first_at"))))
    last = F.when(again | lost, now).otherwise(F.when(old.isNull(), F.col("new_last_at")).otherwise(F.col("old_last_at")))
    evidence = F.when(again, F.col("new_evidence")).otherwise(F.when(old.isNull(), F.col("new_evidence")).otherwise(F.col("old_evidence")))
    return both.select(*key, status.alias("status"), evidence.alias("evidence"), first.alias("first_at"), last.alias("last_at"))


def merge_sightings(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Sightings of both sides by source: earliest and latest date, the label and category of the newer side."""
    rows = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("side")))
    return rows.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), latest("label").alias("label"), latest("category").alias("category"))


def verified_arrivals(sightings: DataFrame, reference: Column, period: str, scope: Column | None = None) -> DataFrame:
    """Families verified as new within a period, with their newest verified sighting; the first of equal dates.

    sightings: family, source, label, status, evidence, new_at (text), place (its position in the family). `scope` is a
    condition on sightings; it is asked before the choice, so a source's own sighting is the one shown for it."""
    ok = verified_new("status", "evidence", "new_at")
    kept = sightings.filter(ok if scope is None else ok & scope).withColumn("at", F.to_timestamp("new_at"))
    newest = Window.partitionBy("family").orderBy(F.col("at").desc(), "place")
    best = kept.withColumn("rank", F.row_number().over(newest)).filter("rank = 1").drop("rank")
    return best.filter(within_period("at", reference, PERIOD_DAYS[period]))


def count_by(arrivals: DataFrame, families: DataFrame, group: str) -> DataFrame:
    """How many of a group's families are among the arrivals; groups without any count zero."""
    new = arrivals.select("family").distinct().withColumn("new", F.lit(1))
    return families.join(new, "family", "left").groupBy(group).agg(F.count("*").alias("families"), F.coalesce(F.sum("new"), F.lit(0)).alias("verified_new"))


def revoke_badges(sightings: DataFrame, audited: DataFrame, cutoff: Column) -> DataFrame:
    """On reading: a NEW badge of an audited (family, source) goes unless it was verified again after the audit."""
    marks = audited.select("family", "source").distinct().withColumn("audited", F.lit(True))
    gone = F.col("audited") & (F.col("status") == "VERIFIED_NEW") & (F.col("evidence") == "NEW_BADGE") & (F.col("last_at") <= cutoff)
    out = sightings.join(marks, ["family", "source"], "left").withColumn("gone", F.coalesce(gone, F.lit(False)))
    return out.withColumn("status", F.when(F.col("gone"), "NOT_VERIFIED").otherwise(F.col("status"))).withColumn("evidence", F.when(~F.col("gone"), F.col("evidence"))).drop("gone", "audited")


def known_before(products: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Every product with the date it was first seen before, and whether that is new."""
    first = seen.groupBy(key).agg(F.min("seen").alias("before"))
    return products.join(first, key, "left").withColumn("is_new", F.col("before").isNull())


def refresh_membership(rows: DataFrame, scan: DataFrame, pinned: list[str], key: str) -> DataFrame:
    """Apply a complete scan of the NEW collections: rows in it get the flag, stale flags go, no row is lost. If a pinned
    path is missing from the scan, nothing changes."""
    complete = scan.filter(F.col("path").isin(pinned)).agg((F.countDistinct("path") == len(set(pinned))).alias("complete"))
    new = scan.select(key).distinct().withColumn("listed", F.lit(True))
    out = rows.join(new, key, "left").join(complete)  # one row
    return out.withColumn("is_new", F.when(F.col("complete"), F.coalesce("listed", F.lit(False))).otherwise(F.col("is_new"))).drop("listed", "complete")
