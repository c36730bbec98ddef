"""Gates: conditions with names, and verdicts from the list of those that hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions.expr import half_up, ladder, reasons


def gate(table: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """Add the reasons against each row, and whether it is accepted (there are none)."""
    return table.withColumn("reasons", reasons(*rules)).withColumn("accepted", F.size("reasons") == 0)


def coverage_status(collected: Column, expected: Column, exhausted: Column, failed: Column | None = None, least: float = 0.9, most: float = 1.25) -> Column:
    """FULL only if the source was read to its end and agrees with the total it states; FAILED if nothing came (or, where
    `failed` is given, if nothing came of a failed run); PARTIAL otherwise."""
    nothing = collected == 0
    full = F.coalesce(exhausted & (expected > 0) & (collected >= expected * least) & (collected <= expected * most), F.lit(False))
    return ladder((nothing & failed if failed is not None else nothing, "FAILED"), (full, "FULL"), default="PARTIAL")


def collection_status(state: Column, collected: Column, reported: Column, exhausted: Column, errors: Column, capped: Column, root: Column, least: float = 0.9, most: float = 1.25) -> Column:
    """The status of a source by how its collection went: what it still needs first, then failures, then FULL only if the
    pages were read to their end, under its footwear root, without a cap, and agree with the total it reports."""
    nothing = collected == 0
    agrees = (reported > 0) & (collected >= reported * least) & (collected <= reported * most)
    full = exhausted & F.coalesce(root, F.lit(True)) & ~F.coalesce(capped, F.lit(False)) & agrees
    return ladder(
        (state.isin("NEEDS_PROBE", "NEEDS_CUSTOM_ADAPTER"), state),
        (nothing & ((state == "FAILED") | (errors > 0)), "FAILED"),
        (~nothing & F.coalesce(full, F.lit(False)), "FULL"),
        default="PARTIAL",
    )


def retained(current: Column, previous: Column, share: float = 0.6) -> Column:
    """At least the share of what there was, rounded up."""
    return current >= F.ceil(previous * share)


def refresh_health(table: DataFrame, least_coverage: float = 95.0, most_drop: float = 40.0) -> DataFrame:
    """Verdict for each source from collected, expected, previous, duplicates and bad_prices."""
    coverage = F.when(F.col("expected") > 0, half_up(F.col("collected") / F.col("expected") * 100.0, 1))
    drop = F.when(F.col("previous") > 0, F.greatest(F.lit(0.0), half_up((F.col("previous") - F.col("collected")) / F.col("previous") * 100.0, 1))).otherwise(0.0)
    out = table.withColumn("coverage", coverage).withColumn("drop", drop)
    status = ladder(
        (F.col("collected") == 0, "FAILED"),
        (F.col("duplicates") > 0, "INVALID_DUPLICATES"),
        (F.col("bad_prices") > 0, "INVALID_PRICES"),
        (F.col("coverage") < least_coverage, "PARTIAL"),
        (F.col("drop") > most_drop, "REJECTED_DROP"),
        default="HEALTHY",
    )
    return out.withColumn("status", status)


def gate_report(table: DataFrame, group: str, verdict: str, name: str, k: int = 10) -> DataFrame:
    """Accepted, excluded and uncertain rows of each group, and the first k excluded names."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(group, verdict).orderBy(name))
    ranked = table.withColumn("place", place)
    first = F.sort_array(F.collect_list(F.when((F.col(verdict) == "EXCLUDE") & (F.col("place") <= k), F.col(name))))
    return ranked.groupBy(group).agg(*[F.count_if(F.col(verdict) == v.upper()).alias(v) for v in ("accept", "exclude", "uncertain")], F.array_join(first, ",").alias("first_excluded"))


def assert_none_missing(previous: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Keys that a complete run must have but lacks."""
    return previous.select(*key).distinct().join(current.select(*key).distinct(), key, "left_anti")
