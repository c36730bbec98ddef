"""Row-level resolution: text against vision, conflicts, stability over runs, evidence ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def known(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", UNKNOWN)


def resolve(text: Column, vision: Column, confidence: Column, least: float = 0.5) -> tuple[Column, Column]:
    """Confident vision first, then text, then any vision: the value and where it comes from."""
    sure = known(vision) & (confidence >= least)
    value = F.when(sure, vision).when(known(text), text).when(known(vision), vision).otherwise(UNKNOWN)
    origin = F.when(sure & known(text) & (text == vision), "hybrid").when(sure, "vision").when(known(text), "text").when(known(vision), "vision").otherwise("none")
    return value, origin


def conflicts(text: Column, vision: Column) -> Column:
    return known(text) & known(vision) & (text != vision)


def stability(observed: DataFrame, expected: DataFrame, key: list[str], run: str, value: str, runs: int) -> DataFrame:
    """For each expected key: STABLE_YES or STABLE_NO if all runs agree, UNSTABLE if not, INCOMPLETE_RUN if one lacks it.

    observed has one YES, NO or UNCLEAR per key and run."""
    v = F.col(value)
    seen = observed.groupBy(*key).agg(F.countDistinct(run).alias("runs"), F.bool_and(v == "YES").alias("yes"), F.bool_and(v == "NO").alias("no"))
    verdict = F.when(F.coalesce("runs", F.lit(0)) < runs, "INCOMPLETE_RUN").when(F.col("yes"), "STABLE_YES").when(F.col("no"), "STABLE_NO").otherwise("UNSTABLE")
    return expected.select(*key).distinct().join(seen, key, "left").select(*key, F.coalesce("runs", F.lit(0)).alias("runs"), verdict.alias("verdict"))
