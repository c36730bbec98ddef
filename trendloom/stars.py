"""Connected components of an edge table, in rounds of joins and minima."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def durable(spark: SparkSession) -> None:
    """See to a checkpoint folder: the one of spark.checkpoint.dir; a local session without it gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="trendloom-")
    sc.setCheckpointDir(where)


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """Rows dealt evenly by key over all shuffle partitions. A file of few row groups is read by few tasks, and partitions
    that are small in bytes are joined into few; where a row means much work or many rows, that is all the work in them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def connected_components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame], rounds: int = 60) -> DataFrame:
    """edges(u, v) -> node, component (the smallest node it reaches), for nodes that have an edge.

    Alternating star contraction: each round links the larger neighbours of a node to its smallest neighbour, then the
    smaller ones. Minima are pre-aggregated before the shuffle, the join back splits hot nodes (adaptive skew join), and
    `cut` takes every round off its lineage. The driver only sees a count and a checksum.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, larger: bool) -> DataFrame:
        # e holds (u, v) with u > v
        if larger:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = e.join(least, "u")
        if larger:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()

    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = cut(star(star(now, True), False))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
