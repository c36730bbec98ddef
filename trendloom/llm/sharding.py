"""Operator 5: sharding by a two-pass external shuffle.

Law `key`: the shard is the one of `shards` whose seeded hash with the doc_id is largest (rendezvous hashing), so
doc_id and shard count alone decide, and one more shard takes rows only into itself. Pass one scatters the records of
every shard by a second seeded hash into buckets of about `bucket_bytes`; pass two shuffles each bucket in memory
(Fisher-Yates, seeded by the bucket) and writes it. A record's slot is the number of records in the shard's earlier
buckets plus its place in its own; bucket sizes are read from the written table.

Defined cases: null text counts 0 bytes (size 1) and has crc32 0; a very long text is one record of its bucket; a null doc_id is a key like any other; rows
that repeat a doc_id go to one shard and are scattered over its buckets by their text; equal rows are
interchangeable and scattered over all buckets of their shard by their number; empty shards have no files; extra columns are written along when asked for (`keep`), under names of
their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import new_dir, shuffle_partitions, stash

BUCKET_BYTES = 16 << 20


def key_shard(key: Column, shards: int, seed: str = "shard") -> Column:
    """Rendezvous hashing: the shard with the largest hash of seed, key and shard number."""
    return F.greatest(*[F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)])["s"] if shards > 1 else F.lit(0)


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of 0..n-1; draws are made at once, swaps one by one."""
    out = list(range(n))
    draw = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 0, -1)) if n else []
    for i, j in zip(range(n - 1, -1, -1), draw):
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def numbered(rows: DataFrame) -> DataFrame:
    """Add ordinal, which counts rows that are equal in every column: 0 for the first or only one. Such rows are counted and
    made again from one of them, so that they can be dealt apart; rows are moved only if there are any."""
    columns = rows.columns
    both = [F.xxhash64(F.lit(s), *columns).alias(f"hash{s}") for s in (1, 2)]
    many = stash(rows.groupBy(*both).agg(F.count("*").alias("times")).filter("times > 1"), "equal")
    if not many.limit(1).count():
        return rows.withColumn("ordinal", F.lit(0).cast("long"))
    tagged = rows.select("*", *both).join(many, ["hash1", "hash2"], "left")
    once = tagged.filter("times is null").withColumn("ordinal", F.lit(0).cast("long"))
    again = tagged.filter("times is not null").dropDuplicates(["hash1", "hash2"]).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return once.unionByName(again).select(*columns, "ordinal")


def write_shards(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, keep: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """Write docs(doc_id, text, keep...) as shards and return the written table, with each row's bucket and place in it."""
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "shards")
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"), key_shard(key, shards).alias("shard"), key_shard(key, shards + 1).alias("grown_shard"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 1)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    # equal rows are dealt apart, by their number, so no bucket is theirs alone
    hashed = F.when(F.col("ordinal") == 0, F.xxhash64(F.lit(seed), "doc_id", "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id", "text", "ordinal"))
    scattered = numbered(rows).withColumn("bucket", F.pmod(hashed, F.lit(buckets)).cast("int")).drop("ordinal")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scattered.schema.fields) + ", place long"

    def shuffle(table: pa.Table) -> pa.Table:
        at = [int(table["shard"][0].as_py()), int(table["bucket"][0].as_py())]
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        return table.take(pa.array(fisher_yates(len(table), [seed, *at]))).append_column("place", pa.array(np.arange(len(table)), pa.int64()))

    parts = max(shuffle_partitions(spark), shards * int(buckets))  # a partition for each bucket: tasks do not grow
    scattered.repartition(parts, "shard", "bucket").groupBy("shard", "bucket").applyInArrow(shuffle, kinds).write.partitionBy("shard").parquet(folder)
    return spark.read.schema(kinds).parquet(folder)


def with_slots(written: DataFrame) -> DataFrame:
    """Replace bucket and place of written rows by their slot. Select the columns wanted first: what is left here moves."""
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return written.join(base, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("place")).drop("base", "place", "bucket")


def op5_key_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    digest = written.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("grown_shard").cast("int").alias("grown_shard"), "bucket", "place")
    return with_slots(digest).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
