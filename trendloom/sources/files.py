"""Reading and writing tables: missing inputs, sharded sinks, compare-and-set publishing, sealed deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file; an empty table if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sharded dataset by its manifest (a JSON file with `shards`: file names), with each row's place in it; without a
    manifest the one file beside it; without either an empty table."""
    if not exists(spark, f"{path}/manifest.json"):
        return read_json(spark, f"{path}/all.json", schema).withColumn("shard", F.lit(0))
    names = spark.read.schema("shards array<string>").option("multiLine", True).json(f"{path}/manifest.json").first()["shards"]
    if not names:
        return spark.createDataFrame([], schema).withColumn("shard", F.lit(0))
    place = F.array_position(F.array(*map(F.lit, names)), F.element_at(F.split(F.input_file_name(), "/"), -1)) - 1
    return spark.read.schema(schema).json([f"{path}/{n}" for n in names]).withColumn("shard", place.cast("int"))


def write_sorted_shards(table: DataFrame, path: str, key: str, shard_bytes: int = 16 << 20, bytes_per_row: int | None = None) -> int:
    """Write range-partitioned shards of about shard_bytes of JSON, sorted by key; returns their number."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()["b"] or 0
    shards = max(1, -(-size // shard_bytes))
    table.repartitionByRange(int(shards), key).sortWithinPartitions(key).write.mode("overwrite").json(path)
    return int(shards)


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The numbered pointers of a store and the snapshot each names (empty if its writer was lost half-way)."""
    if not exists(spark, f"{path}/pointers"):
        return []
    fs, p = _fs(spark, f"{path}/pointers")
    names = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().isdigit())
    out = []
    for name in names:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointers/{name}"))
        out.append((int(name), "".join(map(chr, stream.readAllBytes()))))
        stream.close()
    return out


def publish(table: DataFrame, path: str, snapshot: str, expected: str | None) -> bool:
    """Publish a snapshot only over the one expected: data first, then the next numbered pointer, created without
    overwriting. Of two writers who saw the same state only one creates it, and readers always find a pointer."""
    spark = table.sparkSession
    pointers = _pointers(spark, path)
    if current_snapshot(spark, path) != expected:
        return False
    table.write.mode("overwrite").parquet(f"{path}/snapshot={snapshot}")
    return _claim(spark, path, max((n for n, _ in pointers), default=0) + 1, snapshot)


def _claim(spark: SparkSession, path: str, number: int, snapshot: str) -> bool:
    from py4j.protocol import Py4JJavaError

    fs, p = _fs(spark, f"{path}/pointers/{number:012d}")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()) or "already exists" in str(e.java_exception.getMessage()):
            return False
        raise
    out.write(bytearray(snapshot.encode()))
    out.close()
    return True


def current_snapshot(spark: SparkSession, path: str) -> str | None:
    return next((name for _, name in reversed(_pointers(spark, path)) if name), None)


def read_published(spark: SparkSession, path: str) -> DataFrame | None:
    at = current_snapshot(spark, path)
    return spark.read.parquet(f"{path}/snapshot={at}") if at else None


def seal(table: DataFrame) -> tuple[int, str]:
    """Row count and an order-free checksum, to be kept beside a delivery and checked when it is read."""
    r = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], str(r["h"])
