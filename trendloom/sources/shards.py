"""Sorted shards filled one after the other, deliveries whose parts are named by their content, and lanes that publish several
tables at once or not at all."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.sources.files import _claim, _pointers, exists

SHARD_BYTES, MOST_BYTES, PART_BYTES = 16 << 20, 20 << 20, 6 << 20
#: A JSON array has two brackets, and a comma before each element but the first.
BRACKETS, COMMA = 2, 1


def _breaks(size: np.ndarray, used: int, target: int) -> list[int]:
    """The rows that begin a shard when a shard with `used` bytes is open before the first (0: none is open)."""
    ends = np.cumsum(size + COMMA)
    out, row, room = [], 0, target - used if used else 0
    if not used:
        out, room = [0], target - BRACKETS + COMMA
    while True:
        # the first row that the open shard has no room for; its own first row always has
        base = ends[row - 1] if row else 0
        at = int(np.searchsorted(ends, base + room, side="right"))
        at = max(at, out[-1] + 1) if out and out[-1] == row else at
        if at >= len(size):
            return out
        out.append(at)
        row, room = at, target - BRACKETS + COMMA


def _left_open(size: np.ndarray, used: int, breaks: list[int]) -> int:
    if not breaks:
        return used + int((size + COMMA).sum())
    return BRACKETS - COMMA + int((size[breaks[-1] :] + COMMA).sum())


def packed(table: DataFrame, key: str, size: Column, target: int = SHARD_BYTES, rows_per_range: int = 200_000) -> DataFrame:
    """Number the shards of a table that is filled in order of `key`: a row goes to the open shard unless that would pass
    `target`; a row larger than that has a shard of its own. Ties of key go by the row's whole content.

    Rows are sorted in ranges. What a range does depends on how full the shard is that comes into it, and only by the first
    row that no longer fits: so each range says, for every such row of its first shard, how full its last shard is and how
    many it begins; most rows say the same, and only where that changes goes to the driver, which goes through the ranges
    once. No task sees more than a range.
    """
    spark = table.sparkSession
    rows = table.withColumn("_size", size.cast("long"))
    count = rows.count()
    ranges = max(1, -(-count // rows_per_range))
    order = F.sha2(F.to_json(F.struct(*[c for c in table.columns])), 256)
    placed = rows.withColumn("_tie", order).repartitionByRange(ranges, key, "_tie").sortWithinPartitions(key, "_tie").withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    from trendloom import stars

    stars.durable(spark)
    placed = placed.checkpoint()

    def table_of(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf.sort_values("_row")["_size"].to_numpy(np.int64)
        first = _breaks(n, 0, target)
        seen: list[tuple[int, int, int]] = []
        ends = np.cumsum(n + COMMA)
        # by the first row k that does not fit; k = all: everything fits
        for k in range(int(np.searchsorted(ends, target, side="right")) + 1):
            tail = n[k:]
            if len(tail):
                b = _breaks(tail, 0, target)
                state = (_left_open(tail, 0, b), len(b))
                if not seen or seen[-1][1:] != state:
                    seen.append((k, *state))
        fresh = (_left_open(n, 0, first), len(first))
        return pd.DataFrame({"_range": [int(pdf["_range"].iloc[0])], "total": [int((n + COMMA).sum())], "fresh": [list(fresh)], "firsts": [[s[0] for s in seen]], "opens": [[s[1] for s in seen]], "begun": [[s[2] for s in seen]], "ends": [ends[: int(np.searchsorted(ends, target, side="right")) + 1].tolist()]})

    kinds = "_range int, total long, fresh array<long>, firsts array<long>, opens array<long>, begun array<long>, ends array<long>"
    steps = placed.select("_range", "_row", "_size").groupBy("_range").applyInPandas(table_of, kinds).orderBy("_range").toLocalIterator()
    used, shard, starts = 0, -1, []
    for s in steps:
        starts.append((s["_range"], used, shard))
        if not used:
            used, begun = s["fresh"]
        elif s["total"] <= target - used:
            used, begun = used + s["total"], 0
        else:
            k = int(np.searchsorted(np.array(s["ends"]), target - used, side="right"))
            at = bisect_left(s["firsts"], k + 1) - 1
            used, begun = s["opens"][at], s["begun"][at]
        shard += begun
    begins = spark.createDataFrame(starts, "_range int, _used long, _shard long")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        n = pdf["_size"].to_numpy(np.int64)
        at = np.zeros(len(n), np.int64)
        at[_breaks(n, int(pdf["_used"].iloc[0]), target)] = 1
        return pd.DataFrame({"_row": pdf["_row"], "shard": int(pdf["_shard"].iloc[0]) + np.cumsum(at)})

    numbered = placed.select("_range", "_row", "_size").join(F.broadcast(begins) if ranges < 100_000 else begins, "_range").groupBy("_range").applyInPandas(number, "_row long, shard long")
    return placed.join(numbered, "_row").drop("_range", "_row", "_size", "_tie")


def bodies(table: DataFrame, key: str, target: int, most: int) -> DataFrame:
    """shard, rows, body and bytes: each shard as the text of a JSON array in order of key; raises if one is over `most`."""
    json = F.to_json(F.struct(*table.columns))
    numbered = packed(table.withColumn("_json", json), key, F.length("_json"), target)
    elements = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.sha2("_json", 256).alias("h"), F.col("_json").alias("j"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(elements, lambda e: e["j"]), ","), F.lit("]"))
    out = numbered.groupBy("shard").agg(F.count("*").alias("rows"), text.alias("text"))
    size = F.octet_length("text")
    over = F.raise_error(F.concat(F.lit("shard "), F.col("shard"), F.lit(" has "), size, F.lit(f" bytes, over {most}"))).cast("string")
    return out.select("shard", "rows", F.when(size > most, over).otherwise(F.col("text")).alias("body"), size.alias("bytes"))


def write_shards(table: DataFrame, path: str, key: str, target: int = SHARD_BYTES, most: int = MOST_BYTES) -> DataFrame:
    """Write the table as sorted JSON shards in folders part=000, part=001, ... and a manifest of (part, rows, bytes); returns the
    manifest. A shard over `most` bytes stops the write before the manifest."""
    spark = table.sparkSession
    named = bodies(table, key, target, most).withColumn("part", F.lpad(F.col("shard").cast("string"), 3, "0"))
    named.select("part", "rows", "bytes", "body").write.mode("overwrite").partitionBy("part").json(f"{path}/shards")
    manifest = spark.read.schema("part string, rows long, bytes long").json(f"{path}/shards").select("part", "rows", "bytes")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of such a dataset; raises if a shard has another number of rows than the manifest says."""
    stored = spark.read.schema("part string, body string").json(f"{path}/shards").join(spark.read.parquet(f"{path}/manifest"), "part", "full")
    rows = F.from_json("body", f"array<struct<{schema}>>")
    right = F.coalesce(F.size(rows) == F.col("rows"), F.lit(False))
    checked = F.when(right, rows).otherwise(F.raise_error(F.concat(F.lit("row count of shard "), F.col("part"))).cast(f"array<struct<{schema}>>"))
    return stored.select(F.explode(checked).alias("r")).select("r.*")


def seal(tables: dict[str, DataFrame], path: str, keys: dict[str, str], target: int = PART_BYTES) -> str:
    """Write a delivery: each table as parts of at most `target` bytes, each in a folder named by field, place and the sha256 of
    its text, so that nothing that an older manifest names is ever overwritten; then the manifest; returns the root, the sha256
    of all names in order. Raises if a row is larger than a part."""
    spark = next(iter(tables.values())).sparkSession
    written = []
    for field, table in tables.items():
        # a part's text is at most its target: the row that would pass it begins the next one
        parts = bodies(table, keys[field], target, target)
        digest = F.sha2("body", 256)
        named = parts.withColumn("name", F.concat_ws("-", F.lit(field), F.lpad(F.col("shard").cast("string"), 6, "0"), F.substring(digest, 1, 12)))
        from trendloom import stars

        stars.durable(spark)
        named = named.select("name", "rows", digest.alias("sha256"), "body").checkpoint()
        fresh = named.select("name", "body")
        if exists(spark, f"{path}/parts"):  # what an older delivery has under this name has this content
            fresh = fresh.join(spark.read.schema("value string, name string").text(f"{path}/parts").select("name").distinct(), "name", "left_anti")
        fresh.write.mode("append").partitionBy("name").text(f"{path}/parts")
        written.append(named.select(F.lit(field).alias("field"), "name", "rows", "sha256"))
    manifest = written[0]
    for more in written[1:]:
        manifest = manifest.unionByName(more)
    root = _root(manifest)
    manifest.write.mode("overwrite").parquet(f"{path}/manifests/root={root}")
    pointers = _pointers(spark, path)
    if not _claim(spark, path, max((n for n, _ in pointers), default=0) + 1, root):
        raise RuntimeError("another delivery was published meanwhile")
    return root


def _root(manifest: DataFrame) -> str:
    """A digest of all parts: digests of ranges of names in order, digested again, so no task has all names."""
    part = manifest.groupBy("field", F.floor(F.substring_index(F.substring_index("name", "-", -2), "-", 1).cast("long") / 10_000).alias("block"))
    blocks = part.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "rows", "sha256"))), "\n"), 256).alias("d"))
    return blocks.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "field", "block", "d"))), "\n"), 256)).first()[0] or ""


def open_sealed(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of a field of the current delivery. A part that is missing, has other bytes or another number of rows than
    the manifest says, or a manifest that does not give its root, stops the read."""
    root = next(name for _, name in reversed(_pointers(spark, path)) if name)
    manifest = spark.read.parquet(f"{path}/manifests/root={root}").select("field", "name", "rows", "sha256")
    if _root(manifest) != root:
        raise ValueError("the manifest does not give its root")
    parts = spark.read.option("wholetext", True).schema("value string, name string").text(f"{path}/parts")
    found = manifest.filter(F.col("field") == field).join(parts, "name", "left").withColumn("body", F.regexp_replace("value", r"\n$", ""))
    rows = F.from_json("body", f"array<struct<{schema}>>")
    right = F.coalesce((F.sha2("body", 256) == F.col("sha256")) & (F.size(rows) == F.col("rows")), F.lit(False))
    checked = F.when(right, rows).otherwise(F.raise_error(F.concat(F.lit("part "), F.col("name"), F.lit(" is not as it was sealed"))).cast(f"array<struct<{schema}>>"))
    return found.select(F.explode(checked).alias("r")).select("r.*")


def lane(path: str, steps: dict[str, Callable[[DataFrame], DataFrame]], accept: Callable[[dict[str, DataFrame]], bool] = lambda _: True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each step makes a table of a batch, all are written beside each other under the batch's number,
    and one numbered pointer then names them all. A step that fails, or tables that are not accepted, leave the pointer and so
    every reader where they were; a batch that comes again after a restart is published once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _pointers(spark, path)
        if any(name.split("-")[0] == str(batch_id) for _, name in known):
            return
        state = f"{batch_id}-{len(known)}"
        written = {}
        for name, step in steps.items():
            step(batch).write.mode("overwrite").parquet(f"{path}/state={state}/{name}")
            written[name] = spark.read.parquet(f"{path}/state={state}/{name}")
        if accept(written) and not _claim(spark, path, max((n for n, _ in known), default=0) + 1, state):
            raise RuntimeError("another writer published meanwhile")

    return run


def read_lane(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """A table as of the last batch that was published whole; None before the first."""
    state = next((name for _, name in reversed(_pointers(spark, path)) if name), None)
    return spark.read.parquet(f"{path}/state={state}/{table}") if state and exists(spark, f"{path}/state={state}/{table}") else None
