"""Operator 8: mixing sources to target weights by weighted fair queueing.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share `share` times the words there are; no
source's target exceeds `passes` times its own words, and what is cut off is shared again by weight (water filling,
closed form over the table of sources). Each source's documents stand in a queue in seeded random order, once per pass.
A document is served in packets of at most `packet` words; a packet's virtual finish time is the words of its queue up
to and with it, divided by its source's target. All packets together, sorted by finish time, are the mix, and it is
truncated where it reaches the total budget, the sum of the targets. So every source ends within about one packet of
its target. With `packet=None` a document is one packet, taken wholly or (the last one of the mix) if over half of it
fits.

The sort is a range sort: packets are summed by ranges of finish time, ranges before the one that holds the cut are in
the mix whole, and only that range is put in order. The sum along a queue is made in two steps too: sums of hash ranges,
then sums within a range. A source has as many ranges as its rows need, so one that holds a third of all rows is
spread over many tasks, and reruns agree.

Defined cases: null and empty texts have 0 words and are never taken; null sources are one source; rows that repeat a
doc_id are taken each for itself, in the order of a hash of their texts (as are rows without doc_id); sources without
words have target 0; very long texts are many packets of one row; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import stash

WEIGHTS = (3, 1, 2)
WORD_RE = r"[^\x20\x09-\x0D]+"
PACKET = 100
#: Rows or packets aimed at for a range, and the most ranges there are; larger tables have larger ranges.
RANGE_ROWS, MOST_RANGES = 500, 200_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, passes: int = 2) -> DataFrame:
    """sizes(source, size) -> source, source_size, target: a row for each source."""
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    table = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double")).withColumn("cap", (F.col("source_size") * passes).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    # In order of cap / weight, the first ones fill up: what is left for the others at each step gives the level.
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * share
    step = table.withColumn("left", budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    full = step.withColumn("full", F.col("cap") * F.col("heavy") <= F.col("weight") * F.col("left"))
    level = full.withColumn("level", F.max(F.when(~F.col("full"), F.col("left") / F.col("heavy"))).over(everything))
    return level.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def order_key(number: int, seed: str = "mix") -> Column:
    """The place of a document in its source's queue in one pass."""
    return F.md5(F.concat(F.lit(f"{seed}{number}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("hash")))


def sizes_of(docs: DataFrame) -> DataFrame:
    """row (a number for each input row), doc_id, source, size in words and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD_RE)).cast("long").alias("size"), F.md5(text).alias("hash"))


def queues(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, passes: int = 2, seed: str = "mix") -> DataFrame:
    """A written table of sizes: adds source_size, target, and for each pass p key{p} and before{p}, the words before
    the document in its queue, passes before included."""
    spread = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(max(RANGE_ROWS, sizes.count() // MOST_RANGES))))
    goal = targets(sizes, weights, share, passes).join(sizes.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("rows")), F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", spread.alias("ranges"))
    out = sizes.join(goal, sizes.source.eqNullSafe(goal.s)).drop("s")
    for p in range(passes):
        out = out.withColumn(f"key{p}", order_key(p, seed)).withColumn(f"range{p}", F.floor(F.conv(F.substring(f"key{p}", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.col("ranges")).cast("long"))
    for p in range(passes):
        sums = out.groupBy("source", f"range{p}").agg(F.sum("size").alias("in_range"))
        up_to = Window.partitionBy("source").orderBy(f"range{p}").rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select(F.col("source").alias("s"), F.col(f"range{p}").alias("r"), F.coalesce(F.sum("in_range").over(up_to), F.lit(0)).alias(f"base{p}"))
        out = out.join(base, out.source.eqNullSafe(base.s) & (out[f"range{p}"] == base.r)).drop("s", "r")
        within = Window.partitionBy("source", f"range{p}").orderBy(f"key{p}", "size").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"before{p}", p * F.col("source_size") + F.col(f"base{p}") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    return out.drop("ranges", *(f"{c}{p}" for c in ("range", "base") for p in range(passes)))


def packets_of(passes: int, packet: int | None) -> Column:
    """The packets of a row: finish time, pass, key, number and words."""

    def of_pass(p: int) -> Column:
        def at(k: Column) -> Column:
            begin = k * packet if packet else F.lit(0).cast("long")
            words = F.least(F.lit(packet).cast("long"), F.col("size") - begin) if packet else F.col("size")
            return F.struct(((F.col(f"before{p}") + begin + words) / F.col("target")).alias("finish"), F.lit(p).alias("pass"), F.col(f"key{p}").alias("key"), k.alias("k"), words.alias("words"))

        n = F.ceil(F.col("size") / packet) if packet else F.lit(1).cast("long")
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), at)

    return F.when(F.col("size") > 0, F.concat(*map(of_pass, range(passes)))).otherwise(F.array())


def mix_sizes(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, passes: int = 2, packet: int | None = PACKET, seed: str = "mix") -> DataFrame:
    """sizes (a written table as `sizes_of` makes it): adds source_size, target, taken, and finish: array of finish
    times, one for each pass in which the document is taken, that of its last packet taken."""
    queued = stash(queues(sizes, weights, share, passes, seed), "queues")
    known = queued.withColumn("packets", packets_of(passes, packet))
    each = known.select("source", F.explode("packets").alias("packet")).select("source", "packet.*")
    total = sizes.agg(F.sum(F.ceil(F.col("size") / packet) if packet else F.lit(1))).first()[0] or 0
    scale = float(max(1, min(total // RANGE_ROWS, MOST_RANGES)))
    ranged = each.withColumn("range", F.floor(F.col("finish") * scale))
    budget = int((queued.select("source", "target").distinct().agg(F.sum("target")).first()[0] or 0) + 1e-6)
    before = F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # of one row per range
    cut = ranged.groupBy("range").agg(F.sum("words").alias("words")).withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") + F.col("words") >= budget).orderBy("range").first()
    taken = lambda p: p["words"]
    if cut is not None:
        up_to = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "pass", "key", "k").rowsBetween(Window.unboundedPreceding, -1)
        crossing = ranged.filter(F.col("range") == cut["range"]).withColumn("room", budget - cut["before"] - F.coalesce(F.sum("words").over(up_to), F.lit(0)))
        last = crossing.filter("room >= 0").orderBy("room", F.desc("finish")).first()
        rank = lambda source: F.coalesce(source, F.lit(""))
        place = lambda p, source: F.struct(p["finish"].alias("a"), source.isNull().alias("b"), rank(source).alias("c"), p["pass"].alias("d"), p["key"].alias("e"), p["k"].alias("f"))
        end = F.struct(F.lit(last["finish"]).alias("a"), F.lit(last["source"] is None).alias("b"), F.lit(last["source"] or "").alias("c"), F.lit(last["pass"]).alias("d"), F.lit(last["key"]).alias("e"), F.lit(last["k"]).alias("f"))
        rest = min(last["words"], last["room"]) if packet else last["words"] * (2 * last["room"] >= last["words"])
        taken = lambda p: F.when(place(p, F.col("source")) < end, p["words"]).when(place(p, F.col("source")) == end, F.lit(rest).cast("long")).otherwise(F.lit(0).cast("long"))
    served = known.withColumn("served", F.transform("packets", lambda p: F.struct(p["finish"].alias("finish"), p["pass"].alias("pass"), taken(p).alias("words"))))
    words = F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x["words"])

    def last_finish(number: int) -> Column:
        return F.array_max(F.transform(F.filter("served", lambda x: (x["pass"] == number) & (x["words"] > 0)), lambda x: x["finish"]))

    finish = F.array(*map(last_finish, range(passes)))
    return served.select("row", "doc_id", "source", "hash", "size", "source_size", "target", words.alias("taken"), F.array_compact(finish).alias("finish"))


def mix_order(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each time a document is taken, range-sorted by virtual finish time."""
    return mixed.select("row", "doc_id", "source", "hash", "size", F.explode("finish").alias("finish")).orderBy("finish", "source", "doc_id")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stash(sizes_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    return mix_sizes(sizes).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH s AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS name FROM documents),
w AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         (source_size * 2)::DOUBLE AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source)),
l AS (
  SELECT *, (SELECT sum(source_size) FROM w)::DOUBLE * 1.5 - coalesce(sum(cap) OVER o, 0.0) AS rest,
         (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0.0) AS heavy
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         CASE WHEN cap * heavy <= weight * rest THEN cap
              ELSE weight * (SELECT max(rest / heavy) FROM l WHERE NOT cap * heavy <= weight * rest) END AS target FROM l),
q AS (
  SELECT s.*, t.source_size, t.target, p.pass, md5('mix' || p.pass || ':' || name) AS key FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source, range(2) AS p(pass)),
b AS (
  SELECT *, pass * source_size + coalesce(sum(size) OVER (PARTITION BY source, pass ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
e AS (
  SELECT *, least({PACKET}, size - k * {PACKET}) AS words, (before + k * {PACKET} + least({PACKET}, size - k * {PACKET})) / target AS finish
  FROM (SELECT *, unnest(range(((size + {PACKET} - 1) // {PACKET})::BIGINT)) AS k FROM b)),
c AS (
  SELECT row, words, (SELECT floor(sum(target) + 1e-6) FROM t)
         - coalesce(sum(words) OVER (ORDER BY finish, source NULLS LAST, pass, key, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM e)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(m.taken, 0)::BIGINT AS taken
FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN (SELECT row, sum(least(words, greatest(0, room))) AS taken FROM c GROUP BY row) m ON s.row = m.row
"""
