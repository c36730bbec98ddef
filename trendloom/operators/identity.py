"""Entity resolution: equality blocks first, pair predicates only inside them, components by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom import stars

SEASON_WORDS = ("spring", "summer", "fall", "winter", "resort", "ss", "fw", "new")


def model_name(name: Column, drop: tuple[str, ...], categories: tuple[str, ...]) -> Column:
    """Lower case, without the words to drop; cut after the earliest category word, longest on a tie; singular."""
    lower = F.lower(F.regexp_replace(name, r"\s+-\s+.*$", ""))
    words = F.filter(F.split(lower, r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*drop, *SEASON_WORDS))
    single = F.transform(words, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "(?<!s)s$", "")).otherwise(w))
    at = F.array_min(F.transform(F.filter(F.array(*map(F.lit, categories)), lambda c: F.array_contains(single, c)), lambda c: F.array_position(single, c)))
    return F.array_join(F.when(at.isNotNull(), F.slice(single, F.lit(1), at.cast("int"))).otherwise(single), " ")


def family_keys(products: DataFrame, style: Column, handle: Column, name: Column) -> DataFrame:
    """The strongest key each product has: verified style code (HIGH), handle (MEDIUM), name (LOW), else itself."""
    kind = F.when(F.coalesce(style, F.lit("")) != "", "style").when(F.coalesce(handle, F.lit("")) != "", "handle").when(F.coalesce(name, F.lit("")) != "", "name").otherwise("single")
    level = F.when(kind == "style", "HIGH").when(kind == "handle", "MEDIUM").when(kind == "name", "LOW").otherwise("SINGLE")
    key = F.when(kind == "style", style).when(kind == "handle", handle).otherwise(name)
    return products.withColumn("key_kind", kind).withColumn("family_key", F.concat_ws(":", kind, key)).withColumn("confidence", level)


def families(keyed: DataFrame, brand: str, item: str) -> DataFrame:
    """One row per brand and key: representative (smallest item), variants and confidence."""
    return keyed.groupBy(brand, "family_key").agg(F.min(item).alias("representative"), F.count("*").alias("variants"), F.first("confidence").alias("confidence"))


def pairs_within(items: DataFrame, block: list[str], item: str, match: Column) -> DataFrame:
    """Pairs of one block that satisfy `match`, a condition on columns of a and b; only these leave the join. Where `match`
    needs more equalities, name them in `block`: they make it small. Hot blocks are split by the adaptive skew join."""
    a, b = items.alias("a"), items.alias("b")
    same = F.col(f"a.{item}") < F.col(f"b.{item}")
    for c in block:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, same & match).select(F.col(f"a.{item}").alias("u"), F.col(f"b.{item}").alias("v")).distinct()


def star_links(items: DataFrame, block: list[str], item: str) -> DataFrame:
    """Links that join all items of a block, where being in one block is the relation itself: each to the smallest."""
    first = items.groupBy(*block).agg(F.min(item).alias("u"))
    return items.join(first, block).filter(F.col(item) != F.col("u")).select("u", F.col(item).alias("v")).distinct()


def components(nodes: DataFrame, edges: DataFrame, node: str, rounds: int = 60) -> DataFrame:
    """The smallest node that each node reaches, by alternating stars; raises if they do not settle. Rounds are cut from
    their lineage by a checkpoint in spark.checkpoint.dir; a session on one machine without it gets a folder of its own."""
    stars.durable(nodes.sparkSession)
    labels = nodes.select(F.col(node).alias("n"))
    known = edges.select("u", "v").join(labels.select(F.col("n").alias("u")), "u", "left_semi").join(labels.select(F.col("n").alias("v")), "v", "left_semi").select("u", "v")
    found = stars.connected_components(known, lambda e: e.checkpoint(), rounds).select(F.col("node").alias("n"), "component")
    return labels.join(found, "n", "left").select(F.col("n").alias(node), F.coalesce("component", "n").alias("component"))


def block_components(items: DataFrame, block: list[str], item: str) -> DataFrame:
    """The smallest item that each item reaches, where being in one block is the relation itself; raises if rounds do not settle.
    items: a row for each item of a block, repeated or not; an item that no other shares a block with, or without a block, is alone.

    Each item stands beside the least item m of each of its blocks; l is the least m it has. What is linked is m and l, and the
    item and l: nearly all rows then say the same, so the rounds see little more than one row an item. Minima are pre-aggregated
    before the shuffle; rows are not sorted to meet them, and hot blocks and items are split (adaptive skew join).
    """
    stars.durable(items.sparkSession)
    member = items.select(*block, F.col(item).alias("n"))
    least = member.groupBy(*block).agg(F.min("n").alias("m"))
    met = member.join(least.hint("shuffle_hash"), block).select("n", "m")
    best = met.groupBy("n").agg(F.min("m").alias("l"))
    both = met.join(best.hint("shuffle_hash"), "n").select("l", F.explode(F.array("n", "m")).alias("v"))
    found = stars.connected_components(both.select(F.col("l").alias("u"), "v"), lambda e: e.checkpoint())
    alone = items.select(F.col(item).alias("node")).distinct()
    return alone.join(found, "node", "left").select(F.col("node").alias(item), F.coalesce("component", "node").alias("component"))


def reanchor(fresh: DataFrame, prior: DataFrame, suffix: str = "--fresh") -> DataFrame:
    """Variants of refreshed families under the ids that they had before: anchored_id, fresh_id, brand, url, and what else
    fresh holds (a count, where equal variants stand in one row).

    fresh: fresh_id, brand, url; prior: old_id, brand, url, a row for each variant. A variant goes to every old family with its
    brand and URL (white space, case and slashes at the end aside). What matches nothing goes with the rest of its family if
    that has one old id, and stays under the fresh id otherwise, with the suffix as often as it takes to be no old id; a family
    that matches nothing keeps its id. Rows without a URL match nothing; a variant that stands twice in a family does so under
    each of its ids.
    """
    key = [F.upper(F.trim("brand")).alias("b"), F.lower(F.regexp_replace(F.trim("url"), "/+$", "")).alias("k")]
    known = prior.select(*key, "old_id").distinct()
    # One row may match many old families, so rows are few and evenly dealt before they meet them.
    keyed = fresh.select("*", *key)
    matched = stars.spread(keyed, *fresh.columns).join(known, ["b", "k"], "left").drop("b", "k")
    met = stars.spread(keyed.select("fresh_id", "b", "k").distinct(), "fresh_id", "b", "k").join(known, ["b", "k"], "left").select("fresh_id", "old_id").distinct()
    anchors = met.groupBy("fresh_id").agg(F.count("old_id").alias("anchors"), F.min("old_id").alias("only"))
    taken = prior.select("old_id").distinct()
    base, times = F.regexp_replace("old_id", f"(?:{suffix})+$", ""), lambda c, b: ((F.length(c) - F.length(b)) / len(suffix)).cast("int")
    used = taken.select(base.alias("base"), times(F.col("old_id"), base).alias("t")).groupBy("base").agg(F.collect_set("t").alias("used"))
    mine = F.regexp_replace("fresh_id", f"(?:{suffix})+$", "")
    free = anchors.withColumn("base", mine).withColumn("t", times(F.col("fresh_id"), F.col("base"))).join(used, "base", "left")
    used_here = F.coalesce("used", F.array().cast("array<int>"))
    least = F.array_min(F.array_except(F.sequence(F.col("t"), F.col("t") + F.size(used_here)), used_here))
    free = free.withColumn("free_id", F.concat("fresh_id", F.repeat(F.lit(suffix), least - F.col("t"))))
    out = matched.join(free.select("fresh_id", "anchors", "only", "free_id"), "fresh_id")
    anchored = F.coalesce("old_id", F.when(F.col("anchors") == 0, F.col("fresh_id")).when(F.col("anchors") == 1, F.col("only")).otherwise(F.col("free_id")))
    return out.withColumn("anchored_id", anchored).drop("old_id", "anchors", "only", "free_id")
