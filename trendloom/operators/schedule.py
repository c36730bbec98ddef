"""Selection of work: what is due, in what order, and what may run together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Priorities in order.
PRIORITIES = ("P0", "P1", "P2", "P3")


def priority_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for i, p in enumerate(PRIORITIES) for x in (p, i)])[c], F.lit(len(PRIORITIES)))


def numbered(table: DataFrame, coarse: dict[str, Column], order: list[Column], name: str = "place") -> DataFrame:
    """Number all rows in the order of `coarse`, then `order`, without one task for all: rows are counted by the coarse
    values (a table of its own, small if they are days or ranks), the counts before give each group its first number."""
    keyed = table.withColumns({f"_{k}": c for k, c in coarse.items()})
    keys = [f"_{k}" for k in coarse]
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*(F.col(k).alias(f"b{k}") for k in keys), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return keyed.join(base, same).withColumn(name, F.col("_base") + inside).drop("_base", *keys, *(f"b{k}" for k in keys))


def task_order(tasks: DataFrame, priority: Column, created: str, key: str) -> DataFrame:
    """Every task's place by priority, time and key."""
    return numbered(tasks, {"rank": priority, "day": F.to_date(F.col(created))}, [F.col(created), F.col(key)])


def due(status: Column, retry_at: Column, now: Column, terminal: tuple[str, ...] = ("DONE", "REJECTED")) -> Column:
    return ~status.isin(*terminal) & (retry_at.isNull() | (retry_at <= now))


def select_candidates(queue: DataFrame, order: list[Column], k: int, fresh: Column) -> DataFrame:
    """The first k in order; the last place goes to the first fresh candidate if none is among them."""
    ranked = queue.withColumn("is_fresh", fresh)
    best = ranked.orderBy(*order).limit(k - 1)
    taken = best.agg(F.max("is_fresh").alias("has_fresh"))
    rest = ranked.join(best.select("key"), "key", "left_anti").join(taken)  # one row
    last = rest.orderBy(F.when(~F.coalesce("has_fresh", F.lit(False)) & F.col("is_fresh"), 0).otherwise(1), *order).limit(1)
    return best.unionByName(last.drop("has_fresh"))


def without_conflicts(tasks: DataFrame, order: list[str], key: str, locks: str, k: int, block: int = 1000) -> DataFrame:
    """Greedy choice in order: a task that shares a lock with one already chosen waits.

    The driver takes the first `block` tasks that no chosen task's lock bars, chooses among them, and asks again with the
    locks taken since, until k are chosen or no task is left. Every round chooses at least one, none is lost."""
    chosen: list = []
    taken: set = set()
    while len(chosen) < k:
        free = tasks.filter(~F.coalesce(F.exists(locks, lambda x: x.isin(list(taken))), F.lit(False)) & ~F.col(key).isin(chosen)) if chosen else tasks
        rows = free.orderBy(*order).select(key, locks).limit(block).collect()
        if not rows:
            break
        for r in rows:
            own = set(r[locks] or ())
            if not own & taken:
                taken |= own
                chosen.append(r[key])
            if len(chosen) == k:
                break
    return tasks.filter(F.col(key).isin(chosen))
