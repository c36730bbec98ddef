"""Operator 11: stretches of a text that repeat themselves with a period, by harmonic grid probing.

A run is a stretch of words with smallest period q (words q apart are equal), at least `times` periods and `least` words
long, that no neighbouring word extends. With three periods or more, the places where word i equals word i + q form an
interval of at least 2q, so one of the grid points 0, q, 2q, ... lies in its first q places and the q + 1 places from
there on all hold equal pairs. For all periods together the grids have n ln n points. Each is probed: the words at jq and
(j+1)q, then at (j+2)q, then at places spread over one period; survivors are extended both ways by comparing chunks of
growing size. Grid points inside a run that was found with a divisor of the period are skipped: their stretch is that run.

Texts are probed one by one inside the tasks that scan them: there is no shuffle, and memory is that of one text and
`PROBES` grid points.

Defined cases: null and blank texts have no words, no runs and an empty collapsed text; a very long text is probed whole;
repeated rows give a row each; a null doc_id stays null; an empty table gives no rows; extra columns are left behind.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import documents, give_back, words

LEAST, TIMES = 24, 3
PROBES = 1 << 20
SPREAD = 8  # places within a period that are compared before a stretch is extended
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _equal_stretch(w: np.ndarray, x: int, q: int) -> tuple[int, int]:
    """The interval around x of places whose word equals the word q later."""
    hi, last, step = x, len(w) - q, 64
    while hi < last:
        same = w[hi : min(hi + step, last)] == w[hi + q : min(hi + step, last) + q]
        if not same.all():
            hi += int(same.argmin())
            break
        hi, step = hi + len(same), step * 2
    lo, step = x, 64
    while lo > 0:
        at = max(0, lo - step)
        same = (w[at:lo] == w[at + q : lo + q])[::-1]
        if not same.all():
            lo -= int(same.argmin())
            break
        lo, step = at, step * 2
    return lo, hi


def _probed(w: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods first..last and those of their grid points that pass all probes, by period and place."""
    periods = np.arange(first, last + 1)
    points = np.maximum(0, -(-(len(w) - 2 * periods) // periods))  # x + 2q must be a word
    q = np.repeat(periods, points)
    x = (np.arange(len(q)) - np.repeat(np.cumsum(points) - points, points)) * q
    for k in (1, 2):
        ok = w[x + (k - 1) * q] == w[x + k * q]
        x, q = x[ok], q[ok]
    for k in range(1, SPREAD):
        if not len(x):
            break
        at = x + q * k // SPREAD
        ok = w[at] == w[at + q]
        x, q = x[ok], q[ok]
    return q, x


def find_runs(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start, then period."""
    if times < 3:
        raise ValueError("the grid finds runs of three periods and more")
    n, longest = len(w), len(w) // times
    found: dict[int, tuple[list[int], list[int]]] = {}  # period: starts and ends, ascending
    first = 1
    while first <= longest:
        last, size = first, n // first
        while last < longest and size < PROBES:
            last += 1
            size += n // last
        q, x = _probed(w, first, last)
        for at, to in zip(*_groups(q)):
            period, places = int(q[at]), x[at:to]
            divisors = [found[p] for p in found if period % p == 0]
            i = 0
            while i < len(places):
                place = int(places[i])
                beyond = _covered(divisors, place, period)
                if beyond is None:
                    lo, beyond = _equal_stretch(w, place, period)
                    length = beyond - lo + period
                    if length >= max(least, times * period):
                        if period not in found:
                            found[period] = ([], [])
                            divisors.append(found[period])
                        found[period][0].append(lo)
                        found[period][1].append(lo + length)
                i = max(i + 1, int(np.searchsorted(places, beyond)))
        first = last + 1
    return sorted((s, e - s, p) for p, (starts, ends) in found.items() for s, e in zip(starts, ends))


def _groups(q: np.ndarray) -> tuple[list[int], list[int]]:
    """Where each group of equal values of a sorted array begins and ends."""
    cut = np.flatnonzero(np.diff(q)) + 1
    return ([], []) if not len(q) else ([0, *cut.tolist()], [*cut.tolist(), len(q)])


def _covered(runs: list[tuple[list[int], list[int]]], x: int, q: int) -> int | None:
    """If x and x + q lie in one of these runs (whose periods divide q): the first place whose pair leaves it."""
    for starts, ends in runs:
        j = bisect_right(starts, x) - 1
        for k in (j, j - 1):  # runs of one period overlap by less than it
            if k >= 0 and x + q < ends[k]:
                return ends[k] - q
    return None


def collapse(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(tokens)
    depth = np.zeros(len(tokens) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([tokens[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and the collapsed text of each document."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, kept = [], []
            for text in batch.column(1).cast(pa.large_binary()):
                tokens = (text.as_py() or b"").split()  # of bytes: ASCII white space only
                number: dict[bytes, int] = {}
                w = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens))
                runs = find_runs(w, least, times) if len(tokens) >= least else []
                lists.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(collapse(tokens, runs))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind), pa.array(kept, pa.large_binary()).cast(pa.large_string(), safe=False).cast(pa.string())], ["doc_id", "runs", "collapsed"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(probe, f"doc_id long, runs array<{RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The contract's texts: in one document of ten, by the crc32 of its decimal doc_id, the words from a on go round with
    period p. A null doc_id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10).cast("long"), F.greatest(F.size("_w"), F.lit(1)).cast("long")
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(h % 10 == 0, words(F.col("text"))).alias("_w"), g.alias("_g"))
    listed = listed.withColumn("_a", F.col("_g") % n)
    listed = listed.withColumn("_p", F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + F.col("_g") % 8)).cast("long"))
    a, p = F.col("_a"), F.col("_p")
    turned = F.transform("_w", lambda x, i: F.when(i >= a, F.get("_w", (a + (i - a) % p).cast("int"))).otherwise(x))
    return listed.select("doc_id", F.when(F.size("_w") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first."""

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    found = periodic_runs(planted(documents(spark, sf_dir)))
    top = F.col("top")
    return found.withColumn("top", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
