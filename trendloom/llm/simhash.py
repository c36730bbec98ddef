"""Operator 4: SimHash near-duplicates over a byte-position inverted index with count filtering.

Fingerprint: texts in lower case (A-Z), words between ASCII white space, 3-word shingles with repeats, XXH64 of each
(seed 42); a bit is set if over half the shingles set it. Two fingerprints link if at most 3 of 64 bits differ.

Bits that differ lie in at most 3 of the 8 bytes, so linked fingerprints share at least 5 positional bytes. Tallying
single (position, byte) postings would make a posting list of N / 256 and N^2 / 32 pair counts; instead the index posts
each distinct fingerprint under every set of 5 positions with their bytes (56 lists), so two fingerprints meet in a
list exactly if their tally reaches the guaranteed minimum of 5, and the list only has to verify the rest. In one list
fingerprints differ in 24 bits at most, so it has a proven bound whatever the data. A list emits a spanning forest of
its links, never all pairs: connected components need no more, and no link between different texts is lost. Lists up
to `SMALL` compare all members in memory; longer ones probe the 2,324 patterns of up to 3 of the 24 bits.

Defined cases: null and blank texts have fingerprint zero and link like any other; very long texts are hashed whole,
`BLOCK` shingles at a time; rows that share a doc_id are one document; rows with a null doc_id have a fingerprint, link nothing and get a null component; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import give_back, shuffle_partitions, stash
from trendloom.llm.graph import connected_components

MAX_BITS = 3
SHARED_BYTES = 8 - MAX_BITS
SMALL = 4096
SETS = list(combinations(range(8), SHARED_BYTES))
BLOCK = 1 << 16


def fingerprint(text: str | bytes | None, width: int = 3) -> int:
    """The 64-bit SimHash of a whole text; 0 without words."""
    import xxhash

    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()  # of bytes: ASCII only, as the contract has it
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - width + 1)
    lo, hi = starts[:n].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], 42) for a, b in zip(lo[at : at + BLOCK], hi[at : at + BLOCK])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _forest(fp: np.ndarray, free: np.ndarray) -> list[tuple[int, int]]:
    """Edges (indices) that join everything in a list of distinct fingerprints that links reach."""
    left = np.ones(len(fp), bool)
    edges: list[tuple[int, int]] = []
    near = None
    if len(fp) > SMALL:
        order = np.argsort(fp)
        ranked = fp[order]
        near = np.array([np.bitwise_or.reduce(free[list(c)]) for k in (1, 2, 3) for c in combinations(range(len(free)), k)], np.uint64)
    for root in range(len(fp)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        while front:
            i = front.pop()
            if near is None:
                rest = np.flatnonzero(left)
                hit = rest[np.bitwise_count(fp[rest] ^ fp[i]) <= MAX_BITS]
            else:
                want = fp[i] ^ near
                at = np.minimum(np.searchsorted(ranked, want), len(ranked) - 1)
                hit = order[at[ranked[at] == want]]
                hit = hit[left[hit]]
            left[hit] = False
            edges += [(i, int(j)) for j in hit]
            front += hit.tolist()
    return edges


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << 8 * p for p in positions)


def _links_in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings (set, bytes, fp, rep) in, links (u, v) out; a list may go on into the next batch."""
    held: list[pa.RecordBatch] = []

    def solve(table: dict[str, np.ndarray]) -> pa.RecordBatch:
        k, b, fp, rep = (table[c] for c in ("k", "bytes", "fp", "rep"))
        head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])])
        size = np.diff(np.r_[head, len(k)])
        two = head[size == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS]
        us, vs = [rep[two]], [rep[two + 1]]
        for a, n in zip(head[size > 2], size[size > 2]):
            free = np.array([1 << (8 * p + i) for p in range(8) if p not in SETS[k[a]] for i in range(8)], np.uint64)
            e = np.array(_forest(fp[a : a + n], free), np.int64).reshape(-1, 2)
            us.append(rep[a + e[:, 0]])
            vs.append(rep[a + e[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    def columns(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(parts)
        out = {c: t[c].combine_chunks().to_numpy(zero_copy_only=False) for c in t.column_names}
        return out | {"fp": out["fp"].view(np.uint64)}

    for batch in batches:
        if not len(batch):
            continue
        k, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        last = np.flatnonzero((k != k[-1]) | (b != b[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield solve(columns([*held, batch.slice(0, cut)]))
            held = []
        elif held and (held[-1].column(0)[-1] != batch.column(0)[0] or held[-1].column(1)[-1] != batch.column(1)[0]):
            yield solve(columns(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield solve(columns(held))


def index_links(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A written table of fingerprints -> its classes (fp, rep: the smallest doc_id of those with one fingerprint) and
    the links (u, v) between classes that the index finds."""
    n = shuffle_partitions(marked.sparkSession)
    nodes = marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    lists = F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in map(_mask, SETS)])
    postings = nodes.select("fp", "rep", F.posexplode(lists).alias("k", "bytes")).select(F.col("k").cast("int").alias("k"), "bytes", "fp", "rep")
    return nodes, postings.repartition(n, "k", "bytes").sortWithinPartitions("k", "bytes", "fp").mapInArrow(_links_in_lists, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    marked = stash(fingerprints(docs, width), "fingerprints")
    nodes, links = index_links(marked)
    # Rows that repeat a doc_id are one document: their fingerprints' classes are joined.
    ids = marked.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b")
    several = marked.join(ids.select("doc_id"), "doc_id").distinct().join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    components = connected_components(links.unionByName(several))
    named = nodes.join(components, nodes.rep == components.node, "left").select(F.col("fp").alias("node_fp"), F.coalesce("component", "rep").alias("component_id"))
    out = marked.join(named, marked.fp == named.node_fp, "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
