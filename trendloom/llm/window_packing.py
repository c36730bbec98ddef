"""Operator 13: best-fit decreasing into windows, with a segment tree over remaining capacities.

Every document (its ids, then an end id) longer than a window is first cut into full windows, which are sequences of
their own; what remains of it, and every shorter document, is one piece. Pieces are dealt by hash to groups of about
`group_pieces`, longest first within a group. A segment tree whose leaves are the remaining capacities 0..capacity tells
where open windows are: the piece goes to the tightest one that holds it, found and kept up to date in log2(capacity)
steps. Only the last windows of a group stay unfilled, whatever its size; no key, source or length can fill a group.

Defined cases: null and empty texts are one piece of the end id; a very long text is encoded whole; repeated rows are
packed each for itself; a null doc_id stays null; an empty table gives no rows; extra columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import documents, stash
from trendloom.llm.encode import slices
from trendloom.llm.word_encode import encoder, end_of_task

CAPACITY, END_ID = 4096, 2
PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_windows(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: full windows, then what remains. row numbers the input rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                flat, n = enc.encode(batch.column(1).slice(a, b - a))
                total = n + 1
                ids = np.full(int(total.sum()), end_id, "<u4")
                inner = np.ones(len(ids), bool)
                inner[np.cumsum(total) - 1] = False
                ids[inner] = flat
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, total[doc] - start)
                at = (np.cumsum(total) - total)[doc] + start
                crc = [zlib.crc32(ids[i : i + k]) for i, k in zip(at, length)]
                take = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])], ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])
        end_of_task()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(cut, PIECES)


class OpenWindows:
    """Open windows by remaining capacity; node i of the tree holds whether any window is open below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()  # a leaf for each of 0..capacity
        self.any = bytearray(2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, window: int) -> None:
        self.at[remaining].append(window)
        node, tree = self.size + remaining, self.any
        while node and not tree[node]:
            tree[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove the window with the least remaining capacity of at least `need`; that capacity and the window."""
        node, tree = self.size + need, self.any
        while not tree[node]:
            # To the next leaf on the right: up while this is a right child, then over.
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node if tree[2 * node] else 2 * node + 1
        remaining = node - self.size
        window = self.at[remaining].pop()
        if not self.at[remaining]:
            tree[node] = 0
            node >>= 1
            while node and not (tree[2 * node] or tree[2 * node + 1]):
                tree[node] = 0
                node >>= 1
        return remaining, window


def tightest_windows(length: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece, pieces taken as they come (longest first for best-fit decreasing)."""
    if len(length) and length.max() > capacity:
        raise ValueError("a piece is longer than a window")
    open_, windows, out = OpenWindows(capacity), 0, np.empty(len(length), np.int64)
    for i, need in enumerate(length.tolist()):
        found = open_.take(need)
        if found is None:
            remaining, window, windows = capacity, windows, windows + 1
        else:
            remaining, window = found
        out[i] = window
        if remaining > need:
            open_.put(remaining - need, window)
    return out


def pack_windows(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = 50_000) -> DataFrame:
    """Add sequence_id and offset to a table of pieces as `cut_windows` makes it."""
    part = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        n = pdf["length"].to_numpy(np.int64)
        where = tightest_windows(n, capacity)
        order = np.argsort(where, kind="stable")
        before = np.cumsum(n[order]) - n[order]
        first = np.r_[True, np.diff(where[order]) > 0]
        offset = np.empty(len(n), np.int64)
        offset[order] = before - before[np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))]
        # numbers of groups' windows are even, those of full windows odd
        return pdf.assign(sequence_id=(where * groups + pdf["_group"].to_numpy(np.int64)) * 2, offset=offset).drop(columns="_group")

    packed = part.withColumn("_group", F.pmod(F.xxhash64("row", "start"), F.lit(groups))).groupBy("_group").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
    full = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = stash(cut_windows(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")), "windows")
    return pack_windows(pieces).drop("row")
