"""Operator 10: vector best-fit packing of token sequences.

Every document (its ids, then an end id) is cut only if it is longer than a sequence; the remainder goes first and
full pieces follow. Full pieces are sequences of their own. All other pieces are dealt by hash to groups of about
`group_pieces` (a group per key range of the hash, so no key or source can fill one), and each group is packed by
vector best-fit decreasing: a bin has three residuals (tokens, documents, attention cost = sum of squared lengths); a
piece may enter a bin only if it fits every one of them, and goes to the feasible bin with the best score, either the
largest weighted dot product of need and residual ("dot") or the smallest weighted norm of what would remain
("norm"). A group wastes at most about half a sequence, whatever its size.

Defined cases: null and empty texts are one piece of the end id; a very long text is encoded whole, its full pieces are
sequences of their own; repeated rows are packed each for itself; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import stash
from trendloom.llm.encode import SLICE_BYTES, encoder, end_of_task, slices

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def encode_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, row (a number for each input row), piece, start, length, ids_crc32 and, if asked for, ids (array<int>).
    About slice_bytes of text are encoded at a time."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for a, b in slices(batch.column(1), slice_bytes):
                flat, n = enc.encode(batch.column(1).slice(a, b - a))
                ids = np.full(len(flat) + len(n), end_id, "<u4")
                keep = np.ones(len(ids), bool)
                keep[np.cumsum(n + 1) - 1] = False
                ids[keep] = flat
                total = n + 1
                pieces = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (total - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = (np.cumsum(total) - total)[doc] + start
                crc = [zlib.crc32(ids[i : i + k]) for i, k in zip(at, length)]
                take = pa.array(doc + a)
                cols = [batch.column(0).take(take), batch.column(2).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[i : i + k].astype(np.int32) for i, k in zip(at, length)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        end_of_task()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(length: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.2), rule: str = "norm") -> np.ndarray:
    """The bin of each piece, pieces taken as they come (longest first for best-fit decreasing)."""
    need = np.stack([length, np.ones(len(length)), length.astype(float) ** 2], 1) / np.array(capacity, float)
    if (need > 1).any():
        raise ValueError("a piece needs more than a whole sequence")
    w = np.array(weights, float)
    left = np.ones((min(len(length), 1024), 3))
    bins, out = 0, np.empty(len(length), np.int64)
    # Bins too full for the shortest piece still to come are closed: the open ones stay few.
    shortest = np.minimum.accumulate(length[::-1])[::-1] / capacity[0] if len(length) else length
    open_ = np.empty(0, np.int64)
    for i, x in enumerate(need):
        if not i % 256:
            open_ = open_[left[open_, 0] + 1e-12 >= shortest[i]]
        rest = left[open_] - x
        ok = (rest >= -1e-12).all(1)
        if ok.any():
            score = -(w * rest**2).sum(1) if rule == "norm" else (w * x * left[open_]).sum(1)
            at = open_[np.argmax(np.where(ok, score, -np.inf))]
        else:
            if bins == len(left):
                left = np.concatenate([left, np.ones_like(left)])
            at, bins = bins, bins + 1
            open_ = np.append(open_, at)
        left[at] -= x
        out[i] = at
    return out


def pack(pieces: DataFrame, capacity: int = 1024, max_docs: int | None = None, max_cost: float | None = None, rule: str = "norm", group_pieces: int = 8000) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (as `encode_pieces` makes it); other columns stay.

    Without max_docs and max_cost both have the values that a full sequence can reach, so only tokens bind.
    """
    limits = (float(capacity), float(max_docs or capacity), float(max_cost or capacity**2))
    alone = (F.col("length") >= capacity) if max_cost is None else F.lit(False)
    part = pieces.filter(~alone)
    groups = max(1, -(-part.count() // group_pieces))
    keys = [c for c in ("doc_id", "row", "piece") if c in pieces.columns]
    group = "_".join(["group", *pieces.columns])  # no column has this name

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *keys], ascending=[False, *[True] * len(keys)], kind="stable").reset_index(drop=True)
        n = pdf["length"].to_numpy(np.int64)
        where = best_fit(n, limits, rule=rule)
        order = np.argsort(where, kind="stable")
        before = np.cumsum(n[order]) - n[order]
        first = np.r_[True, np.diff(where[order]) > 0]
        offset = np.empty(len(n), np.int64)
        offset[order] = before - before[np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))]
        # group numbers are even, sequences of full pieces are odd
        return pdf.assign(sequence_id=(where * groups + pdf[group].to_numpy(np.int64)) * 2, offset=offset).drop(columns=group)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    packed = part.withColumn(group, F.pmod(F.xxhash64(*keys), F.lit(groups))).groupBy(group).applyInPandas(place, kinds)
    full = pieces.filter(alone).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = stash(encode_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    return pack(pieces).drop("row")
