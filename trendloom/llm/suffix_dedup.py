"""Operator 2: removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of `threshold` (100) bytes that covers it also starts earlier: in a document with a smaller
doc_id, or earlier in the same one. Strings are judged on the input and never cross documents.

Prefix doubling gives every position a rank for its first 2^k bytes from the pair of ranks at p and p + 2^(k-1). Here
ranks are content names (64-bit), so the doublings 1, 2, 4 ... 64 need no exchange: each task computes them for its
own text, and equal strings have equal names everywhere. Spark sorts (name, position) pairs at two offsets:

* At 32 bytes, for sampled positions only. Each string of 100 bytes has one anchor, the position in it whose 32-byte
  name is smallest. A row stands for an anchor and all strings it is the anchor of (its run); the sort finds anchors
  whose name is unique, and their strings are done. Within a name, runs with the same whole content are sorted on: all
  but the first of them repeat. Only first runs that share the anchor with different content go on.
* At 100 bytes, from the pair of 64-byte names at p and p + 36, for every string of those runs.

A task first settles what repeats within its own batch, so a passage that a third of all documents hold sends one row
from each batch, not from each document, and joins settled runs that touch, so a very long text that repeats itself is
a few intervals. Rows that need only to be kept apart get a key of their own. What is gathered for a document are
intervals of it, fewer than its bytes.

Defined cases: null text counts as empty; texts shorter than the threshold keep everything; very long texts are named in
overlapping chunks of `CHUNK` bytes; rows that repeat a doc_id
with the same text count as one document and get the same result; rows with one doc_id and different texts are
ordered by a hash of the text; a null doc_id sorts first; an empty table gives no rows; extra columns are ignored.
Names are 64 bits, compared together with a second name of 64 bits within an anchor and 24 bits at the last sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import give_back, shuffle_partitions, stash
from trendloom.llm.encode import slices

ANCHOR = 32
NO_ID = -(1 << 63)
CHUNK = 1 << 20
#: A word is a place and, in its low bits, how many strings more follow it (or, while strings are compared, a check).
LEN_BITS = CHECK_BITS = 24
MOST = (1 << LEN_BITS) - 1
SLICE = 48 << 20
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def _double(names: np.ndarray, offset: int) -> np.ndarray:
    """Names of p for the bytes of both halves, from the names at p and at p + offset."""
    h = names[: len(names) - offset] * M1
    h += names[offset:]
    h *= M2
    h ^= h >> np.uint64(29)
    return h


def name_levels(data: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the first 32 bytes, and of the first `threshold` bytes, of every position that has so many."""
    h = (data.astype(np.uint64) + np.uint64(1)) * M2
    h ^= h >> np.uint64(31)
    size, anchor = 1, h
    while size * 2 <= threshold:
        h = _double(h, size)
        size *= 2
        if size == ANCHOR:
            anchor = h
    if size < threshold:
        h = _double(h, threshold - size)
    return anchor, h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if width > size:
        values = np.minimum(values[: size - width], values[width - size :])
    return values


def _merged(doc: np.ndarray, start: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of string starts joined where they touch: documents and words, so a text that repeats itself all along is a
    few rows whatever its length."""
    order = np.lexsort((start, doc))
    doc, start, last = doc[order], start[order], start[order] + span[order]
    if len(doc):
        shift = doc.astype(np.int64) * (int(last.max()) + 2)  # documents apart on one line
        reach = np.maximum.accumulate(last + shift)
        head = np.flatnonzero(np.r_[True, (start[1:] + shift[1:] > reach[:-1] + 1) | (doc[1:] != doc[:-1])])
        tail = np.r_[head[1:], len(doc)] - 1
        doc, start, last = doc[head], start[head], reach[tail] - shift[tail]
    pieces = (last - start) // (MOST + 1) + 1
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    doc, start, last = (np.repeat(x, pieces) for x in (doc, start, last))
    start = start + nth * (MOST + 1)
    return doc, (start << LEN_BITS) | np.minimum(last - start, MOST)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _text_parts(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, threshold: int):
    """Chunks of concatenated texts: bytes, and for each string start its document's row and start; long texts overlap."""
    size = np.diff(offsets)
    row, n = 0, len(size)
    while row < n:
        if size[row] > CHUNK:
            for at in range(0, int(size[row]) - threshold + 1, CHUNK):
                end = min(int(size[row]), at + CHUNK + threshold - 1)
                yield data[offsets[row] + at : offsets[row] + end], np.full(end - at - threshold + 1, row), np.arange(at, end - threshold + 1), np.arange(end - at - threshold + 1)
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        lens = np.maximum(size[row:last] - threshold + 1, 0)
        doc = np.repeat(np.arange(row, last), lens)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(lens) - lens, lens)
        if len(doc):
            yield data[offsets[row] : offsets[last]], doc, start, start + (offsets[doc] - offsets[row])
        row = last


def _bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = pc.fill_null(text.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(text):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    raw = text.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[text.offset : text.offset + len(text) + 1]
    return offsets, np.frombuffer(raw[2], np.uint8) if raw[2] else np.empty(0, np.uint8)


def _anchor_rows(threshold: int):
    """Map stage of the first sort: (key, name, content, d, tag, word, settled); word is start and run length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in slices(b.column(2), SLICE)):
            d, tag = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            offsets, data = _bytes_of(batch.column(2))
            got = []
            for part, doc, start, at in _text_parts(d, offsets, data, threshold):
                anchor, full = name_levels(part, threshold)
                low = _least(anchor, threshold - ANCHOR + 1)[at]
                # A run ends where the least name changes or its leftmost place is left behind (periodic texts).
                behind = anchor[at] == low
                first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | behind[:-1]])
                last = np.r_[first[1:], len(low)] - 1
                content = full[at[first]] * M1 + full[at[last]] * M2 + (last - first).astype(np.uint64)
                content ^= content >> np.uint64(32)
                got.append((low[first], content, doc[first], start[first], last - first))
            if not got:
                continue
            name, content, doc, start, span = (np.concatenate(x) for x in zip(*got))
            dd, tt, word = d[doc], tag[doc], (start << LEN_BITS) | span
            # What repeats within the batch is settled here.
            order = np.lexsort((word, tt, dd, content, name))
            name, content, dd, tt, word = name[order], content[order], dd[order], tt[order], word[order]
            same_name = np.r_[False, name[1:] == name[:-1]]
            again = same_name & np.r_[False, content[1:] == content[:-1]]
            fresh = ~again
            # One row for each name and content; all but the first of a name only need to meet equal contents.
            head = np.flatnonzero(~same_name)
            n_contents = np.add.reduceat(fresh, head)
            many = np.repeat(n_contents > 1, np.diff(np.r_[head, len(name)]))
            key = name.copy()
            apart = fresh & same_name
            key[apart] = content[apart] * M2 ^ name[apart]
            # 0: alone with its name here, 1: its name has other contents here, 2: repeats an earlier run for certain
            settled = np.where(many, 1, 0).astype(np.int32)
            at, gone = _merged(doc[order][again], start[order][again], span[order][again])
            lone = np.arange(len(at), dtype=np.uint64) * M2 + d[at].view(np.uint64) * M1
            zero = np.zeros(len(at), np.uint64)
            key, name, content, dd, tt, word, settled = (np.r_[a[fresh], b] for a, b in zip((key, name, content, dd, tt, word, settled), (lone, zero, zero, d[at], tag[at], gone, np.full(len(at), 2, np.int32))))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array(_signed(name)), pa.array(_signed(content)), pa.array(dd), pa.array(tt), pa.array(word), pa.array(settled)], ["key", "name", "content", "d", "tag", "word", "settled"])
        give_back()

    return run


def _string_rows(threshold: int):
    """Map stage of the last sort: every string of the open runs, as (key, d, tag, word, settled); word is start and check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in slices(b.column(2), SLICE)):
            d, tag, runs = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            offsets, data = _bytes_of(batch.column(2))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            packed = np.asarray(runs.flatten())
            at = offsets[np.repeat(np.arange(len(batch)), np.diff(np.asarray(runs.offsets)))] + (packed >> LEN_BITS)
            mark = np.zeros(len(data) + 1, np.int8)  # runs of a document do not overlap
            np.add.at(mark, at, 1)
            np.add.at(mark, at + (packed & MOST) + 1, -1)
            wanted = np.cumsum(mark, dtype=np.int8)[:-1] > 0
            got = []
            for part, doc, start, at in _text_parts(d, offsets, data, threshold):
                keep = np.flatnonzero(wanted[offsets[doc] + start])
                if len(keep):
                    anchor, full = name_levels(part, threshold)
                    a = at[keep]
                    check = anchor[a] ^ anchor[a + threshold - ANCHOR] * M1
                    got.append((full[a], (check >> np.uint64(64 - CHECK_BITS)).astype(np.int64), doc[keep], start[keep]))
            if not got:
                continue
            name, check, doc, start = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((start, tag[doc], d[doc], check, name))
            name, check, doc, start = name[order], check[order], doc[order], start[order]
            again = np.r_[False, (name[1:] == name[:-1]) & (check[1:] == check[:-1])]
            at, gone = _merged(doc[again], start[again], np.zeros(int(again.sum()), np.int64))
            lone = np.arange(len(at), dtype=np.uint64) * M2 + d[at].view(np.uint64) * M1
            name, doc = np.r_[name[~again], lone], np.r_[doc[~again], at]
            word, settled = np.r_[((start << CHECK_BITS) | check)[~again], gone], np.arange(len(doc)) >= len(doc) - len(at)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(name)), pa.array(d[doc]), pa.array(tag[doc]), pa.array(word), pa.array(settled)], ["key", "d", "tag", "word", "settled"])
        give_back()

    return run


def _removed(threshold: int, with_text: bool):
    """Last map stage: spans of each text to lengths, counts and the hash of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in slices(b.column(1), SLICE)):
            offsets, data = _bytes_of(batch.column(1))
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            lists = [(np.asarray(c.offsets), np.asarray(c.values), np.asarray(c.is_valid())) for c in (batch.column(2), batch.column(3))]
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]]
                words = np.concatenate([v[o[i] : o[i + 1]] if ok[i] else v[:0] for o, v, ok in lists])
                spans = 0
                if len(words):
                    lo = words >> LEN_BITS
                    hi = lo + (words & MOST) + threshold
                    mark = np.zeros(len(text) + 1, np.int32)
                    np.add.at(mark, lo, 1)
                    np.add.at(mark, hi, -1)
                    gone = np.cumsum(mark)[:-1] > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    left = text[~gone]
                else:
                    left = text
                raw = left.tobytes()
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(left))
                out["n_spans"].append(spans)
                out["kept_sha256"].append(hashlib.sha256(raw).hexdigest())
                if with_text:
                    out["kept"].append(raw if len(left) == len(text) else raw.decode("utf-8", "ignore").encode())
            cols = [batch.column(0), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(out["kept"], pa.binary()).view(pa.string()))
                names.append("kept")
            extra = [c for c in batch.schema.names if c.startswith("c_")]
            yield pa.RecordBatch.from_arrays([*cols, *(batch.column(n) for n in extra)], [*names, *extra])
        give_back()

    return run


def remove_repeats(docs: DataFrame, threshold: int = 100, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, with `kept` (the text left, without characters
    cut in half) if with_text, and the columns in `carry` as they are. threshold: 2 * 32 to 128 bytes."""
    if not 2 * ANCHOR <= threshold < 160:
        raise ValueError("threshold must be from 64 to 159")
    n = shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # Only where a doc_id has several texts do positions need more than the doc_id to name their document.
    hashed = F.xxhash64(text)
    by_id = docs.groupBy(d.alias("d")).agg(F.min(hashed).alias("a"), F.max(hashed).alias("b"), F.count("*").alias("n"))
    several, repeated = by_id.agg(F.max(F.col("a") != F.col("b")), F.max(F.col("n") > 1)).first()
    rows = docs.select(d.alias("d"), (hashed if several else F.lit(0).cast("long")).alias("tag"), text.alias("text"), F.col("doc_id").cast("long").alias("id"), *(F.col(c).alias(f"c_{c}") for c in carry))

    # Sort at 32 bytes.
    once = rows.dropDuplicates(["d", "tag"]) if repeated else rows
    anchors = once.select("d", "tag", "text").mapInArrow(_anchor_rows(threshold), "key long, name long, content long, d long, tag long, word long, settled int")
    dealt = anchors.repartition(n, "key")
    by_content = Window.partitionBy("key", "name", "content").orderBy("d", "tag", "word")
    by_name = Window.partitionBy("key")
    ranked = dealt.withColumn("rank", F.row_number().over(by_content)).withColumn("lo", F.min("content").over(by_name)).withColumn("hi", F.max("content").over(by_name)).withColumn("several", F.max(F.col("settled") == 1).over(by_name))
    repeats = (F.col("settled") == 2) | (F.col("rank") > 1)
    # A batch that saw several contents kept only the least of them under the name: one such row opens the name.
    goes_on = ~repeats & (F.col("several") | (F.col("lo") != F.col("hi")))
    live = ranked.filter(repeats | goes_on).select("d", "tag", "word", repeats.alias("repeats"))
    runs = stash(live.groupBy("d", "tag").agg(F.collect_set(F.when(~F.col("repeats"), F.col("word"))).alias("open"), F.collect_set(F.when(F.col("repeats"), F.col("word"))).alias("runs")), "runs")

    # Sort at the threshold, of the strings of open runs. Both joins read one exchange of the texts.
    keys = ["d", "tag"] if several else ["d"]  # a constant key would make the joins deal the texts anew
    placed = rows.repartition(n, *keys)
    used = ["id", *(f"c_{c}" for c in carry)]
    open_ = runs.filter(F.size("open") > 0).select(*keys, "open")
    compared = once.repartition(n, *keys) if repeated else placed
    strings = compared.join(open_.hint("shuffle_hash"), keys).select("d", "tag", "text", "open", *used).mapInArrow(_string_rows(threshold), "key long, d long, tag long, word long, settled boolean")
    order = Window.partitionBy("key", "check").orderBy("d", "tag", "word")
    checked = strings.repartition(n, "key").withColumn("check", F.col("word").bitwiseAND((1 << CHECK_BITS) - 1))
    later = checked.withColumn("rank", F.row_number().over(order)).filter(F.col("settled") | (F.col("rank") > 1))
    place = F.when(F.col("settled"), F.col("word")).otherwise(F.shiftleft(F.shiftright("word", CHECK_BITS), CHECK_BITS))
    starts = later.groupBy("d", "tag").agg(F.collect_set(place).alias("starts"))
    found = runs.filter(F.size("runs") > 0).select("d", "tag", "runs").join(starts, ["d", "tag"], "full")
    out = placed.join(found.select(*keys, "runs", "starts").hint("shuffle_hash"), keys, "left").select("id", "text", "runs", "starts", *used[1:])
    kinds = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text + "".join(f", `c_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    done = out.mapInArrow(_removed(threshold, with_text), kinds)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    return done.select(F.col("id").alias("doc_id"), *names, *(F.col(f"c_{c}").alias(c) for c in carry))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
