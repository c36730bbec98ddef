"""Operator 1: token-id shards with a minimal perfect hash index.

Documents are range-partitioned by doc_id; each partition becomes one shard, sorted by doc_id:

``shard-NNNNN.bin``  the ids of its documents, one after the other, raw little-endian uint16 (vocabularies of up to
                     65,536 ids) or uint32
``shard-NNNNN.idx``  keys in document order, their id counts, the bit levels of a minimal perfect hash over the
                     distinct keys, and for each hash slot a 32-bit fingerprint and the first record of the key

A manifest (a written table, one small row per shard) has every shard's key range and the number of ids before it, so a
key is found with one binary search over shards, one hash probe and one seek. The fingerprint turns foreign keys away
without a look at the keys. The hash is built level by level: keys that fall alone on a bit of a level stay there, the
others go on to the next; the slot is the rank of the key's bit.

Shards hold `SHARD_BYTES` of text, larger ones where there would be over `MOST_SHARDS` of them, so what the driver samples
and counts stays small. Files are written and read back in pieces: memory does not grow with a shard.

Defined cases: null text has only the end id; very long texts are encoded whole; a repeated doc_id keeps all its rows, in the order of a hash of their texts, and
the index leads to the first of them; rows with a null doc_id come first and have no key; an empty table has no shard.
Extra columns of the input are ignored.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import new_dir, stash
from trendloom.llm.encode import encoder, end_of_task, slices

GAMMA = 2.0
MAGIC = b"TLMPH001"
#: Text bytes aimed at for a shard, and the most shards of a store.
SHARD_BYTES, MOST_SHARDS = 24 << 20, 50_000
#: Bytes of ids read at once.
PIECE = 32 << 20


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over integer keys."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class PerfectHash:
    """Minimal perfect hash of distinct int64 keys: bit levels and the rank at which each begins."""

    levels: list[np.ndarray]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys)
        while len(left):
            size = max(64, int(len(left) * GAMMA))
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            left = left[hits[at] > 1]
        return cls(levels)

    def __post_init__(self):
        ranks = [np.cumsum(x) for x in self.levels]
        base = np.cumsum([0, *(int(r[-1]) for r in ranks)])
        self._ranks = [r - 1 + b for r, b in zip(ranks, base)]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit. Foreign keys may get a slot: check the fingerprint."""
        out = np.full(len(keys), -1, np.int64)
        for k, bits in enumerate(self.levels):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            at = (mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self._ranks[k][at[hit]]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0xF1) >> np.uint64(32)).astype(np.uint32)


@dataclass
class ShardIndex:
    keys: np.ndarray
    has_key: np.ndarray
    sizes: np.ndarray
    hash: PerfectHash
    prints: np.ndarray
    records: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, has_key: np.ndarray, sizes: np.ndarray) -> ShardIndex:
        at = np.flatnonzero(has_key)
        distinct, first = np.unique(keys[at], return_index=True)
        ph = PerfectHash.build(distinct)
        slot = ph.slots(distinct)
        prints, records = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64)
        prints[slot], records[slot] = fingerprints(distinct), at[first]
        return cls(keys, has_key, sizes, ph, prints, records)

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes

    def dump(self) -> bytes:
        out = io.BytesIO()
        parts = {"keys": self.keys, "has_key": np.packbits(self.has_key), "sizes": self.sizes, "prints": self.prints, "records": self.records} | {f"level{i}": np.packbits(x) for i, x in enumerate(self.hash.levels)}
        head = {"n": len(self.keys), "levels": [len(x) for x in self.hash.levels], "parts": [[k, str(v.dtype), len(v)] for k, v in parts.items()]}
        text = json.dumps(head).encode()
        out.write(MAGIC + len(text).to_bytes(8, "little") + text)
        for v in parts.values():
            out.write(np.ascontiguousarray(v).astype(v.dtype.newbyteorder("<")).tobytes())
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> ShardIndex:
        assert raw[:8] == MAGIC, "not an index file"
        n = int.from_bytes(raw[8:16], "little")
        head, at, got = json.loads(raw[16 : 16 + n]), 16 + n, {}
        for name, dtype, length in head["parts"]:
            kind = np.dtype(dtype)
            got[name] = np.frombuffer(raw, kind, length, at)
            at += kind.itemsize * length
        levels = [np.unpackbits(got[f"level{i}"], count=size).astype(bool) for i, size in enumerate(head["levels"])]
        return cls(got["keys"], np.unpackbits(got["has_key"], count=head["n"]).astype(bool), got["sizes"], PerfectHash(levels), got["prints"], got["records"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key; -1 where the index has no such key."""
        out = np.full(len(keys), -1, np.int64)
        slot = self.hash.slots(keys)
        ok = np.flatnonzero(slot >= 0)
        good = ok[self.prints[slot[ok]] == fingerprints(keys[ok])]
        rec = self.records[slot[good]]
        same = self.keys[rec] == keys[good]
        out[good[same]] = rec[same]
        return out


def _write_file(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/{name}") as out:
        for c in chunks:
            out.write(c)


def _read_file(folder: str, name: str) -> bytes:
    where, base = fs.FileSystem.from_uri(folder)
    with where.open_input_stream(f"{base}/{name}") as f:
        return f.read()


def write_token_index(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode docs(doc_id, text), write the shards, return their folder and the manifest.

    Files carry the task attempt in their name, and the manifest, written by the same job, names those of the attempts
    that counted, so a retried task leaves no mixed shard. The driver sees none of it.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // max(shard_bytes, -(-total // MOST_SHARDS))))
    # Range bounds are sampled to the driver, so they are made of numbers only.
    ordered = rows.repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc = encoder(tokenizer_path)
        width = np.dtype("<u2") if max(enc.vocab_size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        keys, sizes, has = [], [], []

        def chunks():
            for batch in batches:
                ids, text = batch.column(0), batch.column(1)
                has.append(np.asarray(ids.is_valid()))
                keys.append(np.asarray(ids.fill_null(0)).astype(np.int64))
                for a, b in slices(text):
                    flat, n = enc.encode(text.slice(a, b - a))
                    out = np.full(len(flat) + len(n), end_id, width)
                    ends = np.cumsum(n + 1) - 1
                    keep = np.ones(len(out), bool)
                    keep[ends] = False
                    out[keep] = flat
                    sizes.append(n + 1)
                    yield out.tobytes()

        name = f"shard-{task.partitionId():05d}-{task.taskAttemptId()}"
        _write_file(folder, f"{name}.bin", chunks())
        end_of_task()
        if sizes:
            index = ShardIndex.build(np.concatenate(keys), np.concatenate(has), np.concatenate(sizes))
            _write_file(folder, f"{name}.idx", iter([index.dump()]))
            known = index.keys[index.has_key]
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "name": [name], "width": [width.itemsize], "n_docs": [len(index.keys)], "n_tokens": [int(index.sizes.sum())], "first_key": pa.array([int(known[0]) if len(known) else None], pa.int64()), "last_key": pa.array([int(known[-1]) if len(known) else None], pa.int64())})

    manifest = stash(ordered.mapInArrow(write, "shard long, name string, width long, n_docs long, n_tokens long, first_key long, last_key long"), "manifest")
    before = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # of one row per shard
    return folder, manifest.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of records with about so many ids together; a long one may stand alone."""
    part = (np.cumsum(sizes) - sizes) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(sizes)]
    return ((int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:]) if a < b)


def read_documents(folder: str, manifest: DataFrame) -> DataFrame:
    """Read the shards back, a task for each: doc_id, start, n_tokens, ids_crc32, each found by its key in the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                index = ShardIndex.load(_read_file(folder, f"{m['name']}.idx"))
                found = index.find(index.keys)
                again = np.r_[False, (index.keys[1:] == index.keys[:-1]) & index.has_key[1:] & index.has_key[:-1]]
                rec = np.where(index.has_key & ~again, found, np.arange(len(index.keys)))
                start, size = index.starts[rec], index.sizes[rec]
                crc: list[int] = []
                where, base = fs.FileSystem.from_uri(folder)
                with where.open_input_file(f"{base}/{m['name']}.bin") as f:
                    for a, b in _pieces(size, PIECE // m["width"]):
                        f.seek(int(start[a]) * m["width"])
                        ids = np.frombuffer(f.read(int(size[a:b].sum()) * m["width"]), f"<u{m['width']}")
                        at = start[a:b] - start[a]
                        crc += [zlib.crc32(ids[x : x + n].astype("<u4").tobytes()) for x, n in zip(at, size[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(index.keys, pa.int64(), mask=~index.has_key), pa.array(m["start"] + start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(rec), m["shard"]), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    spark = manifest.sparkSession
    shards = manifest.count()
    spread = manifest.repartition(max(1, shards), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


class TokenStore:
    """Keyed reads on a written folder, for one process: binary search over shards, hash probe, one ranged read. The index
    of a shard is loaded when it is first asked for and kept."""

    def __init__(self, folder: str, manifest: DataFrame):
        self.folder, self.shards = folder, manifest.filter("first_key is not null").orderBy("shard").collect()
        self._last = np.array([m["last_key"] for m in self.shards], np.int64)
        self._index: dict[str, ShardIndex] = {}

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, or None."""
        for at in range(int(np.searchsorted(self._last, key)), len(self.shards)):
            m = self.shards[at]
            if key < m["first_key"]:
                return None
            if m["name"] not in self._index:
                self._index[m["name"]] = ShardIndex.load(_read_file(self.folder, f"{m['name']}.idx"))
            index = self._index[m["name"]]
            rec = int(index.find(np.array([key], np.int64))[0])
            if rec >= 0:
                where, base = fs.FileSystem.from_uri(self.folder)
                with where.open_input_file(f"{base}/{m['name']}.bin") as f:
                    f.seek(int(index.starts[rec]) * m["width"])
                    return np.frombuffer(f.read(int(index.sizes[rec]) * m["width"]), f"<u{m['width']}").astype(np.uint32)
        return None


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(*write_token_index(docs, public_tokenizers.path("byte_bpe_50k.json")))
