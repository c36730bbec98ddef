"""Operator 12: phrases of two to five words that keep together, counted by word-id suffix arrays.

Texts are cut into pieces at marks and line ends and into words. A task joins the texts that it scans into shards of
about `shard_words` words; a shard numbers its words, sorts its suffixes by prefix doubling (1, 2, 4, 8 words: no phrase is
longer) and reads the n-gram counts off the intervals of common prefixes. Counts of all shards are summed by (lang,
phrase) in Spark: every occurrence counts, however few a shard has.

A phrase can only be frequent if its parts are, so there are three passes. Words and pairs are counted by 64-bit keys alone
(rows of key and count), then, the same way, triples both of whose pairs pass; what reaches the least count goes to the next
pass as a bit filter of fixed size (`FILTER_BITS`). The last pass counts the words and pairs that pass, and the longer
phrases in stretches of triples that pass, by their strings, and adds them up within the task. Keys and bits that fall together only let too much pass, which costs work,
not correctness: the strings' own sums decide. Frequent phrases are a table in the shared folder.

Scores are integers of up to 38 digits (Spark decimals). The first phrases of a language are taken within hash buckets
first, so that no task sorts all phrases of a language.

Defined cases: null, empty and blank texts have no words; a null lang is "und", together with rows that say so; a very long
text is a shard of its own; repeated rows and null doc_ids count like others; an empty table gives no rows; extra columns
are left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import documents, give_back, stash
from trendloom.llm.encode import slices

LEAST, LONGEST, FIRST, COVER = 100, 5, 2000, 100
SHARD_WORDS, SLICE_BYTES = 500_000, 2 << 20
FILTER_BITS = 24
TASK_ROWS = 1_000_000
MARKS = b".,;:!?\x0a\x0b\x0c\x0d"
KEYS, PHRASES = "key long, count long", "lang string, phrase string, count long"
_ODD = np.uint64(0x9E3779B97F4A7C15)

_END, _SPACE = pa.scalar("\n", pa.large_string()), pa.scalar(" ", pa.large_string())
_lower = bytes.maketrans(bytes(range(65, 91)) + MARKS + b"\t", bytes(range(97, 123)) + b"\n" * len(MARKS) + b" ")


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words and piece ends ("\\n") of all texts, one after the other, with empty strings between; how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = pa.concat_arrays([texts]).buffers()
    plain = pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_lower)))
    ended = pc.binary_join_element_wise(pc.replace_substring(plain, "\n", " \n "), _END, _SPACE)
    lists = pc.split_pattern(ended, " ")
    return lists.flatten(), np.diff(np.asarray(lists.offsets))


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of what follows them, as far as `depth` numbers: prefix doubling."""
    rank, k, order = t.astype(np.int64), 1, None
    while k < depth:
        ahead = np.zeros_like(rank)
        ahead[:-k] = rank[k:]
        pair = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(pair, kind="stable")
        new = np.r_[1, (np.diff(pair[order]) != 0).astype(np.int64)].cumsum()
        rank[order] = new
        if new[-1] == len(t):
            break
        k *= 2
    return np.argsort(rank, kind="stable") if order is None else order


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words each suffix shares with the one before it, up to `depth` and to the end (0) of its piece."""
    wide = np.r_[t, np.zeros(depth, t.dtype)]
    out, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for d in range(depth):
        x = wide[order[1:] + d]
        same &= (x == wide[order[:-1] + d]) & (x != 0)
        out[1:] += same
    return out


def intervals(t: np.ndarray, order: np.ndarray, common: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different phrase of `size` words and how often it occurs."""
    heads = np.flatnonzero(common < size)
    counts = np.diff(np.r_[heads, len(order)])
    wide = np.r_[t, np.zeros(size, t.dtype)]
    place = order[heads]
    whole = np.logical_and.reduce([wide[place + d] != 0 for d in range(size)])
    return place[whole], counts[whole]


def _chains(t: np.ndarray, joined: np.ndarray, least: int) -> np.ndarray:
    """The places of t in chains of at least `least` words; joined[i]: word i and the next stay together."""
    chain = np.r_[0, np.cumsum(~joined[:-1])] if len(t) else np.empty(0, np.int64)
    return (np.bincount(chain)[chain] >= least) & (t != 0) if len(t) else np.empty(0, bool)


def _ended(t: np.ndarray, keep: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """What is kept of t, with a 0 after every chain."""
    out = np.zeros(2 * len(t), t.dtype)
    out[::2] = t
    return out[np.stack([keep, keep & ~joined], 1).ravel()]


class Shard:
    """The words of some texts as numbers, and the keys of their phrases."""

    def __init__(self, words: list[pa.Array], langs: list[pa.Array]):
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        self.words, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        lang = pa.chunked_array(langs).combine_chunks().dictionary_encode()
        self.langs, of = lang.dictionary, np.asarray(lang.indices).astype(np.int64)
        names = self.words.to_pylist()
        empty, end = (names.index(x) if x in names else -1 for x in ("", "\n"))
        some = code != empty
        code, of = code[some], of[some]
        both = np.where(code == end, -1, of * len(names) + code)
        values, t = np.unique(both, return_inverse=True)
        self.t = t.astype(np.int64) + (0 if len(values) and values[0] == -1 else 1)
        self.values = np.r_[-1, values[values >= 0]]  # number 0: the end of a piece
        self.lang_of, self.word_of = self.values // len(names), self.values % len(names)
        hashes = np.array([xxhash.xxh64_intdigest(x) for x in names] or [0], np.uint64)
        seeds = np.array([xxhash.xxh64_intdigest(x, 1) for x in self.langs.to_pylist()] or [0], np.uint64)
        self.hash, self.seed = hashes[self.word_of], seeds[self.lang_of]

    def keys(self, t: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """64-bit keys of the phrases at these places, of lang and words."""
        key = self.seed[t[place]].copy()
        for d in range(size):
            key = (key ^ self.hash[t[place + d]]) * _ODD
            key ^= key >> np.uint64(32)
        return key

    def rows(self, t: np.ndarray, size: int, place: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        parts = [self.words.take(pa.array(self.word_of[t[place + d]])) for d in range(size)]
        phrase = pc.binary_join_element_wise(*parts, _SPACE) if size > 1 else parts[0]
        return _phrase_rows(self.langs.take(pa.array(self.lang_of[t[place]])), phrase, count)

    def totals(self) -> pa.RecordBatch:
        """All words of each lang, as the phrase of no words."""
        count = np.bincount(self.lang_of[self.t[self.t != 0]], minlength=len(self.langs))
        return _phrase_rows(self.langs, pa.array([""] * len(count), pa.large_string()), count)


def _phrase_rows(lang: pa.Array, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(count.astype(np.int64))], ["lang", "phrase", "count"])


def _passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key >> np.uint64(65 - (64 * len(bits)).bit_length())
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _passing(shard: Shard, t: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """For each place of t whether the `size` words from there on are in one piece and pass the filter."""
    wide = np.r_[t, np.zeros(size, t.dtype)]
    whole = np.flatnonzero(np.logical_and.reduce([wide[np.arange(len(t)) + d] != 0 for d in range(size)]))
    ok = np.zeros(len(t), bool)
    ok[whole] = _passes(bits, shard.keys(t, whole, size))
    return ok


def _counted(t: np.ndarray, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, places and counts of the different phrases of t."""
    if len(t):
        order = suffix_array(t, sizes[-1])
        common = common_prefixes(t, order, sizes[-1])
        for size in sizes:
            place, count = intervals(t, order, common, size)
            if len(place):
                yield size, place, count


def _keyed(shard: Shard, filters: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Keys and counts of all words and pairs or, with a filter of them, of triples whose pairs pass it."""
    t, sizes = shard.t, range(1, 3)
    if filters:
        joined = _passing(shard, t, filters[0], 2)
        t, sizes = _ended(t, _chains(t, joined, 3), joined), range(3, 4)
    for size, place, count in _counted(t, sizes):
        yield pa.RecordBatch.from_arrays([pa.array(shard.keys(t, place, size).view(np.int64)), pa.array(count.astype(np.int64))], ["key", "count"])


def _phrased(shard: Shard, filters: list[np.ndarray], longest: int) -> Iterator[pa.RecordBatch]:
    """Totals, words and pairs that pass, and longer phrases whose triples pass, with their strings and counts."""
    yield shard.totals()
    for size in range(1, min(longest, 3) + 1):
        ok = _passing(shard, shard.t, filters[size == 3], size)
        joined = np.zeros(len(ok), bool)
        for d in range(size - 1):  # the words of a phrase that passes stay together
            joined[d:] |= ok[: len(ok) - d]
        t = shard.t[ok] if size == 1 else _ended(shard.t, _chains(shard.t, joined, size), joined)
        for n, place, count in _counted(t, range(size, (longest if size == 3 else size) + 1)):
            yield shard.rows(t, n, place, count)


def summed(batches: Iterator[pa.RecordBatch], most: int = TASK_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of a task's shards with the counts of equal phrases added up; at most about `most` rows are held."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > most:
            held = _added(held)
            rows = sum(b.num_rows for b in held)
            if rows > most // 2:
                yield from held
                held, rows = [], 0
    if held:
        yield from _added(held)


def _added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    keys = [c for c in held[0].schema.names if c != "count"]
    table = pa.Table.from_batches(held).group_by(keys).aggregate([("count", "sum")])
    return table.rename_columns([*keys, "count"]).combine_chunks().to_batches()


def mined(docs: DataFrame, each: Callable[[Shard], Iterator[pa.RecordBatch]], kinds: str, shard_words: int = SHARD_WORDS, add_up: bool = False) -> DataFrame:
    """What `each` says of every shard of the documents; with add_up the counts of equal rows of a task are added up."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Array] = []
        langs: list[pa.Array] = []
        held = 0
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                flat, n = _tokens(batch.column(1).slice(a, b - a))
                words.append(flat)
                langs.append(batch.column(0).slice(a, b - a).cast(pa.large_string()).take(pa.array(np.repeat(np.arange(b - a), n))))
                held += len(flat)
                if held >= shard_words:
                    yield from each(Shard(words, langs))
                    words, langs, held = [], [], 0
        if words:
            yield from each(Shard(words, langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from summed(mine(batches)) if add_up else mine(batches)
        give_back()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, kinds)


def bit_filter(keyed: DataFrame, least: int, filter_bits: int = FILTER_BITS) -> bytes:
    """2**filter_bits bits (at least 64), set where a key falls whose counts sum up to `least`. Words of 64 bits are made in
    Spark; the driver gets at most 2**filter_bits / 64 of them."""
    frequent = keyed.groupBy("key").agg(F.sum("count").alias("count")).filter(F.col("count") >= least)
    bit = frequent.select(F.shiftrightunsigned("key", 64 - filter_bits).alias("bit"))
    cells = bit.select(F.shiftrightunsigned("bit", 6).alias("cell"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("one"))
    found = cells.groupBy("cell").agg(F.bit_or("one").alias("bits")).toPandas()
    bits = np.zeros((1 << filter_bits) // 64, np.uint64)
    bits[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits.tobytes()


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_words: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, size, phrase and count of every phrase of 1 to `longest` words that occurs at least `least` times in its lang;
    and for each lang the phrase of no words with the number of all its words."""
    sent = []
    for _ in range(2 if longest > 2 else 1):
        filters = list(sent)
        keyed = mined(docs, lambda s, f=filters: _keyed(s, _read(f)), KEYS, shard_words)
        sent.append(docs.sparkSession.sparkContext.broadcast(bit_filter(keyed, least, filter_bits)))
    # Each task tells a phrase once, so a task for each core, not for each split of a growing table, makes the rows that are summed.
    few = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    summed = mined(few, lambda s: _phrased(s, _read(sent), longest), PHRASES, shard_words, True).groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return stash(summed.filter((F.col("phrase") == "") | (F.col("count") >= least)).select("lang", size.alias("size"), "phrase", "count"), "phrases")


def _read(sent: list) -> list[np.ndarray]:
    return [np.frombuffer(x.value, np.uint64) for x in sent]


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, cover: int = COVER, shard_words: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of each lang by the score of their weakest cut, without
    those that a longer frequent phrase with at least cover % of their count holds."""
    known = frequent_phrases(docs, least, longest, shard_words, filter_bits)
    total = known.filter("size = 0").select("lang", F.col("count").alias("n"))
    some = known.filter("size > 0").select("lang", "size", "phrase", "count")
    candidates = some.filter("size > 1").select("lang", "size", "phrase", F.col("count").alias("a"), F.split("phrase", " ").alias("w"))

    cut = candidates.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("tail"))
    heads, tails = some.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l")), some.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("r"))
    scored = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, "lang")
    exact = "cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.expr(f"min(struct({exact} as score, k, l, r))").alias("c")).select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")

    # A phrase of m words holds m - 1, ..., 2 consecutive words.
    inner = candidates.filter("size > 2").withColumn("m", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("at", F.explode(F.expr("sequence(1, size - m + 1)")))
    held = inner.groupBy("lang", F.expr("array_join(slice(w, at, m), ' ')").alias("phrase")).agg(F.max("a").alias("longer"))
    left = weakest.join(held, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {cover} * a")

    buckets = max(1, known.count() // 100_000)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, m AS size, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists), (SELECT unnest(range(1, 6)) AS m)
  WHERE i + m - 1 <= len(w)
), counted AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang
), known AS (
  SELECT * FROM counted WHERE f >= 100
), cuts AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM known WHERE size > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, n, ((1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c
  JOIN known h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN known t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1 :], ' ')
  JOIN total ON total.lang = c.lang
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), open AS (
  SELECT * FROM weakest x
  WHERE NOT EXISTS (SELECT 1 FROM known y WHERE y.lang = x.lang AND y.size > 2 AND y.f >= x.a AND y.phrase <> x.phrase AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM open QUALIFY rank <= 2000
"""
