"""The ten operators against brute force, exact round trips and held-out accuracy, and their defined cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import compare

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: doc_id, text, source, and a column whose name clashes with the operators' own.
ODD = [
    (0, "the cat sat on the mat. " * 30, "a", "k"),
    (1, "the cat sat on the mat. " * 30, "a", "k"),
    (2, None, "a", None),
    (3, "", None, "k"),
    (4, "   \n\t ", "b", "k"),
    (5, "Été à  la plage <|endoftext|> 日本語 テキスト\n\nfin", "b", "k"),
    (5, "another text of the same id", "b", "k"),
    (6, "x", "c", "k"),
    (6, "x", "c", "k"),
    (None, "no id here", "c", "k"),
    (7, " ".join(f"word{i % 7919}" for i in range(60_000)), "c", "k"),
    (8, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause\nMIT  license, mit-license", None, "k"),
]
NAMES = "doc_id long, text string, source string, key string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, NAMES)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], NAMES)


@pytest.fixture(scope="module")
def real(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


def ids_of(text, end):
    from tokenizers import Tokenizer

    tok = ids_of.__dict__.setdefault("tok", Tokenizer.from_file(BPE))
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


# 1


def test_token_index_round_trip(spark, sf_dir, real):
    from trendloom.llm.token_index import op1_token_index

    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op1_token_index(spark, sf_dir).collect()}
    at = 0
    for i, text, _ in real:
        ids = ids_of(text, 0)
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_index_odd_rows_and_keyed_access(odd, empty):
    from trendloom.llm.token_index import TokenStore, read_documents, write_token_index

    folder, manifest = write_token_index(odd, BPE, shard_bytes=10_000)
    rows = read_documents(folder, manifest).orderBy("start").collect()
    assert len(rows) == len(ODD) and rows[0].doc_id is None
    assert [r.doc_id for r in rows[1:]] == sorted(i for i, *_ in ODD if i is not None)
    store = TokenStore(folder, manifest)
    for i in (0, 2, 7, 8):
        assert store.get(i).tolist() == ids_of(next(t for j, t, *_ in ODD if j == i), 0).tolist()
    assert store.get(99) is None and store.get(-1) is None
    assert read_documents(*write_token_index(empty, BPE)).count() == 0


def test_perfect_hash_is_minimal():
    from trendloom.llm.token_index import PerfectHash

    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    assert sorted(PerfectHash.build(keys).slots(keys)) == list(range(len(keys)))


# 2


def brute_repeats(rows, size=100):
    seen, out = set(), {}
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - size + 1):
            w = raw[p : p + size]
            if w in seen:
                gone[p : p + size] = True
            seen.add(w)
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0, hashlib.sha256(left).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark, sf_dir, real):
    from trendloom.llm.suffix_dedup import op2_suffix_dedup

    want = brute_repeats([(i, t) for i, t, _ in real])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_dedup(spark, sf_dir).collect()} == want


def test_suffix_dedup_periodic_shared_and_long_texts(spark):
    from trendloom.llm import suffix_dedup

    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, other = text(150), text(400)
    rows = [(1, "ab" * 200), (2, text(90) + shared + text(30)), (3, shared[20:] + text(60)), (4, text(300) + other), (5, other), (6, other + text(99)), (7, "é" * 300), (8, "x" * 100), (9, "x" * 101), (10, text(suffix_dedup.CHUNK + 5000) + other[:120])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows)


def test_suffix_dedup_does_not_depend_on_batches(spark, sf_dir, real):
    """A text alone in one Arrow batch; its copy in another one, beside a third text that shares a passage with it."""
    from trendloom.llm import suffix_dedup

    rng = np.random.default_rng(11)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    rows = []
    for i in range(0, 64, 4):
        shared = text(150)
        first = text(80) + shared + text(80)
        rows += [(i, first), (i + 1, text(50)), (i + 2, first), (i + 3, text(80) + shared + text(80))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in (1, 2, 1000):
            spark.conf.set(key, str(size))
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
            assert got == brute_repeats(rows), size
        spark.conf.set(key, "7")
        want = brute_repeats([(i, t) for i, t, _ in real])
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op2_suffix_dedup(spark, sf_dir).collect()} == want
    finally:
        spark.conf.set(key, before)


def test_settled_runs_are_joined(spark):
    from trendloom.llm import suffix_dedup

    rows = list(suffix_dedup._anchor_rows(100)(iter([pa.RecordBatch.from_pydict({"d": [1, 2], "tag": [0, 0], "text": ["x" * 300_000, "ab" * 50_000]})])))
    assert sum(map(len, rows)) < 20
    doc, word = suffix_dedup._merged(np.array([0, 0, 0, 1]), np.array([5, 0, 9, 3]), np.array([2, 4, 0, 1]))
    assert list(zip(doc, word >> suffix_dedup.LEN_BITS, word & suffix_dedup.MOST)) == [(0, 0, 7), (0, 9, 0), (1, 3, 1)]
    long = suffix_dedup._merged(np.array([0]), np.array([7]), np.array([3 * suffix_dedup.MOST]))[1]
    assert sum((long & suffix_dedup.MOST) + 1) == 3 * suffix_dedup.MOST + 1
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 400))
    same = spark.createDataFrame([(3, text), (3, text), (4, text[:250])], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(same).collect())
    assert got == [(3, 0), (3, 0), (4, 250)]  # rows that repeat a document are one document


def test_suffix_dedup_odd_rows(odd, empty):
    from trendloom.llm.suffix_dedup import remove_repeats

    rows = remove_repeats(odd, with_text=True, carry=("key",)).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by[1][0].n_removed == by[1][0].n_bytes and by[0][0].n_removed > 0
    assert by[2][0].n_bytes == 0 and by[None][0].kept == "no id here" and by[2][0].key is None
    assert by[6][0].n_removed == by[6][1].n_removed == 0 and len(by[5]) == 2
    assert remove_repeats(empty).count() == 0


# 3


def test_permutation_index_recall_and_scores(spark, sf_dir):
    from trendloom.llm.permutation_index import op3_permutation_index

    got = op3_permutation_index(spark, sf_dir).collect()
    t = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet' ORDER BY vec_id").fetchnumpy()
    x, ids = np.stack(t["embedding"]).astype(float), t["vec_id"]
    hits = n = 0
    found = defaultdict(dict)
    for r in got:
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        mine = found[ids[i]]
        hits += len(best & {v for v, _ in mine.values()})
        n += 20
        assert sorted(mine) == list(range(1, 21))
        assert all(abs(s - x[np.searchsorted(ids, v)] @ x[i]) < 1e-12 for v, s in mine.values())
    assert hits / n >= 0.9


@pytest.mark.parametrize("hot", [False, True])
def test_permutation_index_recall_where_the_share_cuts(spark, hot):
    """Files of far more than 1,460 rows, so that the footrule cut acts; a third of the rows in one cluster if hot."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from trendloom.llm.permutation_index import search

    rng = np.random.default_rng(1)
    x = rng.normal(size=(24_000, 64))
    if hot:
        x[:8000] = rng.normal(size=64) + 0.1 * rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x))})).repartition(8)
    found = defaultdict(set)
    for r in search(frame, F.col("vec_id") % 200 == 0).collect():
        found[r.query_id].add(r.vec_id)
    recall = []
    for i in range(0, len(x), 200):
        score = x @ x[i]
        score[i] = -np.inf
        recall.append(len(found[i] & set(np.argsort(-score)[:20].tolist())) / 20)
    print("recall", np.mean(recall[:40]), np.mean(recall[40:]))
    assert min(np.mean(recall[:40]), np.mean(recall[40:])) >= 0.9


def test_permutation_index_does_not_depend_on_the_session(spark):
    from trendloom.llm.permutation_index import op3_permutation_index

    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 16, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(tuple(r) for r in op3_permutation_index(spark, "/root/testdata/sf0.1").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2] and got[0]


def test_permutation_index_odd_vectors(spark):
    from pyspark.sql import functions as F

    from trendloom.llm.permutation_index import search

    rows = [(i, [1.0, float(i % 3)]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [1.0, None]), (104, [1.0]), (105, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(frame, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {0, 20} and max(r.vec_id for r in got) < 100
    first = sorted((r.rank, r.vec_id) for r in got if r.query_id == 20)
    ties = [v for _, v in first]
    assert len(ties) == 20 and len(set(ties)) == 20 and ties[:3] == [2, 5, 8]
    assert search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 4


def slow_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(ids, fps):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.array(ids)
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_simhash_equals_brute_force(spark, sf_dir, real):
    from trendloom.llm.simhash import op4_simhash_near_dedup

    fps = np.array([slow_fingerprint(t) for _, t, _ in real], np.uint64)
    want = dict(zip([i for i, *_ in real], zip((f"{int(f):016x}" for f in fps), brute_components([i for i, *_ in real], fps))))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash_near_dedup(spark, sf_dir).collect()} == want


def test_forest_joins_what_pairs_join():
    from trendloom.llm import simhash

    rng = np.random.default_rng(3)
    free = np.array([1 << b for b in range(24)], np.uint64)
    fps = np.unique(rng.integers(0, 1 << 24, 6000).astype(np.uint64) & np.uint64(0xFF0F33))
    assert len(fps) > 1000
    small = simhash.SMALL

    def parts(limit):
        simhash.SMALL = limit
        try:
            label = np.arange(len(fps))
            edges = simhash._forest(fps, free)
            for a, b in edges:
                assert int(np.bitwise_count(fps[a] ^ fps[b])) <= 3
                label[label == label[b]] = label[a]
            return label, len(edges)
        finally:
            simhash.SMALL = small

    (a, n), (b, m) = parts(10**6), parts(1)
    assert n == m and len(set(a)) == len(set(b)) == len(fps) - n


def test_simhash_odd_rows(odd, empty):
    from trendloom.llm.simhash import near_duplicates

    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == 0 and by[None].component_id is None
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16 and by[4].component_id == 2
    assert near_duplicates(empty).count() == 0


# 5


def test_key_shards(spark, sf_dir, real):
    from trendloom.llm.sharding import op5_key_shards

    rows = op5_key_shards(spark, sf_dir).collect()
    texts = {i: (t or "").encode() for i, t, _ in real}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.slot) if r.shard == 0]
    assert order != sorted(order)


def test_shards_equal_plain_rendezvous_hashing(spark, sf_dir, real):
    import xxhash

    from trendloom.llm.sharding import op5_key_shards

    def shard(key, n):
        def h(s):
            seed = xxhash.xxh64_intdigest(b"shard", 42)
            seed = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed)
            out = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed)
            return out - (1 << 64) if out >> 63 else out

        return max(range(n), key=lambda s: (h(s), s))

    texts = {i: (t or "").encode() for i, t, _ in real}
    rows = op5_key_shards(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.shard, r.grown_shard) == (shard(r.doc_id, 8), shard(r.doc_id, 9)) and r.grown_shard in (r.shard, 8)
        assert (r["size"], r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "key")
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shards_of_many_buckets_and_odd_rows(odd, empty):
    from trendloom.llm.sharding import fisher_yates, with_slots, write_shards

    rows = with_slots(write_shards(odd, shards=2, bucket_bytes=10_000, keep=("key",))).collect()
    again = with_slots(write_shards(odd.repartition(3), shards=2, bucket_bytes=10_000, keep=("key",))).collect()
    place = lambda rs: Counter((r.doc_id, r.text, r.shard, r.slot, r.kept_key) for r in rs)
    assert place(rows) == place(again) and len(rows) == len(ODD)
    assert with_slots(write_shards(empty, shards=2)).count() == 0
    assert sorted(fisher_yates(100, [1])) == list(range(100)) and list(fisher_yates(0, [1])) == []


def test_equal_rows_are_scattered_over_all_buckets(spark):
    from trendloom.llm.sharding import with_slots, write_shards

    rows = spark.range(20_000).selectExpr("7L AS doc_id", "'the same text' AS text").unionByName(spark.range(3_000).selectExpr("id AS doc_id", "concat('text ', id) AS text"))
    written = write_shards(rows, shards=2, bucket_bytes=30_000)
    size = {(r.shard, r.bucket): r.b for r in written.groupBy("shard", "bucket").agg(F.sum(F.octet_length("text") + 1).alias("b")).collect()}
    shard = max(size, key=size.get)[0]
    assert max(size.values()) <= 2 * sum(b for (s, _), b in size.items() if s == shard) / 6 and sum(s == shard for s, _ in size) >= 5
    place = lambda df: Counter((r.doc_id, r.text, r.shard, r.slot) for r in with_slots(df).collect())
    first = place(written)
    assert first == place(write_shards(rows.repartition(7), shards=2, bucket_bytes=30_000)) and sum(first.values()) == 23_000
    for s in (0, 1):
        slots = sorted(slot for (_, _, at, slot) in first.elements() if at == s)
        assert slots == list(range(len(slots)))


# 6


def test_classifier_held_out_accuracy(spark):
    from trendloom.llm.quality_classifier import op6_quality_classifier

    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op6_quality_classifier(spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [(rows[i].predicted, q) for i, q in labels if rows[i].held_out]
    assert len(held) > 30 and np.mean([p == q for p, q in held]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())


def test_classifier_odd_rows(spark, odd, empty):
    from trendloom.llm import quality_classifier as q

    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (4, None, 0), (7, 0, 0), (8, 1, 0), (8, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.fit(odd, labels)
    rows = q.score(odd, model, carry=("key",)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert q.score(empty, model).count() == 0
    one_class = q.fit(odd, labels.filter("quality = 1"))
    assert len({r.score for r in q.score(odd, one_class).collect()}) == 1
    assert q.fit(odd, labels.limit(0)).scores([b"", b"a b"]).tolist() == [0.5, 0.5]


def test_long_texts_score_as_their_parts_do():
    from trendloom.llm import quality_classifier as q

    model = q.Model(np.random.default_rng(0).normal(size=1 << q.BUCKET_BITS), 0.1)
    text = b"alpha beta gamma delta " * 100_000
    assert abs(model.scores([text])[0] - model.scores([b"x", text, b"y"])[1]) < 1e-12


@pytest.mark.parametrize("part", [1, 7, 40, 1000])
def test_cut_texts_have_the_features_of_whole_ones(part):
    from trendloom.llm import quality_classifier as q

    rng = np.random.default_rng(4)
    words = ["a", "bb", "ünï", "日本語" * 9, "x" * 130, "x" * 129 + "y", "the"]
    for gap in (" ", " \n\t ", "  "):
        text = (gap.join(rng.choice(words, 60)) + gap).encode()
        whole = Counter((k, b) for k, (_, bs) in enumerate(q.hashed_features([(q._codes(text), 0)])) for b in bs.tolist())
        cut = Counter((k, b) for p in q._cut(text, part) for k, (_, bs) in enumerate(q.hashed_features([p])) for b in bs.tolist())
        assert cut == whole
    one, other = (q._word_hashes(q._codes(w), np.array([0]), np.array([len(w)]))[0] for w in (b"x" * 150 + b"y" + b"x" * 150, b"x" * 150 + b"z" + b"x" * 150))
    assert one != other


def test_classifier_sample_is_bounded(spark):
    from trendloom.llm import quality_classifier as q

    docs = spark.createDataFrame([(i, f"good words {i} " * 5 if i % 2 else f"bad stuff {i} " * 5) for i in range(60)] + [(1, "good again")] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert q.fit(docs, labels).scores([b"good words", b"bad stuff"]).round().tolist() == [1, 0]
    assert q.fit(docs, labels, max_features=1).scores([b"good"]).tolist() == [0.5]


# 7


def test_license_scan_equals_brute_force(spark, sf_dir, real):
    from trendloom.llm.license_scan import BASE, op7_license_scan

    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {i: t for i, t, _ in real}
    for r in op7_license_scan(spark, sf_dir).collect():
        words = token.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id] or ""))
        hits = sorted((k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in hits})) and 0 <= r.score <= 1
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels


def test_license_expressions_and_odd_rows(odd, empty):
    from trendloom.llm import license_scan as s

    assert s.parse_expression("MIT OR Apache-2.0 AND BSD WITH x") == ["mit", "apache-2.0", "bsd", "x", "with", "and", "or"]
    assert s.allows(s.parse_expression("(MIT OR GPL-2.0) AND BSD"), {"mit", "bsd"}) and not s.allows(s.parse_expression("MIT AND GPL-2.0"), {"mit"})
    assert s.parse_expression("MIT AND (") == ["mit"] == s.parse_expression("((MIT OR (") and s.parse_expression("MIT OR (BSD AND (") == ["mit", "bsd", "or"]
    assert s.parse_expression("MIT OR") == ["mit"] and s.parse_expression("") == [] and s.parse_expression(") MIT (") == []
    assert s.identifiers(s.parse_expression("GPL-2.0 WITH Classpath-exception-2.0")) == {"gpl-2.0"}
    by = {r.doc_id: r for r in s.scan_licenses(odd).collect()}
    assert by[8].labels == "bsd-3-clause,gpl-2.0-only,mit" and (by[8].n_base, by[8].base_labels) == (2, "mit")
    assert (by[2].n_words, by[2].labels, by[2].score) == (0, "", 0.0)
    assert s.scan_licenses(empty).count() == 0


def random_expression(rng, depth=0):
    """A licence expression with the brackets it needs and some it does not: text, and a function of the allowed set."""
    kind = rng.integers(0, 4) if depth < 4 else 0
    if kind == 0:
        name = rng.choice(["MIT", "GPL-2.0-only", "Apache-2.0", "x.y+z"])
        return name, 9, lambda ok, n=name.lower(): n in ok
    if kind == 1:
        a, _, f = random_expression(rng, 9)
        return f"{a} WITH some-exception", 3, f
    (a, ra, f), (b, rb, g) = random_expression(rng, depth + 1), random_expression(rng, depth + 1)
    word, rank = (("AND", 2), ("or", 1))[kind - 2]
    a, b = (f"({x})" if r < rank or rng.integers(0, 4) == 0 else x for x, r in ((a, ra), (b, rb)))
    both = (lambda ok: f(ok) and g(ok)) if rank == 2 else (lambda ok: f(ok) or g(ok))
    return f"{a} {word} {b}", rank, both


def test_license_expressions_evaluate_as_their_trees_do():
    from trendloom.llm import license_scan as s

    rng = np.random.default_rng(3)
    found = s.automaton()
    for _ in range(300):
        text, _, tree = random_expression(rng)
        for ok in ({"mit"}, {"apache-2.0", "gpl-2.0-only"}, {"mit", "x.y+z"}):
            assert s.allows(s.parse_expression(text), ok) == tree(ok)
            assert s.allows(s.parse_expression(f"{text} and"), ok) == s.allows(s.parse_expression(f"{text} ("), ok) == tree(ok)
        # Any cut leaves something that evaluates.
        cut = text[: rng.integers(0, len(text) + 1)]
        s.identifiers(s.parse_expression(cut)), s.allows(s.parse_expression(cut), {"mit"})
        got = s.scan(f"x\nSPDX-License-Identifier: {text} */ see below", found)
        assert got[7] == tree(s.PERMISSIVE) and "see" not in got[5].split(",")


def test_license_scan_time_grows_with_the_text():
    import time

    from trendloom.llm import license_scan as s

    found = s.automaton()
    text = "MIT license " * 90_000 + "SPDX-License-Identifier: " * 4_000
    began = time.process_time()
    got = s.scan(text, found)
    assert (got[1], got[2], got[3]) == (90_000, 0, 179_998) and time.process_time() - began < 3


# 8


def test_mixing_equals_sql(spark, sf_dir):
    from trendloom.llm import mixing

    assert compare.differences(mixing.op8_mix_sources(spark, sf_dir), compare.tables(sf_dir), mixing.ORACLE) is None


def test_mixing_targets_and_odd_rows(spark, odd, empty):
    from trendloom.llm import mixing
    from trendloom.llm.common import stash

    sizes = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate([("a", 100), ("b", 1000), ("c", 10), (None, 50)])], "doc_id long, source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    caps, total = {"a": 200, "b": 2000, "c": 20, None: 100}, 1160 * 1.5
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    want = {k: 0.0 for k in caps}
    open_ = set(caps)
    while True:
        left = total - sum(want[k] for k in caps if k not in open_)
        share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > caps[k]}
        want |= share | {k: float(caps[k]) for k in over}
        open_ -= over
        if not over:
            break
    assert got == pytest.approx(want)
    stashed = stash(mixing.sizes_of(odd), "sizes")
    rows = mixing.mix_sizes(stashed).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(t - goal) < 3 * mixing.PACKET for t, goal in by.values())
    assert sum(t for t, _ in by.values()) == int(sum(goal for _, goal in by.values()) + 1e-6)
    assert mixing.mix_sizes(stash(mixing.sizes_of(empty), "sizes")).count() == 0
    whole = mixing.mix_sizes(stashed, packet=None).collect()
    assert all(r.taken == len(r.finish) * r["size"] for r in whole)


@pytest.mark.parametrize("packet", [None, 7])
def test_mixing_equals_a_plain_queue(spark, packet):
    """Every packet in one list, sorted by finish time and cut at the budget."""
    from trendloom.llm import mixing
    from trendloom.llm.common import stash

    rng = np.random.default_rng(2)
    docs = [(int(i) if i % 11 else None, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None, int(n)) for i, n in enumerate(rng.integers(0, 60, 400))]
    frame = spark.createDataFrame([(i, s, " ".join(f"w{i}x{k}" for k in range(n))) for i, s, n in docs], "doc_id long, source string, text string")
    sizes = stash(mixing.sizes_of(frame), "sizes")
    got = {r.row: r for r in mixing.mix_sizes(sizes, packet=packet).collect()}
    line = []
    for source in {r.source for r in got.values()}:
        own = [r for r in got.values() if r.source == source]
        clock = 0
        for p in range(2):
            for r in sorted(own, key=lambda r: (hashlib.md5(f"mix{p}:{'null' if r.doc_id is None else r.doc_id}:{r.hash}".encode()).hexdigest(), r["size"])):
                for words in [min(packet or 10**9, r["size"] - k) for k in range(0, r["size"], packet or 10**9)]:
                    clock += words
                    line.append((clock / r.target, source is None, source or "", p, words, r.row))
    budget = int(sum({r.source: r.target for r in got.values()}.values()) + 1e-6)
    taken = Counter()
    for _, _, _, _, words, row in sorted(line):
        room = max(0, budget - sum(taken.values()))
        taken[row] += min(words, room) if packet else words * (room > 0 and 2 * room >= words)
        if words > room:
            break
    assert {k: r.taken for k, r in got.items()} == {k: taken[k] for k in got}


# 9


def base_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts_and_verdicts(spark, sf_dir, real):
    from trendloom.llm.quality_rules import op9_quality_rules

    rows = {r.doc_id: r for r in op9_quality_rules(spark, sf_dir).collect()}
    for i, text, _ in real:
        r, want = rows[i], base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    judged = [(rows[i].kept, q) for i, q in labels.items() if not rows[i].base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) >= 0.9


def plain_expectation_maximisation(x, rounds, start, pseudo):
    """On a matrix of votes, document by document."""
    share, alarm, hit = start
    good, a, h = share, np.full(x.shape[1], alarm), np.full(x.shape[1], hit)
    for _ in range(rounds):
        odds = np.log(good / (1 - good)) + np.where(x == -1, np.log(a / h), np.where(x == 1, np.log((1 - a) / (1 - h)), 0)).sum(1)
        p = 1 / (1 + np.exp(-odds))
        good = (p.sum() + pseudo * share) / (len(x) + pseudo)
        against, cast = x == -1, x != 0
        a = (p @ against + pseudo * share * alarm) / (p @ cast + pseudo * share)
        h = ((1 - p) @ against + pseudo * (1 - share) * hit) / ((1 - p) @ cast + pseudo * (1 - share))
    return good, a, h


def test_quality_rules_estimate_as_plain_expectation_maximisation_does(spark):
    from trendloom.llm import quality_rules as q
    from trendloom.llm.common import stash

    rng = np.random.default_rng(5)
    bad = rng.random(3000) < 0.12
    x = np.stack([np.where(rng.random(3000) < np.where(bad, 0.6, 0.01), -1, 1) for _ in range(4)] + [np.where(rng.random(3000) < 0.2, -1, 1)], 1)
    x[rng.random(x.shape) < 0.1] = 0
    votes = [f"v{i}" for i in range(5)]
    patterns = stash(spark.createDataFrame(x.tolist(), ", ".join(f"{v} int" for v in votes)).groupBy(*votes).count(), "votes")
    got = q.estimate(patterns, votes, rounds=12)
    good, a, h = plain_expectation_maximisation(x, 12, q.START, q.PSEUDO)
    assert abs(got.good - good) < 1e-9 and np.allclose(got.alarm, a) and np.allclose(got.hit, h)
    assert abs(good - 0.88) < 0.03 and abs(a[4] - 0.2) < 0.03 and h[0] > 0.5


def test_a_rule_that_often_errs_is_overruled(spark):
    from trendloom.llm import quality_rules as q
    from trendloom.llm.common import stash

    rng = np.random.default_rng(6)
    rows = [(i, float(k), bool(b)) for i, (k, b) in enumerate(zip(rng.random(4000) < 0.15, rng.random(4000) < 0.1))]
    table = spark.createDataFrame(rows, "doc_id long, noise double, junk boolean").withColumns({"n_words": F.lit(100), "n_repeat_words": F.lit(0)})
    seen = [q.Rule(f"sees{i}", F.col("junk") & (F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.lit(10)) < 7), ~F.col("junk")) for i in range(3)]
    errs = q.Rule("errs", F.col("noise") > 0, F.col("noise") == 0)
    out = q.judge(stash(table, "features"), [*seen, errs]).collect()
    alone = [r.kept for r in out if r.vote_errs == -1 and not r.junk]
    assert len(alone) > 400 and all(alone)  # kept against a vote
    assert not any(r.kept for r in out if r.junk and min(r.vote_sees0, r.vote_sees1, r.vote_sees2) == -1)


def test_quality_rules_odd_rows(odd, empty):
    from trendloom.llm import quality_rules as q
    from trendloom.llm.common import stash

    rows = q.judge(stash(q.features(odd), "features")).collect()
    assert len(rows) == len(ODD)
    want = Counter((i, *base_counts(t)) for i, t, *_ in ODD)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert q.judge(stash(q.features(empty), "features")).count() == 0


# 10


def test_packing_is_valid_and_tight(spark, sf_dir, real):
    from trendloom.llm.packing import op10_best_fit_packing

    rows = op10_best_fit_packing(spark, sf_dir).collect()
    docs = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, text, _ in real:
        ids, at = ids_of(text, 2), 0
        pieces = sorted(docs[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 1024)))
        for p in pieces:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids) and all(p.length == 1024 for p in pieces[1:])
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.03 * -(-sum(r.length for r in rows) // 1024)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_limit(spark, rule):
    from trendloom.llm.packing import best_fit, pack

    pieces = spark.createDataFrame([(i, 0, 1 + i * 37 % 90) for i in range(400)], "doc_id long, piece int, length long")
    rows = pack(pieces, capacity=128, max_docs=3, max_cost=9000.0, rule=rule, group_pieces=100).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r.length)
    assert len(rows) == 400 and all(sum(b) <= 128 and len(b) <= 3 and sum(x * x for x in b) <= 9000 for b in bins.values())
    with pytest.raises(ValueError):
        best_fit(np.array([200]), (128, 3, 9000))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_equals_a_plain_search_over_all_bins(rule):
    from trendloom.llm import packing

    rng = np.random.default_rng(8)
    length = np.sort(rng.integers(1, 300, 700))[::-1]
    limits, w = (1024.0, 6.0, 200_000.0), np.array([1.0, 0.05, 0.2])
    left, want = [], []
    for n in length:
        x = np.array([n, 1.0, float(n) ** 2]) / limits
        fits = [(i, b - x) for i, b in enumerate(left) if ((b - x) >= -1e-12).all()]
        if fits:
            score = [-(w * r**2).sum() if rule == "norm" else (w * x * left[i]).sum() for i, r in fits]
            at = fits[int(np.argmax(score))][0]
        else:
            at = len(left)
            left.append(np.ones(3))
        left[at] = left[at] - x
        want.append(at)
    assert packing.best_fit(length, limits, rule=rule).tolist() == want


def test_packing_keeps_columns_of_any_name(spark):
    from trendloom.llm import packing

    pieces = spark.createDataFrame([(i, 0, 0, 100 + i, i, "g", "x") for i in range(50)], "doc_id long, row long, piece int, length long, start long, `group` string, sequence string")
    got = packing.pack(pieces).collect()
    assert len(got) == 50 and {(r["group"], r["sequence"]) for r in got} == {("g", "x")}


def test_packing_odd_rows(odd, empty):
    from trendloom.llm.packing import encode_pieces, pack

    pieces = pack(encode_pieces(odd, BPE, with_ids=True)).collect()
    assert sum(r.length for r in pieces) == sum(len(ids_of(t, 2)) for _, t, *_ in ODD)
    assert all(len(r.ids) == r.length for r in pieces)
    assert pack(encode_pieces(empty, BPE)).count() == 0


def test_encoder_equals_the_library():
    import pyarrow as pa

    from trendloom.llm.encode import encoder

    texts = [None, "", " ", "a  b", " x \n y", "don't stop it's", "x<|endoftext|>y z", "tab\tsep\n\nnew  ", "“quote” — dash", "3.14 1,000 a1b2 A.B.C", "...!!!", "word\n next", "ﬁ ﬂ 𝒳 ɐb"] + [t for _, t, *_ in ODD]
    flat, n = encoder(BPE).encode(pa.array(texts))
    for part, text in zip(np.split(flat, np.cumsum(n)[:-1]), texts):
        assert part.tolist() == ids_of(text, 0)[:-1].tolist()


def test_pieces_with_white_space_at_their_ends_are_told():
    import pyarrow as pa

    from trendloom.llm.encode import _spaced, encoder

    pieces = ["a", "", "\x1cx", "x\x85", " x", "é", "xé", "　", "x\n"]
    starts, ends = _spaced(pa.array(["skipped", *pieces], pa.large_string())[1:], pieces)
    assert starts.tolist() == [not p or p[0].isspace() for p in pieces] and ends.tolist() == [not p or p[-1].isspace() for p in pieces]
    texts = [f"one {p} two, three" for p in pieces]
    flat, n = encoder(BPE).encode(pa.array(texts))
    for part, text in zip(np.split(flat, np.cumsum(n)[:-1]), texts):
        assert part.tolist() == ids_of(text, 0)[:-1].tolist()
