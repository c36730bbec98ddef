"""Operators 11 to 13 against brute force, SQL and the tokenizer itself, and their defined cases."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import compare

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    (0, "a b c " * 40, "en", "k"),
    (0, "a b c " * 40, "en", "k"),
    (1, None, None, "k"),
    (2, "", "und", None),
    (3, " \t\n\v ", "en", "k"),
    (4, "Ärger im ÄRGER, İstanbul ΣΑΣ été <|endoftext|> 日本語x1234 it's we'll \x1c don't\n\nfin", "de", "k"),
    (None, "no id " * 30, None, "k"),
    (7, " ".join(f"w{i % 4999}" for i in range(60_000)), "fr", "k"),
    (8, "x " * 70_000, "fr", "k"),
]
NAMES = "doc_id long, text string, lang string, _w string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, NAMES)


@pytest.fixture(scope="module")
def real(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


# 11
def brute_runs(w, least=24, times=3):
    """Every maximal stretch with a period, those kept whose smallest period it is."""
    n, out = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, times * p):
                out.setdefault((i, j - i + p), p)  # the smallest period comes first
            i = j + 1
    return sorted((s, length, p) for (s, length), p in out.items())


def planted_words(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    return w


def digest(doc_id, text):
    w = planted_words(doc_id, text)
    runs = brute_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_equal_brute_force_on_random_words():
    from trendloom.llm import periodic_runs

    rng = np.random.default_rng(7)
    for trial in range(400):
        w = []
        while len(w) < rng.integers(0, 260):
            block = rng.integers(0, 3 if trial % 2 else 40, rng.integers(1, 14)).tolist()
            w += block * int(rng.integers(1, 12))
            w += w[-int(rng.integers(1, 60)) :] * int(rng.integers(0, 4)) if rng.random() < 0.3 else []
        for least, times in ((24, 3), (3, 3), (10, 5)):
            assert periodic_runs.find_runs(np.array(w, np.int64), least, times) == brute_runs(w, least, times)


def test_runs_do_not_depend_on_the_block_of_periods(monkeypatch):
    from trendloom.llm import periodic_runs

    w = np.array(([1, 2, 3] * 30 + [4] * 40 + [5, 6]) * 5 + list(range(50)), np.int64)
    whole = periodic_runs.find_runs(w)
    monkeypatch.setattr(periodic_runs, "PROBES", 50)
    assert periodic_runs.find_runs(w) == whole == brute_runs(w.tolist())


def test_runs_of_one_word_take_linear_time():
    import time

    from trendloom.llm import periodic_runs

    began = time.time()
    assert periodic_runs.find_runs(np.zeros(120_000, np.int64)) == [(0, 120_000, 1)]
    assert time.time() - began < 20


def test_periodic_runs_equal_brute_force(spark, sf_dir, real):
    from trendloom.llm.periodic_runs import op11_periodic_runs

    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(real)
    short = [(i, t) for i, t, _ in real if len(t or "") < 6000]
    assert len(short) > 100 and any(digest(i, t)[1] for i, t in short)
    assert all(got[i] == digest(i, t) for i, t in short)


def test_periodic_runs_odd_rows(spark, odd, tmp_path):
    from trendloom.llm import periodic_runs

    rows = periodic_runs.periodic_runs(odd).collect()
    assert len(rows) == len(ODD) and periodic_runs.periodic_runs(odd.limit(0)).count() == 0
    of = {r.doc_id: r for r in rows}
    assert [tuple(x) for x in of[0].runs] == [(0, 120, 3)] and of[0].collapsed == "a b c"
    assert all(of[i].runs == [] and of[i].collapsed == "" for i in (1, 2, 3))
    assert of[None].collapsed == "no id" and [tuple(x) for x in of[7].runs] == [(0, 60_000, 4999)]
    assert of[8].collapsed == "x"
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).filter("doc_id is null or doc_id < 5").collect()), key=repr)
    assert got == sorted((digest(i, t) for i, t, _, _ in ODD if i is None or i < 5), key=repr)


# 12
def brute_phrases(rows, least, first, cover=100):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    known = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    gone = {(lang, p[i : i + m]) for (lang, p), v in known.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * v >= cover * f[lang, p[i : i + m]]}
    out = []
    for (lang, p), a in known.items():
        if (lang, p) not in gone:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank = Counter()
    ranked = []
    for x in out:
        rank[x[0]] += 1
        if rank[x[0]] <= first:
            ranked.append((x[0], rank[x[0]], *x[1:]))
    return ranked


@pytest.mark.parametrize("least,first,cover,shard_words", [(100, 2000, 100, 500_000), (12, 300, 100, 5_000), (30, 50, 60, 20_000)])
def test_phrases_equal_brute_force(spark, real, least, first, cover, shard_words):
    from trendloom.llm import phrases

    docs = spark.createDataFrame([(t, lang) for _, t, lang in real], "text string, lang string").repartition(5)
    got = [tuple(r) for r in phrases.collocations(docs, least=least, first=first, cover=cover, shard_words=shard_words).orderBy("lang", "rank").collect()]
    want = brute_phrases([(t, lang) for _, t, lang in real], least, first, cover)
    assert got == want and (least == 100 or len(got) > 40)


def test_phrases_equal_sql(spark):
    from trendloom.llm import phrases

    sf = "/root/testdata/sf0.01"
    assert compare.differences(phrases.op12_phrase_collocations(spark, sf), compare.tables(sf), phrases.ORACLE) is None


def test_phrases_with_a_filter_of_one_cell(spark, real):
    """A filter that lets nearly everything pass costs work and changes nothing."""
    from trendloom.llm import phrases

    rows = [(t, lang) for _, t, lang in real[:40]]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert [tuple(r) for r in phrases.collocations(docs, least=10, filter_bits=6).orderBy("lang", "rank").collect()] == brute_phrases(rows, 10, 2000)


def test_phrases_odd_rows(odd):
    from trendloom.llm import phrases

    got = [tuple(r) for r in phrases.collocations(odd, least=5).orderBy("lang", "rank").collect()]
    assert got == brute_phrases([(t, lang) for _, t, lang, _ in ODD], 5, 2000) and {"und", "en", "fr"} == {r[0] for r in got}
    assert phrases.collocations(odd.limit(0)).count() == 0


def test_scores_of_huge_counts_are_exact(spark, monkeypatch):
    from trendloom.llm import phrases

    n, a, l, r = 9 * 10**15, 3 * 10**12 + 7, 5 * 10**12 + 1, 4 * 10**12 + 3
    known = [("en", 0, "", n), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)]
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: spark.createDataFrame(known, "lang string, size int, phrase string, count long"))
    assert phrases.collocations(spark.range(1)).first().score == 1000 * a * n // (l * r)


def test_suffix_array_and_intervals_equal_plain_counts():
    from trendloom.llm import phrases

    rng = np.random.default_rng(3)
    for _ in range(60):
        t = rng.integers(0, 5, int(rng.integers(1, 200)))
        order = phrases.suffix_array(t, 5)
        common = phrases.common_prefixes(t, order, 5)
        for m in range(1, 6):
            place, count = phrases.intervals(t, order, common, m)
            plain = Counter(tuple(t[i : i + m]) for i in range(len(t) - m + 1) if (t[i : i + m] > 0).all())
            assert {tuple(t[p : p + m]): c for p, c in zip(place, count)} == plain


# 13
def ids_of(text):
    from tokenizers import Tokenizer

    tok = ids_of.__dict__.setdefault("tok", Tokenizer.from_file(WORD_BPE))
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_word_encoder_equals_the_library(real):
    from trendloom.llm.word_encode import WordEncoder

    enc = WordEncoder(WORD_BPE)
    assert enc.fast
    rng = np.random.default_rng(5)
    letters = list("aAzZéÉßẞÖşİıſñ0123'’.,-_<|>̧́  \x1c\x85\n\t  日本ΣςσＡ①²½ªºǅ") + ["<|endoftext|>", "'s", "'LL", "don't"]
    texts = [t for _, t, _ in real[:60]] + [t for _, t, _, _ in ODD[:-2]] + ["".join(rng.choice(letters, int(rng.integers(0, 40)))) for _ in range(2000)]
    flat, n = enc.encode(pa.array(texts, pa.string()))
    for i, (got, text) in enumerate(zip(np.split(flat, np.cumsum(n)[:-1]), texts)):
        assert got.tolist() == ids_of(text)[:-1].tolist(), (i, text)
    assert [len(x) for x in enc.encode(pa.array([], pa.string()))] == [0, 0]


def check_windows(rows, texts, capacity):
    """Every id of every document in one piece, pieces gapless in their sequences."""
    at, seqs = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        at.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in seqs.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    ids = [(i, ids_of(t)) for i, t in texts]
    want = Counter((i, int(s), len(x[s : s + capacity]), zlib.crc32(x[s : s + capacity]), len(x)) for i, x in ids for s in range(0, len(x), capacity))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    total = sum(len(x) for _, x in ids)
    return len(seqs), -(-total // capacity)


def test_windows_are_valid_and_tight(spark, sf_dir, real):
    from trendloom.llm.window_packing import op13_window_packing

    df = op13_window_packing(spark, sf_dir)
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    used, least = check_windows(df.collect(), [(i, t) for i, t, _ in real], 4096)
    assert used <= least + 1


def test_windows_in_groups_and_odd_rows(odd):
    from trendloom.llm import window_packing

    pieces = window_packing.cut_windows(odd, WORD_BPE, 256)
    got = window_packing.pack_windows(pieces, 256, group_pieces=3).collect()
    check_windows(got, [(i, t) for i, t, _, _ in ODD], 256)
    assert window_packing.pack_windows(window_packing.cut_windows(odd.limit(0), WORD_BPE)).count() == 0


def test_segment_tree_equals_a_plain_search():
    from trendloom.llm import window_packing

    rng = np.random.default_rng(11)
    for trial in range(30):
        capacity = int(rng.integers(1, 200))
        length = np.sort(rng.integers(1, capacity + 1, 400))[::-1] if trial % 2 else rng.integers(1, capacity + 1, 400)
        where = window_packing.tightest_windows(length, capacity)
        left = []
        for need, at in zip(length.tolist(), where.tolist()):
            tightest = min((r for r in left if r >= need), default=None)
            if tightest is None:
                assert at == len(left)
                left.append(capacity)
            else:
                assert left[at] == tightest
            left[at] -= need
    with pytest.raises(ValueError):
        window_packing.tightest_windows(np.array([5]), 4)


def test_rows_of_phrases_do_not_grow_with_the_splits(spark, monkeypatch):
    """The pass with strings has as many tasks as there are cores, however many splits the table has."""
    from trendloom.llm import phrases

    tasks, mined = [], phrases.mined
    monkeypatch.setattr(phrases, "mined", lambda docs, *a: tasks.append(docs.rdd.getNumPartitions()) or mined(docs, *a))
    docs = spark.createDataFrame([(i, "en", "one two three four") for i in range(80)], "doc_id long, lang string, text string").repartition(40)
    got = {(r.phrase, r["count"]) for r in phrases.frequent_phrases(docs, least=80).collect()}
    assert tasks[-1] <= spark.sparkContext.defaultParallelism < tasks[0] and ("one two three four", 80) in got and len(got) == 11
