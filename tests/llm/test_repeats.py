"""Substring dedup against brute force: words (suffix trees) and bytes (bucket-pointer refinement)."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfund.llm import common, suffix_buckets, suffix_trees, windows
from quillfund.llm.common import keyed
from quillfund.llm.suffix_buckets import refine
from quillfund.llm.suffix_trees import remove_repeated_words

DOCS = "doc_id long, text string, start int, key string"


def units_left(units, length, seen):
    gone = set()
    for i in range(len(units) - length + 1):
        if seen[tuple(units[i : i + length])] > 1:
            gone |= set(range(i, i + length))
    return gone


def brute(units, length):
    seen = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    return [units_left(u, length, seen) for u in units]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["é", "日本", "a", "a", "a"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 140))] for _ in range(4)]
    texts = [None, "", "  \n ", "short", "a " * 300, "ab" * 700, " ".join(f"only{k}" for k in range(200))]
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        texts.append("".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words))
    texts += [texts[10], texts[11], texts[11].replace("w1", "x1")]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)]
    return rows + [rows[12], (None, texts[13], 1, "x"), (None, texts[13], 1, "x"), (3, texts[14], 1, "x")]


@pytest.mark.parametrize("limits", [{}, {"group_texts": 2}, {"group_texts": 7, "batch_bytes": 3000}])
def test_words(spark, limits, monkeypatch):
    if limits:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)  # side tables are shuffled
    rows = corpus(1)
    found = suffix_trees.remove_repeated_words(spark.createDataFrame(rows, DOCS), **limits)
    got = Counter((r.doc_id, " ".join(r.kept), sum(s.end - s.begin for s in r.removed)) for r in found.collect())
    units = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _, _ in rows]
    expected = Counter((r[0], " ".join(w for i, w in enumerate(u) if i not in g), len(g)) for r, u, g in zip(rows, units, brute(units, 35), strict=True))
    assert sum(v[2] * c for v, c in expected.items()) > 1000
    assert got == expected


@pytest.mark.parametrize("limits", [{}, {"group_texts": 2, "batch_bytes": 3000}])
def test_bytes(spark, limits, monkeypatch):
    if limits:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)  # side tables are shuffled
    rows = corpus(2)
    found = suffix_buckets.remove_repeated_bytes(spark.createDataFrame(rows, DOCS), **limits)
    got = Counter((r.doc_id, bytes(r.kept), tuple((s.begin, s.end) for s in r.removed)) for r in found.collect())
    units = [(t or "").encode() for _, t, _, _ in rows]
    expected = Counter()
    for r, u, g in zip(rows, units, brute(units, 400), strict=True):
        edges = [i for i in range(len(u) + 1) if (i in g) != (i - 1 in g)]
        expected[r[0], bytes(b for i, b in enumerate(u) if i not in g), tuple(zip(edges[::2], edges[1::2], strict=True))] += 1
    assert sum(bool(v[2]) for v in expected) > 5
    assert got == expected


def test_refine_names_equal_strings():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1400] = text[:400]
    ends = np.where(np.arange(3000) < 1700, 1700, 3000)
    for length in (3, 8, 13, 50, 64):
        bucket = refine(text, ends, length)
        strings = {}
        for i in range(3000):
            if i + length > ends[i]:
                assert bucket[i] == -1
            else:
                assert strings.setdefault(bytes(text[i : i + length]), bucket[i]) == bucket[i]
        assert len(set(strings.values())) == len(strings)


def test_deep_nodes_are_the_repeats():
    rng = np.random.default_rng(8)
    for _ in range(40):
        size = int(rng.integers(1, 120))
        words = rng.integers(0, 3, size).astype(np.uint64)
        words[: size // 3] = words[size // 3 : 2 * (size // 3)]
        cut = int(rng.integers(1, size + 1))
        ends = np.where(np.arange(size) < cut, cut, size)
        for length in (1, 2, 5, 8, 11):
            tree = suffix_trees.SuffixTree(words, ends, length)
            first, last, depth, maximal = tree.deep_nodes()
            got = {frozenset(tree.order[a : b + 1].tolist()): (d, m) for a, b, d, m in zip(first, last, depth, maximal, strict=True)}
            places = {}
            for i in range(size):
                if i + length <= ends[i]:
                    places.setdefault(tuple(words[i : i + length]), []).append(i)
            places = {frozenset(p): p for p in places.values() if len(p) > 1}
            assert set(got) == set(places)
            for node, p in places.items():
                more = length
                while all(i + more < ends[i] for i in p) and len({words[i + more] for i in p}) == 1:
                    more += 1
                before = {(i, None) if i in (0, cut) else words[i - 1] for i in p}
                assert got[node][1] == (len(before) > 1)
                assert got[node][0] == more or more > got[node][0] >= 2 * (1 << (length.bit_length() - 1)) - 1
            again = np.flatnonzero(suffix_trees.repeated(words, ends, length)).tolist()
            assert again == sorted(i for p in places.values() for i in p)
    assert len(suffix_trees.repeated(np.zeros(0, np.uint64), np.zeros(0, np.int64), 35)) == 0


def test_a_prefix_that_many_texts_share(spark):
    """One passage in every text: its groups are dealt out by ever longer prefixes, and no copy is lost."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(50)]
    rows = [(k, " ".join([word() for _ in range(60)] + passage[: 50 - k % 3] + [word() for _ in range(60)]), 1, "x") for k in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    units = [t.split() for _, t, _, _ in rows]
    for r, gone in zip(sorted(suffix_trees.remove_repeated_words(docs, group_texts=5).collect(), key=lambda r: r.doc_id), brute(units, 35), strict=True):
        assert {i for s in r.removed for i in range(s.begin, s.end)} == gone
    bytes_of = [list(t.encode()) for _, t, _, _ in rows]
    for r, gone in zip(sorted(suffix_buckets.remove_repeated_bytes(docs, length=150, group_texts=5).collect(), key=lambda r: r.doc_id), brute(bytes_of, 150), strict=True):
        assert {i for s in r.removed for i in range(s.begin, s.end)} == gone


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffix_trees.remove_repeated_words(empty).count() == 0
    assert suffix_buckets.remove_repeated_bytes(empty).count() == 0


def test_query_digests(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, DOCS)
    row = suffix_buckets.remove_repeated_bytes(docs).where("doc_id = 6").select(F.sha2("kept", 256)).first()[0]
    assert row == hashlib.sha256(rows[6][1].encode()).hexdigest()


def test_runs_name_equal_windows_alike(monkeypatch):
    monkeypatch.setattr(windows, "CHUNK_BITS", 10)
    monkeypatch.setattr(windows, "_MASK", np.uint64(1023))
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    data[3000:3600] = data[100:700]
    data[4000:4500] = 97
    start, n, key, _, _, loop = windows.runs(windows.byte_units(data), 400, 24, data)
    assert n.sum() == 5000 - 399 and (np.cumsum(n)[:-1] == start[1:]).all()
    keys, loops = np.repeat(key, n), np.repeat(loop, n)
    seen = {}
    for i in range(len(keys)):
        first = seen.setdefault(bytes(data[i : i + 400]), i)
        assert keys[first] == keys[i]
        # An equal window is in another run, or in a run that is marked.
        assert first == i or loops[i] or np.searchsorted(start, first, side="right") != np.searchsorted(start, i, side="right")


def test_very_long_texts(spark):
    rng = np.random.default_rng(6)
    a, b = (rng.integers(97, 123, size).astype(np.uint8) for size in (1_500_000, 1_200_000))
    b[1_100_000:1_101_000] = a[1_048_000:1_049_000]  # across the border of a chunk in the one, not in the other
    b[1_099_999], b[1_101_000] = 65, 66
    docs = spark.createDataFrame([(1, bytes(a).decode()), (2, bytes(b).decode())], "doc_id long, text string")
    found = suffix_buckets.repeated_spans(keyed(docs)).collect()
    assert {(r.doc_id, tuple((s.begin, s.end) for s in r.items)) for r in found} == {(1, ((1_048_000, 1_049_000),)), (2, ((1_100_000, 1_101_000),))}
    words = [f"w{k}" for k in rng.integers(0, 10**9, 60_000)]
    words[50_000:50_040] = words[10:50]
    found = suffix_trees.repeated_spans(keyed(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))).collect()
    assert [(s.begin, s.end) for r in found for s in r.items] == [(10, 50), (50_000, 50_040)]


def test_words_that_beat_polynomial_hashes(spark):
    """Thue-Morse words and their complements clash under every polynomial modulo 2**64; letters cut into other words don't."""
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{k}" for k in range(34))
    rows = [(1, f"{same} {thue}"), (2, f"{same} {other}"), (3, f"{' '.join(f'v{k}' for k in range(33))} ab c"), (4, f"{' '.join(f'v{k}' for k in range(33))} a bc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: sum(s.end - s.begin for s in r.removed) for r in remove_repeated_words(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    rows.append((5, rows[0][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: sum(s.end - s.begin for s in r.removed) for r in remove_repeated_words(docs).collect()} == {1: 35, 2: 0, 3: 0, 4: 0, 5: 35}
