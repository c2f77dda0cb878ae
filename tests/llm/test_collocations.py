import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillfund.llm.collocations import Summary, Words, collocations, cut_scores, survivors, tokenised

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def expected(rows, threshold, top):
    f, n = Counter(), Counter()
    for _, text, lang, _, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= threshold:
            score, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found[lang, w] = (a, left, right, score)
    out = []
    for lang in n:
        own = [(w, x) for (of, w), x in found.items() if of == lang and not any(of == z and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * y[0] >= 50 * x[0] for (z, v), y in found.items())]
        own.sort(key=lambda e: (-e[1][3], -e[1][0], " ".join(e[0]).encode()))
        out += [(lang, k, " ".join(w), x[0], x[1], x[2], n[lang], x[3]) for k, (w, x) in enumerate(own[:top], 1)]
    return sorted(out)


def rows():
    rng = np.random.default_rng(11)
    vocabulary = ["New", "york", "city", "la", "Éa", "a|b", "x y", " ", "the", "of", "\U00010000", "￿", "İ"]
    join = [" ", " ", " ", "\t ", ", ", ".", "\x0b", "\x85", "?"]
    text = lambda n: "".join(vocabulary[min(int(rng.exponential(4)), 12)] + join[int(rng.integers(0, 9))] for _ in range(n))
    out = [(k, text(int(rng.integers(0, 40))), ["en", "de", None, "und", ""][k % 5], "s", 1) for k in range(150)]
    return out + [(1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, "lone", "nothing", "s", 1), (4, "", "empty", "s", 1), (5, " ".join(["ha"] * 5000), "en", "s", 1)] + [(6, "red herring: RED  herring!", "fr", "s", 1)] * 7


@pytest.mark.parametrize(("threshold", "top", "bound"), [(3, 2000, 64 << 20), (10, 5, 0), (14, 2000, 0)])
def test_against_every_phrase(spark, threshold, top, bound):
    docs = spark.createDataFrame(rows(), DOCS).withColumns({"phrase": F.lit("p"), "words": F.lit(1), "f": F.lit("x")})
    found = collocations(docs.repartition(5), threshold, top, bound=bound).collect()
    assert sorted(map(tuple, found)) == expected(rows(), threshold, top)
    assert found


@pytest.mark.parametrize("chunk", [1, 7, 50, 1 << 20])
def test_pieces_are_cut_nowhere_else(chunk):
    """However texts are cut for tokenising, the same phrases are counted."""
    own = [r for r in rows() if r[2] is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in own]), pa.array([r[1] or "" for r in own])], ["lang", "text"])
    found = Counter()
    for lang, words in tokenised([batch], chunk):
        for n in (1, 2, 3):
            at = np.flatnonzero(words.inside(n))
            if len(at):
                phrases, counts = words.phrases(at, n)
                found.update({(lang, p): c for p, c in zip(phrases.to_pylist(), counts.tolist(), strict=True)})
    expected_counts = Counter()
    for _, text, lang, _, _ in own:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            expected_counts.update((lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert found == expected_counts


def test_empty(spark):
    assert collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None, None, None), (2, "a b", "en", "s", 1)], DOCS)).collect() == []


def test_summaries_lose_no_frequent_item():
    rng = np.random.default_rng(5)
    for threshold in (2, 5, 10):
        items = np.concatenate([rng.zipf(1.3, 20_000) % 5000, np.repeat(np.arange(9000, 9100), threshold)])
        rng.shuffle(items)
        summary = Summary(len(items) // threshold + 1)
        small = Summary(len(items) // threshold // 8)
        for part in np.array_split(items, 37):
            h, c = np.unique(part, return_counts=True)
            for s in (summary, small):
                s.merge(h, c)
                s.settle()
        true = dict(zip(*(x.tolist() for x in np.unique(items, return_counts=True)), strict=True))
        for s, bound in ((summary, threshold - 1), (small, 8 * threshold)):
            h, c = s.settle()
            counters = dict(zip(h.tolist(), c.tolist(), strict=True))
            assert len(h) <= s.capacity and s.lost <= bound
            assert all(counters.get(x, 0) <= n <= counters.get(x, 0) + s.lost for x, n in true.items())


def test_merged_summaries_find_all(spark):
    items = np.concatenate([np.arange(40_000), np.repeat(np.arange(50_000, 50_200), 10), np.repeat([77], 9000)])
    np.random.default_rng(2).shuffle(items)
    for partitions in (1, 7):
        rows = []
        for part in np.array_split(items, 9):
            h, c = np.unique(part, return_counts=True)
            for p in range(partitions):
                own = h % partitions == p
                rows += [(p, (h[own] // partitions).tolist(), c[own].tolist()), (p, [], [int(c[own].sum())])]
        local = spark.createDataFrame(rows, "p int, h array<int>, c array<long>").repartition(9)
        kept = {r["h"] for r in survivors(local, 10, partitions).collect()}
        assert kept >= {*range(50_000, 50_200), 77}
        assert len(kept) < 4800


def test_phrases_are_counted_as_texts():
    words = Words(np.frombuffer(b"a b c a b. a  b\tc", np.uint8))
    phrases, counts = words.phrases(np.flatnonzero(words.inside(2)), 2)
    assert dict(zip(phrases.to_pylist(), counts.tolist(), strict=True)) == {"a b": 3, "b c": 2, "c a": 1}
    assert len(Words(np.frombuffer(b" .,\t", np.uint8)).code) == 0 and len(Words(np.zeros(0, np.uint8)).code) == 0


def test_scores_beyond_64_bits(spark):
    cases = [(3_000_000_000_000_001, 3_000_000_000_000_003, 3_000_000_000_000_001), (10, 10, 10), (7, 11, 13), (999_999_999_999_999, 10**15, 10**16)]
    found = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", cut_scores(F.col("a"), [(F.col("l"), F.col("r"))])["score"].alias("score")).collect()
    assert all(r["score"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in found)
