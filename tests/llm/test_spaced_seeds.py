"""Decontamination: lossless seeds, and overlaps against all alignments."""

import itertools
import random

import numpy as np
import pytest

from quillfund.llm.spaced_seeds import IDENTITY, LEAST_WORDS, MASKS, OVERLAP, SHORT_MASK, clean, leaks, overlap, words_of

DOCS = "doc_id long, text string, item_id long, words string"


def test_masks_find_every_two_substitutions():
    for bad in itertools.combinations(range(OVERLAP), 2):
        assert any(all(s + p not in bad for p in mask) for mask in MASKS for s in range(OVERLAP - mask[-1]))
    for n in range(LEAST_WORDS, OVERLAP):
        for bad in itertools.combinations(range(n), int(n * (1 - IDENTITY) + 1e-9)):
            assert any(all(s + p not in bad for p in SHORT_MASK) for s in range(n - SHORT_MASK[-1]))


def test_masks_find_every_fifth_replaced():
    # Longer overlaps need no try: one of two halves of at least 13 words has its share of equal words.
    for n in range(OVERLAP, 2 * OVERLAP):
        bad = np.array([sum(1 << p for p in places) for places in itertools.combinations(range(n), n // 5)])
        for mask in MASKS:
            for s in range(n - mask[-1]):
                bad = bad[bad & sum(1 << (s + p) for p in mask) != 0]
        assert not len(bad), (n, [p for p in range(n) if bad[0] >> p & 1])


def test_every_fifth_replaced_is_found(spark):
    rng = random.Random(3)
    items = [[f"w{k}x{j}" for j in range(n)] for k, n in enumerate(range(OVERLAP, 31))]
    lost = {15: (2, 5, 8), 16: (3, 7, 11), 20: (1, 8, 10, 13)}
    docs = []
    for k, item in enumerate(items):
        for turn in range(12):
            n = len(item)
            gone = lost[n] if turn == 0 and n in lost else rng.sample(range(1, n - 1), n // 5)
            copy = [f"r{turn}" if p in gone else w for p, w in enumerate(item)]
            docs.append((100 * k + turn, " ".join(["before"] * rng.randrange(20) + copy + ["after"] * rng.randrange(20)), 1, "x"))
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert found == {(d[0], d[0] // 100) for d in docs}


def stretch(same):
    best = 0
    for a in range(len(same)):
        for b in range(a + 1, len(same) + 1):
            if same[a] and same[b - 1] and sum(same[a:b]) >= IDENTITY * (b - a) - 1e-9:
                best = max(best, b - a)
    return best


def test_overlap_is_the_longest():
    rng = random.Random(1)
    for _ in range(400):
        same = [rng.random() < rng.choice([0.5, 0.8, 0.9]) for _ in range(rng.randrange(1, 30))]
        a = np.arange(len(same))
        size, equal = overlap(a, np.where(same, a, -1))
        assert size >= stretch(same) - 4 and (size == 0 or equal >= IDENTITY * size - 1)


def test_overlap_is_exactly_the_longest():
    rng = random.Random(4)
    cases = [[True] * 12 + [False] * 20 + [True] * 6 + [False] * 2 + [True] * 5]
    cases += [[rng.random() < rng.choice([0.5, 0.8, 0.9]) for _ in range(rng.randrange(1, 45))] for _ in range(400)]
    for same in cases:
        a = np.arange(len(same))
        size, equal = overlap(a, np.where(same, a, -1))
        assert size == stretch(same) and equal >= IDENTITY * size - 1e-9
        assert size == 0 or any(same[k] and same[k + size - 1] and sum(same[k : k + size]) == equal for k in range(len(same) - size + 1))


def test_edge_replacements(spark):
    docs, bench, expected = [], [], set()
    for n in (5, 6, 8, 10, 12, 13, 15, 20):
        item = [f"w{n}x{j}" for j in range(n)]
        bench.append((n, " ".join(item)))
        most = n // 5
        for turn, gone in enumerate([range(most), range(n - most, n), [0, *range(n - most + 1, n)], range(most + 1), range(n - 2 * n // 5, n)]):
            copy = ["r" if p in gone else w for p, w in enumerate(item)]
            same = [p not in gone for p in range(n)]
            if len(set(gone)) <= most or stretch(same) >= OVERLAP:
                expected.add((100 * n + turn, n))
            docs.append((100 * n + turn, " ".join(["before"] * turn + copy + ["after"] * turn), 1, "x"))
    # The longer untrimmed stretch of equal words hides the one that counts.
    item = [f"long{j}" for j in range(45)]
    bench.append((45, " ".join(item)))
    docs.append((45, " ".join(f"r{j}" if 12 <= j < 32 or j in (38, 39) else w for j, w in enumerate(item)), 1, "x"))
    expected.add((45, 45))
    found = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert all(r.equal_words >= IDENTITY * r.overlap_words for r in found)


@pytest.mark.parametrize("exact", [2_000_000, 0])
def test_against_all_alignments(spark, exact):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(2000)}"
    items = [[word() for _ in range(n)] for n in (5, 8, 12, 13, 20, 45, 70)]
    benchmark = [(k, " ".join(i), "x") for k, i in enumerate(items)] + [(50, None, "x"), (51, "", "x"), (52, "too short", "x"), (53, " ".join(items[4]), "x"), (None, " ".join(items[5]), "x"), (4, " ".join(items[4]), "x")]
    docs, planted = [(0, None, 1, "x"), (1, "", 1, "x")], set()
    for k in range(2, 80):
        text = [word() for _ in range(rng.randrange(0, 300))]
        if k % 3 == 0:
            which = rng.randrange(len(items))
            copy = [w if w not in () else w for w in items[which]]
            for at in rng.sample(range(1, len(copy) - 1), int(len(copy) * 0.15)):
                copy[at] = "replaced"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in copy]
            planted.add((k, which))
        docs.append((k, " ".join(text), 1, "x"))
    docs += [docs[3 * 2], (None, docs[6][1], 1, "x")]
    table, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(benchmark, "item_id long, text string, doc_id string")
    found = leaks(table, bench, exact_seeds=exact).collect()
    assert planted <= {(r.doc_id, r.item_id) for r in found}
    expected = set()
    for doc, text, _, _ in docs:
        words = words_of(text or "")
        for item, passage, _ in benchmark:
            target = words_of(passage or "")
            if len(target) < LEAST_WORDS:
                continue
            for shift in range(1 - len(target), len(words)):
                a, b = max(0, shift), min(len(words), shift + len(target))
                if b - a >= min(OVERLAP, len(target)) and overlap(words[a:b], target[a - shift : b - shift])[0] >= min(OVERLAP, len(target)):
                    expected.add((doc, item))
    assert {(r.doc_id, r.item_id) for r in found} == expected
    kept = clean(table, bench)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if d[0] not in {e[0] for e in expected})


def test_items_of_few_words_match_whole_documents_only(spark):
    table = spark.createDataFrame([(1, "Two, words!", 1, "x"), (2, "two words more", 1, "x"), (3, "words two", 1, "x"), (4, None, 1, "x"), (None, "two words", 1, "x")], DOCS)
    bench = spark.createDataFrame([(7, "two words"), (8, "TWO words."), (9, "..."), (10, "a b c d e f")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id, r.item_words, r.overlap_words, r.equal_words) for r in leaks(table, bench).collect()) == [(0, 7, 2, 2, 2), (0, 8, 2, 2, 2), (1, 7, 2, 2, 2), (1, 8, 2, 2, 2)]
    assert sorted(r.doc_id for r in clean(table, bench).collect()) == [2, 3, 4]


def test_empty_tables(spark):
    table = spark.createDataFrame([(1, "a b c d e f g", 1, "x")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(table, none).count() == 0 and clean(table, none).count() == 1
    assert leaks(table.limit(0), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0
