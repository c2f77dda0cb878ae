import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfund.llm.mixture import Recipe, mix, permuted, shard_texts, taken, targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "b", 1), (2, "", "en", "b", 1), (None, "x y", "en", None, 1), (7, "r s t", "de", "b", 1), (7, "r s t", "de", "b", 1), (7, "r s t", "fr", "a", 1), (8, "a b\x0bc  d", "fr", "é", 1), (9, " \t", "fr", "empty", 1)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(n=400):
    rng = np.random.default_rng(3)
    sources = ["hot", "a", "b", "B", "", None, "\U00010000", "￿"]
    return [(k, " ".join(f"{k}.{j}" for j in range(int(rng.integers(0, 90)))), "en", sources[int(rng.integers(0, 14)) % 14 % 8 if k % 3 else 0], 1) for k in range(n)] + ODD


def level(sizes, weights):
    """The targets, by raising one level for all in small exact steps: where their sum is 150 % of the sizes."""
    goal, low, high = Fraction(3, 2) * sum(sizes), Fraction(0), Fraction(4 * sum(sizes) + 1)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * w, 2 * s) for w, s in zip(weights, sizes, strict=True)) < goal else (low, mid)
    return [float(min(high * w, 2 * s)) for w, s in zip(weights, sizes, strict=True)]


@pytest.mark.parametrize("sizes", [[10, 20, 30, 40], [1, 1, 1000], [0, 5, 0], [1000, 1, 1, 1, 7], [3]])
def test_targets(sizes):
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    found = targets(sizes, weights)
    assert sum(found) == Fraction(3, 2) * sum(sizes)
    assert [float(t) for t in found] == pytest.approx(level(sizes, weights), abs=1e-6)


def test_permutations():
    for n in (1, 2, 3, 7, 16, 100, 1025):
        for key in (0, 5, 1 << 63):
            to = permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(to) == list(range(n))
            assert list(permuted(to, np.full(n, n), np.full(n, key, np.uint64), back=True)) == list(range(n))
    assert list(permuted(np.arange(100), np.full(100, 100), np.full(100, 1, np.uint64))) != list(permuted(np.arange(100), np.full(100, 100), np.full(100, 2, np.uint64)))


def test_quotas_are_met_to_the_word():
    for size in range(0, 60):
        for quota in range(2 * size + 1):
            recipe = Recipe([size, 13], [Fraction(quota), Fraction(5)], 7, 1)
            recipe.drawn = recipe.slots
            n = int(recipe.slots[0])
            block, got = recipe.blocks_of(np.zeros(n, np.int64), np.arange(n))
            assert got.sum() == quota and (got > 0).all()
            assert max(Counter(block.tolist()).values(), default=0) <= 2


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_mix(spark, bound):
    data = rows()
    docs = spark.createDataFrame(data, DOCS).withColumns({"sid": F.lit("x"), "at": F.lit(1), "size": F.lit(2), "target": F.lit("t")})
    made = mix(docs.repartition(5), block=16, shard=8, bound=bound)
    found = taken(made).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((d[0], len(words(d[1]))) for d in data)
    names = sorted({d[3] for d in data} - {None}) + [None]
    sizes = [sum(len(words(d[1])) for d in data if d[3] == s) for s in names]
    wanted = targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    assert {(r["source_size"], round(r["target"], 6)) for r in found} == {(s, round(float(t), 6)) for s, t in zip(sizes, wanted, strict=True)}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    got = Counter()
    for r in made.slots.select("source", F.explode("pieces").alias("p")).select("source", "p.*").collect():
        got[r["source"]] += r["n"]
        assert len(r["text"].split(" ")) == r["n"]
    assert [got[s] for s in names] == [int(t + Fraction(1, 2)) for t in wanted]
    # Every shard is full but the last, and what stands in the mix is what the documents hold, at most twice.
    slots = made.slots.collect()
    sizes_of = Counter(r["shard"] for r in slots)
    assert all(n == 8 for shard, n in sizes_of.items() if shard < max(sizes_of)) and set(sizes_of) == set(range(max(sizes_of) + 1))
    assert len({(r["shard"], r["place"]) for r in slots}) == len(slots) and max(r["place"] for r in slots) < 8
    assert max(Counter((r["sid"], r["block"]) for r in slots).values()) <= 2
    assert len({tuple(sorted(Counter(r["source"] or "" for r in slots if r["shard"] == s).items())) for s in sizes_of}) > 3
    mixed = Counter(w for r in shard_texts(made).collect() for w in r["text"].split(" "))
    held = Counter(w for d in data for w in words(d[1]))
    assert all(n <= 2 * held[w] for w, n in mixed.items())
    # Reruns agree, however the rows are dealt out and whatever else the table holds.
    again = taken(mix(spark.createDataFrame(data[::-1], DOCS).coalesce(1), block=16, shard=8)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["source_size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_hot_repeats_and_tiny_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 1)] * 300 + [(2, "d e", "en", "t", 1)], DOCS)
    found = taken(mix(docs, block=4, shard=4)).collect()
    assert sum(r["taken"] for r in found if r["doc_id"] == 1) == 1349 and sum(r["taken"] for r in found if r["doc_id"] == 2) == 4
    assert sorted({r["target"] for r in found}) == [4.0, 1349.0]
    assert all(r["taken"] <= 2 * r["size"] for r in found) and len(found) == 301
    assert taken(mix(spark.createDataFrame([], DOCS))).collect() == []
    empty = taken(mix(spark.createDataFrame([(1, None, "en", None, 1), (2, "", "en", "a", 1)], DOCS))).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in empty) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
