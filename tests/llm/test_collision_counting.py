"""Vector links against all pairs."""

import math

import numpy as np
import pytest

from quillfund.llm.collision_counting import calibrate, near_duplicates, usable

VECTORS = "vec_id long, embedding array<float>, label string, node long"


def brute(rows):
    ok = {k: np.array(r[1], np.float32).astype(float) for k, r in enumerate(rows) if r[0] is not None and r[1] is not None and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(r[1])}
    ok = {k: v / np.linalg.norm(v) for k, v in ok.items()}
    keys = list(ok)
    links = {k: [j for j in keys if j != k and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] >= 0.9] for k in keys}
    label = {k: rows[k][0] for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for k in keys:
            low = min([label[k], *(label[j] for j in links[k])])
            if low < label[k]:
                label[k], changed = low, True
    return [(r[0], len(links.get(k, [])), label[k]) for k, r in enumerate(rows)]


def corpus(seed, groups, near):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(24) for _ in range(300)]
    for _ in range(groups):
        base = rng.standard_normal(24)
        rows += [base + near * rng.standard_normal(24) for _ in range(rng.integers(2, 40))]
    rows = [(k, [float(np.float32(x)) for x in v], "x", 1) for k, v in enumerate(rows)]
    rng.shuffle(rows)
    rows = [(k, r[1], "x", 1) for k, r in enumerate(rows)]
    rows += [(900, rows[5][1], "a", 2), (900, rows[5][1], "a", 2), (901, [2 * x for x in rows[5][1]], "a", 2), (902, None, "a", 2), (903, [0.0] * 24, "a", 2), (904, [math.nan, *rows[5][1][1:]], "a", 2), (905, [None, *rows[5][1][1:]], "a", 2), (906, [math.inf, *rows[5][1][1:]], "a", 2), (907, [], "a", 2), (908, [1.0, 2.0], "a", 2), (909, [1.0, 2.1], "a", 2), (None, rows[5][1], "a", 2), (910, [-3.0], "a", 2), (911, [-1.0], "a", 2)]
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_links_against_all_pairs(spark, block):
    rows = corpus(1, 8, 0.1)
    got = sorted(near_duplicates(spark.createDataFrame(rows, VECTORS), block=block).collect(), key=str)
    expected = brute(rows)
    assert sum(e[1] for e in expected) > 500
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append(r)
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= 0.97 * sum(e[1] for e in expected)
    for vec, n, component in expected:
        for r in found[vec]:
            assert r.n_links <= n
            assert r.component_id == component and r.kept == (vec == component)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(0, 1200, 2):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= (y @ x) * x
        y = 0.905 * x + math.sqrt(1 - 0.905**2) * y / np.linalg.norm(y)
        rows += [(k, x.tolist(), "x", 1), (k + 1, y.tolist(), "x", 1)]
    got = near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert sum(r.n_links for r in got) >= 0.93 * sum(e[1] for e in brute(rows))
    assert calibrate(1000, 64).lists <= 64


def test_empty_and_unusable(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(1, None, "x", 1), (2, [0.0], "x", 1)], VECTORS)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(rows).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert rows.where(usable("embedding")).count() == 0


def test_planted_pairs_among_many(spark):
    """Pairs at 0.90 to 0.92 among vectors that have nothing to do with them, so that lists hold many collisions."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((800, 32))
    y -= (y * x[:800]).sum(axis=1, keepdims=True) * x[:800]
    cosine = rng.uniform(0.9, 0.92, (800, 1))
    vectors = np.concatenate([x, cosine * x[:800] + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)]).astype(np.float32)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    expected = np.zeros(len(unit), int)
    for at in range(0, len(unit), 2000):
        expected[at : at + 2000] = (unit[at : at + 2000] @ unit.T >= 0.9).sum(axis=1) - 1
    assert expected.sum() >= 1500
    rows = [(k, v, "x", 1) for k, v in enumerate(vectors.tolist())]
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert all(got[k] <= expected[k] for k in got)
    assert sum(got.values()) >= 0.95 * expected.sum()


def test_plans_that_miss_the_recall_are_refused():
    assert calibrate(10**5, 64).count >= 2
    with pytest.raises(ValueError, match="no plan"):
        calibrate(10**5, 64, threshold=0.2)
