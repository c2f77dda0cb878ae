"""SimHash groups against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillfund.llm import common
from quillfund.llm.simhash import bucket_links, fingerprint, fingerprint_links, keep_one, near_duplicates, pieces, plan, probes

DOCS = "doc_id long, text string, fp int, component string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, distance):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def corpus():
    rng = random.Random(5)
    texts = [None, "", " \n", "ONE two", "one TWO", "É é ẞ", "a b c d", "A b c d e"]
    for _ in range(40):
        words = [f"v{rng.randrange(900)}" for _ in range(rng.randrange(5, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("\t".join(copy))
    return [(k, t, 1, "x") for k, t in enumerate(texts)]


def test_fingerprints():
    for _, text, _, _ in corpus():
        assert fingerprint((text or "").encode()) == plain(text)


@pytest.mark.parametrize("broadcast", [True, False])
def test_groups(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = corpus()
    rows += [rows[9], (None, rows[10][1], 1, "x"), (4, rows[12][1], 1, "x")]
    values = [plain(r[1]) for r in rows]
    label = components(values, 4)
    least = {g: min((r[0] for r, x in zip(rows, label, strict=True) if x == g and r[0] is not None), default=None) for g in set(label)}
    expected = Counter((r[0], v, least[g]) for r, v, g in zip(rows, values, label, strict=True))
    docs = spark.createDataFrame(rows, DOCS)
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs).collect())
    assert got == expected
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(v for v in least.values())
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_probes_meet():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    for n in (100, 240_000, 10**9, 10**13):
        parts = plan(n, np.full((64, 64), n / 4) + np.eye(64) * n / 4)
        assert sum(t + 1 for _, t in parts) == 5  # the sum of T over all parts is distance - parts + 1
        near = base.copy()
        for row in range(50):
            for bit in rng.choice(64, 4, replace=False):
                near[row] ^= np.uint64(1 << int(bit))
        keys = [set(zip(*(x.tolist() for x in probes(f, parts)), strict=True)) for f in (base, near)]
        assert {p for _, _, p in keys[0] & keys[1]} == set(range(50))


def test_bucket_links_join_what_is_near():
    rng = np.random.default_rng(2)
    values = np.unique(np.concatenate([(rng.integers(0, 1 << 63, 5, dtype=np.uint64)[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (1, 60)).astype(np.uint64))).ravel(), rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    expected = components([int(v) for v in values], 4)
    a, b = bucket_links(values, 4)
    assert (np.bitwise_count(values[a] ^ values[b]) <= 4).all()
    label = list(range(len(values)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        old, new = sorted((label[x], label[y]), reverse=True)
        label = [new if v == old else v for v in label]
    assert len(set(label)) == len(set(expected))
    assert [x.size for x in bucket_links(values[:0], 4)] == [0, 0]


def test_pieces_cut_the_free_bits():
    free = 0xF0F0_0000_0000_00FF
    assert sum(pieces(free, 5)) == free and len(pieces(free, 5)) == 5


@pytest.mark.parametrize("bucket", [40, 100])
def test_crowded_buckets_are_dealt_out(spark, bucket):
    """Fingerprints a few bits from each other fill buckets far beyond the limit."""
    rng = np.random.default_rng(4)
    near = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in rng.integers(0, 1 << 63, 3) for i, j in rng.integers(0, 64, (150, 2))}
    values = sorted(near | {int(x) for x in rng.integers(0, 1 << 63, 100)})
    rows = [(v - (1 << 64) * (v >> 63), k if k % 7 else None) for k, v in enumerate(values)]
    links = fingerprint_links(spark.createDataFrame(rows, "fp long, least long"), bucket=bucket).collect()
    place = {fp: k for k, (fp, _) in enumerate(rows)}
    label = list(range(len(values)))
    for r in links:
        x, y = place[r.a.fp], place[r.b.fp]
        assert (values[x] ^ values[y]).bit_count() <= 4
        assert [(r.a.none, r.a.least), (r.b.none, r.b.least)] == [(rows[k][1] is None, rows[k][1] or 0) for k in (x, y)]
        old, new = max(label[x], label[y]), min(label[x], label[y])
        label = [new if v == old else v for v in label]
    assert label == components(values, 4)
