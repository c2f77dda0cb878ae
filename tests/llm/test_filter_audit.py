import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillfund.llm.filter_audit import audit, failures, mask_counts, possible_repeats, repeat_sketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{k}" for k in range(250))
ROWS = [
    (1, LONG, "en", "s", 1), (2, LONG, "en", "s", 1), (2, LONG, "en", None, 1), (3, LONG + " A", "en", "", 1), (None, LONG, "en", "s", 1), (4, None, "en", "s", 1),
    (5, "", "de", "t", 1), (6, "ABC def", "de", "t", 1), (7, "a " * 300, "de", "t", 1), (8, "a|b" + LONG, "fr", "u", 1), (9, "é\x0bÉÀ A\x85b", "fr", "u", 1), (10, "x" * 300_000, "fr", "u", 1), (11, LONG[::-1], "fr", "ü", 1), (12, LONG[::-1], "fr", "ü", 1),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, 0, 1), (6, None, None), (None, 1, 1), (12, 1, 0), (99, 1, 1)]


def masks(rows):
    """(part, mask, quality, toxic) of each row, by the definition."""
    out = []
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))]
        fails.append(doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows))
        marks = [m for m in MARKS if m[0] is not None and m[0] == doc_id]
        out.append((source or "", {"ABCDE"[k] for k in range(5) if fails[k]}, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    return out


def expected(rows):
    docs, out = masks(rows), []
    for part in {d[0] for d in docs}:
        own = [d[1:] for d in docs if d[0] == part]
        shapley = {x: sum(x in fails and not set(order[: order.index(x)]) & fails for order in permutations("ABCDE") for fails, _, _ in own) for x in "ABCDE"}
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                gone = [d for d in own if x in d[0] and not d[0] & before]
                out.append((part, "".join(order), k + 1, sum(not d[0] & {*before, x} for d in own), len(gone), sum(x in d[0] and bool(d[0] & before) for d in own), sum(d[0] == {x} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone), shapley[x]))
    return sorted(out)


@pytest.mark.parametrize(("bound", "digest"), [(64 << 20, F.xxhash64), (0, F.xxhash64), (64 << 20, F.length), (0, lambda c: F.lit(7))])
def test_against_every_order(spark, bound, digest):
    """Broadcast or shuffled, and with a hash that different texts share."""
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({"h": F.lit(1), "mask": F.lit("m"), "part": F.lit(2)})
    found = audit(mask_counts(docs.repartition(3), spark.createDataFrame(MARKS, LABELS), bound, digest))
    assert sorted(map(tuple, found.collect())) == expected(ROWS)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit(mask_counts(docs, labels)).count() == 0
    assert audit(mask_counts(spark.createDataFrame(ROWS[:2], DOCS), labels)).count() == 600


def test_sketch_clears_unique_texts_only(spark):
    """Every repeat passes, however its copies are dealt out, and nearly no unique text does."""
    rows = spark.range(20_000).select("id", F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(F.col("id"))).alias("h")).repartition(7)
    blocks = 20_000 * 16 // (1 << 13) + 1
    for bound in (1 << 20, 0):
        passed = {r["id"] for r in possible_repeats(rows, repeat_sketch(rows, blocks), blocks, bound).collect()}
        assert passed >= set(range(0, 20_000, 10))
        assert len(passed) - 2000 < 0.01 * 18_000


def test_failures_by_bytes():
    assert failures(b"") == 1
    assert failures("ÀÉ".encode()) == 1
    assert failures(b"A" + b"b" * 49) == 1 and failures(b"A" + b"b" * 48) == 5
    assert failures(LONG.encode()) == 0
