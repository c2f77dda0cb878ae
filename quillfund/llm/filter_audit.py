"""How a chain of document filters interacts: every order of five filters from one pass of additive counts.

Four filters read one text each; the fifth asks whether an equal text with a smaller id exists anywhere. A counting-Bloom
prepass keeps most texts out of that question's shuffle: each task counts its texts' hashes in a sparse sketch, sketches are
merged block by block, and a text with a counter of one is unique for certain. Only possible repeats are shuffled, with
their whole texts, for the smallest id of each text. A document's failures are a mask of five bits, and all that the report
asks is additive over (part, mask), so 120 orders cost no more than one.

The sketch has 16 counters for each document, in blocks that one hash chooses, so blocks merge independently at any size;
0.3 % of unique texts are expected to pass as possible repeats, which costs a shuffle and never a wrong count.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.llm.common import BROADCAST_BYTES, table, written
from quillfund.llm.windows import texts

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = b"#$%&*|"
DUPLICATE = 1 << LETTERS.index("E")
#: Counters of a block (in four parts, one for each hash of a text), and of each document.
BLOCK, PART, PER_DOCUMENT = 1 << 13, 1 << 11, 16
#: Texts whose counters a task gathers before it hands them on.
SKETCH_ROWS = 1 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def failures(text: bytes) -> int:
    """The filters A to D that a UTF-8 text fails, as a mask."""
    data = np.frombuffer(text, np.uint8)
    words = text.split()  # at ASCII white space
    few, poor = len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    points = np.count_nonzero((data & 0xC0) != 0x80)
    loud = 100 * np.count_nonzero((data >= 65) & (data <= 90)) > MOST_CAPITALS * points
    return few | poor << 1 | bool(loud) << 2 | bool(_SYMBOL[data].any()) << 3


def with_masks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``mask`` in place of ``text``."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def measure(batches):
        for batch in batches:
            masks = pa.array([failures(x.tobytes()) for x in texts(batch, "text")], pa.int32())
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, masks], [*(f.name for f in kept), "mask"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(measure, f"{schema}, mask int")


def cells(h: Column) -> list[Column]:
    """The four counters of a text within its block, one in each part."""
    return [F.shiftrightunsigned(F.xxhash64(h), 13 * k).bitwiseAND(PART - 1).cast("int") + k * PART for k in range(4)]


def repeat_sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """block, bits: which of the block's counters reached two, 64 to a number, from the column ``h`` of ``hashes``."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)]))
            size += batch.num_rows
            if size >= SKETCH_ROWS:
                yield sketch(held)
                held, size = [], 0
        if size:
            yield sketch(held)

    def sketch(held):
        block, *at = np.concatenate(held, axis=1)
        cell, n = np.unique(np.concatenate([block * BLOCK + a for a in at]), return_counts=True)
        first = np.flatnonzero(np.diff(cell // BLOCK, prepend=-1))
        counters = pa.array(((cell % BLOCK) * 2 + (n > 1)).astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(cell)).astype(np.int32)), counters)
        return pa.RecordBatch.from_arrays([pa.array(cell[first] // BLOCK), lists], ["block", "counters"])

    def merge(batches):
        block, total = None, None
        for batch in batches:
            for at, counters in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != block:
                    if block is not None:
                        yield emit(block, total)
                    block, total = at, np.zeros(BLOCK, np.uint8)
                found = counters.values.to_numpy()
                total[found >> 1] = np.minimum(total[found >> 1] + 1 + (found & 1), 2)  # each counter stands once in a row
        if block is not None:
            yield emit(block, total)

    def emit(block, total):
        bits = np.packbits(total > 1, bitorder="little").view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bits], pa.list_(pa.int64()))], ["block", "bits"])

    placed = hashes.select(F.pmod("h", F.lit(blocks)).alias("block"), *cells(F.col("h")))
    partial = placed.toDF("block", "c0", "c1", "c2", "c3").mapInArrow(count, "block long, counters array<int>")
    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits array<long>")


def possible_repeats(rows: DataFrame, sketch: DataFrame, blocks: int, bound: int) -> DataFrame:
    """The ``rows`` (with ``h``) that the ``sketch`` cannot clear. It is broadcast up to ``bound`` bytes of its own size, two
    for each document; beyond that hashes go to the sketch's blocks."""
    sketch = F.broadcast(sketch) if blocks * BLOCK // 8 <= bound else sketch.hint("shuffle_hash")
    joined = rows.withColumn("block", F.pmod("h", F.lit(blocks))).join(sketch, "block")
    for cell in cells(F.col("h")):
        joined = joined.where(F.getbit(F.element_at("bits", F.shiftright(cell, 6) + 1), cell % 64) == 1)
    return joined.select(rows.columns)


def mask_counts(docs: DataFrame, labels: DataFrame, bound: int = BROADCAST_BYTES, digest=F.xxhash64) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each source by the filters they fail (bit 0 for A to bit 4 for E), and
    how many of them ``labels`` calls good (quality 1) and toxic (1).

    A null text counts as empty, a null source as the empty one. E asks for an equal text with a smaller ``doc_id`` in the
    whole table, so repeated rows don't fail it for each other and a null id never does. Of several labels of a document
    any counts, those with a null id none; empty tables give an empty result; other columns are not read.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("text"), digest(text).cast("long").alias("h"))
    flags = written(with_masks(rows), "flags")
    blocks = -(-max(1, flags.count()) * PER_DOCUMENT // BLOCK)
    sketch = written(repeat_sketch(flags, blocks), "sketch")
    # Whole texts meet here, after partial minima in each task, so that a group of copies sends one row a task.
    groups = written(possible_repeats(rows.select("doc_id", "text", "h"), sketch, blocks, bound).groupBy("text", "h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("c")), "repeats")
    by_hash = groups.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.max("first").alias("first"), F.max("c").alias("c"))
    by_hash = written(by_hash.where("c > 1"), "repeated-hashes")
    plain, mixed = by_hash.where("texts = 1").select("h", "first"), by_hash.where("texts > 1").select("h")
    side = F.broadcast(plain) if plain.count() * 40 <= bound else plain.hint("shuffle_hash")
    found = flags
    if not mixed.isEmpty():  # different texts of one hash: those are compared as texts
        found = flags.join(mixed, "h", "left_anti")
    found = found.join(side, "h", "left").select("doc_id", "part", "mask", "first")
    if not mixed.isEmpty():
        again = rows.join(mixed, "h", "left_semi").join(groups.select("text", "first"), "text")
        found = found.unionByName(with_masks(again.select("doc_id", "part", "text", "first")).select("doc_id", "part", "mask", "first"))
    found = found.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), DUPLICATE).otherwise(0)).alias("mask"))
    marks = written(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*[F.max(F.coalesce(labels[c] == 1, F.lit(False)).cast("int")).alias(f"_{c}") for c in ("quality", "toxic")]), "marks")
    marks = F.broadcast(marks) if marks.count() * 40 <= bound else marks.hint("shuffle_hash")
    joined = found.join(marks, found["doc_id"] == marks["_id"], "left")
    sums = [F.sum(F.coalesce(F.col(f"_{c}"), F.lit(0))).cast("long") for c in ("quality", "toxic")]
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), sums[0].alias("good"), sums[1].alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """The report of every part, order and step from ``mask_counts``: 600 rows for each part."""
    orders = F.split(F.lit(",".join(map("".join, permutations(LETTERS)))), ",")
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # 32 masks at most
    rows = rows.select("part", "rows", F.explode(orders).alias("filter_order")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    rows = rows.withColumn("bit", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - 65)"))
    rows = rows.withColumn("earlier", F.expr("aggregate(sequence(1, step), 0, (acc, k) -> acc | shiftleft(1, ascii(substring(filter_order, k, 1)) - 65)) - bit"))

    def total(what, where) -> Column:
        return F.aggregate(F.filter("rows", where), F.lit(0).cast("long"), lambda acc, r: acc + what(r))

    fails, before = (lambda r: r["mask"].bitwiseAND(F.col("bit")) != 0), (lambda r: r["mask"].bitwiseAND(F.col("earlier")) != 0)
    removed = lambda r: fails(r) & ~before(r)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda r: r["n"], lambda r: ~fails(r) & ~before(r)).alias("kept"),
        total(lambda r: r["n"], removed).alias("removed"),
        total(lambda r: r["n"], lambda r: fails(r) & before(r)).alias("redundant"),
        total(lambda r: r["n"], lambda r: r["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda r: r["good"], removed).alias("good_lost"),
        total(lambda r: r["toxic"], removed).alias("toxic_lost"),
        # Of the 120 orders, one in popcount(mask) meets this filter first among those the document fails.
        total(lambda r: r["n"] * (F.lit(120) / F.bit_count(r["mask"])).cast("long"), fails).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS f FROM documents),
 l AS (SELECT doc_id AS i, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
 m AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
   + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > f THEN 16 ELSE 0 END AS mask
   FROM d LEFT JOIN l ON l.i = d.doc_id),
 c AS (SELECT part, mask, count(*) AS n, sum(q) AS good, sum(x) AS toxic, bit_count(mask) AS bits FROM m GROUP BY part, mask),
 f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v (letter, bit)),
 o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
 s AS (SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(list_concat([0], bits[1 : step - 1])) AS INTEGER) AS earlier FROM (SELECT *, unnest(range(1, 6)) AS step FROM o) y)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(sum(CASE WHEN mask & bit = 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost, CAST(sum(CASE WHEN mask & bit <> 0 THEN n * (120 // c.bits) ELSE 0 END) AS BIGINT) AS shapley
FROM c CROSS JOIN s GROUP BY part, filter_order, step
"""
