"""Benchmark decontamination with spaced seeds.

A seed hashes the words at some places of a span and skips the others, so a substituted word at a skipped place does not
break it. The three masks below find every overlap of at least 13 words in which any fifth is replaced: a test tries all
patterns of 13 to 25 words, and of a longer overlap one half has as many equal words in proportion. Seeds of all
benchmark items are hashed once; every position of every document is tested against a bitmap of fixed size, and only
what is found there is joined with the items and verified word by word around the hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.llm.common import drop_rows, keyed, table, written
from quillfund.llm.windows import mix, word_units, words_of_texts

#: Places of a span that a seed reads.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 5, 7, 8, 10), (0, 2, 3, 5, 9, 10))
#: For items of fewer than ``OVERLAP`` words: it finds every such item with a fifth of its words replaced.
SHORT_MASK = (0, 1)
#: Words that an overlap has at least, or the whole item if that is shorter; and the least share of equal words.
OVERLAP, IDENTITY = 13, 0.8
#: Items with fewer words are too short to be found inside texts; they match documents that have the same words and no more.
LEAST_WORDS = 5
#: Bits of the bitmap (2 MB), whatever the size of the benchmark.
BITMAP_BITS = 1 << 24
#: Up to so many seeds (16 MB), workers also test hits exactly; beyond, the join alone does.
EXACT_SEEDS = 2_000_000

_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words_of(text: str) -> np.ndarray:
    """Hashes of the lower-cased words; ASCII punctuation and white space separate them."""
    return word_units(np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8), _BETWEEN)


def words_of_batch(texts: list[str], most: int = 1 << 20) -> Iterator[np.ndarray]:
    """``words_of`` of each text, with about ``most`` bytes in hand at once."""
    held, size = [], 0
    for text in texts:
        held.append(np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8))
        size += len(held[-1])
        if size >= most:
            yield from (units for units, _, _ in words_of_texts(held, 0, _BETWEEN, most))
            held, size = [], 0
    yield from (units for units, _, _ in words_of_texts(held, 0, _BETWEEN, most))


def seeds_of(words: np.ndarray, masks) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, position) arrays for each mask."""
    found = []
    for k, mask in enumerate(masks):
        n = max(0, len(words) - mask[-1])
        total = np.full(n, 0x9E3779B97F4A7C15 * (k + 1) % (1 << 64), np.uint64)
        for turn, place in enumerate(mask):
            total = (total ^ words[place : place + n]) * np.uint64(0xD6E8FEB86659FD93 + 2 * turn)
        found.append((mix(total), np.arange(n)))
    return found


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words and equal words of the longest stretch of two aligned sequences that begins and ends on equal words and in
    which ``IDENTITY`` of the words agree."""
    equal = np.flatnonzero(a == b)
    if not len(equal):
        return 0, 0
    share = round(IDENTITY * 1000)
    # A stretch from the i-th to the j-th equal word has its share if end[j] is at least begin[i].
    begin = 1000 * np.arange(len(equal)) - share * equal
    end = begin + 1000 - share
    # The longest stretch begins at a new low and ends at the last place that is as high.
    low = np.flatnonzero(np.concatenate([[True], begin[1:] < np.minimum.accumulate(begin)[:-1]]))
    reach = np.maximum.accumulate(end[::-1])  # ascending, from the end
    last = len(equal) - 1 - np.searchsorted(reach, begin[low], side="left")
    k = int(np.argmax(equal[last] - equal[low]))
    return int(equal[last[k]] - equal[low[k]] + 1), int(last[k] - low[k] + 1)


def agreement(a: np.ndarray, b: np.ndarray, size: int) -> tuple[int, int]:
    """``overlap``, or all of an item of ``size`` words if it is aligned whole and ``IDENTITY`` of its words are equal,
    whichever words are replaced."""
    equal = int(np.count_nonzero(a == b))
    return (size, equal) if len(a) == size and equal * 1000 >= round(IDENTITY * 1000) * size else overlap(a, b)


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    def split(batches):
        for batch in batches:
            words = [words_of(text or "").view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], ["item_id", "item"])

    def seed(batches):
        for batch in batches:
            for words in batch.column(1):
                words = words.values.to_numpy().view(np.uint64)
                masks = (*MASKS, SHORT_MASK) if len(words) < OVERLAP else MASKS
                for h, at in seeds_of(words, masks):
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array([words.view(np.int64)] * len(h), pa.list_(pa.int64()))], ["h", "at", "item"])

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    items = written(source.mapInArrow(split, "item_id long, item array<long>").where(F.size("item") > 0).withColumn("it", F.xxhash64("item")), "items")
    distinct = items.where(F.size("item") >= LEAST_WORDS).groupBy("it").agg(F.first("item").alias("item"))
    seeds = distinct.select("it", "item").mapInArrow(seed, "h long, at int, item array<long>").select("h", "at", F.xxhash64("item").alias("it"))
    return items, written(seeds, "seeds")


def leaks(docs: DataFrame, benchmark: DataFrame, exact_seeds: int = EXACT_SEEDS) -> DataFrame:
    """``doc_id, t, item_id, item_words, overlap_words, equal_words``: one row for each document (of ``docs`` rows) and
    item whose texts overlap: at least ``OVERLAP`` aligned words that begin and end on equal ones, or the whole of an item
    of any length whichever of its words are replaced; in both, ``IDENTITY`` of the words are equal. Items of fewer than
    ``LEAST_WORDS`` words match documents of exactly their words.

    Null and empty texts and items match nothing; repeated documents or items repeat
    rows only where both ids and texts are distinct; empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    items, seeds = _items(benchmark)
    longest, = items.agg(F.coalesce(F.max(F.size("item")), F.lit(0))).first()
    tiny = items.where(F.size("item") < LEAST_WORDS)
    short = not items.where(F.size("item").between(LEAST_WORDS, OVERLAP - 1)).isEmpty()
    whole = not tiny.isEmpty()
    bits = F.pmod("h", F.lit(BITMAP_BITS))
    filled = seeds.groupBy(F.shiftright(bits, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {BITMAP_BITS}) & 63 as int))")).alias("mask")).collect()  # BITMAP_BITS / 64 rows at most
    bitmap = np.zeros(BITMAP_BITS // 64, np.uint64)
    for word, mask in filled:
        bitmap[word] = mask % (1 << 64)
    few = seeds.select("h").distinct().limit(exact_seeds + 1).toPandas()["h"].to_numpy(np.int64)
    exact = np.sort(few) if len(few) <= exact_seeds else None
    shared = spark.sparkContext.broadcast((bitmap.view(np.uint8), exact))
    masks = (*MASKS, SHORT_MASK) if short else MASKS

    def search(batches):
        bitmap, exact = shared.value
        for batch in batches:
            rows, begins, regions, hits = [], [], [], []
            for row, words in enumerate(words_of_batch(batch.column(2).to_pylist())):
                if whole and 0 < len(words) < LEAST_WORDS:
                    rows.append(row)
                    begins.append(0)
                    regions.append(words.view(np.int64))
                    hits.append([])
                    continue
                found_h, found_at = [], []
                for h, at in seeds_of(words, masks):
                    bit = (h.view(np.int64) & (BITMAP_BITS - 1)).astype(np.int64)
                    on = np.flatnonzero(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                    if exact is not None and len(on):
                        place = np.searchsorted(exact, h[on].view(np.int64))
                        on = on[(place < len(exact)) & (exact[np.minimum(place, len(exact) - 1)] == h[on].view(np.int64))]
                    found_h.append(h[on].view(np.int64))
                    found_at.append(at[on])
                h, at = np.concatenate(found_h), np.concatenate(found_at)
                if not len(h):
                    continue
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > longest) + 1):
                    begin = max(0, int(at[part[0]]) - longest)
                    rows.append(row)
                    begins.append(begin)
                    regions.append(words[begin : int(at[part[-1]]) + longest + 1].view(np.int64))
                    hits.append([{"h": int(x), "at": int(y) - begin} for x, y in zip(h[part], at[part], strict=True)])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(begins, pa.int32()), pa.array(regions, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())])))], ["doc_id", "t", "begin", "words", "hits"])

    def verify(batches):
        for batch in batches:
            out = []
            for words, item, shifts in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                words, item = (x.values.to_numpy() for x in (words, item))
                best = (0, 0)
                for shift in shifts:
                    a, b = max(0, shift), min(len(words), shift + len(item))
                    best = max(best, agreement(words[a:b], item[a - shift : b - shift], len(item)))
                out.append((*best, len(item)))
            columns = [pa.array([o[k] for o in out], pa.int32()) for k in (2, 0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), *columns], ["doc_id", "t", "it", "item_words", "overlap_words", "equal_words"])

    regions = written(keyed(docs).mapInArrow(search, "doc_id long, t long, begin int, words array<long>, hits array<struct<h:long,at:int>>"), "regions")
    place = ["doc_id", "t", "begin"]
    hits = regions.select(*place, F.explode("hits").alias("hit")).select(*place, "hit.h", F.col("hit.at").alias("found"))
    shifts = hits.join(seeds, "h").groupBy(*place, "it").agg(F.collect_set(F.col("found") - F.col("at")).alias("shifts"))  # at most a region's words
    same = [regions[c].eqNullSafe(F.col(f"_{c}")) for c in place]
    pairs = shifts.withColumnsRenamed({c: f"_{c}" for c in place}).join(regions.dropDuplicates(place), same).join(items.groupBy("it").agg(F.first("item").alias("item")), "it")
    checked = pairs.select("doc_id", "t", "words", "item", "shifts", "it").mapInArrow(verify, "doc_id long, t long, it long, item_words int, overlap_words int, equal_words int")
    best = checked.where(F.col("overlap_words") >= F.least(F.lit(OVERLAP), "item_words")).groupBy("doc_id", "t", "it", "item_words").agg(F.max(F.struct("overlap_words", "equal_words")).alias("best"))
    found = best.join(items.select("it", "item_id").distinct(), "it").select("doc_id", "t", "item_id", "item_words", "best.overlap_words", "best.equal_words")
    if not whole:
        return found
    size = F.size("words")
    same = regions.where(size < LEAST_WORDS).join(tiny, regions["words"] == tiny["item"]).select("doc_id", "t", "item_id", *[size.alias(c) for c in ("item_words", "overlap_words", "equal_words")])
    return found.unionByName(same.distinct())


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item."""
    return drop_rows(docs, leaks(docs, benchmark).select("doc_id", "t").distinct())


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("t")
