"""Mixing sources to target weights, in fixed-length blocks of words.

The documents of a source, in an order that a hash of their ids and texts gives, are one stream of words, cut into blocks
of ``BLOCK`` words (the last one is shorter); a block can hold parts of several documents, and a document spans blocks.
Output shards have ``SHARD`` slots each. Every shard draws its sources from a multinomial over the targets, on its own, and
the draws' running numbers are mapped through a pseudorandom permutation of each source's block numbers, once for each
pass over the source, so no block comes twice in a pass. Blocks and slots then join by number.

Independent draws miss their totals by about their square root, which would take a source past two passes where its target
is two times its size. So each source has a quota of slots: draws beyond it (chosen by a permutation, so from all shards
alike) are handed to the sources that were drawn too seldom, one by one. Their number is about the root of the number of
slots. Taken words then equal the rounded target, as the last slot of a source is cut to the words still missing.

Prefix sums run in two levels (buckets of documents, groups of shards), so a source with a third of all documents is no
single task's work. One row for each source passes through the driver: the recipe.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfund.llm.common import BROADCAST_BYTES, keyed, table, written
from quillfund.llm.windows import mix as scrambled
from quillfund.llm.windows import texts

WEIGHTS = (5, 2, 1)
#: The mix has so many times the words of all documents, and a source gives at most so many times its own.
SHARE, MOST_PASSES = Fraction(3, 2), 2
BLOCK, SHARD = 1024, 256
#: Sources of a recipe: its rows are driver-side state and a broadcast of 8 bytes each.
MOST_SOURCES = 1_000_000
#: Documents of a bucket and shards of a group, whose prefix sums one task forms.
BUCKET_DOCS, GROUP_SHARDS = 4096, 1024
#: Bytes of pieces that leave a task at once, and copies of a repeated row that one task expands.
PIECE_BYTES, COPIES = 8 << 20, 64


class Mixture(NamedTuple):
    """``documents``: doc_id, size, source_size, target, sid, at, one row for each input row; ``at`` is where its words begin
    in the stream of its source ``sid`` (null without words). ``slots``: shard, place, sid, source, block, words and pieces
    (at, doc_id, begin, n, text), the mix in shards."""

    documents: DataFrame
    slots: DataFrame


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction = SHARE, most: int = MOST_PASSES) -> list[Fraction]:
    """The words that sources of these sizes and weights give: their weight's part of ``share`` times all words, at most
    ``most`` times their size, the excess dealt out by weight among the others until none is above. Exact."""
    left, free, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while free:
        level = left / sum(weights[k] for k in free)
        full = {k for k in free if level * weights[k] > most * sizes[k]}
        if not full:
            for k in free:
                out[k] = level * weights[k]
            break
        for k in full:
            out[k] = Fraction(most * sizes[k])
            left -= most * sizes[k]
        free -= full
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of ``range(n)``, named by ``key``, takes ``x`` (or, ``back``, what it takes there): a
    four-round Feistel network on the next even number of bits, walked until the result is below ``n``."""
    x, n, key = (np.array(a, np.uint64) for a in np.broadcast_arrays(x, n, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float) + 1)).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.flatnonzero(n > 0)
    while len(todo):
        a, b, m = x[todo] >> half[todo], x[todo] & low[todo], low[todo]
        for turn in (3, 2, 1, 0) if back else range(4):
            seed = key[todo] + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))
            if back:
                a, b = b ^ (scrambled(a ^ scrambled(seed)) & m), a
            else:
                a, b = b, a ^ (scrambled(b ^ scrambled(seed)) & m)
        x[todo] = a << half[todo] | b
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


class Recipe:
    """Sizes, targets, quotas and numbers of blocks of the sources, as arrays; ``drawn`` once the draws are counted."""

    def __init__(self, sizes: Sequence[int], wanted: Sequence[Fraction], block: int, seed: int):
        self.block, self.seed, self.drawn = block, seed, None
        self.size = np.array(sizes, np.int64)
        self.quota = np.array([int(t + Fraction(1, 2)) for t in wanted], np.int64)
        self.blocks = -(-self.size // block)
        self.tail = self.size - (self.blocks - 1) * block
        passes, rest = np.divmod(self.quota, np.maximum(self.size, 1))
        # Slots of the last, partial pass: one more if the short block is among them and they fall short.
        slots = -(-rest // block)
        short = np.where(slots > 0, permuted(self.blocks - 1, self.blocks, self.key(np.arange(len(self.size)), passes), back=True) < slots, False)
        words = slots * block - short * (block - self.tail)
        more = words < rest
        # The slot that is added could be the short block only if it is the last one, and then all words are there.
        slots, words = slots + more, np.where(more, np.where(short, words + block, words), words)
        self.slots = passes * self.blocks + slots
        self.over = np.where(rest > 0, words - rest, 0)  # words of the last slot that the quota doesn't need

    def key(self, sid: np.ndarray, turn: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return scrambled(np.asarray(sid).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(turn).astype(np.uint64) + np.uint64(self.seed << 32))

    def settle(self, sid: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The source and rank that the draw ``number`` of ``sid`` gets: its own, or one of a source drawn too seldom."""
        rank = permuted(number, self.drawn[sid], self.key(sid, 1 << 20))
        over, under = np.maximum(0, self.drawn - self.slots), np.maximum(0, self.slots - self.drawn)
        gone = np.flatnonzero(rank >= self.slots[sid])
        s = sid[gone]
        spare = (np.cumsum(over) - over)[s] + rank[gone] - self.slots[s]
        spare = permuted(spare, np.full(len(spare), over.sum()), self.key(np.zeros(len(spare)), 1 << 21))
        ends = np.cumsum(under)
        to = np.searchsorted(ends, spare, side="right")
        sid, rank = sid.copy(), rank.copy()
        sid[gone], rank[gone] = to, self.drawn[to] + spare - (ends - under)[to]
        return sid, rank

    def blocks_of(self, sid: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each rank and how many of its words are taken."""
        turn, at = np.divmod(rank, self.blocks[sid])
        block = permuted(at, self.blocks[sid], self.key(sid, turn))
        words = np.where(block == self.blocks[sid] - 1, self.tail[sid], self.block)
        return block, words - np.where(rank == self.slots[sid] - 1, self.over[sid], 0)


def running(rows: DataFrame, group: list[str], bucket: str, order: list, amount: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` over the rows of its ``group`` that come earlier, by ``bucket`` and then
    by ``order``. Sums of buckets are added up first, so no task holds a group's rows."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return local.join(sums, [*group, bucket]).withColumn("before", F.col("_base") + F.col("_inside")).drop("_base", "_inside", bucket)


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """sid, block, at, doc_id, begin, n, text: the words of texts that begin at ``at`` in their stream, cut at block edges."""

    def cut(batches):
        for batch in batches:
            sids, ats, ids = (batch.column(k).to_pylist() for k in range(3))
            out, size = [], 0
            for sid, at, doc_id, text in zip(sids, ats, ids, texts(batch, "text"), strict=True):
                words = text.tobytes().split()
                begin = 0
                while begin < len(words):
                    name, inside = divmod(at + begin, block)
                    end = min(len(words), begin + block - inside)
                    out.append((sid, name, at, doc_id, inside, end - begin, b" ".join(words[begin:end])))
                    size, begin = size + len(out[-1][6]), end
                    if size >= PIECE_BYTES:
                        yield emit(out)
                        out, size = [], 0
            yield emit(out)

    def emit(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays[:6], arrays[6].cast(pa.string())], ["sid", "block", "at", "doc_id", "begin", "n", "text"])

    return rows.select("sid", "at", "doc_id", "text").mapInArrow(cut, "sid int, block long, at long, doc_id long, begin int, n int, text string")


def draw(spark: SparkSession, recipe: Recipe, shard: int) -> DataFrame:
    """shard, sid, n, first: how many of each shard's slots fall to each source, and the first of them. Each shard is drawn
    by itself, from a generator that its number seeds."""
    total = int(recipe.slots.sum())
    edges, seed = np.cumsum(recipe.slots / max(total, 1)), recipe.seed

    def drawn(batches):
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                points = np.random.default_rng((seed, k)).random(min(shard, total - k * shard))
                sid, n = np.unique(np.minimum(np.searchsorted(edges, points, side="right"), np.flatnonzero(recipe.slots)[-1]), return_counts=True)
                out.append((np.full(len(sid), k), sid, n, np.cumsum(n) - n))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(kind)) for c, kind in zip(columns, (np.int64, np.int32, np.int64, np.int64), strict=True)], ["shard", "sid", "n", "first"])

    shards = -(-total // shard)
    return spark.range(0, shards, 1, min(max(1, shards // 64), 4096)).mapInArrow(drawn, "shard long, sid int, n long, first long")


def slots(spark: SparkSession, recipe: Recipe, shard: int) -> DataFrame:
    """sid, block, shard, place, words: which block each slot of the mix holds and how many of its words."""
    draws = written(draw(spark, recipe, shard), "draws")
    recipe.drawn = np.zeros(len(recipe.size), np.int64)
    for sid, n in draws.groupBy("sid").agg(F.sum("n")).collect():
        recipe.drawn[sid] = n
    total = int(recipe.slots.sum())
    numbered = running(draws.withColumn("_group", F.expr(f"shard div {GROUP_SHARDS}")), ["sid"], "_group", ["shard"], "n")
    each = numbered.select("sid", "shard", "before", "first", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))

    def place(batches):
        for batch in batches:
            sid, at, before, first, k = (batch.column(j).to_numpy().astype(np.int64) for j in range(5))
            own, rank = recipe.settle(sid, before + k)
            block, words = recipe.blocks_of(own, rank)
            inside = permuted(first + k, np.minimum(shard, total - at * shard), recipe.key(at, 1 << 22))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(block), pa.array(at), pa.array(inside.astype(np.int32)), pa.array(words.astype(np.int32))], ["sid", "block", "shard", "place", "words"])

    return each.mapInArrow(place, "sid int, block long, shard long, place int, words int")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_PASSES, block: int = BLOCK, shard: int = SHARD, seed: int = 0, bound: int = BROADCAST_BYTES) -> Mixture:
    """The mix of ``docs``: sources, by code point and null last, weigh ``weights``, repeating (see ``targets``).

    Words are ``[^\\x20\\x09-\\x0D]+``. Each source gives its target, rounded to words; no document is taken more than
    ``most`` times. A null text is an empty one and gives nothing, like a source without words. Repeated rows are documents
    of their own; the same rows, seed and parameters give the same mix however they are partitioned. An empty table gives
    an empty mix; other columns are not read. More than ``MOST_SOURCES`` sources are an error.
    """
    spark = docs.sparkSession
    source = docs["source"].cast("string")
    rows = keyed(docs, source.alias("source"))
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    light = written(rows.select("source", "doc_id", "t", size.alias("size")).groupBy("source", "doc_id", "t").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("c")), "sizes")
    found = light.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("size"), F.count(F.lit(1)).alias("docs")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"a recipe has at most {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["size"] for r in found], [weights[k % len(weights)] for k in range(len(found))], share, most)
    recipe = Recipe([r["size"] for r in found], wanted, block, seed)
    sources = spark.createDataFrame([(k, r["source"], r["size"], float(t)) for k, (r, t) in enumerate(zip(found, wanted, strict=True))], "sid int, _source string, source_size long, target double")
    sources = F.broadcast(sources)  # MOST_SOURCES rows at most
    order = F.xxhash64(F.lit(seed), "doc_id", "t")
    bits = max(0, min(40, (max(1, sum(r["docs"] for r in found)) // BUCKET_DOCS).bit_length()))
    ordered = light.join(sources, light["source"].eqNullSafe(sources["_source"])).drop("_source")
    ordered = ordered.withColumns({"order": order, "words": F.col("size") * F.col("c")}).withColumn("bucket", F.shiftright("order", 63 - bits))
    placed = running(ordered, ["sid"], "bucket", ["order", "doc_id", "t"], "words").withColumnRenamed("before", "at")
    placed = written(placed.drop("order", "words"), "places")

    side = placed.where("size > 0").select("sid", "at", "size", "c", *[F.col(x).alias(f"_{x}") for x in ("source", "doc_id", "t")])
    side = F.broadcast(side) if placed.count() * 96 <= bound else side.hint("shuffle_hash")
    same = rows["source"].eqNullSafe(side["_source"]) & rows["doc_id"].eqNullSafe(side["_doc_id"]) & (rows["t"] == side["_t"])
    whole = rows.join(side, same).select("sid", "at", "size", "c", "doc_id", "text")
    cut = pieces(whole.where("c = 1"), block)
    if not placed.where("c > 1 and size > 0").isEmpty():
        # One copy of each repeated row is enough; its places are expanded by several tasks.
        once = whole.where("c > 1").groupBy("sid", "at", "size", "c", "doc_id").agg(F.first("text").alias("text"))
        dealt = once.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(c - 1) div {COPIES}")))).repartition("sid", "at", "part")
        copy = F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("c"), F.col("part") * COPIES + COPIES) - 1))
        cut = cut.unionByName(pieces(dealt.withColumn("copy", copy).withColumn("at", F.col("at") + F.col("copy") * F.col("size")), block))
    packed = cut.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("begin", "at", "doc_id", "n", "text"))).alias("pieces"))  # ``block`` words
    held = slots(spark, recipe, shard).join(packed, ["sid", "block"])
    left = lambda p: F.least(p["n"], F.col("words") - p["begin"])
    kept = F.transform(F.filter("pieces", lambda p: p["begin"] < F.col("words")), lambda p: F.struct(p["at"].alias("at"), p["doc_id"].alias("doc_id"), p["begin"].alias("begin"), left(p).alias("n"), F.when(left(p) == p["n"], p["text"]).otherwise(F.array_join(F.slice(F.split(p["text"], " "), 1, left(p)), " ")).alias("text")))
    mixed = held.withColumn("pieces", kept).join(sources.select("sid", F.col("_source").alias("source")), "sid")
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    documents = copies.select("doc_id", "size", "source_size", "target", "sid", F.when(F.col("size") > 0, F.col("at") + F.col("copy") * F.col("size")).alias("at"))
    return Mixture(documents, mixed.select("shard", "place", "sid", "source", "block", "words", "pieces"))


def shard_texts(mixture: Mixture) -> DataFrame:
    """shard, place, source, text: the mix as texts, to be written with ``partitionBy`` or sorted by shard and place."""
    return mixture.slots.select("shard", "place", "source", F.array_join(F.col("pieces.text"), " ").alias("text"))


def taken(mixture: Mixture) -> DataFrame:
    """The documents with ``taken``, the words of theirs that stand in the mix, repeats counted."""
    parts = mixture.slots.select("sid", F.explode("pieces").alias("p")).groupBy("sid", F.col("p.at").alias("at")).agg(F.sum("p.n").alias("taken"))
    return mixture.documents.join(parts, ["sid", "at"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")
