"""Phrase collocations: word sequences that occur far more often together than their parts suggest.

Frequent words, pairs and triples are found level by level (a frequent phrase has only frequent parts). At each level every
task summarises its n-grams as (hash, count); summaries are dealt out by hash partition, and each partition merges its own into one Misra-Gries summary. Its capacity exceeds the partition's mass divided by the threshold, so whatever is
subtracted stays below the threshold and every frequent n-gram survives; survivors whose count plus what was subtracted
stays below the threshold cannot be frequent and go too. A second pass counts the survivors' words exactly.

Hashes only choose survivors: a clash lets an infrequent phrase through to the exact count, never loses one. Tasks test
n-grams against survivors in a bitmap of fixed size; a full bitmap lets more through and costs time, not correctness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillfund.llm.common import BROADCAST_BYTES, table, written
from quillfund.llm.windows import mix, texts, word_bounds

THRESHOLD, TOP = 10, 2000
#: A phrase is dropped if a longer candidate that holds it has at least this share (in %) of its count.
COVERED = 50
LONGEST = 3
#: Bytes of text tokenised at once (a longer piece is taken whole), and n-grams that a task sums up before handing on.
CHUNK_BYTES, HELD = 2 << 20, 1 << 20
#: Bytes of the corpus for each hash partition, and the least number of those.
PARTITION_BYTES, LEAST_PARTITIONS = 16 << 20, 1024
#: Bits of a level's bitmap (16 MB), which travels to the driver in blocks and back as a broadcast.
BITMAP_BITS, BITMAP_BLOCK = 1 << 27, 1 << 15

_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[9, 32]] = True


class Words:
    """The words of some text in order: codes into a ``dictionary``, and the number of the piece that each stands in."""

    def __init__(self, data: np.ndarray):
        begin, end = word_bounds(data, _BETWEEN)
        letters = data[~_BETWEEN[data]]
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        held = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
        self.dictionary, self.code = held.dictionary, held.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.piece = np.cumsum(_ENDS[data])[begin] if len(begin) else begin

    def inside(self, n: int) -> np.ndarray:
        """Where ``n`` words of one piece begin."""
        return self.piece[n - 1 :] == self.piece[: max(0, len(self.piece) - n + 1)]

    def hashes(self, lang: str, n: int) -> list[np.ndarray]:
        """The hashes of the words, pairs, ... up to ``n`` words at each place, whatever piece they stand in."""
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        own = np.array([xxhash.xxh3_64_intdigest(w.as_py(), seed) for w in self.dictionary], np.uint64)[self.code]
        out = [own]
        for k in range(1, n):
            out.append(mix(out[-1][: max(0, len(own) - k)] * np.uint64(0x9E3779B97F4A7C15) + own[k:]))
        return out

    def phrases(self, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
        """The distinct ``n``-word phrases at the places ``at``, compared word by word, and how often each stands there."""
        name = self.code[at]
        for k in range(1, n):
            name = np.unique(name, return_inverse=True)[1] * len(self.dictionary) + self.code[at + k]
        _, first, count = np.unique(name, return_index=True, return_counts=True)
        parts = [self.dictionary.take(pa.array(self.code[at[first] + k])) for k in range(n)]
        return (parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))).cast(pa.large_string()), count


def tokenised(batches, chunk: int = CHUNK_BYTES) -> Iterator[tuple[str, Words]]:
    """(lang, ``Words``) of parts of the texts, which are cut only where a piece ends."""
    for batch in batches:
        langs, held, sizes = batch.column(0).to_pylist(), {}, {}
        for lang, text in zip(langs, texts(batch, "text"), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= chunk:
                yield from _parts(lang, held.pop(lang), chunk)
                sizes[lang] = 0
        for lang, own in held.items():
            yield from _parts(lang, own, chunk)


def _parts(lang: str, own: list[np.ndarray], chunk: int) -> Iterator[tuple[str, Words]]:
    data = np.frombuffer(b"\n".join(x.tobytes() for x in own).lower(), np.uint8)  # of bytes: A-Z only
    ends, begin = (np.flatnonzero(_ENDS[data]), 0) if len(data) > 2 * chunk else ([], 0)
    while begin < len(data):
        k = np.searchsorted(ends, begin + chunk)
        end = int(ends[k]) + 1 if k < len(ends) else len(data)
        yield lang, Words(data[begin:end])
        begin = end


def span_of(partitions: int) -> np.uint64:
    """Hashes are cut to so many values: 32 bits within each of the hash partitions."""
    return np.uint64(partitions << 32)


def found_in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64(BITMAP_BITS - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def local_counts(rows: DataFrame, n: int, below, partitions: int) -> DataFrame:
    """p, h, c: summaries of the ``n``-grams in each task, of those whose parts are in the bitmap ``below`` (a broadcast). A row
    has hashes (without their partition) and counts of one hash partition, or no hashes and the mass of such a row."""
    span = span_of(partitions)

    def count(batches):
        held, size = [], 0
        for lang, words in tokenised(batches):
            *shorter, h = words.hashes(lang, n)
            good = words.inside(n)
            if n > 1:
                part = found_in(below.value, shorter[-1] % span)
                good &= part[: len(h)] & part[1 : len(h) + 1]
            h, c = np.unique(h[good] % span, return_counts=True)
            held.append((h, c))
            size += len(h)
            if size >= HELD:
                h, c = added(held)
                held, size = [(h, c)], len(h)
                if size >= HELD // 2:
                    yield emit(h, c)
                    held, size = [], 0
        if size:
            yield emit(*added(held))

    def emit(h, c):
        p = h % np.uint64(partitions)
        order = np.argsort(p, kind="stable")
        p, inner, c = p[order].astype(np.int32), (h[order] // np.uint64(partitions)).astype(np.uint32).view(np.int32), c[order]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        mass, none = np.add.reduceat(c, first), np.full(len(first), len(c))
        offsets = pa.array(np.concatenate([first, none, [len(c)]]).astype(np.int32))
        # An empty list for each mass stands behind all others, which end where the next one begins.
        hashes = pa.ListArray.from_arrays(offsets, pa.array(inner))
        counts = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(c)], len(c) + np.arange(1, len(first) + 1)]).astype(np.int32)), pa.array(np.concatenate([c, mass]).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[first], p[first]])), hashes, counts], ["p", "h", "c"])

    return rows.mapInArrow(count, "p int, h array<int>, c array<long>")


def added(parts) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several (hashes, counts)."""
    h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.zeros(len(h), np.int64)
    np.add.at(total, at, np.concatenate([p[1] for p in parts]))
    return h, total


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters. A true count is at most ``lost`` above its counter (zero if it
    has none), and ``lost`` is at most the mass divided by ``capacity`` + 1."""

    def __init__(self, capacity: int):
        self.capacity, self.lost, self.size = capacity, 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def merge(self, h: np.ndarray, c: np.ndarray) -> None:
        self.parts.append((h, c))
        self.size += len(h)
        if self.size > 2 * self.capacity + 4096:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        h, c = added(self.parts) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(h) > self.capacity:
            cut = np.partition(c, len(c) - self.capacity - 1)[len(c) - self.capacity - 1]  # the largest that must go
            self.lost += int(cut)
            h, c = h[c > cut], c[c > cut] - cut
        self.parts, self.size = [(h, c)], len(h)
        return h, c


def survivors(local: DataFrame, threshold: int, partitions: int) -> DataFrame:
    """h: the hashes (modulo ``span_of``) that can reach ``threshold``, by one summary for each hash partition."""

    def merge(batches):
        summary, mass, last = None, 0, None
        for batch in batches:
            columns = [batch.column(0).to_pylist(), *([c[a:b] for a, b in zip(o[:-1], o[1:], strict=True)] for o, c in ((x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)) for x in batch.columns[1:]))]
            for p, h, c in zip(*columns, strict=True):
                if p != last:
                    if summary:
                        yield emit(last, summary)
                    summary, mass, last = None, 0, p
                if not len(h):  # these come first
                    mass += int(c[0])
                    continue
                summary = summary or Summary(mass // threshold + 1)
                summary.merge(h.view(np.uint32), c)
        if summary:
            yield emit(last, summary)

    def emit(p, summary):
        h, c = summary.settle()
        whole = h[c + summary.lost >= threshold].astype(np.uint64) * np.uint64(partitions) + np.uint64(p)
        return pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64))], ["h"])

    return local.repartition("p").sortWithinPartitions("p", F.size("h") > 0).mapInArrow(merge, "h long")


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """A bitmap of ``BITMAP_BITS`` bits in which those of ``hashes`` are set; built in blocks, which come to the driver."""
    blocks, size = BITMAP_BITS // BITMAP_BLOCK, BITMAP_BLOCK // 8

    def build(batches):
        held = {}
        for batch in batches:
            bit = batch.column(1).to_numpy()
            for block in np.unique(bit // BITMAP_BLOCK):  # a task has a share of the fixed number of blocks
                held.setdefault(int(block), np.zeros(BITMAP_BLOCK, bool))[bit[bit // BITMAP_BLOCK == block] % BITMAP_BLOCK] = True
            if len(held) > 256:
                yield emit(held)
                held = {}
        yield emit(held)

    def emit(held):
        packed = [np.packbits(x, bitorder="little").tobytes() for x in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], ["block", "bits"])

    bit = F.col("h").bitwiseAND(BITMAP_BITS - 1)
    parts = hashes.select(F.expr(f"(h & {BITMAP_BITS - 1}) div {BITMAP_BLOCK}").cast("int").alias("block"), bit.alias("bit"))
    dealt = parts.repartition("block").sortWithinPartitions("block").mapInArrow(build, "block int, bits binary")
    out = np.zeros((blocks, size), np.uint8)
    for batch in dealt.toArrow().to_batches():
        for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out[block] |= np.frombuffer(bits, np.uint8)
    return out.ravel()


def phrase_counts(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``lang, words, phrase, f``: every phrase of 1 to ``LONGEST`` words that occurs ``threshold`` times or more, with its
    exact count; ``words`` 0 has a row for each language with the number of all its words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = min(max(LEAST_PARTITIONS, size // PARTITION_BYTES), 1 << 30)
    span, bitmaps, below = span_of(partitions), [], None
    for n in range(1, LONGEST + 1):
        found = survivors(local_counts(rows, n, below, partitions), threshold, partitions)
        below = spark.sparkContext.broadcast(bitmap_of(written(found, f"frequent-{n}")))
        bitmaps.append(below)

    def count(batches):
        for lang, words in tokenised(batches):
            yield emit(lang, 0, pa.array([""], pa.large_string()), np.array([len(words.code)]))
            for n, h in enumerate(words.hashes(lang, LONGEST), 1):
                at = np.flatnonzero(words.inside(n) & found_in(bitmaps[n - 1].value, h % span))
                if len(at):
                    yield emit(lang, n, *words.phrases(at, n))

    def emit(lang, n, phrase, c):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(np.full(len(c), n, np.int32)), phrase.cast(pa.string()), pa.array(c.astype(np.int64))], ["lang", "words", "phrase", "f"])

    exact = rows.mapInArrow(count, "lang string, words int, phrase string, f long").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return exact.where((F.col("words") == 0) | (F.col("f") >= threshold))


def cut_scores(a: Column, cuts: list[tuple[Column, Column]]) -> Column:
    """(score, k, l, r) of the lowest-scoring cut, in exact decimal arithmetic."""
    whole = lambda c: c.cast("decimal(19,0)")
    top = F.lit(1_000_000).cast("decimal(7,0)") * whole(a) * whole(a)
    scored = [F.struct(F.call_function("div", top, whole(left) * whole(right)).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, (left, right) in enumerate(cuts, 1)]
    return F.array_min(F.array(*scored))


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, covered: int = COVERED, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to 3 words with a count ``a`` of at least
    ``threshold``, by score, count and phrase.

    A-Z are lower-cased, texts end in pieces at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+`` of a piece, and phrases
    stay in one; a null text is empty, a null language ``und``. The score is that of the worst cut into two parts with
    counts l and r: 1000000 a a / (l r), rounded down. Candidates with ``covered`` % of their occurrences inside one longer
    candidate are dropped. Repeated rows count each time; no candidates or an empty table give an empty result; other
    columns are not read.
    """
    counts = written(phrase_counts(docs, threshold), "phrases")
    sizes = {r["words"]: r["b"] for r in counts.groupBy("words").agg(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 64).alias("b")).collect()}

    def known(n: int, key: str, name: str) -> DataFrame:
        side = counts.where(F.col("words") == n).select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
        return F.broadcast(side) if sizes.get(n, 0) <= bound else side

    def candidates(n: int) -> DataFrame:
        return counts.where(F.col("words") == n).select("lang", "phrase", F.col("f").alias("a"))

    part = lambda k: F.substring_index("phrase", " ", k)
    triples = candidates(3).withColumns({"w1": part(1), "w23": part(-2), "w12": part(2), "w3": part(-1)})
    for n, key, name in ((1, "w1", "l1"), (2, "w23", "r1"), (2, "w12", "l2"), (1, "w3", "r2")):
        triples = triples.join(known(n, key, name), ["lang", key])
    triples = triples.withColumn("cut", cut_scores(F.col("a"), [(F.col("l1"), F.col("r1")), (F.col("l2"), F.col("r2"))]))
    longer = candidates(3).select("lang", F.explode(F.array(part(2), part(-2))).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    pairs = candidates(2).join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    pairs = pairs.withColumns({"w1": part(1), "w2": part(-1)}).join(known(1, "w1", "l1"), ["lang", "w1"]).join(known(1, "w2", "r1"), ["lang", "w2"])
    pairs = pairs.withColumn("cut", cut_scores(F.col("a"), [(F.col("l1"), F.col("r1"))]))
    every = pairs.select("lang", "phrase", "a", "cut.*").unionByName(triples.select("lang", "phrase", "a", "cut.*"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # cut to ``top`` rows in each task first
    best = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
 g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
   UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
   UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
 n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
 f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
 c AS (SELECT x.lang, x.k, x.phrase, x.f AS a, 1 AS cut, l.f AS l, r.f AS r FROM f x JOIN f l ON l.lang = x.lang AND l.phrase = x.w[1] JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[2:], ' ') WHERE x.k > 1
   UNION ALL SELECT x.lang, x.k, x.phrase, x.f, 2, l.f, r.f FROM f x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:2], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = x.w[3] WHERE x.k = 3),
 s AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM c),
 best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s),
 longer AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM f WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM f WHERE k = 3) y GROUP BY lang, phrase),
 kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE b.o = 1 AND (most IS NULL OR 100 * most < 50 * a)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
