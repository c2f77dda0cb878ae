"""Which windows of a corpus can repeat: content-chosen runs of windows, and their classification with Spark.

A window is ``length`` consecutive units (bytes or words) of one document. Each window is named by its *key*, the smallest
hash among its q-grams (leftmost on ties), so equal windows have equal keys wherever they stand. Neighbouring windows
mostly share a key, and a maximal run of them is one row: for 400-byte windows about one row per 190 bytes. A run's text
(first byte of its first window to the last byte of its last) has a hash of its own, ``seg``.

Any window that repeats has its key in two runs, or twice inside one run that is marked ``loop``. So keys seen once are
dropped; copies of a run's text are one class with its number of members, told apart by 128 bits of XXH3 over the text
itself, under a random key that each call draws, so that no text can be made to clash; what is left is *open*: classes that share a key with a different text. The operators settle those by content, each by
its own method, one copy of each text.

A key that more texts share than one task takes (``settle``) is dealt out by longer shared content. Every window with that
key holds the key's q-gram at some offset; the offsets are cut into ranges, and all windows of one range share the units
around the q-gram that lie in every window of it. Those units name the new, smaller group. Ranges shrink until groups fit;
windows of a range of one offset share everything, so they are one class.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfund.llm.common import attach, written

#: Units handled at once; positions inside a chunk need this many bits.
CHUNK_BITS = 20
_MASK = np.uint64((1 << CHUNK_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Where a run of windows stands.
PLACE = ("doc_id", "t", "start", "n")
#: Bytes of open texts that leave a task at once.
OPEN_BYTES = 8 << 20
_RANDOM = np.random.default_rng(20240229)
#: A random 64-bit value for each byte.
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first ``n`` powers modulo 2**64, and their inverses."""
    if len(_tables["up"]) < n:
        size = max(n, 2 * len(_tables["up"]), 1 << 16)
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"][:n], _tables["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def secret_key() -> int:
    """A fresh key of the hashes that tell texts apart, so that nobody can prepare texts that clash."""
    return secrets.randbits(64)


def prefix(units: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` reads the hash of any span from them."""
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(len(units))[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[begin]) * powers(len(sums))[1][begin])


def gram_hashes(sums: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the q-gram at each place, the same wherever the q-gram stands."""
    return mix((sums[gram:] - sums[:-gram]) * powers(len(sums))[1][: len(sums) - gram])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def byte_units(data: np.ndarray) -> np.ndarray:
    return BYTE_VALUES[data]


def word_bounds(data: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 text begin and end; bytes marked in ``between`` are no part of words. By default words
    are ``[^\\x20\\x09-\\x0D]+``."""
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = between[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def words_of(data: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The words of UTF-8 text one behind the other, and where each begins, with the end of the last."""
    begin, end = word_bounds(data, between)
    return np.ascontiguousarray(data[~between[data]]), np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)


def word_units(data: np.ndarray, between: np.ndarray = _SPACE, key: int = 0, words: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A 64-bit XXH3 of each word of UTF-8 text under ``key``; each distinct word is hashed once, told apart by its bytes.
    ``words``: what ``words_of`` gives, if it is known."""
    letters, offsets = words or words_of(data, between)
    if len(offsets) < 2:
        return np.zeros(0, np.uint64)
    held = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    hashes = [xxhash.xxh3_64_intdigest(word, key) for word in held.dictionary.to_pylist()]
    return np.array(hashes, np.uint64)[held.indices.to_numpy()]


def words_of_texts(datas: list[np.ndarray], key: int, between: np.ndarray = _SPACE, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``word_units`` and ``words_of`` of each text; texts of about ``most`` bytes share one table of distinct words."""
    sizes = np.cumsum([len(d) for d in datas])
    for group in np.split(np.arange(len(datas)), np.flatnonzero(np.diff(sizes // most)) + 1) if len(datas) else ():
        own = [datas[k] for k in group]
        gap = np.array([32], np.uint8)
        data = np.concatenate([part for d in own for part in (d, gap)])
        words = words_of(data, between)
        units = word_units(data, key=key, words=words)
        starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in own])])
        cuts = np.searchsorted(word_bounds(data, between)[0], starts)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield units[a:b], words[0], words[1][a : b + 1]


def runs(units: np.ndarray, length: int, gram: int, content: np.ndarray, offsets: np.ndarray | None = None, key: int = 0) -> tuple[np.ndarray, ...]:
    """Runs of the windows of one document: first window, number of windows, key, text hash in two halves, loop mark.

    ``content`` holds the bytes of all units and ``offsets`` where each begins and the last ends (none: a byte each). The text
    hash is 128 bits of XXH3 over those bytes and the units' lengths under ``key``."""
    parts = []
    step = (1 << CHUNK_BITS) - length
    for at in range(0, len(units) - length + 1, step):
        windows = min(step, len(units) - length + 1 - at)
        part = units[at : at + windows + length - 1]
        grams = gram_hashes(prefix(part), gram)
        least = sliding_min((grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        name = least >> np.uint64(CHUNK_BITS)
        first = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1])
        last = np.concatenate([first[1:], [windows]]) - 1
        moved = np.concatenate([[0], np.cumsum(least[1:] != least[:-1])])
        digests = bytearray()
        for a, b in zip((first + at).tolist(), (last + at + length).tolist(), strict=True):
            if offsets is None:
                digests += xxhash.xxh3_128_digest(content[a:b], key)
            else:  # with the lengths, so that words are told apart from the same letters in other words
                digest = xxhash.xxh3_128(content[offsets[a] : offsets[b]], key)
                digest.update((offsets[a : b + 1] - offsets[a]).tobytes())
                digests += digest.digest()
        seg, twin = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2).T
        parts.append((first + at, last - first + 1, name[first].astype(np.int64), seg, twin, moved[last] != moved[first]))
    if not parts:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, np.int64, bool))
    return tuple(np.concatenate(column) for column in zip(*parts, strict=True))


def texts(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """The UTF-8 bytes of each text of a batch, without copies."""
    array = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def window_runs(docs: DataFrame, unit: str, length: int, gram: int, secret: int) -> DataFrame:
    """``runs`` of every document of ``keyed`` rows: doc_id, t, start, n, key, seg, twin, loop."""

    def find(batches):
        for batch in batches:
            ids, ts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "t"))
            rows, found = [], []
            held = texts(batch, "text")
            parts = words_of_texts(held, secret) if unit == "word" else ((byte_units(data) if len(data) >= length else data, data, None) for data in held)
            for row, (units, content, offsets) in enumerate(parts):
                if len(units) >= length:
                    found.append(runs(units, length, gram, content, offsets, secret))
                    rows.append(np.full(len(found[-1][0]), row))
            if rows:
                start, n, key, seg, twin, loop = (np.concatenate(column) for column in zip(*found, strict=True))
                take = pa.array(np.concatenate(rows))
                columns = [ids.take(take), ts.take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(seg), pa.array(twin), pa.array(loop)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "start", "n", "key", "seg", "twin", "loop"])

    return docs.select("doc_id", "t", "text").mapInArrow(find, "doc_id long, t long, start int, n int, key long, seg long, twin long, loop boolean")


def classify(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits ``window_runs`` into (whole, open), both written tables.

    whole: doc_id, t, start, n of runs whose text has copies, so that they are repeated throughout. open: one row for each
    text that shares its key with others, with one place where it stands (doc_id, t, start, n), its key, and ``lone``: the
    text occurs only there, so which of its windows repeat is asked; the others only serve as witnesses.
    """
    found = written(found, "runs")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("seg", "twin") for f in (F.min, F.max)]
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *ends, F.max("loop").alias("loops")).where("c > 1 or loops")
    shared = written(found.join(keys.drop("c"), "key"), "shared-runs")
    alike = F.expr("min_seg = max_seg and min_twin = max_twin and not loops")
    mixed = shared.where(~alike)
    segs = mixed.groupBy("key", "seg", "twin").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "t", "start", "n")).alias("at"))
    segs = written(segs, "segments")
    many = mixed.join(segs.where("c > 1").select("key", "seg", "twin"), ["key", "seg", "twin"], "left_semi")
    whole = shared.where(alike).select(*PLACE).unionByName(many.select(*PLACE))
    return whole, segs.select("at.*", "key", (F.col("c") == 1).alias("lone"))


def open_texts(docs: DataFrame, asked: DataFrame, unit: str, length: int, gram: int, secret: int, ranges: int = 1) -> DataFrame:
    """The content of ``asked`` runs: doc_id, t, start, n, lone, body (the bytes, or 8 bytes for each word), ``key`` and
    ``group``: the key itself, or with several ``ranges`` of offsets a hash of what all windows of the range share."""
    span = length - gram + 1

    def pieces(hashes: np.ndarray, body: np.ndarray, at: int, n: int, key: int) -> Iterator[tuple[int, int, int]]:
        """(first window, windows, group) of the parts of one run, each of one place of the q-gram and one range."""
        stands = np.flatnonzero(gram_hashes(prefix(hashes[at : at + n - 1 + length]), gram) >> np.uint64(CHUNK_BITS) == np.uint64(key))
        window = np.arange(n)
        place = stands[np.searchsorted(stands, window)]  # the leftmost, as in ``runs``
        part = (place - window) * ranges // span
        for rows in np.split(window, np.flatnonzero((place[1:] != place[:-1]) | (part[1:] != part[:-1])) + 1):
            k, to = int(part[rows[0]]), at + int(place[rows[0]])
            least, most = -(-k * span // ranges), -(-(k + 1) * span // ranges) - 1
            common = body[to - least : to - most + length].tobytes()
            yield at + int(rows[0]), len(rows), xxhash.xxh64_intdigest(common, (key * 1024 + k) % (1 << 64))

    def cut(batches):
        for batch in batches:
            asks = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("start", "n", "key", "lone")]
            rows, size = [], 0
            for row, (data, *ask) in enumerate(zip(texts(batch, "text"), *asks, strict=True)):
                hashes = word_units(data, key=secret) if unit == "word" else byte_units(data) if ranges > 1 else data
                body = hashes if unit == "word" else data
                for at, n, key, lone in zip(*ask, strict=True):
                    for first, windows, group in pieces(hashes, body, at, n, key) if ranges > 1 else [(at, n, key)]:
                        rows.append((row, first, windows, lone, body[first : first + windows - 1 + length].tobytes(), key, group - (1 << 64) * (group >> 63)))
                        size += len(rows[-1][4])
                if size >= OPEN_BYTES:
                    yield emit(batch, rows)
                    rows, size = [], 0
            yield emit(batch, rows)

    def emit(batch, rows):
        columns = list(zip(*rows, strict=True)) or [()] * 7
        take = pa.array(columns[0], pa.int64())
        ids = [batch.column(batch.schema.get_field_index(c)).take(take) for c in ("doc_id", "t")]
        kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([*ids, *(pa.array(c, kind) for c, kind in zip(columns[1:], kinds, strict=True))], ["doc_id", "t", "start", "n", "lone", "body", "key", "group"])

    with_items = attach(docs, per_document(asked, "start", "n", "key", "lone"), "start", 20).where("start is not null")
    return with_items.mapInArrow(cut, "doc_id long, t long, start int, n int, lone boolean, body binary, key long, group long")


def settle(docs: DataFrame, asked: DataFrame, unit: str, length: int, gram: int, secret: int, group_texts: int, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Which windows of the ``lone`` runs of ``asked`` repeat: doc_id, t, start, n. ``solve`` gets groups of at most
    ``group_texts`` different texts; larger ones come back as several, by ever narrower ranges of offsets."""
    span, ranges, settled = length - gram + 1, 1, []
    while True:
        found = written(open_texts(docs, asked, unit, length, gram, secret, ranges), "open-texts")
        if ranges > 1:
            # Different texts can have equal parts. Those repeat throughout, and one of them stays as a witness.
            same = found.groupBy("group", "body").agg(F.count(F.lit(1)).alias("c"), F.max("lone").alias("lone"), F.min(F.struct(*PLACE, "key")).alias("at"))
            same = written(same, "open-texts")
            many = same.where("c > 1").select("group", "body")
            settled.append(found.where("lone").join(many, ["group", "body"], "left_semi").select(*PLACE))
            found = same.select("group", "body", "at.*", (F.col("lone") & (F.col("c") == 1)).alias("lone"))
        crowded = found.groupBy("group").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group_texts).select("group")
        crowded = written(crowded, "crowded-groups")
        if ranges == span or crowded.isEmpty():
            return reduce(DataFrame.unionByName, [*settled, solve(found)])
        settled.append(solve(found.join(crowded, "group", "left_anti")))
        asked = found.join(crowded, "group", "left_semi").select(*PLACE, "key", "lone")
        ranges = min(4 * ranges, span)


def in_groups(length: int, batch_bytes: int, unit_bytes: int, repeated: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    """A ``solve`` for ``settle``: deals texts out by group and asks ``repeated`` which positions of the joined texts
    (units, end of each position's text, length) start a window that starts elsewhere too. Whole groups are asked about
    together, with at least ``batch_bytes`` of text unless it ends."""
    kind = np.uint8 if unit_bytes == 1 else np.uint64

    def walk(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if size >= batch_bytes and row["group"] != last:
                    yield answer(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row["body"]), row["group"]
        if held:
            yield answer(held)

    def answer(rows):
        sizes = np.array([len(r["body"]) // unit_bytes for r in rows])
        text = np.frombuffer(b"".join(r["body"] for r in rows), kind)
        ends = np.cumsum(sizes)
        again = repeated(text, np.repeat(ends, sizes), length) & np.repeat(np.array([r["lone"] for r in rows]), sizes)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2]  # a text's last windows are not starts, so runs never cross texts
        of = np.searchsorted(ends, begin, side="right")
        take = [rows[k] for k in of]
        start = np.array([r["start"] for r in take], np.int64) + begin - (ends - sizes)[of]
        return pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in take], pa.int64()), pa.array([r["t"] for r in take], pa.int64()), pa.array(start.astype(np.int32)), pa.array((end - begin).astype(np.int32))], list(PLACE))

    return lambda rows: rows.repartition("group").sortWithinPartitions("group").mapInArrow(walk, "doc_id long, t long, start int, n int")


def per_document(rows: DataFrame, *columns: str) -> DataFrame:
    """One written row per document with an array for each column; a document's items are bounded by its own length.
    Arrays of plain values take a sixth of the room that an array of structs takes, which matters when they are broadcast."""
    items = rows.groupBy("doc_id", "t").agg(F.collect_list(F.struct(*columns)).alias("items"))
    return written(items.select("doc_id", "t", *[F.col(f"items.{c}").alias(c) for c in columns]), "items")


def spans(rows: DataFrame, length: int) -> DataFrame:
    """Merges repeated runs (doc_id, t, start, n) into maximal covered spans: one row per document, ``items`` of (begin, end)."""

    def merge(batches):
        for batch in batches:
            items = batch.column(2)
            begin = items.flatten().field("start").to_numpy(zero_copy_only=False).astype(np.int64)
            end = begin + items.flatten().field("n").to_numpy(zero_copy_only=False) - 1 + length
            offsets = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False))])
            counts, begins, ends = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                order = a + np.argsort(begin[a:b], kind="stable")
                reach = np.maximum.accumulate(end[order])
                new = np.concatenate([[True], begin[order][1:] > reach[:-1]])
                begins.append(begin[order][new])
                ends.append(reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [b - a - 1]])])
                counts.append(len(begins[-1]))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int32)) for x in (begins, ends)], ["begin", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "t", "items"])

    rows = rows.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "n")).alias("items"))
    return written(rows.mapInArrow(merge, "doc_id long, t long, items array<struct<begin:int,end:int>>"), "spans")


def kept_pieces(spans_column: str, size):
    """The gaps between spans, as an array of (begin, size), zero-based."""
    spans_col = F.coalesce(F.col(spans_column), F.array().cast("array<struct<begin:int,end:int>>"))
    begins = F.concat(F.array(F.lit(0)), F.transform(spans_col, lambda s: s["end"]))
    ends = F.concat(F.transform(spans_col, lambda s: s["begin"]), F.array(size))
    return F.filter(F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("begin"), (e - b).alias("size"))), lambda p: p["size"] > 0)
