"""SimHash near-duplicates by the generalised pigeonhole principle.

If the 64 bits are split into parts with thresholds ``T_i`` whose sum is ``distance - parts + 1``, two fingerprints that
differ in at most ``distance`` bits differ in at most ``T_i`` bits of some part i (a part with T = -1 is left out). The
parts group correlated bits, and the thresholds are unequal: dynamic programming picks those with the fewest estimated
candidates, from bit and bit-pair counts over all fingerprints; the number of parts follows from the same estimate, so
few wide parts are chosen on large corpora. Probes that meet in a part's value are verified on all 64 bits.

A part's value that more fingerprints share than one task compares is dealt out again: of the bits that it leaves free,
cut into ``distance + 1`` pieces, two fingerprints within the distance agree on one piece, so the bucket becomes smaller
ones by piece and value. What stays crowded after ``DEALS`` rounds is a cloud of fingerprints a few bits apart (of which
there are not very many: 680,000 within four bits of one) and is split into pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfund.llm.common import drop_rows, keyed, table, written
from quillfund.llm.components import connected_components

DISTANCE = 4
WORDS = 4
SEED = 42
#: Relative cost of one probe row (shuffled) and of one candidate pair (an XOR and a bit count).
ROW_COST, PAIR_COST = 100.0, 1.0
#: Fingerprints of a bucket compared at once.
BLOCK = 1024
#: Fingerprints of a bucket that a task compares; larger buckets are dealt out again on the bits that they leave free.
BUCKET = 8192
#: Rounds of that.
DEALS = 2


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: words are split at ASCII white space and lower-cased (A-Z only)."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    cut = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    begins, ends = [0, *(cut + 1).tolist()], [*cut.tolist(), len(joined)]
    if len(begins) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(begins) - words + 1
    for at in range(0, total, 1 << 15):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(begins[at : at + (1 << 15)], ends[at + words - 1 :], strict=False)], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, t, fp`` of each row; ``fp`` is the fingerprint as a signed long. A null text counts as empty (fp 0)."""

    def compute(batches):
        for batch in batches:
            values = [fingerprint(text) for text in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "t", "fp"])

    return keyed(docs).mapInArrow(compute, "doc_id long, t long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j: sums over all of them, 4096 rows at most."""

    def count(batches):
        sums = np.zeros((64, 64))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            sums += bits.T @ bits
        place = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *place]), pa.array([0.0, *sums.ravel()[place]])], ["place", "ones"])

    n = fps.count()
    both = np.zeros(4096)
    for place, ones in fps.select("fp").mapInArrow(count, "place long, ones double").groupBy("place").agg(F.sum("ones")).collect():
        if place >= 0:
            both[place] = ones
    return n, both.reshape(64, 64)


def _bits(fps: np.ndarray) -> np.ndarray:
    """Row k: the bits of ``fps[k]``, lowest first."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts (bits) with their thresholds, -1 left out: the plan with the least estimated cost."""
    p = np.diag(both) / max(n, 1)
    pair = both / max(n, 1)
    states = [pair, p[:, None] - pair, p[None, :] - pair, 1 - p[:, None] - p[None, :] + pair]
    match2 = sum(np.clip(s, 0, 1) ** 2 for s in states)  # two random fingerprints agree on bits i and j
    match = p**2 + (1 - p) ** 2
    excess = np.clip(match2 / np.maximum(np.outer(match, match), 1e-9), 1e-3, 4.0)
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for parts in range(2, distance + 2):
        groups = _group(excess, parts)
        # DP over the parts: least cost of the thresholds so far, by their sum.
        states_by_sum: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            grown: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in states_by_sum.items():
                for t in (-1, 0, 1, 2):
                    total = cost + _cost(n, match[bits], excess[np.ix_(bits, bits)], t)
                    if total < grown.get(used + t, (np.inf,))[0]:
                        grown[used + t] = (total, [*chosen, t])
            states_by_sum = grown
        cost, chosen = states_by_sum.get(distance - parts + 1, (np.inf, []))
        if cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _group(excess: np.ndarray, parts: int) -> list[list[int]]:
    """Even-sized groups; each grows from the least bound bit left by the bit most correlated with it."""
    left, groups = set(range(64)), []
    strength = np.abs(np.log(excess))
    np.fill_diagonal(strength, 0)
    for k in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - k)
        order = sorted(left)
        group = [max(order, key=lambda b: (strength[b, order].max(), -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (strength[b, group].sum(), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def _cost(n: int, match: np.ndarray, excess: np.ndarray, t: int) -> float:
    if t < 0:
        return 0.0
    near = np.zeros(t + 1)  # chance that two random fingerprints differ in 0..t bits of the part
    near[0] = 1.0
    for m in match:
        near[1:] = near[1:] * m + near[:-1] * (1 - m)
        near[0] *= m
    bound = np.exp(np.log(excess[np.triu_indices(len(match), 1)]).sum())
    probes = 1 + (len(match) / 2 if t == 1 else len(match) if t == 2 else 0)
    return n * probes * ROW_COST + n * n / 2 * min(1.0, near.sum() * max(bound, 1.0)) * max(1.0, probes / 2) * PAIR_COST


def probes(fps: np.ndarray, parts: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (part, value, place in ``fps``). Fingerprints within a part's threshold T of each other share a value of it:
    T = 0 the value itself; T = 1 also each value with one set bit cleared; T = 2 each value with one bit flipped."""
    out = []
    places = np.arange(len(fps))
    for k, (bits, t) in enumerate(parts):
        value = np.zeros(len(fps), np.uint64)
        for to, bit in enumerate(bits):
            value |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
        out.append((k, value, places))
        for to in range(len(bits) if t else 0):
            one = np.uint64(1 << to)
            moved = np.flatnonzero(value & one) if t == 1 else places
            out.append((k, value[moved] ^ one, moved))
    return (np.concatenate([np.full(len(v), k, np.int32) for k, v, _ in out]), np.concatenate([v for _, v, _ in out]).view(np.int64), np.concatenate([p for _, _, p in out]))


def bucket_links(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``fps`` that join every two fingerprints within ``distance``, directly or through others; each
    pair is within it itself. At most one pair for each merge, so the output is linear in the bucket."""
    label, links = np.arange(len(fps)), [np.zeros((2, 0), np.int64)]
    for at in range(0, len(fps), BLOCK):
        for to in range(at, len(fps), BLOCK):
            a, b = np.nonzero(np.bitwise_count(fps[at : at + BLOCK, None] ^ fps[None, to : to + BLOCK]) <= distance)
            a, b = a + at, b + to
            while True:
                low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
                apart = np.flatnonzero(low < high)
                if not len(apart):
                    break
                a, b, low, high = a[apart], b[apart], low[apart], high[apart]
                top, one = np.unique(high, return_index=True)  # each component hooks to one lower component
                links.append(np.stack([a[one], b[one]]))
                label[top] = low[one]
                while (label != (jump := label[label])).any():
                    label = jump
    return tuple(np.concatenate(links, axis=1))


def pieces(free: int, count: int) -> list[int]:
    """The set bits of ``free`` as ``count`` masks of even size."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits, int), count)]


def _signed(x: int) -> int:
    return x - (1 << 64) * (x >> 63)


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` among distinct fingerprints (fp, least): every two within ``distance`` bits are joined by a path of
    links. Ends are structs (nameless, least, fp) that sort by ``least``, null last."""
    n, both = bit_counts(fps)
    parts = plan(n, both, distance)
    left_free = [_signed(((1 << 64) - 1) & ~sum(1 << b for b in bits)) for bits, _ in parts]

    def probe(batches):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            part, value, place = probes(values, parts)
            free = np.array(left_free, np.int64)[part]
            take = pa.array(place)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(value), pa.array(free), batch.column(0).take(take), batch.column(1).take(take)], ["part", "value", "free", "fp", "least"])

    def deal(batches):
        for batch in batches:
            group, free, fp = (batch.column(k).to_numpy() for k in (0, 1, 2))
            for mask in np.unique(free):
                rows = np.flatnonzero(free == mask)
                for k, piece in enumerate(pieces(int(mask) % (1 << 64), distance + 1)):
                    take = pa.array(rows)
                    rest = np.full(len(rows), _signed((int(mask) % (1 << 64)) & ~piece))
                    yield pa.RecordBatch.from_arrays([pa.array(group[rows]), pa.array(np.full(len(rows), k, np.int32)), pa.array(fp[rows] & np.int64(_signed(piece))), pa.array(rest), batch.column(2).take(take), batch.column(3).take(take)], ["group", "part", "value", "free", "fp", "least"])

    def link(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            group = rows.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist()]
            yield emit([rows.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1])
            held = rows.slice(cuts[-1])
        if held is not None:
            yield emit([held])

    def emit(groups):
        ends = {c: [np.zeros(0, np.int64)] for c in ("a_fp", "b_fp", "a_least", "b_least")}
        nulls = {c: [np.zeros(0, bool)] for c in ("a_none", "b_none")}
        for rows in groups:
            fps, one = np.unique(rows.column("fp").to_numpy(), return_index=True)
            least = rows.column("least").take(pa.array(one))
            none, least = least.is_null().to_numpy(), least.fill_null(0).to_numpy()
            for side, of in zip("ab", bucket_links(fps.view(np.uint64), distance), strict=True):
                ends[f"{side}_fp"].append(fps[of])
                ends[f"{side}_least"].append(least[of])
                nulls[f"{side}_none"].append(none[of])
        columns = {c: np.concatenate(x) for c, x in (ends | nulls).items()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in order], order)

    order = ["a_none", "a_least", "a_fp", "b_none", "b_least", "b_fp"]
    rows = fps.select("fp", "least").mapInArrow(probe, "part int, value long, free long, fp long, least long").select(F.xxhash64("part", "value").alias("group"), "free", "fp", "least")
    links: list[DataFrame] = []
    for turn in range(DEALS + 2):
        rows = written(rows, "probes")
        crowded = written(rows.groupBy("group").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > bucket), "crowded-buckets")
        done = turn > DEALS or crowded.isEmpty()
        fits = rows if done else rows.join(crowded, "group", "left_anti")
        links.append(fits.repartition("group").sortWithinPartitions("group").mapInArrow(link, ", ".join(f"{c} {'boolean' if c.endswith('none') else 'long'}" for c in order)))
        if done:
            break
        rows = rows.join(crowded, "group")
        if turn < DEALS:
            rows = rows.select("group", "free", "fp", "least").mapInArrow(deal, "group long, part int, value long, free long, fp long, least long")
            rows = rows.select(F.xxhash64("group", "part", "value").alias("group"), "free", "fp", "least")
        else:
            # Two of these blocks fit one bucket.
            blocks = F.ceil(2 * F.col("c") / bucket).cast("int")
            rows = rows.withColumn("one", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("two", F.explode(F.sequence(F.lit(0), blocks - 1))).where("one <> two")
            rows = rows.select(F.xxhash64("group", F.least("one", "two"), F.greatest("one", "two")).alias("group"), "free", "fp", "least")
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    end = lambda side: F.struct(*[F.col(f"{side}_{c}").alias(c) for c in ("none", "least", "fp")]).alias(side)
    return found.select(end("a"), end("b")).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, t, fp, component_id`` for each row of ``docs``.

    ``component_id`` is the smallest non-null doc_id reachable over links of at most ``distance`` bits; null only if no
    reachable row has one. Null and empty texts have fingerprint zero and link like any other; repeated rows keep a row
    each. An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    rows = written(fingerprints(docs), "fingerprints")
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    # The smallest node of a component is that of the smallest doc_id, so nothing has to be looked up by component.
    parts = connected_components(fingerprint_links(groups, distance, bucket)).select(F.col("node.fp").alias("_fp"), F.when(~F.col("component.none"), F.col("component.least")).alias("reached"))
    named = groups.join(parts, F.col("fp") == F.col("_fp"), "left").select("fp", F.when(F.col("_fp").isNull(), F.col("least")).otherwise(F.col("reached")).alias("component_id"))
    return rows.join(written(named, "components"), "fp").select("doc_id", "t", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the group's ``component_id``; if rows with different
    texts share that id, the text with the smallest hash; of repeated rows, one."""
    rows = written(near_duplicates(docs, distance), "near-duplicates")
    stays = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("component_id").alias("_id")).agg(F.min("t").alias("_t"))
    goes = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left_anti")
    kept = drop_rows(docs, goes.select("doc_id", "t").distinct())
    again = rows.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
