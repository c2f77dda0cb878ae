"""Near-duplicate vectors by counting collisions in many one-dimensional projections.

A projection direction is the sum of one direction of each of two sets, so a few hundred dot products give tens of
thousands of projections. Every vector enters the lists of the projections in which it lies furthest out, where the order
is sparse. Lists are sorted by projection. Each vector is the centre of a window of fixed width, and the vectors inside
collide with it. For every colliding pair the collisions over all lists are counted; a pair that reaches the calibrated
count is verified once, by its cosine, in the first list in which it collides. No verified pair is dropped.

The number of lists and the count come from simulated pairs at the threshold itself: the fewest lists with which the
share of them that reaches a count of at least ``LEAST_COUNT`` is the recall asked for. Pairs above the threshold are
found at least as often. If no number of lists will do, the plan is refused with an error.

Equal vectors are one entry with a multiplicity. Lists that many vectors share (a large group of near copies) are split
into pairs of blocks, so no task holds one whole; what leaves a task is a count for each vector and a spanning set of
links, never all pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.llm.common import table, written
from quillfund.llm.components import connected_components

THRESHOLD = 0.9
#: Collisions that a pair needs at least, and the share of pairs at the threshold that must reach the count.
LEAST_COUNT, RECALL = 2, 0.97
#: Independent sets of directions; vectors that a list holds on average; most directions of a set.
SETS, LIST_SIZE, MOST_DIRECTIONS = 3, 40, 4096
#: Colliding pairs that are counted at once.
PAIRS = 20_000
#: Vectors of a list that a task compares; longer lists are split into pairs of blocks.
BLOCK = 2048
SEED = 20240229
#: By how much more than a window's reach a query looks, relative and absolute; places have 24 bits.
EDGE = 1e-4


@dataclass(frozen=True)
class Plan:
    dim: int
    directions: int
    lists: int  # per vector and set
    window: float
    count: int  # collisions that a pair needs


def directions(plan: Plan) -> np.ndarray:
    """(sets, two sides, directions, dim)"""
    return np.random.default_rng([SEED, plan.dim, plan.directions]).standard_normal((SETS, 2, plan.directions, plan.dim))


def enter(unit: np.ndarray, plan: Plan, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of each unit vector, ascending and so set by set, and its place (projection) in each."""
    names, places = [], []
    top = min(plan.lists, plan.directions)
    for s in range(SETS):
        near = []
        for side in range(2):
            h = unit @ ways[s, side].T
            best = np.argpartition(-h, top - 1, axis=1)[:, :top]
            near.append((best, np.take_along_axis(h, best, axis=1)))
        (a, ha), (b, hb) = near
        total = (ha[:, :, None] + hb[:, None, :]).reshape(len(unit), -1)
        best = np.argpartition(-total, top - 1, axis=1)[:, :top]
        i, j = np.take_along_axis(a, best // top, axis=1), np.take_along_axis(b, best % top, axis=1)
        names.append((s * plan.directions + i) * plan.directions + j)
        places.append(np.take_along_axis(total, best, axis=1))
    names, places = np.concatenate(names, axis=1).astype(np.int32), np.concatenate(places, axis=1).astype(np.float32)
    order = np.argsort(names, axis=1)
    return np.take_along_axis(names, order, axis=1), np.take_along_axis(places, order, axis=1)


def collisions(names_a, places_a, names_b, places_b, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of collisions of each pair of rows, and the first list in which they collide."""
    n, width = names_a.shape
    names_a, places_a, names_b, places_b = (x.reshape(n, SETS, width // SETS) for x in (names_a, places_a, names_b, places_b))
    both = (names_a[..., None] == names_b[..., None, :]) & (np.abs(places_a[..., None] - places_b[..., None, :]) <= window)
    met = both.any(axis=3).reshape(n, width)
    first = np.take_along_axis(names_a.reshape(n, width), met.argmax(axis=1)[:, None], axis=1)[:, 0]
    return met.sum(axis=1), np.where(met.any(axis=1), first, -1)


def calibrate(n: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL, pairs: int = 2000) -> Plan:
    """The fewest lists, and the highest count, that simulated pairs at the threshold reach often enough."""
    rng = np.random.default_rng([SEED, dim])
    x = rng.standard_normal((pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, dim))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold**2) * y / np.maximum(1e-12, np.linalg.norm(y, axis=1, keepdims=True))
    window = 3 * math.sqrt(2 * (2 - 2 * threshold))  # three deviations of the projected difference
    for lists in (3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128):
        many = int(max(lists, 8, min(MOST_DIRECTIONS, math.ceil(math.sqrt(n * lists / LIST_SIZE)))))
        plan = Plan(dim, many, lists, window, 0)
        ways = directions(plan)
        counts = collisions(*enter(x, plan, ways), *enter(y, plan, ways), window)[0]
        reached = int(np.quantile(counts, 1 - recall, method="lower"))  # ``recall`` of the pairs have so many or more
        if reached >= LEAST_COUNT:
            return replace(plan, count=reached)
    raise ValueError(f"no plan finds {recall:.0%} of the pairs with cosine {threshold} in {dim} dimensions")


def _compare(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, same: bool, name: int, plan: Plan, threshold: float):
    """Links between the rows ``a`` and ``b`` (the same rows: each pair once) that list ``name`` reports. Both are sorted
    by ``place``."""
    found = [(a[:0], a[:0])]
    # A little wider than the window: ``collisions`` alone decides what lies inside, with the same rounding in every list.
    reach = plan.window * (1 + EDGE) + EDGE
    low = np.searchsorted(rows["place"][b], rows["place"][a].astype(np.float64) - reach)
    high = np.searchsorted(rows["place"][b], rows["place"][a].astype(np.float64) + reach, side="right")
    if same:
        low = np.arange(1, len(a) + 1)
    size = np.maximum(0, high - low)
    for part in np.split(np.arange(len(a)), np.searchsorted(np.cumsum(size), np.arange(PAIRS, size.sum(), PAIRS))):
        # The window of each query: the places ``low`` to ``high``.
        many = size[part]
        p = np.repeat(a[part], many)
        q = b[np.repeat(low[part] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
        count, first = collisions(rows["names"][p], rows["places"][p], rows["names"][q], rows["places"][q], plan.window)
        mine = (count >= plan.count) & (first == name)
        p, q = p[mine], q[mine]
        near = np.einsum("ij,ij->i", rows["unit"][p], rows["unit"][q]) >= threshold
        found.append((p[near], q[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer than ``n`` of the links, which connect what all of them connect."""
    label, kept = np.arange(n), []
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        apart = np.flatnonzero(low < high)
        if not len(apart):
            break
        i, j, low, high = i[apart], j[apart], low[apart], high[apart]
        top, one = np.unique(high, return_index=True)
        kept.append((i[one], j[one]))
        label[top] = low[one]
        while (label != (jump := label[label])).any():
            label = jump
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (i[:0], j[:0])


def usable(column: str):
    """Vectors that can link: no null, NaN or infinite component, and not all zero."""
    v = F.col(column)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors (node, copies, vector): the links of each node, counted in copies, and spanning links (a, b)."""
    sizes = classes.groupBy(F.size("vector").alias("dim")).count().collect()  # one row for each dimension in use
    plans = {r.dim: calibrate(r["count"], r.dim, threshold, recall) for r in sizes}

    kind = np.float32 if dict(classes.dtypes)["vector"] == "array<float>" else np.float64

    def lists(batches):
        """For each dimension of a batch, in slices: (rows, vectors, names, places)."""
        ways = {dim: directions(plan) for dim, plan in plans.items()}
        for batch in batches:
            vectors = [v.values.to_numpy(zero_copy_only=False) for v in batch.column(batch.schema.get_field_index("vector"))]
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    yield batch, int(dim), part, [vectors[k] for k in part], *enter(_units([vectors[k] for k in part]), plans[dim], ways[dim])

    def size(batches):
        for _, dim, _, _, names, _ in lists(batches):
            name, c = np.unique(names, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), dim, np.int32)), pa.array(name), pa.array(c)], ["dim", "name", "c"])

    def assign(batches):
        for batch, dim, part, vectors, names, places in lists(batches):
            width = names.shape[1]
            each = np.repeat(np.arange(len(part)), width)
            node, copies = (batch.column(batch.schema.get_field_index(c)).to_numpy()[part][each] for c in ("node", "copies"))
            own = [pa.array(np.full(len(each), dim, np.int32)), pa.array(names.ravel()), pa.array(places.ravel()), pa.array(node), pa.array(copies)]
            shared = [pa.array([x.tobytes() for x in vectors], pa.binary()).take(pa.array(each))]
            shared += [pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * width), pa.array(x[each].ravel())) for x in (names, places)]
            yield pa.RecordBatch.from_arrays([*own, *shared], ["dim", "name", "place", "node", "copies", "vector", "names", "places"])

    def compare(batches):
        held = None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            whole = pa.concat_tables([held, whole]).combine_chunks() if held is not None else whole
            key = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("dim", "name", "p", "q")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    yield from report(whole.slice(a, b - a))
            held = whole.slice(cuts[-1])
        if held is not None and len(held) > 1:
            yield from report(held)

    def report(group):
        group = group.combine_chunks()
        dim, name, p, q = (group.column(c)[0].as_py() for c in ("dim", "name", "p", "q"))
        rows = {"unit": _units([np.frombuffer(v, kind) for v in group.column("vector").to_pylist()]), "place": group.column("place").to_numpy()}
        for c in ("names", "places"):
            rows[c] = group.column(c).chunk(0).flatten().to_numpy().reshape(len(group), -1)
        part = group.column("part").to_numpy()
        a, b = np.flatnonzero(part == p), np.flatnonzero(part == q)
        i, j = _compare(rows, a, b, p == q, name, plans[dim], threshold)
        if not len(i):
            return
        node, copies = (group.column(c).to_numpy() for c in ("node", "copies"))
        count = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        hit = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(count[hit].astype(np.int64)), pa.nulls(len(hit), pa.int64())], ["node", "links", "other"])
        i, j = _spanning(i, j, len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.nulls(len(i), pa.int64()), pa.array(node[j])], ["node", "links", "other"])

    sizes = classes.select("vector").mapInArrow(size, "dim int, name int, c long").groupBy("dim", "name").agg(F.sum("c").alias("c"))
    crowded = written(sizes.where(F.col("c") > block), "crowded-lists")
    entries = classes.select("node", "copies", "vector").mapInArrow(assign, "dim int, name int, place float, node long, copies long, vector binary, names array<int>, places array<float>")
    whole = [F.lit(0).alias("part"), F.lit(0).alias("p"), F.lit(0).alias("q")]
    if crowded.isEmpty():
        dealt = entries.select("*", *whole)
    else:
        parts = F.ceil(F.col("c") / block).cast("int")
        dealt = entries.join(crowded.drop("c"), ["dim", "name"], "left_anti").select("*", *whole)
        split = entries.join(crowded, ["dim", "name"]).withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = dealt.unionByName(split.select(*entries.columns, "part", F.least("part", "other").cast("int").alias("p"), F.greatest("part", "other").cast("int").alias("q")))
    keys = ["dim", "name", "p", "q"]
    found = dealt.repartition(*keys).sortWithinPartitions(*keys, "place").mapInArrow(compare, "node long, links long, other long")
    found = written(found, "links")
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    return counts, found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row (vec_id, embedding).

    Rows without a usable vector, or without a vec_id, link with nothing: n_links 0, component_id their vec_id, kept true.
    Vectors link only within their dimension. Repeated rows are vectors of their own and link with each other; rows that share a
    vec_id are one node of the graph. An empty table gives an empty result; other columns (labels) are not read.
    """
    single = dict(vectors.dtypes)["embedding"] == "array<float>"  # kept so, and compared in double precision
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("embedding") if single else F.col("embedding").cast("array<double>")).alias("vector"))
    can = F.col("vec_id").isNotNull() & usable("vector")
    classes = written(rows.where(can).groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors")
    counts, edges = links(classes, threshold, recall, block)
    parts = connected_components(edges)
    classes = classes.join(counts, "node", "left").join(parts, "node", "left")
    classes = classes.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = rows.where(can).join(classes, "vector").select("vec_id", "n_links", "component_id")
    others = rows.where(~can | can.isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs: equal as long as no link is missed.
OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
 reach AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.id)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.a = vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT id, min(c) AS component_id FROM reach GROUP BY id) m ON m.id = vec_id
"""
