"""Evaluation statistics: agreement, intervals, sweeps, percentiles, samples and the paired bootstrap."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z = 1.96


def rate(k: Column, n: Column) -> Column:
    return F.when(n > 0, F.round(k / n, 4))


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """struct(low, high) of a binomial share, within [0, 1]; null for n = 0."""
    p, d = k / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def nearest_place(n: Column, p: float) -> Column:
    """The rank ceil(p% of n) of n sorted values, from 1."""
    return F.greatest(F.lit(1), F.ceil(n * p / 100).cast("long"))


def floor_place(n: Column, f: float) -> Column:
    """The rank of index floor(f * n), at most the last."""
    return F.least(n, F.floor(n * f).cast("long") + 1)


def rounded_place(n: Column, q: float) -> Column:
    """The rank of index round(q * (n - 1)), half to even."""
    return F.bround(q * (n - 1)).cast("long") + 1


def nearest_rank(values: Column, p: float) -> Column:
    """Of a sorted array: the value at ``nearest_place``."""
    return F.get(values, (nearest_place(F.size(values), p) - 1).cast("int"))


def floor_index(values: Column, f: float) -> Column:
    """Of a sorted array: the value at ``floor_place``."""
    return F.get(values, (floor_place(F.size(values), f) - 1).cast("int"))


#: Cells of equal width that a range of values is cut into, twice.
CELLS = 1000


def _cut(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds the cell of each value between the least and greatest finite value of its group; later cells hold greater values."""
    v = F.col("v").cast("double")
    finite = F.when(F.abs(v) < float("inf"), v)
    edges = counts.groupBy(*by).agg(F.min(finite).alias("low"), F.max(finite).alias("high"))
    low, high = F.col("low"), F.col("high")
    inside = F.when(high > low, F.least(F.lit(CELLS - 1), F.floor((v - low) / (high - low) * CELLS))).otherwise(0)
    cell = F.when(v < low, -1).when(v > high, CELLS).otherwise(inside)
    return counts.join(edges, by).withColumn(name, cell.cast("int")).drop("low", "high")


def order_values(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``keys``, ``n`` and, by name, exact order statistics of each group: the value at a rank (from 1) that is a function of
    n, the number of values that are not null. Groups without values are left out; NaN is the greatest value.

    No task holds a group: equal values are counted first, their counts fall into cells of the range of values, and only
    cells that hold an asked rank are sorted (on disk if need be). Spans of finite values must be finite."""
    counts = rows.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_key"), F.col(value).alias("v")).groupBy("_key", "v").agg(F.count(F.lit(1)).alias("c"))
    cell = ["_key", "outer", "inner"]
    counts = _cut(_cut(counts, ["_key"], "outer"), cell[:2], "inner")
    key = Window.partitionBy("_key")
    cells = counts.groupBy(*cell).agg(F.sum("c").alias("m")).withColumn("n", F.sum("m").over(key)).withColumn("below", F.sum("m").over(key.orderBy("outer", "inner")) - F.col("m"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), (rank(F.col("n")) - F.col("below")).alias("rank")) for name, rank in ranks.items()])
    asked = cells.select(*cell, "n", F.filter(asked, lambda a: (a["rank"] >= 1) & (a["rank"] <= F.col("m"))).alias("asked")).where(F.size("asked") > 0)
    held = counts.join(asked, cell).withColumn("upto", F.sum("c").over(Window.partitionBy(*cell).orderBy("v")))
    hits = F.filter("asked", lambda a: (a["rank"] <= F.col("upto")) & (a["rank"] > F.col("upto") - F.col("c")))
    found = held.select("_key", "n", "v", F.explode(hits).alias("hit"))
    at = lambda name: F.max(F.when(F.col("hit.name") == name, F.col("v"))).alias(name)
    return found.groupBy("_key").agg(F.first("n").alias("n"), *[at(name) for name in ranks]).select("_key.*", "n", *ranks)


def percentiles(rows: DataFrame, keys: list[str], value: str, asked: dict[str, float]) -> DataFrame:
    """``keys``, ``n`` and percentiles of each group by linear interpolation between the two ranks around them (``order_values``),
    by name. Without keys all rows are one group; groups without values are left out."""
    by = keys or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    places = {}
    for name, q in asked.items():
        places[f"{name}_low"] = lambda n, q=q: F.floor(q * (n - 1)) + 1
        places[f"{name}_high"] = lambda n, q=q: F.ceil(q * (n - 1)) + 1
    found = order_values(rows, by, value, places)
    part = lambda q: q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))
    low, high = (lambda name: F.col(f"{name}_low")), (lambda name: F.col(f"{name}_high"))
    return found.select(*keys, "n", *[(low(name) + (high(name) - low(name)) * part(q)).alias(name) for name, q in asked.items()])


def same_keys(keys: list[str], prefix: str = "_") -> Column:
    """Whether ``keys`` equal the columns with the ``prefix``, nulls too."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def kappa(pairs: DataFrame, x: str, y: str, linear: bool = False, categories: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Cohen's kappa of two raters over the given categories and all that occur; 1 if chance disagreement is 0. One row
    from at most (categories squared) counts."""
    counts = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("a"), F.col(y).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = counts.groupBy("a").agg(F.sum("n").alias("ra")), counts.groupBy("b").agg(F.sum("n").alias("cb"))
    known = counts.select(F.col("a").alias("c")).unionByName(counts.select(F.col("b").alias("c"))).unionByName(pairs.sparkSession.createDataFrame([(c,) for c in categories], "c int").select("c")).distinct()
    order = known.select("c", (F.row_number().over(Window.orderBy("c")) - 1).alias("place"))  # categories only
    size = known.agg(F.count(F.lit(1)).alias("k"))
    place = lambda name: order.select(F.col("c").alias(name), F.col("place").alias(f"p{name}"))
    weight = F.abs(F.col("pa") - F.col("pb")) / (F.col("k") - 1) if linear else F.when(F.col("a") == F.col("b"), 0.0).otherwise(1.0)
    chance = rows.crossJoin(cols).join(place("a"), "a").join(place("b"), "b").crossJoin(size)
    seen = counts.join(place("a"), "a").join(place("b"), "b").crossJoin(size).agg(F.sum(weight * F.col("n")).alias("num"), F.sum("n").alias("n"))
    wide = chance.agg(F.sum(weight * F.col("ra") * F.col("cb")).alias("den"))
    den = F.col("den") / (F.col("n") * F.col("n"))
    return seen.crossJoin(wide).select("n", F.when(F.coalesce(den, F.lit(0.0)) == 0, 1.0).otherwise(1 - F.col("num") / F.col("n") / den).alias("kappa"))


def sweep(scored: DataFrame, low: float = 0.5, step: float = 0.005, n: int = 101) -> DataFrame:
    """Counts and rates at each threshold of (label, category, sim, guard_ok). Scores are first cut down to one count for
    each grid cell, so the grid meets at most ``n`` + 1 cells of each kind, not the rows."""
    cell = F.greatest(F.lit(-1), F.least(F.lit(n - 1), F.floor((F.col("sim") - low) / step + 1e-9))).cast("int")
    cells = scored.groupBy(cell.alias("cell"), "label", "category", "guard_ok").agg(F.count(F.lit(1)).alias("n"))
    grid = scored.sparkSession.range(n).select(F.col("id").cast("int").alias("k"), F.round(low + step * F.col("id"), 3).alias("threshold"))
    over = F.col("cell") >= F.col("k")
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    same, hard, far = F.col("label") == "same", F.col("category") == "hard_negative", F.col("category") == "unrelated"
    out = cells.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(add(same)("n_pos"), add(hard)("n_hard"), add(far)("n_unrelated"), add(same & over)("tp"), add(hard & over)("fp_hard"), add(far & over)("fp_unrelated"), add(hard & over & F.col("guard_ok"))("fp_hard_guarded"))
    return out.withColumn("recall", F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos"))).withColumn("recall_ci", wilson(F.col("tp"), F.col("n_pos")))


def select_threshold(swept: DataFrame, floor: float = 0.0, unrelated: bool = False) -> DataFrame:
    bad = F.col("fp_hard") + (F.col("fp_unrelated") if unrelated else 0)
    return swept.where((bad == 0) & (F.col("threshold") >= floor)).agg(F.min("threshold").alias("threshold"))


def stratified_split(items: DataFrame, stratum: str, text: str, share: float = 0.3) -> DataFrame:
    """Per stratum in order of sha256(stratum NUL text): the first round(share * n), half to even, are dev, the rest test."""
    w = Window.partitionBy(stratum)
    order = F.sha2(F.concat(F.col(stratum).cast("string"), F.lit("\0"), F.col(text)), 256)
    rows = items.withColumn("_k", F.row_number().over(w.orderBy(order, text))).withColumn("_n", F.count(F.lit(1)).over(w))
    return rows.withColumn("split", F.when(F.col("_k") <= F.bround(share * F.col("_n")), "dev").otherwise("test")).drop("_k", "_n")


def spot_sample(items: DataFrame, stratum: str, key: str, k: int, prefix: str = "spotcheck-v1:") -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(prefix), F.col(key).cast("string")), 256), key)
    return items.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def proportional_sample(items: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """max(1, round(n * stratum / all)) rows of each stratum by a seeded hash."""
    sizes = items.groupBy(stratum).agg(F.count(F.lit(1)).alias("_s"))
    sizes = sizes.crossJoin(items.agg(F.count(F.lit(1)).alias("_all"))).select(stratum, F.greatest(F.lit(1), F.bround(n * F.col("_s") / F.col("_all"))).alias("_take"))
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(0), key), key)
    return items.withColumn("_k", F.row_number().over(w)).join(sizes, stratum).where("_k <= _take").drop("_k", "_take")


def compare_gold(items: DataFrame, results: DataFrame) -> DataFrame:
    """Results of queries (query_id, first: the first cell of each row, as text) against gold answers (query_id,
    answer_type, gold: texts, tolerance): query_id, rows, correct.

    ``numeric``: one row within the tolerance; ``entity``: one row, equal; ``list``: the same set of cells; ``text``: any row.
    Counts and the sets of distinct cells are gathered; only lists keep more than one cell."""
    kinds = items.select("query_id", "answer_type")
    cell = F.when(F.col("answer_type") == "list", F.col("first"))
    found = results.join(kinds, "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("rows"), F.max("first").alias("one"), F.collect_set(cell).alias("cells"))
    rows = items.join(found, "query_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    gold = F.get("gold", F.lit(0))
    single = F.col("rows") == 1
    near = F.abs(F.col("one").try_cast("double") - gold.try_cast("double")) <= F.coalesce("tolerance", F.lit(0.0))
    same = F.sort_array(F.coalesce("cells", F.array().cast("array<string>"))) == F.sort_array(F.array_distinct("gold"))
    kind = F.col("answer_type")
    correct = F.when(kind == "numeric", single & near).when(kind == "entity", single & F.col("one").eqNullSafe(gold)).when(kind == "list", same).otherwise(F.col("rows") > 0)
    return rows.select("query_id", "rows", F.coalesce(correct, F.lit(False)).alias("correct"))


#: Draws that one md5 decides, four hexadecimal digits for each.
HASH_DRAWS = 8
#: 65536 times the probabilities of at most 0, 1, ... events of a Poisson distribution with mean 1.
POISSON = (24109, 48218, 60273, 64291, 65296, 65497, 65531, 65536)


def paired_bootstrap(pairs: DataFrame, key: str, a: str, b: str, draws: int = 10_000, seed: int = 0, parts: Column | None = None) -> DataFrame:
    """part, n, mean(b - a), its 95 % interval and the share of resampled means <= 0, for each of the ``parts`` (an array of
    names; by default all are ``all``) of a pair. Pairs need both values; draws that weigh nothing are left out.

    A draw weighs each pair by a Poisson(1) count that the md5 of seed, key and draw determines, so any engine gets the same
    draws. Weights and weighted differences of a block of draws are summed in each task before anything is shuffled."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("_key"), (F.col(b) - F.col(a)).cast("double").alias("d"), (F.array(F.lit("all")) if parts is None else parts).alias("parts"))
    mean = rows.select("d", F.explode("parts").alias("part")).groupBy("part").agg(F.avg("d").alias("mean"), F.count(F.lit(1)).alias("n"))
    hashed = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // HASH_DRAWS)))).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "_key", F.lit(":"), F.col("block").cast("string")).cast("binary")))
    digits = [F.conv(F.substring("h", 4 * k + 1, 4), 16, 10).cast("int") for k in range(HASH_DRAWS)]
    weight = lambda u: reduce(Column.__add__, [(u >= edge).cast("int") for edge in POISSON[:-1]])
    weighed = hashed.select("parts", "d", "block", *[weight(u).alias(f"w{k}") for k, u in enumerate(digits)]).withColumn("part", F.explode("parts"))
    sums = weighed.groupBy("part", "block").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(HASH_DRAWS)], *[F.sum(F.col(f"w{k}") * F.col("d")).alias(f"t{k}") for k in range(HASH_DRAWS)])
    each = sums.select("part", "block", F.posexplode(F.array(*[(F.col(f"t{k}") / F.nullif(F.col(f"w{k}"), F.lit(0))).alias("m") for k in range(HASH_DRAWS)])).alias("k", "m"))
    each = each.where((F.col("block") * HASH_DRAWS + F.col("k") < draws) & F.col("m").isNotNull())
    means = each.groupBy("part").agg(F.sort_array(F.collect_list("m")).alias("ms"), F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0)).alias("share_not_better"))  # ``draws`` values
    return mean.join(means, "part").select("part", "n", "mean", floor_index(F.col("ms"), 0.025).alias("low"), floor_index(F.col("ms"), 0.975).alias("high"), "share_not_better")


def similarity_distribution(scored: DataFrame) -> DataFrame:
    """Per category, and per first part of the subtype of hard negatives: n, least, quartiles at index floor(f n), greatest."""
    labels = F.array_compact(F.array(F.col("category"), F.when(F.col("category") == "hard_negative", F.concat(F.lit("hard:"), F.split("subtype", "_")[0]))))
    rows = scored.select(F.explode(labels).alias("kind"), "sim")
    found = order_values(rows, ["kind"], "sim", {"least": lambda n: F.lit(1), "p25": lambda n: floor_place(n, 0.25), "median": lambda n: floor_place(n, 0.5), "p75": lambda n: floor_place(n, 0.75), "greatest": lambda n: n})
    return found.withColumn("n", F.col("n").cast("int"))


def compare_configurations(a: DataFrame, b: DataFrame, group: str, draws: int = 2000) -> DataFrame:
    """Paired bootstrap of two runs (id, value) over all and in each group (of a), in one plan; pairs need both values, and a
    null group is ``null``."""
    pairs = a.select("id", group, F.col("value").alias("a")).join(b.select("id", F.col("value").alias("b")), "id")
    return paired_bootstrap(pairs, "id", "a", "b", draws, parts=F.array(F.lit("all"), F.coalesce(F.col(group).cast("string"), F.lit("null"))))


def overlap_quantiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, inclusive quartiles and range of a score for each key value, four digits."""
    kinds = F.explode(F.array(*[F.concat_ws("=", F.lit(k), F.col(k).cast("string")) for k in keys])).alias("kind")
    out = rows.select(kinds, F.col(value).cast("double").alias("v"))
    four = lambda c, name: F.round(c, 4).alias(name)
    quartiles = percentiles(out, ["kind"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n").withColumnRenamed("kind", "_kind")
    base = out.groupBy("kind").agg(F.count("v").alias("n"), four(F.avg("v"), "mean"), four(F.min("v"), "least"), four(F.max("v"), "greatest"))
    return base.join(quartiles, same_keys(["kind"]), "left").select("kind", "n", "mean", *[four(F.col(c), c) for c in ("p25", "p50", "p75")], "least", "greatest")


def without_malformed(scored: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose six-digit runs before a space and a digit are all known codes, and the ids of the others."""
    runs = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(q, F.lit(r"(\d{6})(?=\s\d)"), F.lit(1)) for q in ("q1", "q2")])))
    bad = scored.select("id", F.explode(runs).alias("code")).join(codes.select("code"), "code", "left_anti").select("id").distinct()
    return scored.join(bad, "id", "left_anti"), bad


def reachability(hits: DataFrame, evidence: DataFrame, whole: DataFrame) -> DataFrame:
    """Per quote (query_id, ev_no): whether any chunk holds it whole, and whether any chunk reaches it by the run rule."""
    keys = ["query_id", "ev_no"]
    rows = evidence.select(*keys).distinct().join(hits.select(*keys, F.lit(True).alias("reached")).distinct(), keys, "left").join(whole.select(*keys, F.lit(True).alias("whole")).distinct(), keys, "left")
    return rows.fillna(False, ["reached", "whole"])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def percentile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: 0.95 * (n - 1)
    ranks = {"nearest": lambda n: nearest_place(n, 95), "floored": lambda n: floor_place(n, 0.95), "rounded": lambda n: rounded_place(n, 0.9), "disc": lambda n: nearest_place(n, 50), "before": lambda n: F.floor(at(n)) + 1, "after": lambda n: F.ceil(at(n)) + 1}
    part = at(F.col("n")) - F.floor(at(F.col("n")))
    linear = F.col("before") + (F.col("after") - F.col("before")) * part
    return order_values(_events(spark, sf_dir), ["event_type"], "value", ranks).select("event_type", "nearest", F.round(linear, 6).alias("linear"), "floored", "rounded", "disc")


def kappa_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kappa(rows, "quality", "toxic").select("n", F.round("kappa", 6).alias("kappa")).withColumn("weights", F.lit("none")).unionByName(kappa(rows, "quality", "toxic", True).select("n", F.round("kappa", 6).alias("kappa")).withColumn("weights", F.lit("linear")))


_SCORED = "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'same' ELSE 'different' END AS label, CASE WHEN event_type = 'error' THEN 'hard_negative' WHEN event_type = 'signup' THEN 'unrelated' ELSE 'positive' END AS category, value / 300 AS sim, event_id % 3 <> 0 AS guard_ok FROM events"


def sweep_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = spark.sql(_SCORED.replace("events", "{events}"), events=_events(spark, sf_dir))
    return sweep(scored).select("threshold", "n_pos", "n_hard", "n_unrelated", "tp", "fp_hard", "fp_unrelated", "fp_hard_guarded", F.round("recall", 6).alias("recall"), F.round("recall_ci.low", 6).alias("low"), F.round("recall_ci.high", 6).alias("high"))


def split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return stratified_split(parts.select("p_type", "p_partkey", F.concat_ws(" ", "p_partkey", "p_name").alias("question")), "p_type", "question").select("p_partkey", "split")


def spot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_sample(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_mktsegment", "c_custkey", 4).select("c_mktsegment", "c_custkey")


def bootstrap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("user_id").pivot("event_type", ["view", "click"]).avg("value")
    return paired_bootstrap(rows, "user_id", "view", "click", draws=2000).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "share_not_better")])


def distribution_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_SCORED.replace("events", "{events}").replace(" AS guard_ok", " AS guard_ok, concat('s', user_id % 3, '_x') AS subtype"), events=_events(spark, sf_dir))
    return similarity_distribution(rows)


def overlap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_quantiles(spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("year", F.year("o_orderdate")), ["o_orderpriority", "year"], "o_totalprice")


def configurations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_orderpriority", F.col("o_totalprice").alias("value"))
    found = compare_configurations(rows, rows.withColumn("value", F.col("value") + F.col("id") % 3), "o_orderpriority", 200)
    return found.select("part", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "share_not_better")])


def _bootstrap_sql(draws: int) -> str:
    """The draws of ``paired_bootstrap`` over d (part, id, d)."""
    return f"""
          h AS (SELECT part, d, j, b * {HASH_DRAWS} + j AS draw, md5('0:' || id || ':' || b) AS h FROM d CROSS JOIN range({(draws - 1) // HASH_DRAWS + 1}) x(b) CROSS JOIN range({HASH_DRAWS}) y(j)),
          w AS (SELECT part, draw, d, CAST('0x' || substr(h, CAST(4 * j + 1 AS BIGINT), 4) AS INT) AS u FROM h WHERE draw < {draws}),
          c AS (SELECT part, draw, d, {' + '.join(f'CAST(u >= {edge} AS INT)' for edge in POISSON[:-1])} AS c FROM w),
          m AS (SELECT part, sum(c * d) / nullif(sum(c), 0) AS m FROM c GROUP BY part, draw),
          l AS (SELECT part, list_sort(list(m)) AS ms, avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END) AS share FROM m WHERE m IS NOT NULL GROUP BY part),
          n AS (SELECT part, count(*) AS n, avg(d) AS mean FROM d GROUP BY part)
        SELECT part, n, round(mean, 6) AS mean, round(ms[least(len(ms), CAST(floor(len(ms) * 0.025) AS INT) + 1)], 6) AS low, round(ms[least(len(ms), CAST(floor(len(ms) * 0.975) AS INT) + 1)], 6) AS high, round(share, 6) AS share_not_better FROM n JOIN l USING (part)"""


QUERIES = {"a22_percentiles": percentile_query, "a15_kappa": kappa_query, "a11_threshold_sweep": sweep_query, "w9_stratified_split": split_query, "w10_spot_sample": spot_query, "a16_paired_bootstrap": bootstrap_query, "a13_similarity_distribution": distribution_query, "a24_overlap_quantiles": overlap_query, "a17_compare_configurations": configurations_query}
ORACLE_SQL = {
    "a22_percentiles": """
        SELECT event_type, v[greatest(1, CAST(ceil(len(v) * 0.95) AS INT))] AS nearest, round(linear, 6) AS linear, v[least(len(v), CAST(floor(len(v) * 0.95) AS INT) + 1)] AS floored, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS INT) + 1] AS rounded, disc
        FROM (SELECT event_type, list_sort(list(value)) AS v, quantile_cont(value, 0.95) AS linear, quantile_disc(value, 0.5) AS disc FROM events GROUP BY event_type) x""",
    "a15_kappa": """
        WITH o AS (SELECT quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*) AS n FROM o),
          w AS (SELECT 'none' AS weights, 1.0 AS f UNION ALL SELECT 'linear', 0.5),
          s AS (SELECT sum(abs(a - b)) AS num FROM o), d AS (SELECT sum(abs(x.a - y.b)) AS den FROM o x CROSS JOIN o y)
        SELECT n, round(1 - (f * num / n) / (f * den / (n * n)), 6) AS kappa, weights FROM w CROSS JOIN n CROSS JOIN s CROSS JOIN d""",
    "a11_threshold_sweep": f"""
        WITH s AS ({_SCORED}), g AS (SELECT round(0.5 + 0.005 * k, 3) AS threshold FROM range(101) t(k)),
          c AS (SELECT threshold, sum(CAST(label = 'same' AS INT)) AS n_pos, sum(CAST(category = 'hard_negative' AS INT)) AS n_hard, sum(CAST(category = 'unrelated' AS INT)) AS n_unrelated,
            sum(CAST(label = 'same' AND sim >= threshold AS INT)) AS tp, sum(CAST(category = 'hard_negative' AND sim >= threshold AS INT)) AS fp_hard, sum(CAST(category = 'unrelated' AND sim >= threshold AS INT)) AS fp_unrelated,
            sum(CAST(category = 'hard_negative' AND sim >= threshold AND guard_ok AS INT)) AS fp_hard_guarded FROM s CROSS JOIN g GROUP BY threshold),
          r AS (SELECT *, tp / n_pos AS p, 1 + 3.8416 / n_pos AS d FROM c)
        SELECT threshold, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_hard AS BIGINT) AS n_hard, CAST(n_unrelated AS BIGINT) AS n_unrelated, CAST(tp AS BIGINT) AS tp, CAST(fp_hard AS BIGINT) AS fp_hard, CAST(fp_unrelated AS BIGINT) AS fp_unrelated, CAST(fp_hard_guarded AS BIGINT) AS fp_hard_guarded, round(p, 6) AS recall,
          round(greatest(0, (p + 1.9208 / n_pos) / d - 1.96 * sqrt(p * (1 - p) / n_pos + 0.9604 / (n_pos * n_pos)) / d), 6) AS low,
          round(least(1, (p + 1.9208 / n_pos) / d + 1.96 * sqrt(p * (1 - p) / n_pos + 0.9604 / (n_pos * n_pos)) / d), 6) AS high FROM r""",
    "w9_stratified_split": """
        SELECT p_partkey, CASE WHEN k <= round_even(0.3 * n, 0) THEN 'dev' ELSE 'test' END AS split FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY sha256(p_type || chr(0) || p_partkey || ' ' || p_name), p_partkey || ' ' || p_name) AS k, count(*) OVER (PARTITION BY p_type) AS n FROM part) x""",
    "w10_spot_sample": "SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('spotcheck-v1:' || c_custkey), c_custkey) AS k FROM customer) x WHERE k <= 4",
    "a13_similarity_distribution": f"""
        WITH s AS ({_SCORED.replace("AS guard_ok", "AS guard_ok, concat('s', user_id % 3) AS sub")}), k AS (SELECT category AS kind, sim FROM s UNION ALL SELECT concat('hard:', sub), sim FROM s WHERE category = 'hard_negative'),
          l AS (SELECT kind, list_sort(list(sim)) AS v FROM k GROUP BY kind)
        SELECT kind, CAST(len(v) AS INT) AS n, v[1] AS least, v[least(len(v), CAST(floor(len(v) * 0.25) AS INT) + 1)] AS p25, v[least(len(v), CAST(floor(len(v) * 0.5) AS INT) + 1)] AS median, v[least(len(v), CAST(floor(len(v) * 0.75) AS INT) + 1)] AS p75, v[len(v)] AS greatest FROM l""",
    "a16_paired_bootstrap": f"""
        SELECT n, mean, low, high, share_not_better FROM (WITH e AS (SELECT user_id AS id, avg(CASE WHEN event_type = 'click' THEN value END) - avg(CASE WHEN event_type = 'view' THEN value END) AS d FROM events GROUP BY user_id),
          d AS (SELECT 'all' AS part, id, d FROM e WHERE d IS NOT NULL), {_bootstrap_sql(2000)}) r""",
    "a17_compare_configurations": f"""
        WITH e AS (SELECT o_orderkey AS id, o_orderpriority AS part, CAST((o_totalprice + o_orderkey % 3) - o_totalprice AS DOUBLE) AS d FROM orders WHERE o_totalprice IS NOT NULL),
          d AS (SELECT id, part, d FROM e UNION ALL SELECT id, 'all', d FROM e), {_bootstrap_sql(200)}""",
    "a24_overlap_quantiles": """
        SELECT kind, count(*) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(min(v), 4) AS least, round(max(v), 4) AS greatest
        FROM (SELECT concat('o_orderpriority=', o_orderpriority) AS kind, o_totalprice AS v FROM orders UNION ALL SELECT concat('year=', year(o_orderdate)), o_totalprice FROM orders) x GROUP BY kind""",
}
