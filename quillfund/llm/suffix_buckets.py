"""Byte-level substring dedup with a suffix array that is built by bucket-pointer refinement.

``windows`` finds which runs of 400-byte windows may repeat without settling it. The texts of the open runs are dealt out
by key and each task sorts its suffixes only as deep as the answer needs: a first pass puts positions into buckets by
their first eight bytes, and every later pass splits the buckets that still hold several positions by sorting on the
bucket identifiers of a later offset. Identifiers are updated in place, so a pass reuses what earlier passes refined and
the settled depth doubles. Positions that are alone in a bucket are done. Different texts are compared by bytes, not by
hash; a key that very many texts share is dealt out by longer shared content, so no group outgrows a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfund.llm.common import attach, keyed, table, written
from quillfund.llm.windows import classify, in_groups, kept_pieces, secret_key, settle, spans, window_runs

LENGTH = 400
#: Bytes hashed together to choose a window's key.
GRAM = 24
#: Bytes of text refined at once.
BATCH_BYTES = 2 << 20
#: Different texts of one group that a task takes; larger groups are dealt out again.
GROUP_TEXTS = 8192


def refine(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Bucket of each position at depth ``length``: equal numbers, equal strings. -1 where a string would pass its end
    (``ends[i]``: where the text that holds position i ends)."""
    room = ends - np.arange(len(text))
    depth = min(8, length)
    grams = np.zeros(len(text), np.uint64)
    for k in range(depth):
        grams[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(8 * k)
    bucket = np.full(len(text), -1, np.int64)
    active = np.flatnonzero(room >= depth)
    fresh = _number(bucket, active, grams[active], 0)
    while depth < length:
        step = min(depth, length - depth)
        active = active[room[active] >= depth + step]
        active = active[np.bincount(bucket[active], minlength=1)[bucket[active]] > 1]  # alone in a bucket: settled
        # Pointers are read before any of this pass is written. A settled position keeps its identifier, which no other
        # position with room for this depth has.
        fresh = _number(bucket, active, bucket[active] << 32 | bucket[active + step], fresh)
        depth += step
    bucket[room < length] = -1
    return bucket


def _number(bucket: np.ndarray, places: np.ndarray, keys: np.ndarray, fresh: int) -> int:
    """Gives the positions ``places`` new identifiers from ``fresh`` on, in the order of their keys; the next free one.
    Identifiers stay below 2**32: a batch of 2**21 positions takes at most as many in each of its few passes."""
    if not len(places):
        return fresh
    order = np.argsort(keys)
    keys = keys[order]
    names = fresh + np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    bucket[places[order]] = names
    return int(names[-1]) + 1


def repeated(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The positions of several joined texts whose ``length`` bytes start at another position too."""
    bucket = refine(text, ends, length)
    again = bucket >= 0
    again[again] = np.bincount(bucket[again], minlength=1)[bucket[again]] > 1
    return again


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_texts: int = GROUP_TEXTS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The byte spans of ``keyed`` documents that repeated ``length``-byte strings cover: doc_id, t, items of (begin, end)."""
    key = secret_key()
    whole, asked = classify(window_runs(docs, "byte", length, gram, key))
    settled = settle(docs, asked, "byte", length, gram, key, group_texts, in_groups(length, batch_bytes, 1, repeated))
    return spans(whole.unionByName(settled), length)


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, **limits) -> DataFrame:
    """``doc_id, data, removed, kept``: each row's UTF-8 bytes, the maximal spans removed and the bytes left.

    Every byte covered by a ``length``-byte string that starts at another place too, same document included, goes; strings
    are judged on the input. Null texts are empty; texts shorter than ``length`` keep everything; of repeated rows each
    loses its text. An empty table gives an empty result; other columns are not read.
    """
    docs = keyed(docs)
    found = attach(docs, repeated_spans(docs, length, **limits), "items", 24)
    data = F.col("text").cast("binary")
    pieces = kept_pieces("items", F.octet_length("text"))
    kept = F.when(F.col("items").isNull(), data).otherwise(F.aggregate(pieces, F.lit(b""), lambda acc, p: F.concat(acc, F.substring(data, p["begin"] + 1, p["size"]))))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    return found.select("doc_id", data.alias("data"), F.coalesce("items", none).alias("removed"), kept.alias("kept"))


def op6_suffix_buckets(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"]).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 s AS (SELECT r, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800),
 g AS (SELECT s.r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM s JOIN d ON d.r = s.r),
 hit AS (SELECT r, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
 island AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS n FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM hit) x),
 span AS (SELECT r, n, min(i) AS b, max(i) + 400 AS e FROM island GROUP BY r, n),
 piece AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS p FROM span),
 cut AS (SELECT piece.r, count(*) AS n_spans, sum(e - b) AS n_removed, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (b - p) AS BIGINT)), '' ORDER BY b) || substr(any_value(h), CAST(2 * max(e) + 1 AS BIGINT)) AS kept FROM piece JOIN d ON d.r = piece.r GROUP BY piece.r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.r = d.r
"""
