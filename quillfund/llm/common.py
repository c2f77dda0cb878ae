"""Helpers that the training-data operators share.

Rows are told apart by ``(doc_id, text)``: ``keyed`` adds ``t``, the XXH64 of the text, so that a null or repeated
``doc_id`` never mixes two documents, and nothing depends on the order in which Spark reads rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.scratch import BROADCAST_BYTES, clear_scratch, scratch_path, shared_dir, written

__all__ = ["BROADCAST_BYTES", "attach", "clear_scratch", "drop_rows", "fold", "keyed", "labelled", "scratch_path", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, ``t`` and ``text`` (null text becomes empty) of every row, plus the named columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"), *columns)


def attach(docs: DataFrame, side: DataFrame, items: str, item_bytes: int, bound: int | None = None) -> DataFrame:
    """Left join of ``docs`` (of ``keyed``) with one ``side`` row per ``(doc_id, t)``.

    ``side`` is a written table; ``items`` names its array column. Its size is measured first: up to ``bound`` bytes
    (``BROADCAST_BYTES``) it is broadcast and the texts stay where they are, beyond that both sides are shuffled by document.
    """
    bound = BROADCAST_BYTES if bound is None else bound
    rows, total = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(items)), F.lit(0))).first()
    side = side.withColumnsRenamed({"doc_id": "_side_id", "t": "_side_t"})
    side = F.broadcast(side) if rows * 80 + total * item_bytes <= bound else side.hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(side["_side_id"]) & (docs["t"] == side["_side_t"])
    return docs.join(side, same, "left").drop("_side_id", "_side_t")


def drop_rows(docs: DataFrame, gone: DataFrame, bound: int | None = None) -> DataFrame:
    """``docs`` without the rows whose ``(doc_id, t)`` is in ``gone``; all columns stay. ``gone`` is broadcast if its
    measured size is at most ``bound`` bytes (``BROADCAST_BYTES``), and shuffled with the documents otherwise."""
    bound = BROADCAST_BYTES if bound is None else bound
    gone = written(gone.select(F.col("doc_id").alias("_gone_id"), F.col("t").alias("_gone_t")), "gone")
    gone = F.broadcast(gone) if gone.count() * 40 <= bound else gone.hint("shuffle_hash")
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (text == gone["_gone_t"]), "left_anti")


def fold(doc_id: str, modulus: int):
    """``crc32(doc_id as text) mod modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled(docs: DataFrame, labels: DataFrame, label: str, use, most: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``most`` documents with a label 0 or 1, chosen by a hash of the id among those for
    which ``use`` holds: the bounded sample that classifiers are fitted on. Null texts count as empty."""
    y = F.col(label).cast("int")
    chosen = labels.where(use & y.isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), y.alias("y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "y").limit(most)  # so small enough to broadcast
    return keyed(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
