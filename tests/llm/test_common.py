"""Scratch tables and the joins of side tables."""

import os

from quillfund.llm.common import attach, clear_scratch, drop_rows, keyed, scratch_path, written

DOCS = "doc_id long, text string, t string, items string"


def test_scratch_is_cleared(spark):
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    kept = written(spark.range(3), "y")
    assert kept.count() == 3 and clear_scratch(spark) >= 2
    assert not os.path.exists(path.removeprefix("file:")) and clear_scratch(spark) == 0


def test_side_tables_both_ways(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y"), (1, "b", "x", "y"), (None, "a", "x", "y"), (None, None, "x", "y"), (1, "a", "x", "y")], DOCS)
    rows = keyed(docs)
    side = written(rows.where("text = 'a'").distinct().selectExpr("doc_id", "t", "array(1) AS items"), "side")
    for bound in (1 << 20, -1):
        got = sorted((r.doc_id or 0, r.text, r["items"]) for r in attach(rows, side, "items", 8, bound).collect())
        assert got == [(0, "", None), (0, "a", [1]), (1, "a", [1]), (1, "a", [1]), (1, "b", None)]
        left = drop_rows(docs, side.select("doc_id", "t"), bound)
        assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (1, "b")]
