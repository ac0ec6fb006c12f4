import pytest
from pyspark.sql import functions as F

from quillstrata.operators import references
from quillstrata.operators.references import orphan_references

T0, T1, T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"


def frames(spark):
    refs = spark.createDataFrame(
        [(1, "a", "x", T1), (2, "a", None, T1), (3, None, "q", T1), (4, "b", "y", T1), (5, "gone", "z", T1), (6, "no", "z", T1), (7, None, None, T1), (8, "a", "x", None), (8, "no", "z", None)],
        "rec long, p string, q string, at string",
    ).withColumn("at", F.col("at").cast("timestamp")).withColumn("from_at", F.lit("clash"))
    targets = spark.createDataFrame([("a", "x", T0), ("a", "x", T2), ("b", "y", T2), ("c", "w", None)], "p string, q string, at string").withColumn("at", F.col("at").cast("timestamp"))
    deleted = spark.createDataFrame([("gone", "z"), ("gone", "z"), ("a", "x")], "p string, q string")
    return refs, targets, deleted


def run(spark, match, empty=False):
    refs, targets, deleted = frames(spark)
    if empty:
        targets, deleted = targets.limit(0), deleted.limit(0)
    keys = [F.col("p"), F.col("q")]
    out = orphan_references(refs, "rec", keys, F.col("at"), targets, keys, F.col("at"), deleted, keys, match=match)
    return sorted((r.row_id, r.reason) for r in out.collect())


def test_masks(spark):
    whole = [(4, "late"), (5, "deleted"), (6, "missing"), (8, "missing")]
    assert run(spark, "simple") == whole
    assert run(spark, "partial") == sorted([*whole, (3, "missing")])
    assert run(spark, "full") == sorted([*whole, (2, "incomplete"), (3, "incomplete")])


def test_empty(spark):
    assert run(spark, "simple", empty=True) == [(1, "missing"), (4, "missing"), (5, "missing"), (6, "missing"), (8, "missing"), (8, "missing")]
    with pytest.raises(ValueError):
        run(spark, "other")


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(references, "SAMPLED", 4)
    refs = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "gone").otherwise(F.concat(F.lit("k"), "id")).alias("k"), F.lit(T1).cast("timestamp").alias("at"))
    hot = {r.k0: r.parts for r in references.hot_keys(refs.select(F.col("id").alias("row_id"), F.col("k").alias("k0")), ["k0"]).collect()}
    assert set(hot) == {"hot", "gone"} and min(hot.values()) > 30
    targets = spark.createDataFrame([("hot", T0), ("k2", T2)], "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    keys = [F.col("k")]
    found = orphan_references(refs, "id", keys, F.col("at"), targets, keys, F.col("at"), spark.createDataFrame([("gone",)], "k string"), keys)
    assert {r.reason: r["count"] for r in found.groupBy("reason").count().collect()} == {"late": 1, "deleted": 2000, "missing": 1999}
    assert references.hot_keys(refs.where("id % 3 = 2").select(F.col("id").alias("row_id"), F.col("k").alias("k0")), ["k0"]) is None
