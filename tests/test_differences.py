import random

import numpy as np

from pyspark.sql import functions as F

from quillstrata.functions.text import or_empty, uuid_key
from quillstrata.operators import differences as d


def brute(a, b):
    """(main, copy, field) for rows (id, key, name, value)."""
    out = set()
    akeys, bkeys = {r[1] for r in a if r[1]}, {r[1] for r in b if r[1]}
    pairs = [(x, y) for x in a for y in b if x[1] and x[1] == y[1]]
    a0, b0 = [r for r in a if r[1] not in bkeys or not r[1]], [r for r in b if r[1] not in akeys or not r[1]]
    pairs += [(x, y) for x in a0 for y in b0 if x[2] is not None and x[2] == y[2]]
    for x, y in pairs:
        out |= {(x[0], y[0], n) for n, i in (("uuid", 1), ("name", 2), ("value", 3)) if (x[i] or "") != (y[i] or "")}
    used = {x[0] for x, _ in pairs}, {y[0] for _, y in pairs}
    return out | {(x[0], 0, "") for x in a if x[0] not in used[0]} | {(0, y[0], "") for y in b if y[0] not in used[1]}


def run(spark, a, b):
    schema = "id long, uuid string, name string, value string, kh string"
    frames = [spark.createDataFrame([(*r, "clash") for r in rows], schema) for rows in (a, b)]
    fields = {n: or_empty(F.col(n)) for n in ("uuid", "name", "value")}
    found = d.field_differences(*frames, "id", uuid_key(F.col("uuid")), F.col("name"), fields)
    return sorted((r.main_id, r.copy_id, r.field) for r in found.collect())


def test_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64(-5L, 1234567890123L) AS a, xxhash64(-99L, 7) AS b").first()
    unsigned = lambda x: np.array([x], np.int64).view(np.uint64)
    signed = lambda x: int(x.view(np.int64)[0])
    assert (row.a, row.b) == (signed(d.xxhash64_longs(unsigned(-5), unsigned(1234567890123))), signed(d.xxhash64_longs(unsigned(-99), 7, second_is_int=True)))


def test_against_brute_force(spark):
    rng = random.Random(5)
    a = [(i, f"{i:08x}" if i % 9 else "", f"n{i}", rng.choice(["x", "y", None, ""])) for i in range(1, 300)]
    b = [(1000 + i, k if rng.random() > 0.1 else f"f{i:07x}", n if rng.random() > 0.1 else f"m{i}", v if rng.random() > 0.2 else "z") for i, k, n, v in a if rng.random() > 0.1]
    b += [(5000, None, None, "lone"), (5001, "", "only", "lone")]
    assert run(spark, a, b) == sorted(brute(a, b))


def test_equal_and_empty(spark):
    a = [(1, "aa", "n", "v"), (2, "bb", "m", "v")]
    assert run(spark, a, a) == []
    assert run(spark, a, []) == [(1, 0, ""), (2, 0, "")]
    assert run(spark, [], []) == []


def test_overfull_buckets_and_repeats(spark):
    left = spark.range(400).select(F.col("id").alias("kh"), F.col("id").alias("body"))
    right = spark.range(200, 700).select(F.col("id").alias("kh"), F.when(F.col("id") < 300, -F.col("id")).otherwise(F.col("id")).alias("body"))
    wanted = set(range(300)) | set(range(400, 700))
    for cells, differences in ((3, 1), (30, 1), (240, None), (3000, 1)):  # the first cannot peel: then all keys of a bucket count
        found = {r.kh for r in d.revealed_keys(left, right, cells=cells, differences=differences).collect()}
        assert found >= wanted and (cells < 240 or found == wanted)
    three = left.unionByName(left).unionByName(left)
    assert {r.kh for r in d.revealed_keys(three.where("kh < 5"), left.where("kh < 5")).collect()} == set(range(5))


def test_estimate_and_what_travels(spark):
    left = spark.range(0, 60_000, 1, 8).select(F.xxhash64("id").alias("kh"), F.xxhash64("id", F.lit(1)).alias("body"))
    assert d.estimated_differences(d._signed_pairs(left, left)) == 0
    for n in (10, 3000):
        right = left.where(F.pmod("kh", F.lit(60_000 // n)) != 0)
        lost = left.count() - right.count()
        assert lost / 3 <= d.estimated_differences(d._signed_pairs(left, right)) <= 3 * lost
        assert d.revealed_keys(left, right).count() == lost
    # cells are summed before they are sent: each of the 16 parts sends one row a cell at most
    tables = d._tables(d._signed_pairs(left, left), F.lit(0), d.CELLS // 3)
    plan = tables._jdf.queryExecution().executedPlan().toString()  # from the result down to the scan
    assert "partial_sum" in plan and plan.index("Exchange") < plan.index("partial_sum") < plan.index("Generate")
