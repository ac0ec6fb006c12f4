"""Differences between two copies of a table, by invertible Bloom lookup tables.

Each row is reduced to a pair of hashes, (key, body). A pair adds to three
cells of one bucket; a bucket is an invertible Bloom lookup table of CELLS
cells. The pairs of the second copy count negatively, which subtracts its
tables from those of the first while they are being built: equal rows vanish,
and only differences are left to be peeled.

Cells are summed where the rows are read, before anything is sent. There are as
many as the differences need, not the rows: a first table of strata, of fixed
size, estimates how many these are (stratum i holds the pairs whose hash ends
in i zeros; what peels from the upper strata says how much there is below). So
what travels grows with the differences. Buckets go by the hash of the whole
pair, so no key and no group can overload one.

A bucket that holds more differences than its cells can tell apart does not
peel; its pairs are then spread over FINER times as many buckets, by another
hash, and so on. What does not peel after ROUNDS counts as revealed as a
whole. So the result is exact whatever the estimate was.

Cells hold sums of 32-bit halves of the hashes, not exclusive-ors, so that
exact repeats of a row within a copy do not cancel each other: a cell with n
repeats of one pair is recognised by division.

Only the revealed keys are then fetched from both copies and compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.session import materialise

CELLS = 240  # per bucket, in three parts: each pair has one cell in each
PER_BUCKET = 96  # differences a bucket is meant for; up to some 190 peel
STRATA = 40  # levels of the estimate; one more takes all that is above
FINER = 8
ROUNDS = 3

_LOW = 0xFFFFFFFF


#: What a cell sums: the count, and both halves of key, body and check.
SUMS = ("n", "kh", "kl", "bh", "bl", "ch", "cl")


def _halves(column: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(column, 32), column.bitwiseAND(F.lit(_LOW))


def _signed_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    signed = left.select("kh", "body", F.lit(1).alias("sign")).unionByName(right.select("kh", "body", F.lit(-1).alias("sign")))
    return signed.withColumn("ih", F.xxhash64("kh", "body"))


def _tables(items: DataFrame, bucket: Column, part: int) -> DataFrame:
    """Rows ``(bucket, cells)``: the cells that are not zero, summed on the map side first."""
    sums = {"n": F.col("sign").cast("long")}
    for name, column in (("k", F.col("kh")), ("b", F.col("body")), ("c", F.xxhash64("ih", F.lit(7)))):
        for half, value in zip("hl", _halves(column)):
            sums[name + half] = value * F.col("sign")
    places = F.array(*(F.pmod(F.xxhash64("ih", F.lit(j)), F.lit(part)).cast("int") + F.lit(j * part) for j in range(3)))
    spread = items.select(bucket.alias("bucket"), F.explode(places).alias("cell"), *(value.alias(name) for name, value in sums.items()))
    table = spread.groupBy("bucket", "cell").agg(*(F.sum(name).alias(name) for name in SUMS))
    some = F.lit(False)
    for name in SUMS:
        some = some | (F.col(name) != 0)
    return table.where(some).groupBy("bucket").agg(F.collect_list(F.struct("cell", *SUMS)).alias("cells"))


def estimated_differences(items: DataFrame, cells: int = CELLS) -> int:
    """About how many pairs of ``_signed_pairs`` one side lacks, from strata; never less than what was peeled for certain."""
    part = cells // 3
    level = F.least(F.lit(STRATA), F.length(F.regexp_extract(F.lpad(F.bin("ih"), 64, "0"), "0*$", 0)))
    found = {r.bucket: r.cells for r in _tables(items, level, part).collect()}  # at most STRATA + 1 rows of fixed size
    total = 0
    for at in range(STRATA, -1, -1):
        if at not in found:
            continue
        peeled = peel(np.zeros(len(found[at]), np.int64), np.array([tuple(c) for c in found[at]], np.int64), 1, part)
        if peeled[1][0]:
            # strata below double from one to the next
            return max(total, 1) * (2 << at)
        total += len(peeled[0])
    return total


def revealed_keys(left: DataFrame, right: DataFrame, cells: int = CELLS, per_bucket: int = PER_BUCKET, differences: int | None = None) -> DataFrame:
    """Hashes of the keys whose rows are not the same in both: one column ``kh``, distinct.

    ``left`` and ``right`` have the columns ``kh`` and ``body`` (longs, no
    nulls). ``differences`` sizes the tables instead of the estimate; any
    number gives the right keys.
    """
    if cells % 3 or cells < 3:
        raise ValueError("cells must be a multiple of 3")
    part = cells // 3
    items = _signed_pairs(left, right)
    if differences is None:
        differences = estimated_differences(items)
    buckets = max(1, -(-differences // per_bucket))
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("kh", T.LongType())])

    def peel_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            owner = np.asarray(pc.list_parent_indices(lists))
            flat = lists.flatten()
            table = np.stack([flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(SUMS) + 1)], axis=1)
            keys, stuck = peel(owner, table, len(names), part)
            found = [pa.array(np.concatenate([names[keys[:, 0]], names[stuck]]), pa.int64()), pa.concat_arrays([pa.array(keys[:, 1], pa.int64()), pa.nulls(int(stuck.sum()), pa.int64())])]
            yield pa.RecordBatch.from_arrays(found, names=["bucket", "kh"])

    out, seed = None, 11
    for turn in range(ROUNDS):
        bucket = F.pmod(F.xxhash64("ih", F.lit(seed)), F.lit(buckets))
        peeled = materialise(_tables(items, bucket, part).mapInArrow(peel_batches, schema), "peeled")
        # a bucket that does not peel gives nothing in this turn: its pairs come again
        stuck = peeled.where("kh IS NULL").select("bucket")
        sure = peeled.join(stuck, "bucket", "left_anti").select("kh")
        out = sure if out is None else out.unionByName(sure)
        if stuck.isEmpty():
            return out.distinct()
        items = items.withColumn("bucket", bucket).join(stuck, "bucket", "left_semi").drop("bucket")
        buckets, seed = buckets * FINER, seed + 1
    return out.unionByName(items.select("kh")).distinct()


def peel(owner: np.ndarray, table: np.ndarray, buckets: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, key) of the pairs in subtracted tables, and by bucket whether some cannot be told apart.

    table: rows (cell, *SUMS) of the nonzero cells, owner: their buckets. All
    buckets are peeled together, one layer of certain cells at a time.
    """
    cells = np.zeros((buckets * 3 * part, len(SUMS)), np.int64)
    cells[owner * 3 * part + table[:, 0]] = table[:, 1:]
    found: list[np.ndarray] = []
    look = np.flatnonzero(cells.any(axis=1))
    while len(look):
        n = cells[look, 0]
        look, n = look[n != 0], n[n != 0]
        one, rest = np.divmod(cells[look, 1:], n[:, None])
        ok = ~rest.any(axis=1) & ((one >= 0) & (one <= _LOW)).all(axis=1)
        look, n, one = look[ok], n[ok], one[ok].astype(np.uint64)
        kh, body, check = (one[:, i] << np.uint64(32) | one[:, i + 1] for i in (0, 2, 4))
        ih = xxhash64_longs(kh, body)
        bucket, cell = look // (3 * part), look % (3 * part)
        places = np.stack([_modulo(xxhash64_longs(ih, j, second_is_int=True), part) + j * part for j in range(3)], axis=1)
        ok = (xxhash64_longs(ih, 7, second_is_int=True) == check) & (places == cell[:, None]).any(axis=1)
        if not ok.any():
            break
        # a pair is certain in up to three cells: it is taken out once
        _, once = np.unique(np.stack([bucket[ok], ih[ok].view(np.int64)]), axis=1, return_index=True)
        chosen = np.flatnonzero(ok)[once]
        taken = np.concatenate([n[chosen, None], one[chosen].astype(np.int64) * n[chosen, None]], axis=1)
        look = (bucket[chosen, None] * 3 * part + places[chosen]).ravel()
        np.subtract.at(cells, look, np.repeat(taken, 3, axis=0))
        found.append(np.stack([bucket[chosen], kh[chosen].view(np.int64)], axis=1))
        look = np.unique(look)
    stuck = cells.any(axis=1).reshape(buckets, 3 * part).any(axis=1)
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64), stuck


def _modulo(hashes: np.ndarray, part: int) -> np.ndarray:
    """As pmod of signed numbers."""
    return np.mod(hashes.view(np.int64), part)


# The five primes of the public XXH64 hash function.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_U = np.uint64


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x << _U(by) | x >> _U(64 - by)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(33)) * _U(_P2)
    h = (h ^ h >> _U(29)) * _U(_P3)
    return h ^ h >> _U(32)


def _one_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed + _U(_P5 + 8)
    h = h ^ _rotate(value * _U(_P2), 31) * _U(_P1)
    return _mix(_rotate(h, 27) * _U(_P1) + _U(_P4))


def _one_int(value: int, seed: np.ndarray) -> np.ndarray:
    h = seed + _U(_P5 + 4)
    h = h ^ np.full(1, value & _LOW, _U) * _U(_P1)
    return _mix(_rotate(h, 23) * _U(_P2) + _U(_P3))


def xxhash64_longs(first: np.ndarray, second: np.ndarray | int, second_is_int: bool = False) -> np.ndarray:
    """What Spark's xxhash64 gives for longs and second longs (or an int), all as unsigned arrays."""
    h = _one_long(first, np.full(1, 42, _U))
    return _one_int(second, h) if second_is_int else _one_long(second, h)


def field_differences(
    left: DataFrame,
    right: DataFrame,
    id_column: str,
    key: Column,
    name: Column,
    fields: Mapping[str, Column],
) -> DataFrame:
    """Rows ``(main_id, copy_id, field)``: unpartnered rows of either side and fields in which partners differ.

    Rows are partners if they have the same ``key``, or, when neither has a
    partner so, the same ``name``. ``fields`` gives the compared form of each
    field (never null). An id of 0 and the field '' mark a row without partner.

    Defined cases: rows with a null key have none; rows with a null name have
    no partner by name; if a side repeats a key, each of its rows is held
    against the other side's row of that key with the least id (and the other
    way round), so that repeats never multiply; rows equal in all compared
    fields give no row; empty tables give all rows of the other.
    """
    sides = [_prepared(side, id_column, key, name, fields) for side in (left, right)]
    keyed = [side.where(F.col("k").isNotNull()) for side in sides]
    keyless = [side.where(F.col("k").isNull()) for side in sides]
    hashed = [side.select(F.xxhash64("k").alias("kh"), "body") for side in keyed]
    keys = materialise(revealed_keys(*hashed), "revealed")

    def fetched(side: DataFrame) -> DataFrame:
        return side.withColumn("kh", F.xxhash64("k")).join(keys, "kh", "left_semi").drop("kh")

    main, copy = (fetched(side) for side in keyed)
    # written once: three branches follow, and each would run the tables anew
    by_key = materialise(_paired(main, copy, "k"), "pairs")
    alone_main = by_key.where("copy IS NULL").select("main.*")
    alone_copy = by_key.where("main IS NULL").select("copy.*")
    by_name = _paired(alone_main.unionByName(keyless[0]), alone_copy.unionByName(keyless[1]), "name")
    pairs = by_key.where("main IS NOT NULL AND copy IS NOT NULL").unionByName(by_name)
    ids = [F.coalesce(F.col("main.id"), F.lit(0)).cast("long").alias("main_id"), F.coalesce(F.col("copy.id"), F.lit(0)).cast("long").alias("copy_id")]
    differing = F.array(*(F.when(~F.col("main.f")[i].eqNullSafe(F.col("copy.f")[i]), F.lit(n)) for i, n in enumerate(fields)))
    fields_out = F.when(F.col("main").isNull() | F.col("copy").isNull(), F.array(F.lit(""))).otherwise(F.array_compact(differing))
    return pairs.select(*ids, F.explode(fields_out).alias("field"))


def _prepared(side: DataFrame, id_column: str, key: Column, name: Column, fields: Mapping[str, Column]) -> DataFrame:
    return side.select(F.col(id_column).alias("id"), key.alias("k"), name.alias("name"), F.xxhash64(*fields.values()).alias("body"), F.array(*(c.cast("string") for c in fields.values())).alias("f"))


def _paired(main: DataFrame, copy: DataFrame, on: str) -> DataFrame:
    """Full outer join on ``on``; of repeated keys the least id of one side meets all of the other."""

    def ranked(side: DataFrame, as_name: str) -> DataFrame:
        firsts = side.where(F.col(on).isNotNull()).groupBy(on).agg(F.min("id").alias("first_id"))
        with_first = side.join(firsts, on, "left")
        return with_first.select(F.col(on).alias("on_key"), (F.col("id") == F.col("first_id")).alias("first"), F.struct(*side.columns).alias(as_name))

    a, b = ranked(main, "main"), ranked(copy, "copy")
    b = b.withColumnRenamed("on_key", "on_key_b").withColumnRenamed("first", "first_b")
    joined = a.join(b, (F.col("on_key") == F.col("on_key_b")) & (F.col("first") | F.col("first_b")), "full_outer")
    return joined.select("main", "copy")
