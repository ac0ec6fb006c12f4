"""References to records that do not exist.

References are grouped by their null mask: with k reference columns there are
2^k masks, a number fixed by the declaration and not by the data. Each mask's
rows meet the targets on exactly the mask's non-null columns, so a key with
nulls never turns into an OR condition or a theta join. What a mask with nulls
means is declared:

* ``simple``: a reference with any null refers to nothing and is no orphan;
* ``partial``: its non-null columns must occur together in some target;
* ``full``: a reference is all null (no orphan) or has no null; anything
  between is an orphan with reason ``incomplete``.

Targets are reduced to one row per key (with the earliest time they exist)
before the join, by partial aggregation on the map side, so the join never
multiplies rows. A key that holds much of the references is spread: a sample of
one in SAMPLED says which keys these are (at most 1 / HOT of them, whatever the
data, so they may be broadcast) and how many parts each needs; its single
target row is copied as often, all other targets not at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")
#: One reference in so many is looked at for hot keys, and the share of the references from which on a key is hot.
SAMPLED = 32
HOT = 1 / 500


def orphan_references(
    references: DataFrame,
    row_id: str,
    reference_columns: Sequence[Column],
    seen_at: Column,
    targets: DataFrame,
    target_columns: Sequence[Column],
    exists_from: Column,
    deleted: DataFrame | None = None,
    deleted_columns: Sequence[Column] = (),
    match: str = "simple",
) -> DataFrame:
    """Rows ``(row_id, seen_at, reason)`` of the references without a target at their time.

    reason is ``late`` if the target comes to exist after ``seen_at``, else
    ``deleted`` if ``deleted`` has the key, else ``missing`` (``incomplete``
    under ``full``). Defined cases: a target with a null time exists always; a
    reference with a null time is never late; repeated reference rows are
    reported each; empty tables give the empty result (no targets: all
    references are orphans); other columns of the inputs, whatever their
    names, are not touched.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if len(reference_columns) != len(target_columns) or deleted is not None and len(deleted_columns) != len(target_columns):
        raise ValueError("references, targets and deleted need the same number of key columns")
    names = [f"k{i}" for i in range(len(reference_columns))]
    refs = references.select(
        F.col(row_id).alias("row_id"),
        seen_at.alias("seen_at"),
        *(c.alias(n) for c, n in zip(reference_columns, names)),
    )
    # a null time means: has always been there
    held = targets.select(*(c.alias(n) for c, n in zip(target_columns, names)), F.coalesce(exists_from, F.lit("0001-01-01").cast("timestamp")).alias("from_at"))
    gone = None if deleted is None else deleted.select(*(c.alias(n) for c, n in zip(deleted_columns, names)))

    parts = []
    for mask in product((True, False), repeat=len(names)):
        there = [n for n, present in zip(names, mask) if present]
        rows = refs.where(_all(F.col(n).isNotNull() if present else F.col(n).isNull() for n, present in zip(names, mask)))
        if not there or match == "simple" and len(there) < len(names):
            continue
        if match == "full" and len(there) < len(names):
            parts.append(rows.select("row_id", "seen_at", F.lit("incomplete").alias("reason")))
            continue
        parts.append(_orphans_of_mask(rows, there, held, gone))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _orphans_of_mask(rows: DataFrame, there: list[str], held: DataFrame, gone: DataFrame | None) -> DataFrame:
    known = held.where(_all(F.col(n).isNotNull() for n in there)).groupBy(*there).agg(F.min("from_at").alias("from_at"), F.lit(False).alias("was_deleted"))
    if gone is not None:
        dropped = gone.where(_all(F.col(n).isNotNull() for n in there)).groupBy(*there).agg(F.lit(None).cast("timestamp").alias("from_at"), F.lit(True).alias("was_deleted"))
        # one row per key that either side knows: a second join with the many references is saved
        known = known.unionByName(dropped).groupBy(*there).agg(F.min("from_at").alias("from_at"), F.max("was_deleted").alias("was_deleted"))
    keys = list(there)
    hot = hot_keys(rows, there)
    if hot is not None:
        rows = rows.join(F.broadcast(hot), there, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        known = known.join(F.broadcast(hot), there, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        keys.append("salt")
    joined = rows.join(known, keys, "left")
    reason = (
        F.when(F.col("from_at") > F.col("seen_at"), "late")
        .when(F.col("from_at").isNotNull(), None)
        .when(F.col("was_deleted"), "deleted")
        .otherwise("missing")
    )
    return joined.select("row_id", "seen_at", reason.alias("reason")).where(F.col("reason").isNotNull())


def hot_keys(rows: DataFrame, there: list[str]) -> DataFrame | None:
    """Rows ``(*there, parts)`` of the keys that hold more than HOT of the rows, by a sample; None if there are none.

    parts is such that a part holds about HOT of the rows. This settles only
    where rows are joined, never what comes out.
    """
    sample = rows.where(F.pmod(F.xxhash64("row_id"), F.lit(SAMPLED)) == 0)
    least = max(8.0, sample.count() * HOT)
    counts = sample.groupBy(*there).agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") > least).collect()  # 1 / HOT rows at most
    if not found:
        return None
    schema = counts.select(*there).schema.add("parts", "integer")
    return rows.sparkSession.createDataFrame([(*(r[k] for k in there), int(r.n / least) + 1) for r in found], schema)


def _all(conditions) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out
