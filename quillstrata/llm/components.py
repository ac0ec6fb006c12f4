"""Connected components of a graph of longs, by alternating large and small stars.

Each round links every node to the least node it knows of, first its greater
neighbours, then its smaller ones; the rounds are few (logarithmic in practice)
and stop when nothing changes. Minima combine before each shuffle, so a node
with very many neighbours costs no more than its edges. Each round is written
to the shared folder, which cuts the lineage; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` of every node in ``edges(a, b)``; a component is its least node.

    Loops and repeated edges do not matter; edges with a null are left out; no
    edges give no rows.
    """
    nodes = edges.where("a IS NOT NULL AND b IS NOT NULL")
    current = materialise(nodes.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _fingerprint(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        current = materialise(small, "stars")
        now = _fingerprint(current)
        if now == before:
            break
        before = now
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = nodes.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return roots.join(members, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
    return row.n, row.h
