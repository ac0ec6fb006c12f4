"""Two stores that grew apart become one.

"Insert all of the first, then of the second, and ignore what breaks a key" is,
as each side keeps its keys itself, the first and what of the second has no
partner in it on any key: a union with chained anti joins. Children follow
their parents by uuid; a parent that lost takes its children with it, which
``reconcile`` prevents. Merged parents are written once, as every child table
meets them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.operators.writing import _first, _numbered
from quillstrata.session import materialise
from quillstrata.sources.store import SCHEMAS, Snapshot, completed


class Collisions(ValueError):
    """Names that both stores use for different records."""

    def __init__(self, found: list) -> None:
        super().__init__("; ".join(f"{r.tbl} {r.name!r}: {r.uuid_a} and {r.uuid_b}" for r in found))
        self.found = found


def collisions(a: Snapshot, b: Snapshot) -> DataFrame:
    """Rows ``(tbl, name, uuid_a, uuid_b)`` of projects and concepts with one name and two uuids."""
    out = None
    for tbl in ("projects", "concepts"):
        left, right = getattr(a, tbl).select("name", F.col("uuid").alias("uuid_a")), getattr(b, tbl).select("name", F.col("uuid").alias("uuid_b"))
        part = left.join(right, "name").where("uuid_a <> uuid_b").select(F.lit(tbl).alias("tbl"), "name", "uuid_a", "uuid_b")
        out = part if out is None else out.unionByName(part)
    return out


def reconcile(b: Snapshot, found: DataFrame) -> Snapshot:
    """The second store with the first one's uuids where names collide."""
    tables = {}
    for tbl in ("projects", "concepts"):
        takes = found.where(F.col("tbl") == tbl).select("name", F.col("uuid_b").alias("uuid"), F.col("uuid_a").alias("_uuid"))
        tables[tbl] = completed(getattr(b, tbl).join(takes, ["name", "uuid"], "left").withColumn("uuid", F.coalesce("_uuid", "uuid")), tbl)
    return b.with_tables(**tables)


def _complete(df: DataFrame, table: str) -> DataFrame:
    """Without the rows in which a text is null: what must not be null is not taken, from either side."""
    for field in SCHEMAS[table]:
        if field.dataType.typeName() == "string":
            df = df.where(F.col(field.name).isNotNull())
    return df


def _united(a: DataFrame, b: DataFrame, table: str, keys: list[list[str]]) -> DataFrame:
    """The first, and of the second what meets it on no key; ids run on from the first's."""
    a, rest = _complete(a, table), _complete(b, table)
    for key in keys:
        held = a.select(*key)
        if key == ["identifier_type", "identifier_value"]:
            held = held.where("identifier_type <> '' AND identifier_value <> ''")
        rest = rest.join(held, key, "left_anti")
    new = _numbered(rest.withColumnRenamed("id", "seq"), a)
    return materialise(completed(a, table).unionByName(completed(new, table)), table)


def _by_uuid(old: DataFrame, new: DataFrame, field: str) -> DataFrame:
    """The old ids of ``field`` and the new ones of the same uuid."""
    return old.select(F.col("id").alias(field), "uuid").join(new.select(F.col("id").alias(f"new_{field}"), "uuid"), "uuid").select(field, f"new_{field}")


def merge(a: Snapshot, b: Snapshot, reconciled: bool = False) -> Snapshot:
    """The merged store; ``reconciled``: first give colliding names of the second the uuids of the first."""
    if reconciled:
        b = reconcile(b, collisions(a, b))
    merged = {
        "projects": _united(a.projects, b.projects, "projects", [["uuid"], ["name"]]),
        "concepts": _united(a.concepts, b.concepts, "concepts", [["uuid"], ["name"]]),
        "sources": _united(a.sources, b.sources, "sources", [["uuid"], ["identifier_type", "identifier_value"]]),
    }
    moved = []
    for side in (a, b):
        moved.append(side.observations.join(_by_uuid(side.projects, merged["projects"], "project_id"), "project_id").withColumn("project_id", F.col("new_project_id")).drop("new_project_id"))
    merged["observations"] = _united(completed(moved[0], "observations"), completed(moved[1], "observations"), "observations", [["uuid"]])
    targets = {"observation_id": "observations", "concept_id": "concepts", "project_id": "projects", "source_id": "sources"}
    for table in ("observation_concepts", "project_concepts", "observation_sources"):
        keys = [c for c in SCHEMAS[table].names if c.endswith("_id")]
        parts = []
        for seq, side in enumerate((a, b)):
            links = getattr(side, table)
            for key in keys:
                links = links.join(_by_uuid(getattr(side, targets[key]), merged[targets[key]], key), key).withColumn(key, F.col(f"new_{key}")).drop(f"new_{key}")
            parts.append(completed(links, table).withColumn("seq", F.lit(seq)))
        merged[table] = completed(_first(parts[0].unionByName(parts[1]), *keys), table)
    return Snapshot(**merged)


def merge_summary(a: Snapshot, b: Snapshot, merged: Snapshot) -> DataFrame:
    """Rows ``(nth, tbl, from_a, from_b, merged)``: the sizes of each table."""
    out = None
    for nth, table in enumerate(SCHEMAS, 1):
        sizes = [getattr(x, table).agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n") for i, x in enumerate((a, b, merged))]
        part = sizes[0].unionByName(sizes[1]).unionByName(sizes[2]).agg(*(F.sum(F.when(F.col("i") == i, F.col("n"))).alias(n) for i, n in enumerate(("from_a", "from_b", "merged"))))
        part = part.select(F.lit(nth).alias("nth"), F.lit(table).alias("tbl"), "from_a", "from_b", "merged")
        out = part if out is None else out.unionByName(part)
    return out


def merge_stores(a: Snapshot, b: Snapshot, force: bool = False) -> tuple[Snapshot, DataFrame]:
    """Report collisions or, with ``force``, reconcile them; then merge and sum up."""
    found = collisions(a, b)
    if not force:
        rows = found.collect()
        if rows:
            raise Collisions(rows)
        merged = merge(a, b)
    else:
        b = reconcile(b, found)
        merged = merge(a, b)
    return merged, merge_summary(a, b, merged)
