"""The pN_ queries of the general problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions.text import or_empty, uuid_key
from quillstrata.sources.tables import table

def _readings(spark: SparkSession, folder: str, choose: Callable, declares_order: bool = True) -> DataFrame:
    from quillstrata.functions.instants import ANY_ORDER, is_exact_date, is_exact_instant, read_date, read_instant

    order = F.coalesce("date_order", F.lit("dmy")) if declares_order else F.lit(ANY_ORDER)
    conventions = table(spark, folder, "hosts").select(F.col("origin_host").alias("source"), F.coalesce("tz", F.lit("UTC")).alias("zone"), order.alias("date_order"))
    parts = [
        table(spark, folder, name).select(
            F.lit(name).alias("tbl"), F.col("origin_host").alias("source"), order.alias("seq"), F.col(row_id).alias("row_id"), F.col(text).alias("text")
        )
        for name, row_id, order, text in (
            ("observation_records", "rec_no", F.unix_micros("received_at"), "created_at"),
            ("source_records", "rec_no", F.unix_micros("received_at"), "first_seen_at"),
            ("sources", "id", F.col("id"), "published_date"),
        )
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    times, dates = (read_instant, is_exact_instant), (read_date, is_exact_date)
    return choose(
        rows, F.col("tbl"), F.col("source"), F.col("seq"), F.col("row_id"), F.col("text"), conventions,
        {"observation_records": times, "source_records": times, "sources": dates},
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Times and dates of many kinds in one unambiguous form."""
    from quillstrata.operators.timestamps import chosen_readings

    return _readings(spark, folder, chosen_readings)


def p3_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """The same without what the declared hosts say of the order of day and month: the order of the records decides."""
    from quillstrata.operators.timestamps import chosen_readings

    return _readings(spark, folder, chosen_readings, declares_order=False)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table, field and month.

    The key is composite: the table that is referred to, and the uuid's key.
    So all references meet all targets in one join, and each table is read
    once for what it refers to and once for what it holds.
    """
    from quillstrata.operators.references import orphan_references

    observations, links = table(spark, folder, "observation_records"), table(spark, folder, "observation_concept_records")
    # names travel as numbers: their places here
    held = ("projects", "concepts", "observations")
    fields = (("observation_records", "project_uuid", "projects"), ("observation_concept_records", "observation_uuid", "observations"), ("observation_concept_records", "concept_uuid", "concepts"))

    def reference(i: int) -> Column:
        _, field, to = fields[i]
        number = F.lit(i).cast("byte")
        return F.struct(F.lit(held.index(to)).cast("byte").alias("to"), uuid_key(F.col(field)).alias("k"), F.struct(number.alias("i"), F.col("rec_no").alias("rec_no")).alias("ref"))

    references = observations.select("received_at", reference(0).alias("r")).select("received_at", "r.*").unionByName(
        links.select("received_at", F.explode(F.array(reference(1), reference(2))).alias("r")).select("received_at", "r.*")
    )
    targets = None
    for i, (df, from_at) in enumerate(((table(spark, folder, "projects"), "created_at"), (table(spark, folder, "concepts"), "created_at"), (observations, "received_at"))):
        part = df.select(F.lit(i).cast("byte").alias("tbl"), uuid_key(F.col("uuid")).alias("k"), F.col(from_at).alias("from_at"))
        targets = part if targets is None else targets.unionByName(part)
    tombstones = table(spark, folder, "tombstones").where(F.col("tbl").isin(*held))
    found = orphan_references(
        references, "ref", [F.col("to"), F.col("k")], F.col("received_at"),
        targets, [F.col("tbl"), F.col("k")], F.col("from_at"),
        tombstones, [(F.array_position(F.array(*map(F.lit, held)), F.col("tbl")) - 1).cast("byte"), uuid_key(F.col("uuid"))],
        match="simple",
    )

    def name(at: int) -> Column:
        return F.array(*(F.lit(f[at]) for f in fields))[F.col("row_id.i").cast("int")]

    return found.select(name(0).alias("tbl"), name(1).alias("field"), "row_id.rec_no", "reason", or_empty(F.date_format("seen_at", "yyyy-MM")).alias("period"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per author of a source, with its place in the field."""
    from quillstrata.operators.multivalue import exploded_values

    return exploded_values(table(spark, folder, "sources"), "id", "authors", "source_id", "author")


#: Compared fields of both stores; origin and time apart, texts exactly, null as ''.
COMPARED = {
    "projects": ("name", "description", "status", "created_at", "origin_host"),
    "concepts": ("name", "description", "identifier_type", "identifier_value", "created_at", "origin_host"),
}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that one store lacks and fields in which both disagree."""
    from quillstrata.operators.differences import field_differences

    out = None
    for tbl, names in COMPARED.items():
        main, copy = table(spark, folder, tbl), table(spark, folder, f"{tbl}_copy")
        fields = {"uuid": or_empty(uuid_key(F.col("uuid")))} | {n: or_empty(F.unix_micros(n).cast("string") if n == "created_at" else F.col(n)) for n in names}
        found = field_differences(
            main, copy, "id", uuid_key(F.col("uuid")), F.col("name"), fields
        ).select(F.lit(tbl).alias("tbl"), "main_id", "copy_id", "field")
        out = found if out is None else out.unionByName(found)
    return out


#: Columns of the consistent tables, by what the name of a series begins with.
DRIFT_DECLARED = {
    "projects": ("uuid", "origin_host", "name", "description", "status", "created_at"),
    "concepts": ("uuid", "origin_host", "name", "description", "identifier_type", "identifier_value", "created_at"),
}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of top-level fields between the files of a series."""
    from quillstrata.operators.drift import schema_changes, schema_trees

    changes = schema_changes(schema_trees(table(spark, folder, "drift_records").select("series", "file_no", "payload")))

    def row(change: str, field: Column, new_value: Column) -> Column:
        return F.struct(F.lit(change).alias("change"), field.alias("field"), new_value.alias("new_value"))

    # a move changes the top level where it begins there, where it ends there, or both
    top, empty = F.col("depth") == 1, F.lit("")
    moved, goes_up = F.col("change") == "moved", F.instr("new_value", ".") == 0
    rows = F.array_compact(
        F.array(
            F.when(top & ~moved, F.struct("change", "field", "new_value")),
            F.when(top & moved, row("removed", F.col("field"), empty)),
            F.when(moved & goes_up, row("added", F.col("new_value"), empty)),
        )
    )
    return changes.select("series", "file_no", F.explode(rows).alias("r")).select("series", "file_no", "r.*")


def p6_table(spark: SparkSession, folder: str) -> DataFrame:
    """All valid lines of the export files in one consistent set of fields."""
    from quillstrata.operators.drift import drift

    _, rows = drift(table(spark, folder, "drift_records").select("rec_no", "series", "file_no", "payload"), DRIFT_DECLARED)
    names = sorted({n for ns in DRIFT_DECLARED.values() for n in ns})
    return rows.select("rec_no", "series", "file_no", *(F.try_element_at("fields", F.lit(n)).alias(n) for n in names), F.to_json(F.map_filter("fields", lambda k, _: ~k.isin(names))).alias("other_fields"))


_KEY = "nullif(regexp_replace(regexp_replace(lower({0}), 'urn:|uuid:', '', 'g'), '[^0-9a-z]', '', 'g'), '')"

P5_SQL = f"""
WITH held AS (
    SELECT 'projects' AS t, {_KEY.format("uuid")} AS k, min(coalesce(created_at, TIMESTAMPTZ '0001-01-01 00:00:00+00')) AS from_at FROM projects GROUP BY 2
    UNION ALL SELECT 'concepts', {_KEY.format("uuid")}, min(coalesce(created_at, TIMESTAMPTZ '0001-01-01 00:00:00+00')) FROM concepts GROUP BY 2
    UNION ALL SELECT 'observations', {_KEY.format("uuid")}, min(coalesce(received_at, TIMESTAMPTZ '0001-01-01 00:00:00+00')) FROM observation_records GROUP BY 2
), refs AS (
    SELECT 'observation_records' AS tbl, 'project_uuid' AS field, 'projects' AS t, rec_no, received_at, {_KEY.format("project_uuid")} AS k FROM observation_records
    UNION ALL SELECT 'observation_concept_records', 'observation_uuid', 'observations', rec_no, received_at, {_KEY.format("observation_uuid")} FROM observation_concept_records
    UNION ALL SELECT 'observation_concept_records', 'concept_uuid', 'concepts', rec_no, received_at, {_KEY.format("concept_uuid")} FROM observation_concept_records
), gone AS (SELECT DISTINCT tbl AS t, {_KEY.format("uuid")} AS k FROM tombstones)
SELECT r.tbl, r.field, r.rec_no,
       CASE WHEN h.from_at > r.received_at THEN 'late' WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason,
       coalesce(strftime(timezone('UTC', r.received_at), '%Y-%m'), '') AS period
FROM refs r LEFT JOIN held h ON r.t = h.t AND r.k = h.k LEFT JOIN gone g ON r.t = g.t AND r.k = g.k
WHERE r.k IS NOT NULL AND (h.k IS NULL OR h.from_at > r.received_at)
"""


def _p2_sql() -> str:
    parts = []
    for tbl, names in COMPARED.items():
        columns = ", ".join(f"coalesce(CAST(epoch_us({n}) AS VARCHAR), '') AS {n}" if n == "created_at" else f"coalesce({n}, '') AS {n}" for n in names)
        side = f"SELECT id, {_KEY.format('uuid')} AS k, coalesce({_KEY.format('uuid')}, '') AS uuid, name AS full_name, {columns} FROM "
        fields = ", ".join(f"CASE WHEN m.{n} <> c.{n} THEN '{n}' END" for n in ("uuid", *names))
        parts.append(f"""
SELECT '{tbl}' AS tbl, main_id, copy_id, unnest(list_filter(fields, lambda f: f IS NOT NULL)) AS field FROM (
    WITH m AS ({side} {tbl}), c AS ({side} {tbl}_copy),
    m0 AS (SELECT * FROM m WHERE k IS NULL OR k NOT IN (SELECT k FROM c WHERE k IS NOT NULL)),
    c0 AS (SELECT * FROM c WHERE k IS NULL OR k NOT IN (SELECT k FROM m WHERE k IS NOT NULL))
    SELECT m.id AS main_id, c.id AS copy_id, [{fields}] AS fields FROM m JOIN c ON m.k = c.k
    UNION ALL SELECT m.id, c.id, [{fields}] FROM m0 m JOIN c0 c ON m.full_name = c.full_name
    UNION ALL SELECT id, 0, [''] FROM m0 WHERE full_name NOT IN (SELECT full_name FROM c0)
    UNION ALL SELECT 0, id, [''] FROM c0 WHERE full_name NOT IN (SELECT full_name FROM m0)
)""")
    return " UNION ALL ".join(parts)


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_inferred": p3_inferred, "p5_found": p5_found, "p6_found": p6_found, "p6_table": p6_table}
ORACLES: dict[str, str] = {"p2_found": _p2_sql(), "p5_found": P5_SQL}
