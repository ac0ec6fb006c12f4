"""JSON-lines files of a store: export by reachability, import with identities resolved."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstrata.operators.reading import NotFound
from quillstrata.operators.writing import _first, _numbered
from quillstrata.session import materialise
from quillstrata.sources.store import KINDS, SCHEMAS, STATES, Snapshot, completed

# The record types in the order they depend on each other, with their fields.
RECORDS: Mapping[str, tuple[str, ...]] = {
    "project": ("uuid", "origin_host", "name", "description", "status", "created_at"),
    "concept": ("uuid", "origin_host", "name", "description", "identifier_type", "identifier_value", "created_at"),
    "source": ("uuid", "origin_host", "title", "identifier_type", "identifier_value", "authors", "published_date", "publisher", "rights", "version", "retracted", "retraction_note", "first_seen_at"),
    "observation": ("uuid", "origin_host", "project_uuid", "kind", "body", "source_doi", "created_at"),
    "observation_concept": ("observation_uuid", "concept_uuid"),
    "project_concept": ("project_uuid", "concept_uuid"),
    "observation_source": ("observation_uuid", "source_uuid", "relationship"),
}
#: Blocks of files whose numbers are given to every task.
BLOCKS = 10_000


class Malformed(ValueError):
    """A line that is no JSON record; nothing is imported."""


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(column)


def _json(df: DataFrame, kind: str, order: list[Column]) -> DataFrame:
    fields = [_stamp(n) if df.schema[n].dataType.typeName() == "timestamp" else F.col(n) for n in RECORDS[kind]]
    section = list(RECORDS).index(kind) + 1
    return df.select(F.lit(section).alias("section"), F.struct(*(c.cast("string") for c in order)).alias("place"), F.to_json(F.struct(F.lit(kind).alias("type"), *fields), {"ignoreNullFields": "false"}).alias("line"))


def export_tables(s: Snapshot, project: str | None = None) -> dict[str, DataFrame]:
    """The seven record types as tables. With ``project``: it, its observations, and what these and it reach; NotFound if there is none."""
    projects, observations = s.projects, s.observations
    concepts, sources = s.concepts, s.sources
    oc, pc, os_ = s.observation_concepts, s.project_concepts, s.observation_sources
    if project is not None:
        projects = s.projects.where(F.col("name") == project)
        if not projects.limit(1).count():
            raise NotFound(project)
        ids = projects.select(F.col("id").alias("project_id"))
        observations = observations.join(ids, "project_id", "left_semi")
        members = observations.select(F.col("id").alias("observation_id"))
        oc, pc, os_ = oc.join(members, "observation_id", "left_semi"), pc.join(ids, "project_id", "left_semi"), os_.join(members, "observation_id", "left_semi")
        concepts = concepts.join(oc.select("concept_id").union(pc.select("concept_id")).distinct().withColumnRenamed("concept_id", "id"), "id", "left_semi")
        sources = sources.join(os_.select(F.col("source_id").alias("id")), "id", "left_semi")

    def ends(links: DataFrame, *fields: str) -> DataFrame:
        for field in fields:
            target = {"observation": s.observations, "concept": s.concepts, "project": s.projects, "source": s.sources}[field]
            links = links.join(target.select(F.col("id").alias(f"{field}_id"), F.col("uuid").alias(f"{field}_uuid")), f"{field}_id")
        return links

    return {
        "project": projects,
        "concept": concepts,
        "source": sources,
        # observations without project are not exported
        "observation": ends(observations, "project"),
        "observation_concept": ends(oc, "observation", "concept"),
        "project_concept": ends(pc, "project", "concept"),
        "observation_source": ends(os_, "observation", "source"),
    }


def export_lines(s: Snapshot, project: str | None = None) -> DataFrame:
    """Rows ``(section, place, line)``: in this order they are the file; every section follows what it refers to."""
    tables = export_tables(s, project)
    order = {"project": ["created_at", "id"], "concept": ["name"], "source": ["id"], "observation": ["created_at", "id"]}
    out = None
    for kind, df in tables.items():
        by = [F.lpad(F.col(c).cast("string"), 20, "0") if c == "id" else F.col(c) for c in order.get(kind, [c for c in RECORDS[kind] if c.endswith("_uuid")])]
        while len(by) < 2:
            by.append(F.lit(""))
        part = _json(df, kind, [c.alias(f"o{i}") for i, c in enumerate(by[:2])])
        out = part if out is None else out.unionByName(part)
    return out


def write_lines(s: Snapshot, path: str, project: str | None = None) -> int:
    """Writes the lines in order, in as many files as there are partitions (their names sort); the number of lines."""
    lines = export_lines(s, project)
    lines.orderBy("section", "place").select("line").write.text(path)
    return lines.sparkSession.read.text(path).count()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(line_no, line)`` of a file, or of files in the order of their names: numbers rise with the places of the lines.

    Lines come by blocks of the files; a block's place in its file and the
    line's within the block give the order, and the blocks' totals the numbers.
    """
    return numbered_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``(line_no, line)`` of ``(value, path, block)`` as Spark reads them: each block is read by one task, in order."""
    placed = materialise(lines.withColumn("row", F.monotonically_increasing_id()), "lines")
    blocks = placed.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before) if before.limit(BLOCKS + 1).count() <= BLOCKS else before, ["path", "block"]).select((F.col("before") + F.col("row") - F.col("first") + 1).alias("line_no"), F.col("value").alias("line"))


def parsed_lines(lines: DataFrame, check: bool = True) -> DataFrame:
    """Rows ``(line_no, type, record)`` of ``(line_no, line)``; blank lines are skipped; record is a map of texts.

    With ``check`` a line that is no JSON object raises Malformed with the
    least line number, before anything is written; else it is left out.
    """
    full = lines.where(F.trim("line") != "").withColumn("v", F.try_parse_json("line"))
    whole = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    if check:
        bad = full.where(~whole).agg(F.min("line_no").alias("n")).first().n
        if bad is not None:
            raise Malformed(f"line {bad} is no JSON record")
    return full.where(whole).select("line_no", F.expr("try_variant_get(v, '$.type', 'string')").alias("type"), F.expr("try_variant_get(v, '$', 'map<string,variant>')").alias("v")).select(
        "line_no", F.coalesce("type", F.lit("")).alias("type"), F.transform_values("v", lambda k, x: F.call_function("try_variant_get", x, F.lit("$"), F.lit("string"))).alias("record")
    )


def _records(parsed: DataFrame, kind: str) -> DataFrame:
    columns = []
    for name in RECORDS[kind]:
        value = F.try_element_at("record", F.lit(name))
        if name in ("created_at", "first_seen_at"):
            columns.append(F.try_to_timestamp(value).alias(name))
        elif name == "retracted":
            columns.append(F.coalesce(value.try_cast("boolean"), F.lit(False)).alias(name))
        else:
            columns.append(F.coalesce(value, F.lit("")).alias(name))
    return parsed.where(F.col("type") == kind).select(F.col("line_no").alias("seq"), *columns)


def _named(local: DataFrame, incoming: DataFrame, table: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Import by name: (grown table, map of the file's uuids to ids, new rows)."""
    new = _numbered(_first(incoming, "name").join(local.select("name"), "name", "left_anti"), local)
    new = new.withColumn("created_at", F.coalesce("created_at", now))
    new = materialise(completed(new.withColumn("updated_at", now), table), table)  # ids are given once
    grown = local.unionByName(completed(new, table))
    of_file = incoming.where("uuid <> ''").select("uuid", "name", "seq").join(grown.select("name", "id"), "name").groupBy("uuid").agg(F.max_by("id", "seq").alias("id"))
    return grown, of_file, new


def _resolved(links: DataFrame, field: str, of_file: DataFrame | None, table: DataFrame) -> DataFrame:
    """``field``_id from ``field``_uuid: the file's own map goes before the uuids of the table; null if neither has it."""
    key = f"{field}_uuid"
    local = table.where("uuid <> ''").groupBy("uuid").agg(F.min("id").alias("_local")).withColumnRenamed("uuid", key)
    out = links.join(local, key, "left")
    if of_file is not None:
        out = out.join(of_file.select(F.col("uuid").alias(key), F.col("id").alias("_file")), key, "left")
    else:
        out = out.withColumn("_file", F.lit(None).cast("long"))
    return out.withColumn(f"{field}_id", F.coalesce("_file", "_local")).drop("_file", "_local")


def import_parsed(s: Snapshot, parsed: DataFrame, now: Column) -> tuple[Snapshot, DataFrame]:
    """The grown store and the summary ``(nth, type, read, imported, skipped)``, types in the order they first appear.

    Local rows win: nothing that is there is changed. Of repeated lines the
    first counts. References that lead nowhere and pairs that are there already
    are skipped; unknown types are counted only.
    """
    project = _records(parsed, "project").withColumn("status", F.when(F.col("status").isin(*STATES), F.col("status")).otherwise("active"))
    projects, file_projects, new_projects = _named(s.projects, project, "projects", now)
    concepts, file_concepts, new_concepts = _named(s.concepts, _records(parsed, "concept"), "concepts", now)

    source = _records(parsed, "source")
    whole = (F.col("identifier_type") != "") & (F.col("identifier_value") != "")
    pair = ["identifier_type", "identifier_value"]
    by_pair = s.sources.where(whole).groupBy(*pair).agg(F.min("id").alias("_pair"))
    by_uuid = s.sources.where("uuid <> ''").groupBy("uuid").agg(F.min("id").alias("_same"))
    fresh = source.join(by_pair, pair, "left").where("_pair IS NULL").drop("_pair").join(by_uuid, "uuid", "left").where("_same IS NULL").drop("_same")
    once = _first(fresh.where(whole), *pair).unionByName(fresh.where(~whole))
    once = _first(once.where("uuid <> ''"), "uuid").unionByName(once.where("uuid = ''"))
    new_sources = _numbered(once, s.sources).withColumn("first_seen_at", F.coalesce("first_seen_at", now)).withColumn("last_checked_at", now)
    new_sources = materialise(completed(new_sources, "sources"), "sources")
    sources = s.sources.unionByName(completed(new_sources, "sources"))
    grown_pair = sources.where(whole).groupBy(*pair).agg(F.min("id").alias("_pair"))
    grown_uuid = sources.where("uuid <> ''").groupBy("uuid").agg(F.min("id").alias("_same"))
    file_sources = source.where("uuid <> ''").join(grown_pair, pair, "left").join(grown_uuid, "uuid", "left").where("_pair IS NOT NULL OR _same IS NOT NULL").groupBy("uuid").agg(F.max_by(F.coalesce("_pair", "_same"), "seq").alias("id"))

    observation = _records(parsed, "observation").withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("note"))
    placed = _resolved(observation, "project", file_projects, projects).where("project_id IS NOT NULL")
    new_observations = _numbered(_first(placed, "uuid").join(s.observations.select("uuid"), "uuid", "left_anti"), s.observations).withColumn("created_at", F.coalesce("created_at", now))
    new_observations = materialise(completed(new_observations, "observations"), "observations")
    observations = s.observations.unionByName(new_observations)

    ends = {"observation": (None, observations), "project": (file_projects, projects), "concept": (file_concepts, concepts), "source": (file_sources, sources)}
    tables: dict[str, DataFrame] = {}
    added: dict[str, DataFrame] = {"project": new_projects, "concept": new_concepts, "source": new_sources, "observation": new_observations}
    for kind, table in (("observation_concept", "observation_concepts"), ("project_concept", "project_concepts"), ("observation_source", "observation_sources")):
        links = _records(parsed, kind)
        keys = [c for c in SCHEMAS[table].names if c.endswith("_id")]
        for key in keys:
            links = _resolved(links, key[:-3], *ends[key[:-3]]).where(F.col(key).isNotNull())
        if kind == "observation_source":
            links = links.withColumn("relationship", F.when(F.col("relationship") == "", "cited").otherwise(F.col("relationship")))
        existing = getattr(s, table)
        added[kind] = _first(links, *keys).join(existing.select(*keys), keys, "left_anti")
        tables[table] = existing.unionByName(completed(added[kind], table))

    read = parsed.groupBy("type").agg(F.count("*").alias("read"), F.min("line_no").alias("first"))
    imported = None
    for kind, df in added.items():
        part = df.agg(F.count("*").alias("imported")).select(F.lit(kind).alias("type"), "imported")
        imported = part if imported is None else imported.unionByName(part)
    counted = read.join(imported, "type", "left").withColumn("imported", F.coalesce("imported", F.lit(0)))
    known = F.col("type").isin(*RECORDS)
    summary = counted.select(
        F.row_number().over(Window.orderBy("first")).alias("nth"), "type", "read", "imported", F.when(known, F.col("read") - F.col("imported")).otherwise(0).alias("skipped")
    )
    return Snapshot(projects=projects, observations=observations, concepts=concepts, sources=sources, **tables), summary


def import_lines(s: Snapshot, lines: DataFrame, now: Column | None = None) -> tuple[Snapshot, DataFrame]:
    """``lines(line_no, line)`` into the store; Malformed before any change if a line is no record."""
    parsed = materialise(parsed_lines(lines), "parsed")  # every record type reads it
    return import_parsed(s, parsed, F.date_trunc("second", F.current_timestamp()) if now is None else now)
