"""Batch writes: a snapshot and incoming rows give a new snapshot.

Incoming rows count as written one after the other, in the order of ``seq``.
New ids follow the greatest id of the table. Rules are set-wise: no loop runs
over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.sources.store import KINDS, STATES, Snapshot, completed

OPTIONAL_LINK = "relationship"


class Refused(ValueError):
    """Rows that break a rule; nothing is written."""


def _first(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key by seq, as a minimum of whole rows (it combines before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def _numbered(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids from the greatest existing one on, in order of seq.

    Places come from a count per range of seq, not from one sorted partition:
    only the ranges' totals are brought together.
    """
    parts = new.withColumn("_part", F.floor(F.col("seq") / 100_000).cast("long"))
    totals = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("seq"))
    return parts.withColumn("_nth", place).join(before, "_part").crossJoin(F.broadcast(last)).withColumn("id", (F.col("_last") + F.col("_before") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_before", "_last")


def _require(df: DataFrame, rule: Column, message: str) -> None:
    bad = df.where(~F.coalesce(rule, F.lit(False))).limit(5).collect()
    if bad:
        raise Refused(f"{message}: {[r.asDict() for r in bad]}")


def first_wins(existing: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """Incoming rows (first by seq) whose key is not there yet."""
    return _first(incoming, *keys).join(existing.select(*keys), list(keys), "left_anti")


def upsert_projects(s: Snapshot, incoming: DataFrame, now: Column, check: bool = True) -> Snapshot:
    """``incoming(seq, name, description, status, uuid, origin_host)``: new names come in, of known ones only updated_at changes."""
    if check:
        _require(incoming, F.col("status").isin(*STATES), "status is none of " + ", ".join(STATES))
    touched = incoming.select("name").distinct().withColumn("_touched", F.lit(True))
    old = s.projects.join(touched, "name", "left").withColumn("updated_at", F.when(F.col("_touched"), now).otherwise(F.col("updated_at")))
    new = _numbered(first_wins(s.projects, incoming, "name"), s.projects).withColumn("created_at", now).withColumn("updated_at", now)
    return s.with_tables(projects=completed(old, "projects").unionByName(completed(new, "projects")))


def set_status(s: Snapshot, changes: DataFrame, now: Column, check: bool = True) -> Snapshot:
    """``changes(seq, name, status)``: the last one of a name holds; unknown names are refused."""
    if check:
        _require(changes, F.col("status").isin(*STATES), "status is none of " + ", ".join(STATES))
        missing = changes.select("name").join(s.projects.select("name"), "name", "left_anti").limit(5).collect()
        if missing:
            raise Refused(f"no such project: {[r.name for r in missing]}")
    last = changes.groupBy("name").agg(F.max_by("status", "seq").alias("_status"))
    rows = s.projects.join(last, "name", "left")
    return s.with_tables(projects=completed(rows.withColumn("updated_at", F.when(F.col("_status").isNotNull(), now).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce("_status", "status")), "projects"))


def append_observations(s: Snapshot, incoming: DataFrame, now: Column, check: bool = True) -> Snapshot:
    """``incoming(seq, project_id, kind, body, source_doi, uuid, origin_host)``: always new rows; kind and project are checked."""
    if check:
        _require(incoming, F.col("kind").isin(*KINDS), "kind is none of " + ", ".join(KINDS))
        lost = incoming.select("project_id").join(s.projects.select(F.col("id").alias("project_id")), "project_id", "left_anti").limit(5).collect()
        if lost:
            raise Refused(f"no such project: {[r.project_id for r in lost]}")
    new = _numbered(incoming, s.observations).withColumn("created_at", now)
    return s.with_tables(observations=s.observations.unionByName(completed(new, "observations")))


def upsert_concepts(s: Snapshot, incoming: DataFrame, now: Column) -> Snapshot:
    """``incoming(seq, name, description, identifier_type, identifier_value, uuid, origin_host)``.

    A known name takes the last description and, each for itself, the last
    identifier part that is not empty; a new one starts from its first row.
    """

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name) != "", F.col("seq"))).alias(f"_{name}")

    held = incoming.groupBy("name").agg(
        F.max_by("description", "seq").alias("_description"), last("identifier_type"), last("identifier_value"),
        F.min("seq").alias("seq"), F.min_by("uuid", "seq").alias("_uuid"), F.min_by("origin_host", "seq").alias("_origin_host"),
    )
    old = s.concepts.join(held.drop("seq"), "name", "left").select(
        "id", "name", F.coalesce("_description", "description").alias("description"), "created_at",
        F.coalesce("_identifier_type", "identifier_type").alias("identifier_type"), F.coalesce("_identifier_value", "identifier_value").alias("identifier_value"), "uuid", "origin_host",
    )
    new = _numbered(held.join(s.concepts.select("name"), "name", "left_anti"), s.concepts).select(
        "id", "name", F.col("_description").alias("description"), now.alias("created_at"),
        F.coalesce("_identifier_type", F.lit("")).alias("identifier_type"), F.coalesce("_identifier_value", F.lit("")).alias("identifier_value"), F.col("_uuid").alias("uuid"), F.col("_origin_host").alias("origin_host"),
    )
    return s.with_tables(concepts=completed(old, "concepts").unionByName(completed(new, "concepts")))


def upsert_sources(s: Snapshot, incoming: DataFrame, now: Column) -> Snapshot:
    """``incoming(seq, title, identifier_type, identifier_value, …)``: a known pair changes nothing; rows without a whole pair always come in. retracted is not taken over."""
    whole = (F.col("identifier_type") != "") & (F.col("identifier_value") != "")
    keyed = first_wins(s.sources.where(whole), incoming.where(whole), "identifier_type", "identifier_value")
    new = _numbered(keyed.unionByName(incoming.where(~whole)), s.sources).withColumn("retracted", F.lit(False)).withColumn("retraction_note", F.lit("")).withColumn("first_seen_at", now).withColumn("last_checked_at", now)
    return s.with_tables(sources=s.sources.unionByName(completed(new, "sources")))


def remove_sources(s: Snapshot, ids: DataFrame) -> Snapshot:
    """Refused while one is linked; ids that are not there do not matter."""
    blocked = ids.select(F.col("id").alias("source_id")).join(s.observation_sources, "source_id").groupBy("source_id").agg(F.count("*").alias("links")).limit(5).collect()
    if blocked:
        raise Refused(f"still linked: {[(r.source_id, r.links) for r in blocked]}")
    return s.with_tables(sources=s.sources.join(ids.select("id"), "id", "left_anti").select(*s.sources.columns))


def retract_sources(s: Snapshot, notes: DataFrame) -> Snapshot:
    """``notes(seq, id, note)``: flag and note, the last one of an id; ids that are not there do not matter."""
    last = notes.groupBy("id").agg(F.max_by("note", "seq").alias("_note"))
    rows = s.sources.join(last, "id", "left").withColumn("retracted", F.col("retracted") | F.col("_note").isNotNull()).withColumn("retraction_note", F.coalesce("_note", "retraction_note"))
    return s.with_tables(sources=completed(rows, "sources"))


def link(s: Snapshot, table: str, incoming: DataFrame, check: bool = True) -> Snapshot:
    """New pairs of a link table; a pair that is there stays as it is, so its first relationship sticks. Ends that are not there are refused."""
    existing = getattr(s, table)
    keys = [c for c in existing.columns if c.endswith("_id")]
    if check:
        for key in keys:
            target = getattr(s, {"observation_id": "observations", "concept_id": "concepts", "project_id": "projects", "source_id": "sources"}[key])
            lost = incoming.select(key).join(target.select(F.col("id").alias(key)), key, "left_anti").limit(5).collect()
            if lost:
                raise Refused(f"no such {key}: {[r[0] for r in lost]}")
    new = completed(first_wins(existing, incoming, *keys), table)
    return s.with_tables(**{table: existing.unionByName(new)})
