"""Lists, points and joins of a snapshot, and the counts over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.sources.store import SCHEMAS, Snapshot

PROJECT_COLUMNS = ("id", "name", "description", "status", "created_at")
OBSERVATION_COLUMNS = ("id", "project_id", "kind", "body", "source_doi", "created_at")
SOURCE_LIST = ("id", "title", "identifier_type", "identifier_value", "retracted", "retraction_note")
SOURCE_COLUMNS = ("id", "title", "identifier_type", "identifier_value", "authors", "published_date", "publisher", "rights", "version", "retracted", "retraction_note")


#: Days of the spans within which a project's observations are put in order.
DAYS = 7


class NotFound(LookupError):
    """A record that had to be there is not."""


def projects(s: Snapshot) -> DataFrame:
    """By time of creation; equal times by id."""
    return s.projects.select(*PROJECT_COLUMNS).orderBy("created_at", "id")


def project_by_name(s: Snapshot, name: str) -> DataFrame:
    """Exact in letter case; no row if there is none."""
    return s.projects.where(F.col("name") == name).select(*PROJECT_COLUMNS)


def project_by_id(s: Snapshot, project_id: int) -> DataFrame:
    return s.projects.where(F.col("id") == project_id).select(*PROJECT_COLUMNS)


def observations_of(s: Snapshot, project_id: int | None = None) -> DataFrame:
    """Of one project, or of all with their place ``nth`` per project: newest first, equal times by id downwards.

    A project may hold much of all rows, so places are counted within spans of
    DAYS days and the days' totals, of which there are few, are added up.
    """
    rows = s.observations.where(F.col("project_id").isNotNull() if project_id is None else F.col("project_id") == project_id)
    rows = rows.select(*OBSERVATION_COLUMNS, F.coalesce(F.floor(F.unix_seconds("created_at") / (86_400 * DAYS)), F.lit(-(1 << 40))).alias("span"))
    totals = rows.groupBy("project_id", "span").agg(F.count("*").alias("n"))
    later = F.sum("n").over(Window.partitionBy("project_id").orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select("project_id", "span", F.coalesce(later, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("project_id", "span").orderBy(F.desc("created_at"), F.desc("id")))
    return rows.withColumn("within", within).join(before, ["project_id", "span"]).select(*OBSERVATION_COLUMNS, (F.col("before") + F.col("within")).cast("int").alias("nth"))


def newest_first():
    """For the first few of each project: what is beyond them is dropped before the shuffle."""
    return Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))


def recent_observations(s: Snapshot, n: int, project_id: int | None = None) -> DataFrame:
    """The n newest of a project or of each; each partition keeps its own n before the shuffle."""
    rows = s.observations.where(F.col("project_id").isNotNull() if project_id is None else F.col("project_id") == project_id)
    return rows.withColumn("nth", F.row_number().over(newest_first())).where(F.col("nth") <= n).select(*OBSERVATION_COLUMNS, "nth")


def observation_by_id(s: Snapshot, observation_id: int) -> DataFrame:
    return s.observations.where(F.col("id") == observation_id).select(*OBSERVATION_COLUMNS)


def concepts(s: Snapshot) -> DataFrame:
    return s.concepts.select("id", "name", "description", "identifier_type", "identifier_value").orderBy("name")


def concept_by_name(s: Snapshot, name: str) -> DataFrame:
    return s.concepts.where(F.col("name") == name).select("id", "name", "description", "identifier_type", "identifier_value")


def sources(s: Snapshot) -> DataFrame:
    return s.sources.select(*SOURCE_LIST).orderBy("id")


def source_by_id(s: Snapshot, source_id: int) -> DataFrame:
    return s.sources.where(F.col("id") == source_id).select(*SOURCE_COLUMNS)


def unretracted_dois(s: Snapshot) -> DataFrame:
    return s.sources.where("identifier_type = 'doi' AND NOT retracted").select("id", F.col("identifier_value").alias("doi"))


def project_concepts(s: Snapshot, project_id: int | None = None) -> DataFrame:
    links = s.project_concepts if project_id is None else s.project_concepts.where(F.col("project_id") == project_id)
    return links.join(s.concepts.withColumnRenamed("id", "concept_id"), "concept_id").select("project_id", "concept_id", "name", "description")


def observation_sources(s: Snapshot, observation_id: int | None = None) -> DataFrame:
    links = s.observation_sources if observation_id is None else s.observation_sources.where(F.col("observation_id") == observation_id)
    return links.join(s.sources.withColumnRenamed("id", "source_id"), "source_id").select("observation_id", "source_id", "relationship", "title", "retracted", "retraction_note")


def project_summary(s: Snapshot) -> DataFrame:
    """Every project with the names of its concepts, in order of name, '' if it has none."""
    named = s.project_concepts.join(s.concepts.select(F.col("id").alias("concept_id"), F.col("name").alias("concept")), "concept_id")
    joined = named.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list("concept")), ", ").alias("concepts"))
    return s.projects.join(joined, s.projects["id"] == joined["project_id"], "left").select("id", "name", "status", "description", F.coalesce("concepts", F.lit("")).alias("concepts"))


def table_counts(s: Snapshot) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in s.tables().items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def source_link_counts(s: Snapshot) -> DataFrame:
    counted = s.observation_sources.groupBy("source_id").agg(F.count("*").alias("links"))
    return s.sources.select(F.col("id").alias("source_id")).join(counted, "source_id", "left").select("source_id", F.coalesce("links", F.lit(0)).alias("links"))


def removable_sources(s: Snapshot) -> DataFrame:
    return s.sources.join(s.observation_sources.select(F.col("source_id").alias("id")), "id", "left_anti").select("id", "title")


assert set(SOURCE_COLUMNS) <= set(SCHEMAS["sources"].names)
