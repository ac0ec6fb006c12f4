"""Older data brought up to date: missing values filled, citations promoted, legacy tables taken over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.operators.writing import first_wins, link, upsert_projects, upsert_sources
from quillstrata.session import materialise
from quillstrata.sources.store import Snapshot, completed, uuid_v7

# What stands around the DOI in the title of a promoted citation.
PROMOTED_TITLE = ("Source (DOI: ", ")")


def backfill_created_at(s: Snapshot, now: Column) -> Snapshot:
    return s.with_tables(concepts=s.concepts.withColumn("created_at", F.coalesce("created_at", now)))


def backfill_uuids(df: DataFrame, fresh: Column) -> DataFrame:
    """Rows without uuid get one and the host 'unknown'. ``fresh`` may be random: write the result before using it twice."""
    empty = F.coalesce(F.col("uuid"), F.lit("")) == ""
    return df.withColumn("origin_host", F.when(empty, "unknown").otherwise(F.col("origin_host"))).withColumn("uuid", F.when(empty, fresh).otherwise(F.col("uuid")))


def promote_dois(s: Snapshot, now: Column, fresh: Column) -> Snapshot:
    """A source for each cited DOI that none has yet, and a link to each source with that value, whatever its type."""
    cited = s.observations.where("source_doi <> ''").groupBy("source_doi").agg(F.min("id").alias("seq"))
    incoming = cited.select(
        "seq", F.concat(F.lit(PROMOTED_TITLE[0]), F.col("source_doi"), F.lit(PROMOTED_TITLE[1])).alias("title"), F.lit("doi").alias("identifier_type"), F.col("source_doi").alias("identifier_value")
    ).withColumn("uuid", fresh).withColumn("origin_host", F.lit("unknown"))
    grown = upsert_sources(s, incoming, now)
    return link_promoted(grown)


def link_promoted(s: Snapshot) -> Snapshot:
    pairs = s.observations.where("source_doi <> ''").select(F.col("id").alias("observation_id"), F.col("source_doi").alias("identifier_value")).join(
        s.sources.select(F.col("id").alias("source_id"), "identifier_value"), "identifier_value"
    ).select("observation_id", "source_id", F.lit("cited").alias("relationship"), F.col("observation_id").alias("seq"))
    return link(s, "observation_sources", pairs, check=False)


def adopt_legacy(s: Snapshot, experiments: DataFrame, concept_links: DataFrame, now: Column, fresh: Column) -> Snapshot:
    """``experiments(id, name, language, repo_url)`` become projects by name; ``concept_links(experiment_id, concept_id)`` go along.

    A known name keeps its project. The description is language and address,
    as far as there are any. Repeats of a name are one project; doing it again
    changes nothing.
    """
    given = experiments.select(
        F.col("id").alias("seq"), "name",
        F.concat_ws(" — ", F.nullif(F.coalesce("language", F.lit("")), F.lit("")), F.nullif(F.coalesce("repo_url", F.lit("")), F.lit(""))).alias("description"),
        F.lit("active").alias("status"),
    ).withColumn("uuid", fresh).withColumn("origin_host", F.lit("unknown"))
    unknown = first_wins(s.projects, given, "name")
    grown = upsert_projects(s, unknown.select(*given.columns), now, check=False)
    of = experiments.select(F.col("id").alias("experiment_id"), "name").join(grown.projects.select(F.col("id").alias("project_id"), "name"), "name").select("experiment_id", "project_id")
    observations = s.observations
    if "experiment_id" in observations.columns:
        observations = observations.join(of.withColumnRenamed("project_id", "_p"), "experiment_id", "left").withColumn("project_id", F.coalesce("project_id", "_p"))
    links = concept_links.join(of, "experiment_id").select("project_id", "concept_id", F.col("concept_id").alias("seq"))
    return link(grown.with_tables(observations=completed(observations, "observations")), "project_concepts", links, check=False)


def migrated(s: Snapshot, now: Column) -> tuple[Snapshot, set[str]]:
    """The store brought up to date, and the names of the tables that changed; done again it changes nothing.

    Fresh values are random: what gets any is written before it is used.
    """
    changed: set[str] = set()
    if not s.concepts.where("created_at IS NULL").isEmpty():
        s, changed = backfill_created_at(s, now), changed | {"concepts"}
    known = s.sources.where("identifier_type = 'doi'").select(F.col("identifier_value").alias("source_doi"))
    if not s.observations.where("source_doi <> ''").join(known, "source_doi", "left_anti").isEmpty():
        grown = promote_dois(s, now, uuid_v7(now))
        s = s.with_tables(sources=materialise(grown.sources, "sources"))
        changed |= {"sources", "observation_sources"}
    linked = link_promoted(s).observation_sources
    if "observation_sources" in changed or not linked.exceptAll(s.observation_sources).isEmpty():
        s, changed = s.with_tables(observation_sources=linked), changed | {"observation_sources"}
    for name in ("projects", "observations", "concepts", "sources"):
        df = getattr(s, name)
        if not df.where("coalesce(uuid, '') = ''").isEmpty():
            s, changed = s.with_tables(**{name: materialise(backfill_uuids(df, uuid_v7(now)), name)}), changed | {name}
    return s, changed
