"""The text summary and the Markdown report, one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.operators.reading import newest_first, observations_of, project_summary
from quillstrata.sources.store import Snapshot

#: Newest observations that the summary shows of each project.
SHOWN = 3
# The lines of the reports.
NO_PROJECTS = "  (no projects — use project add <name> to create one)\n"
NO_OBSERVATIONS = "_No observations recorded._\n"
TITLE = "# Notes\n"


def summary_rows(s: Snapshot, shown: int = SHOWN) -> DataFrame:
    """Each project with its newest observations, one row per observation, ``nth`` null if it has none."""
    newest = s.observations.where("project_id IS NOT NULL").withColumn("nth", F.row_number().over(newest_first())).where(F.col("nth") <= shown).select("project_id", "nth", "kind", "body")
    heads = project_summary(s)
    return heads.join(newest, heads["id"] == newest["project_id"], "left").select("id", "name", "status", "description", "concepts", "nth", "kind", "body")


def summary_blocks(s: Snapshot, shown: int = SHOWN) -> DataFrame:
    """Rows ``(id, block)``: the summary's text of each project; at most ``shown`` lines are gathered per project."""
    rows = summary_rows(s, shown)
    lines = F.array_sort(F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("nth", F.concat(F.lit("      ["), "kind", F.lit("] "), "body", F.lit("\n")).alias("line")))))
    grouped = rows.groupBy("id", "name", "status", "description", "concepts").agg(lines.alias("lines"))
    return grouped.select(
        "id",
        F.concat(
            F.lit("  ["), F.col("id").cast("string"), F.lit("] "), "name", F.lit("  ("), "status", F.lit(")\n"),
            F.when(F.col("description") != "", F.concat(F.lit("      "), "description", F.lit("\n"))).otherwise(""),
            F.when(F.col("concepts") != "", F.concat(F.lit("      concepts: "), "concepts", F.lit("\n"))).otherwise(""),
            F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit("\n"),
        ).alias("block"),
    )


def summary(s: Snapshot) -> str:
    """The whole summary as one text, in order of id; made on the driver, for reading."""
    return "".join(r.block for r in summary_blocks(s).orderBy("id").collect()) or NO_PROJECTS


def markdown_lines(s: Snapshot, project_id: int | None = None) -> DataFrame:
    """Rows ``(created_at, project_id, part, nth, text)``: the report, piece by piece.

    A project may have any number of observations, so its text is never
    gathered into one value: ordered by these columns the pieces are the report.
    """
    chosen = s.projects if project_id is None else s.projects.where(F.col("id") == project_id)
    heads = project_summary(s.with_tables(projects=chosen)).join(chosen.select("id", "created_at"), "id")
    head = F.concat(
        F.lit("\n## Project: "), "name", F.lit("\n\n"),
        F.when(F.col("description") != "", F.concat("description", F.lit("\n\n"))).otherwise(""),
        F.when(F.col("concepts") != "", F.concat(F.lit("**Concepts:** "), "concepts", F.lit("\n\n"))).otherwise(""),
    )
    headers = heads.select("created_at", F.col("id").alias("project_id"), F.lit(0).alias("part"), F.lit(0).alias("nth"), head.alias("text"))
    of = chosen.select(F.col("id").alias("project_id"), F.col("created_at").alias("project_created"))
    notes = observations_of(s.with_tables(observations=s.observations.join(of.select("project_id"), "project_id", "left_semi"))).join(of, "project_id").select(
        F.col("project_created").alias("created_at"), "project_id", F.lit(1).alias("part"), "nth", F.concat(F.lit("**["), "kind", F.lit("]** "), "body", F.lit("\n\n")).alias("text")
    )
    none = chosen.join(s.observations.select(F.col("project_id").alias("id")), "id", "left_anti").select("created_at", F.col("id").alias("project_id"), F.lit(1).alias("part"), F.lit(1).alias("nth"), F.lit(NO_OBSERVATIONS).alias("text"))
    return headers.unionByName(notes).unionByName(none)


def markdown(s: Snapshot, project_id: int | None = None) -> str:
    """The whole report as one text; '' for no project; made on the driver, for reading."""
    rows = markdown_lines(s, project_id).orderBy("created_at", "project_id", "part", "nth").collect()
    return TITLE + "".join(r.text for r in rows) if rows else ""
