"""The store: seven tables as one immutable snapshot, kept in versioned folders.

A snapshot is a set of DataFrames. Operations take snapshots and give new ones;
nothing is changed in place. On disk a version is a small file that names the
folder of each table; a writer writes the tables that changed, then the file of
the next version, so a reader sees one version or the next, never a part. Files
are made through Hadoop's file system, so a store may lie wherever executors
can write; a version's file is created exclusively, so of two writers one wins
and the other is refused.
"""

from __future__ import annotations

import json
import uuid as uuid_module
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "string": T.StringType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split(":") for x in text.split())])


# The columns of the seven tables, the kinds of observations and the states of projects.
SCHEMAS: dict[str, T.StructType] = {
    "projects": _schema("id:long name:string description:string status:string created_at:timestamp updated_at:timestamp uuid:string origin_host:string"),
    "observations": _schema("id:long project_id:long kind:string body:string created_at:timestamp source_doi:string uuid:string origin_host:string"),
    "concepts": _schema("id:long name:string description:string created_at:timestamp identifier_type:string identifier_value:string uuid:string origin_host:string"),
    "sources": _schema(
        "id:long title:string identifier_type:string identifier_value:string authors:string published_date:string publisher:string rights:string version:string "
        "retracted:boolean retraction_note:string first_seen_at:timestamp last_checked_at:timestamp uuid:string origin_host:string"
    ),
    "observation_concepts": _schema("observation_id:long concept_id:long"),
    "project_concepts": _schema("project_id:long concept_id:long"),
    "observation_sources": _schema("observation_id:long source_id:long relationship:string"),
}
KINDS = ("note", "finding", "decision", "question", "hypothesis")
STATES = ("concept", "active", "paused", "concluded")

#: What a column holds that an older snapshot does not have.
DEFAULTS: dict[str, object] = {"status": "active", "kind": "note", "relationship": "cited", "retracted": False}


@dataclass(frozen=True)
class Snapshot:
    projects: DataFrame
    observations: DataFrame
    concepts: DataFrame
    sources: DataFrame
    observation_concepts: DataFrame
    project_concepts: DataFrame
    observation_sources: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}

    def with_tables(self, **tables: DataFrame) -> Snapshot:
        return replace(self, **tables)

    @classmethod
    def empty(cls, spark: SparkSession) -> Snapshot:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def completed(df: DataFrame, table: str) -> DataFrame:
    """``df`` with all columns of ``table`` in their order: missing ones are added with their defaults, others dropped."""
    columns: list[Column] = []
    for field in SCHEMAS[table]:
        if field.name in df.columns:
            columns.append(df[field.name].cast(field.dataType).alias(field.name))
        else:
            default = DEFAULTS.get(field.name, "" if isinstance(field.dataType, T.StringType) else None)
            columns.append(F.lit(default).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def default_path(root: str) -> str:
    """Where a workspace keeps its store."""
    return f"{root.rstrip('/') or '.'}/agents/notes.store"


class Files:
    """Small files through Hadoop's file system, whatever the scheme of their path."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.root = self._path(folder)
        self._fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self.root)] if self._fs.exists(self.root) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.root, name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """False if there is such a file already."""
        try:
            stream = self._fs.create(self._path(self.root, name), False)
        except Exception as error:  # the JVM's, of whatever file system
            if "AlreadyExists" in str(error) or self._fs.exists(self._path(self.root, name)):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.root, name), True)


class Store:
    """Versions of a snapshot in a folder that all executors see: a path or a URI. Versions are immutable; ``read`` pins one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, str(path).rstrip("/")
        self._files = Files(spark, self.path)

    def version(self) -> int:
        """The current version; 0 for a store that holds nothing yet."""
        return max((int(n[1:-5]) for n in self._files.names() if n.startswith("v") and n.endswith(".json")), default=0)

    def _folders(self, version: int) -> dict[str, str]:
        return json.loads(self._files.read(f"v{version:08d}.json")) if version else {}

    def read(self, version: int | None = None) -> Snapshot:
        """The tables of a version, the current one if not said; older schemas are completed."""
        folders = self._folders(self.version() if version is None else version)
        return Snapshot(
            **{
                name: completed(self.spark.read.parquet(f"{self.path}/{folders[name]}"), name) if name in folders else self.spark.createDataFrame([], schema)
                for name, schema in SCHEMAS.items()
            }
        )

    def open(self, now: Column | None = None) -> Snapshot:
        """The current version brought up to date: schemas completed, times and uuids filled in, cited DOIs promoted; written if that changed anything."""
        from quillstrata.operators.migrating import migrated

        at = self.version()
        if not at:
            return Snapshot.empty(self.spark)
        before = self.read(at)
        after, changed = migrated(before, F.date_trunc("second", F.current_timestamp()) if now is None else now)
        if changed:
            self.write(after, changed, at)
            return self.read()
        return before

    def write(self, snapshot: Snapshot, changed: Mapping[str, object] | None = None, base: int | None = None) -> int:
        """Write the tables named in ``changed`` (all, if not said), then the next version's file; its number.

        ``base``: the version the snapshot was made from. RuntimeError if
        another writer has written one since; nothing of this one holds then.
        """
        current = self.version()
        at = (current if base is None else base) + 1
        folders = self._folders(at - 1)
        for name, df in snapshot.tables().items():
            if changed is None or name in changed or name not in folders:
                folders[name] = f"{name}-{uuid_module.uuid4().hex}"
                completed(df, name).write.parquet(f"{self.path}/{folders[name]}")
        if current >= at or not self._files.create(f"v{at:08d}.json", json.dumps(folders)):
            raise RuntimeError(f"another writer has written version {at} of {self.path}")
        return at

    def close(self) -> None:
        """Nothing is held open: versions are files."""


def broken_references(snapshot: Snapshot) -> DataFrame:
    """Rows ``(tbl, field, value)`` of links and observations whose target is not there."""
    s = snapshot
    parts = [
        s.observations.where("project_id IS NOT NULL").select(F.col("project_id").alias("value")).join(s.projects.select(F.col("id").alias("value")), "value", "left_anti").select(F.lit("observations").alias("tbl"), F.lit("project_id").alias("field"), "value"),
    ]
    for tbl, links in (("observation_concepts", s.observation_concepts), ("project_concepts", s.project_concepts), ("observation_sources", s.observation_sources)):
        for field in [c for c in links.columns if c.endswith("_id")]:
            target = getattr(s, {"observation_id": "observations", "concept_id": "concepts", "project_id": "projects", "source_id": "sources"}[field])
            parts.append(links.select(F.col(field).alias("value")).join(target.select(F.col("id").alias("value")), "value", "left_anti").select(F.lit(tbl).alias("tbl"), F.lit(field).alias("field"), "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Columns in which a table repeats no value; of sources only where both parts are given.
UNIQUE: Mapping[str, tuple[tuple[str, ...], ...]] = {
    "projects": (("id",), ("name",), ("uuid",)),
    "observations": (("id",), ("uuid",)),
    "concepts": (("id",), ("name",), ("uuid",)),
    "sources": (("id",), ("uuid",), ("identifier_type", "identifier_value")),
    "observation_concepts": (("observation_id", "concept_id"),),
    "project_concepts": (("project_id", "concept_id"),),
    "observation_sources": (("observation_id", "source_id"),),
}


def repeated_keys(snapshot: Snapshot) -> DataFrame:
    """Rows ``(tbl, key, value, n)`` of values that a unique key holds more than once."""
    out = None
    for tbl, keys in UNIQUE.items():
        for key in keys:
            rows = getattr(snapshot, tbl)
            if key == ("identifier_type", "identifier_value"):
                rows = rows.where("identifier_type <> '' AND identifier_value <> ''")
            part = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(tbl).alias("tbl"), F.lit(",".join(key)).alias("key"), F.concat_ws("|", *(F.col(k).cast("string") for k in key)).alias("value"), "n")
            out = part if out is None else out.unionByName(part)
    return out


def uuid_v7(at: Column) -> Column:
    """A fresh time-ordered identifier (RFC 9562, version 7): the time's milliseconds, then random bits. Write the result before using it twice."""
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    noise = F.regexp_replace(F.uuid(), "-", "")
    return F.concat(
        F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(noise, 1, 3), F.lit("-"),
        F.substring(F.lit("89ab"), F.floor(F.rand() * 4).cast("int") + 1, F.lit(1)), F.substring(noise, 4, 3), F.lit("-"), F.substring(noise, 7, 12),
    )


def parsed_time(text: Column) -> Column:
    """RFC 3339 or 'date time', else null; never an error."""
    return F.try_to_timestamp(text)
