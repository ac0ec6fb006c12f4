"""The test tables as stores of the seven-table model, in Spark and in SQL.

Observations are the first record of each uuid (a second store: the last one),
with the time of its receipt; projects and concepts are found by key. Projects
carry the concepts of their decisions. An observation cites one source, or none;
every fourth source is cited by none. The second store's sources have ids of
their own; some are the first one's, some share only the identifier or only the
uuid, some are new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.functions.text import or_empty, uuid_key
from quillstrata.session import materialise
from quillstrata.sources.store import SCHEMAS, Snapshot
from quillstrata.sources.tables import table

_KEY = "nullif(regexp_replace(regexp_replace(lower({0}), 'urn:|uuid:', '', 'g'), '[^0-9a-z]', '', 'g'), '')"


def store_of(spark: SparkSession, folder: str, second: bool = False, pinned: bool = False) -> Snapshot:
    """The first store (projects, concepts) or the second (their copies).

    ``pinned``: written to the shared folder first, as a store on disk is, for
    operations that read its tables many times.
    """
    tail = "_copy" if second else ""

    def plain(name: str, kind: str) -> DataFrame:
        df = table(spark, folder, name)
        return df.select(*(or_empty(F.col(c)).alias(c) if df.schema[c].dataType.typeName() == "string" else F.col(c) for c in SCHEMAS[kind].names))

    projects, concepts = plain(f"projects{tail}", "projects"), plain(f"concepts{tail}", "concepts")
    sources = plain("sources", "sources").withColumn("retracted", F.coalesce("retracted", F.lit(False)))
    if second:
        id_ = F.col("id")
        apart = F.when((id_ % 5 == 0) | (id_ % 7 == 0), F.concat(F.lit("b-"), F.col("uuid"))).otherwise(F.col("uuid"))
        value = F.when(id_ % 7 == 0, "").when(id_ % 11 == 0, F.concat("identifier_value", F.lit("-b"))).otherwise(F.col("identifier_value"))
        sources = sources.withColumns({"uuid": apart, "identifier_value": value, "id": id_ * 2 + 1})
    keys_p = projects.select(F.col("id").alias("project_id"), uuid_key(F.col("uuid")).alias("pk")).where("pk IS NOT NULL").groupBy("pk").agg(F.min("project_id").alias("project_id"))
    keys_c = concepts.select(F.col("id").alias("concept_id"), uuid_key(F.col("uuid")).alias("ck")).where("ck IS NOT NULL").groupBy("ck").agg(F.min("concept_id").alias("concept_id"))
    records = table(spark, folder, "observation_records").withColumn("k", uuid_key(F.col("uuid"))).where("k IS NOT NULL")
    pick = F.max_by if second else F.min_by
    row = F.struct("rec_no", "project_uuid", "kind", "body", "received_at", "source_doi", "uuid", "origin_host")
    kept = records.groupBy("k").agg(pick(row, F.struct("received_at", "rec_no")).alias("r")).select("k", "r.*")
    observations = kept.withColumn("pk", uuid_key(F.col("project_uuid"))).join(keys_p, "pk", "left").select(
        F.col("rec_no").alias("id"), F.col("project_id"), or_empty(F.col("kind")).alias("kind"), or_empty(F.col("body")).alias("body"),
        F.col("received_at").alias("created_at"), or_empty(F.col("source_doi")).alias("source_doi"), F.col("k").alias("uuid"), or_empty(F.col("origin_host")).alias("origin_host"),
    )
    links = table(spark, folder, "observation_concept_records").select(uuid_key(F.col("observation_uuid")).alias("k"), uuid_key(F.col("concept_uuid")).alias("ck")).distinct()
    ids = observations.select(F.col("id").alias("observation_id"), F.col("uuid").alias("k"), "project_id", "kind")
    linked = links.join(ids, "k").join(keys_c, "ck")
    last = sources.agg(F.max("id").alias("last"))
    cited = observations.select("id").crossJoin(F.broadcast(last)).select(F.col("id").alias("observation_id"), (1 + F.pmod(F.col("id") * 13, F.col("last"))).alias("source_id")).where("source_id % 4 <> 3")
    store = Snapshot(
        projects=projects,
        observations=observations,
        concepts=concepts,
        sources=sources,
        observation_concepts=linked.select("observation_id", "concept_id").distinct(),
        project_concepts=linked.where("kind = 'decision' AND project_id IS NOT NULL").select("project_id", "concept_id").distinct(),
        observation_sources=cited.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(
            "observation_id", "source_id", F.when(F.pmod("observation_id", F.lit(3)) == 0, "retrieved").otherwise("cited").alias("relationship")
        ),
    )
    if pinned:
        store = store.with_tables(observations=materialise(store.observations, "observations"))
        linked = links.join(store.observations.select(F.col("id").alias("observation_id"), F.col("uuid").alias("k"), "project_id", "kind"), "k").join(keys_c, "ck")
        linked = materialise(linked.select("observation_id", "concept_id", "project_id", "kind"), "links")
        store = store.with_tables(
            observation_concepts=linked.select("observation_id", "concept_id").distinct(),
            project_concepts=linked.where("kind = 'decision' AND project_id IS NOT NULL").select("project_id", "concept_id").distinct(),
        )
    return store


def _text(alias: str, kind: str) -> str:
    names = []
    for field in SCHEMAS[kind]:
        if field.dataType.typeName() == "string":
            names.append(f"coalesce({field.name}, '') AS {field.name}")
        elif field.name == "retracted":
            names.append("coalesce(retracted, false) AS retracted")
        else:
            names.append(field.name)
    return f"SELECT {', '.join(names)} FROM main.{alias}"


def _second_sources(sql: str) -> str:
    return f"""SELECT * REPLACE (2 * id + 1 AS id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'b-' || uuid ELSE uuid END AS uuid,
  CASE WHEN id % 7 = 0 THEN '' WHEN id % 11 = 0 THEN identifier_value || '-b' ELSE identifier_value END AS identifier_value) FROM ({sql})"""


def store_sql(second: bool = False, tail: str = "") -> str:
    """Common table expressions p, o, c, s, oc, pc, os of the same store for DuckDB; ``tail`` is added to their names."""
    copy, order = ("_copy", "DESC") if second else ("", "ASC")
    t = tail
    return f"""
p{t} AS ({_text('projects' + copy, 'projects')}),
c{t} AS ({_text('concepts' + copy, 'concepts')}),
s{t} AS ({_second_sources(_text('sources', 'sources')) if second else _text('sources', 'sources')}),
kp{t} AS (SELECT {_KEY.format('uuid')} AS pk, min(id) AS project_id FROM p{t} GROUP BY 1),
kc{t} AS (SELECT {_KEY.format('uuid')} AS ck, min(id) AS concept_id FROM c{t} GROUP BY 1),
orec{t} AS (SELECT *, {_KEY.format('uuid')} AS k FROM main.observation_records),
o{t} AS (SELECT r.rec_no AS id, kp{t}.project_id, coalesce(r.kind, '') AS kind, coalesce(r.body, '') AS body, r.received_at AS created_at,
  coalesce(r.source_doi, '') AS source_doi, r.k AS uuid, coalesce(r.origin_host, '') AS origin_host
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY received_at {order}, rec_no {order}) AS nth FROM orec{t} WHERE k IS NOT NULL) r
  LEFT JOIN kp{t} ON kp{t}.pk = {_KEY.format('r.project_uuid')} WHERE nth = 1),
lk{t} AS (SELECT DISTINCT o{t}.id AS observation_id, kc{t}.concept_id, o{t}.project_id, o{t}.kind FROM main.observation_concept_records x
  JOIN o{t} ON o{t}.uuid = {_KEY.format('x.observation_uuid')} JOIN kc{t} ON kc{t}.ck = {_KEY.format('x.concept_uuid')}),
oc{t} AS (SELECT DISTINCT observation_id, concept_id FROM lk{t}),
pc{t} AS (SELECT DISTINCT project_id, concept_id FROM lk{t} WHERE kind = 'decision' AND project_id IS NOT NULL),
os{t} AS (SELECT o{t}.id AS observation_id, s{t}.id AS source_id, CASE WHEN o{t}.id % 3 = 0 THEN 'retrieved' ELSE 'cited' END AS relationship
  FROM o{t} JOIN s{t} ON s{t}.id = 1 + (o{t}.id * 13) % (SELECT max(id) FROM s{t}) WHERE s{t}.id % 4 <> 3)
"""
