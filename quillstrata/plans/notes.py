"""Queries over the note store, each with SQL that gives the same rows.

All run over the whole tables. Where an operation takes an incoming batch or a
second store, that too is made from whole tables: the copies of projects and
concepts are the second store and the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.operators import merging, migrating, reading, reporting, retracting, search, writing
from quillstrata.session import materialise
from quillstrata.sources import exchange
from quillstrata.sources.adapter import store_of, store_sql
from quillstrata.sources.store import SCHEMAS, UNIQUE, Snapshot, broken_references, completed, repeated_keys

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW_TEXT = "2030-01-01 00:00:00"
_P = "id, name, description, status, created_at"
_O = "id, project_id, kind, body, source_doi, created_at"
_PROJECT = "(SELECT min(name) FROM p)"


def _now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


NOW = f"TIMESTAMPTZ '{NOW_TEXT}+00'"


def _add(name: str, run: Callable[[Snapshot], DataFrame], sql: str | None, second: bool = False) -> None:
    QUERIES[name] = lambda spark, folder: run(store_of(spark, folder, second))
    if sql is not None:
        ORACLES[name] = f"WITH {store_sql(second)} {sql}"


def _add2(name: str, run: Callable[[Snapshot, Snapshot], DataFrame], sql: str | None) -> None:
    pinned = name.startswith("import_")  # these read the tables of both stores many times
    QUERIES[name] = lambda spark, folder: run(store_of(spark, folder, pinned=pinned), store_of(spark, folder, True, pinned=pinned))
    if sql is not None:
        ORACLES[name] = f"WITH {store_sql()}, {store_sql(True, '2')} {sql}"


def _first_project(s: Snapshot) -> str:
    """A name for the point queries: the least of all."""
    return s.projects.agg(F.min("name")).first()[0] or ""


def _least(df: DataFrame, column: str = "id") -> int:
    return df.agg(F.min(column)).first()[0] or 0


# --- lists, points and joins
_add("projects_list", reading.projects, f"SELECT {_P} FROM p")
_add("project_by_name", lambda s: reading.project_by_name(s, _first_project(s)), f"SELECT {_P} FROM p WHERE name = {_PROJECT}")
_add("project_by_id", lambda s: reading.project_by_id(s, _least(s.projects)), f"SELECT {_P} FROM p WHERE id = (SELECT min(id) FROM p)")
_add("observations_by_project", reading.observations_of, f"SELECT {_O}, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS nth FROM o WHERE project_id IS NOT NULL")
_add("observation_by_id", lambda s: reading.observation_by_id(s, _least(s.observations)), f"SELECT {_O} FROM o WHERE id = (SELECT min(id) FROM o)")
_add("recent_observations", lambda s: reading.recent_observations(s, 5), f"SELECT * FROM (SELECT {_O}, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS nth FROM o WHERE project_id IS NOT NULL) WHERE nth <= 5")
_add("concepts_list", reading.concepts, "SELECT id, name, description, identifier_type, identifier_value FROM c")
_add("concept_by_name", lambda s: reading.concept_by_name(s, s.concepts.agg(F.min("name")).first()[0] or ""), "SELECT id, name, description, identifier_type, identifier_value FROM c WHERE name = (SELECT min(name) FROM c)")
_add("sources_list", reading.sources, "SELECT id, title, identifier_type, identifier_value, retracted, retraction_note FROM s")
_add("source_by_id", lambda s: reading.source_by_id(s, _least(s.sources)), f"SELECT {', '.join(reading.SOURCE_COLUMNS)} FROM s WHERE id = (SELECT min(id) FROM s)")
_add("unretracted_dois", reading.unretracted_dois, "SELECT id, identifier_value AS doi FROM s WHERE identifier_type = 'doi' AND NOT retracted")
_add("project_concepts", reading.project_concepts, "SELECT project_id, concept_id, name, description FROM pc JOIN c ON c.id = concept_id")
_add("observation_sources", reading.observation_sources, "SELECT observation_id, source_id, relationship, title, retracted, retraction_note FROM os JOIN s ON s.id = source_id")
_SUMMARY = "SELECT p.id, p.name, p.status, p.description, coalesce(string_agg(c.name, ', ' ORDER BY c.name), '') AS concepts FROM p LEFT JOIN pc ON pc.project_id = p.id LEFT JOIN c ON c.id = pc.concept_id GROUP BY ALL"
_add("project_summary", reading.project_summary, _SUMMARY)
_add("table_counts", reading.table_counts, " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {a}" for t, a in zip(SCHEMAS, ("p", "o", "c", "s", "oc", "pc", "os"))))
_add("source_link_counts", reading.source_link_counts, "SELECT s.id AS source_id, count(os.source_id) AS links FROM s LEFT JOIN os ON os.source_id = s.id GROUP BY 1")
_add("removable_sources", reading.removable_sources, "SELECT id, title FROM s WHERE id NOT IN (SELECT source_id FROM os)")


def _thinned(s: Snapshot) -> Snapshot:
    """The store without every third row of what links refer to, as after a careless removal."""
    return s.with_tables(**{t: getattr(s, t).where("id % 3 <> 0") for t in ("projects", "observations", "concepts", "sources")})


_LINKS = (
    ("observations", "(SELECT * FROM o WHERE id % 3 <> 0)", "project_id", "p"),
    ("observation_concepts", "oc", "observation_id", "o"), ("observation_concepts", "oc", "concept_id", "c"),
    ("project_concepts", "pc", "project_id", "p"), ("project_concepts", "pc", "concept_id", "c"),
    ("observation_sources", "os", "observation_id", "o"), ("observation_sources", "os", "source_id", "s"),
)
_add(
    "broken_references", lambda s: broken_references(_thinned(s)),
    " UNION ALL ".join(f"SELECT '{t}' AS tbl, '{f}' AS field, {f} AS value FROM {links} x WHERE {f} IS NOT NULL AND {f} NOT IN (SELECT id FROM {to} WHERE id % 3 <> 0)" for t, links, f, to in _LINKS),
)


def _together(a: Snapshot, b: Snapshot) -> Snapshot:
    """The rows of both stores side by side, as a careless copy would have them."""
    return Snapshot(**{t: getattr(a, t).unionByName(getattr(b, t)) for t in SCHEMAS})


def _repeated_sql() -> str:
    parts = []
    for t, x in zip(SCHEMAS, ("p", "o", "c", "s", "oc", "pc", "os")):
        for key in UNIQUE[t]:
            columns = ", ".join(key)
            whole = "WHERE identifier_type <> '' AND identifier_value <> ''" if "identifier_type" in key else ""
            value = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
            parts.append(f"SELECT '{t}' AS tbl, '{','.join(key)}' AS key, {value} AS value, count(*) AS n FROM (SELECT {columns} FROM {x} UNION ALL SELECT {columns} FROM {x}2) {whole} GROUP BY {columns} HAVING count(*) > 1")
    return " UNION ALL ".join(parts)


_add2("repeated_keys", lambda a, b: repeated_keys(_together(a, b)), _repeated_sql())

# --- reports
_TOP = "SELECT project_id, kind, body, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS nth FROM o WHERE project_id IS NOT NULL"
_add("summary_top3", reporting.summary_rows, f", v AS ({_SUMMARY}), t AS ({_TOP}) SELECT v.id, v.name, v.status, v.description, v.concepts, t.nth, t.kind, t.body FROM v LEFT JOIN t ON t.project_id = v.id AND t.nth <= 3")
_add(
    "summary_text", reporting.summary_blocks,
    f""", v AS ({_SUMMARY}), t AS (SELECT project_id, string_agg('      [' || kind || '] ' || body || chr(10), '' ORDER BY nth) AS lines FROM ({_TOP}) WHERE nth <= 3 GROUP BY 1)
    SELECT id, '  [' || id || '] ' || name || '  (' || status || ')' || chr(10) || CASE WHEN description <> '' THEN '      ' || description || chr(10) ELSE '' END
      || CASE WHEN concepts <> '' THEN '      concepts: ' || concepts || chr(10) ELSE '' END || coalesce(lines, '') || chr(10) AS block FROM v LEFT JOIN t ON t.project_id = v.id""",
)
_add(
    "format_markdown", reporting.markdown_lines,
    f""", v AS ({_SUMMARY}), h AS (SELECT p.created_at, v.* FROM v JOIN p ON p.id = v.id)
    SELECT created_at, id AS project_id, 0 AS part, 0 AS nth, chr(10) || '## Project: ' || name || chr(10) || chr(10) || CASE WHEN description <> '' THEN description || chr(10) || chr(10) ELSE '' END
      || CASE WHEN concepts <> '' THEN '**Concepts:** ' || concepts || chr(10) || chr(10) ELSE '' END AS text FROM h
    UNION ALL SELECT h.created_at, h.id, 1, t.nth, '**[' || t.kind || ']** ' || t.body || chr(10) || chr(10) FROM h JOIN ({_TOP}) t ON t.project_id = h.id
    UNION ALL SELECT created_at, id, 1, 1, '_No observations recorded._' || chr(10) FROM h WHERE id NOT IN (SELECT project_id FROM o WHERE project_id IS NOT NULL)""",
)

# --- full-text search
_DOCS = """, docs AS (
  SELECT body, kind, '' AS label, '' AS descr, 'observation' AS source_type, id AS source_id, project_id FROM o
  UNION ALL SELECT name || ' ' || description, 'project', name, description, 'project', id, id FROM p
  UNION ALL SELECT name || ' ' || description, 'concept', name, description, 'concept', id, 0 FROM c
), ix AS (SELECT *, regexp_extract_all(lower(strip_accents(body)), '[\\pL\\pN]+') AS bw, regexp_extract_all(lower(strip_accents(kind)), '[\\pL\\pN]+') AS kw FROM docs)"""
_add("fts_documents", search.documents, f"{_DOCS} SELECT * FROM docs")
_add(
    "fts_tokens", lambda s: search.indexed(search.documents(s)).select("source_type", "source_id", F.explode(F.concat("body_words", "kind_words")).alias("word")).groupBy("source_type", "source_id", "word").agg(F.count("*").alias("n")),
    f"{_DOCS} SELECT source_type, source_id, word, count(*) AS n FROM (SELECT source_type, source_id, unnest(bw || kw) AS word FROM ix) GROUP BY ALL",
)


def _tf(words: str, prefix: bool = False, columns: str = "bk") -> str:
    parts = words.split()
    sums = []
    for c in columns:
        tests = [f"{c}w[i + {k}] = '{w}'" if not (prefix and k == len(parts) - 1) else f"coalesce(starts_with({c}w[i + {k}], '{w}'), false)" for k, w in enumerate(parts)]
        sums.append(f"len(list_filter(range(1, len({c}w) + 1), lambda i: {' AND '.join(tests)}))")
    return "(" + " + ".join(sums) + ")"


def _search_sql(counts: list[str], condition: str, scored: int | None = None, plain: list[str] | None = None) -> str:
    tf = ", ".join(f"{c} AS tf{i}" for i, c in enumerate(counts)) + "".join(f", {c} AS in{i}" for i, c in enumerate(plain or []))
    n = ", ".join(f"count(*) FILTER ({'in' if plain else 'tf'}{i} > 0) AS n{i}" for i in range(len(counts)))
    idf = [f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 0.000001 END" for i in range(len(counts))]
    score = " + ".join(f"({w}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i, w in list(enumerate(idf))[:scored])
    return f"""{_DOCS}, tf AS (SELECT *, CAST(len(bw) + len(kw) AS DOUBLE) AS dl, {tf} FROM ix), st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean, {n} FROM tf),
    hits AS (SELECT tf.*, -({score}) AS score FROM tf, st WHERE {condition}),
    best AS (SELECT *, row_number() OVER (ORDER BY score, source_type, source_id) AS nth FROM hits)
    SELECT nth, kind, CASE WHEN source_type = 'observation' THEN coalesce(p.name, '') ELSE label END AS label, CASE WHEN source_type = 'observation' THEN body ELSE descr END AS snippet, source_type, source_id, round(score, 6) AS score
    FROM best b LEFT JOIN (SELECT id, name FROM p) p ON source_type = 'observation' AND p.id = b.project_id WHERE nth <= 50"""


def _near(word: str, other: str) -> str:
    """Occurrences of a word that some word of the group, itself included, follows within 5 places, with the other one at most 5 places before that."""
    follows = f"list_filter(range(i, least(i + 5, len(bw)) + 1), lambda m: bw[m] IN ('{word}', '{other}') AND list_contains(bw[greatest(m - 5, 1):m], '{other}'))"
    return f"len(list_filter(range(1, len(bw) + 1), lambda i: bw[i] = '{word}' AND len({follows}) > 0))"


for _name, _text, _counts, _condition in (
    ("search_and", "glacier storm", [_tf("glacier"), _tf("storm")], "tf0 > 0 AND tf1 > 0"),
    ("search_or", "glacier OR gletschermodell", [_tf("glacier"), _tf("gletschermodell")], "tf0 > 0 OR tf1 > 0"),
    ("search_not", "glacier NOT storm pollen", [_tf("glacier"), _tf("storm"), _tf("pollen")], "tf0 > 0 AND NOT (tf1 > 0 AND tf2 > 0)"),
    ("search_prefix", "calibr* survey", [_tf("calibr", True), _tf("survey")], "tf0 > 0 AND tf1 > 0"),
    ("search_phrase", '"pollen sample" OR ice + record', [_tf("pollen sample"), _tf("ice record")], "tf0 > 0 OR tf1 > 0"),
    ("search_column", "kind:finding AND body:(tide OR moisture)", [_tf("finding", columns="k"), _tf("tide", columns="b"), _tf("moisture", columns="b")], "tf0 > 0 AND (tf1 > 0 OR tf2 > 0)"),
    ("search_kind_token", "project lichen", [_tf("project"), _tf("lichen")], "tf0 > 0 AND tf1 > 0"),
    ("search_near", "NEAR(glacier storm, 4)", [_near("glacier", "storm"), _near("storm", "glacier")], "tf0 > 0"),
    ("search_unicode", "relevé OR ZUVERLÄSSIG OR marégraph* OR 한국", [_tf("releve"), _tf("zuverlassig"), _tf("maregraph", True), _tf("한국")], "tf0 > 0 OR tf1 > 0 OR tf2 > 0 OR tf3 > 0"),
    ("search_initial", "^tidal survey", [f"CAST(coalesce(bw[1] = 'tidal', false) AS INT) + CAST(coalesce(kw[1] = 'tidal', false) AS INT)", _tf("survey")], "tf0 > 0 AND tf1 > 0"),
):
    _add(_name, lambda s, t=_text: search.search(s, t), _search_sql(_counts, _condition, 1 if _name == "search_not" else None, [_tf("glacier"), _tf("storm")] if _name == "search_near" else None))

# --- batch writes: the second store's rows come in as a batch
_BATCH_P = "seq, name, description, status, uuid, origin_host"


def _batch(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "seq")


def _grown(table: str, key: str, new: str) -> str:
    return f"(SELECT max(id) FROM {table}) + row_number() OVER (ORDER BY {key}) AS {new}"


_add2(
    "upsert_projects", lambda a, b: writing.upsert_projects(a, _batch(b.projects).select("seq", "name", "description", "status", "uuid", "origin_host"), _now()).projects,
    f"""SELECT p.id, p.name, p.description, p.status, p.created_at, CASE WHEN p.name IN (SELECT name FROM p2) THEN {NOW} ELSE p.updated_at END AS updated_at, p.uuid, p.origin_host FROM p
    UNION ALL SELECT {_grown('p', 'id', 'id')}, name, description, status, {NOW}, {NOW}, uuid, origin_host FROM p2 WHERE name NOT IN (SELECT name FROM p)""",
)
_add2(
    "set_status", lambda a, b: writing.set_status(a, _batch(b.projects).join(a.projects.select("name"), "name", "left_semi").select("seq", "name", F.lit("concluded").alias("status")), _now()).projects,
    f"SELECT id, name, description, CASE WHEN name IN (SELECT name FROM p2) THEN 'concluded' ELSE status END AS status, created_at, CASE WHEN name IN (SELECT name FROM p2) THEN {NOW} ELSE updated_at END AS updated_at, uuid, origin_host FROM p",
)
_add2(
    "append_observations", lambda a, b: writing.append_observations(a, _batch(b.observations).join(a.projects.select(F.col("id").alias("project_id")), "project_id", "left_semi").drop("created_at"), _now()).observations,
    f"SELECT * FROM o UNION ALL SELECT {_grown('o', 'id', 'id')}, project_id, kind, body, {NOW}, source_doi, uuid, origin_host FROM o2 WHERE project_id IN (SELECT id FROM p)",
)
_add2(
    "upsert_concepts", lambda a, b: writing.upsert_concepts(a, _batch(b.concepts).drop("created_at"), _now()).concepts,
    f"""SELECT c.id, c.name, coalesce(x.description, c.description) AS description, c.created_at, coalesce(nullif(x.identifier_type, ''), c.identifier_type) AS identifier_type,
      coalesce(nullif(x.identifier_value, ''), c.identifier_value) AS identifier_value, c.uuid, c.origin_host FROM c LEFT JOIN c2 x ON x.name = c.name
    UNION ALL SELECT {_grown('c', 'id', 'id')}, name, description, {NOW}, identifier_type, identifier_value, uuid, origin_host FROM c2 WHERE name NOT IN (SELECT name FROM c)""",
)
_S_NEW = ", ".join(n for n in SCHEMAS["sources"].names if n not in ("id", "retracted", "retraction_note", "first_seen_at", "last_checked_at", "uuid", "origin_host"))
_PAIR = "identifier_type <> '' AND identifier_value <> ''"
_add2(
    "upsert_sources", lambda a, b: writing.upsert_sources(a, _batch(b.sources), _now()).sources,
    f"""SELECT * FROM s UNION ALL SELECT {_grown('s', 'id', 'id')}, {_S_NEW}, false, '', {NOW}, {NOW}, uuid, origin_host FROM (
      SELECT * FROM s2 WHERE NOT ({_PAIR}) UNION ALL
      SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY identifier_type, identifier_value ORDER BY id) AS nth FROM s2 WHERE {_PAIR})
      WHERE nth = 1 AND (identifier_type, identifier_value) NOT IN (SELECT (identifier_type, identifier_value) FROM s))""",
)
_add("retract_sources", lambda s: writing.retract_sources(s, s.sources.where("version = ''").select(F.col("id").alias("seq"), "id", F.concat(F.lit("no version: "), "title").alias("note"))).sources.select("id", "retracted", "retraction_note"), "SELECT id, retracted OR version = '' AS retracted, CASE WHEN version = '' THEN 'no version: ' || title ELSE retraction_note END AS retraction_note FROM s")
_add2("link_observation_concepts", lambda a, b: writing.link(a, "observation_concepts", b.observation_concepts.join(a.observations.select(F.col("id").alias("observation_id")), "observation_id", "left_semi").join(a.concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").withColumn("seq", F.col("concept_id"))).observation_concepts, "SELECT * FROM oc UNION SELECT * FROM oc2 WHERE observation_id IN (SELECT id FROM o) AND concept_id IN (SELECT id FROM c)")
_add2("link_project_concepts", lambda a, b: writing.link(a, "project_concepts", b.project_concepts.join(a.projects.select(F.col("id").alias("project_id")), "project_id", "left_semi").join(a.concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").withColumn("seq", F.col("concept_id"))).project_concepts, "SELECT * FROM pc UNION SELECT * FROM pc2 WHERE project_id IN (SELECT id FROM p) AND concept_id IN (SELECT id FROM c)")
_add(
    "link_observation_sources", lambda s: writing.link(s, "observation_sources", s.observations.join(s.sources.select(F.col("id").alias("id")), "id", "left_semi").select(F.col("id").alias("observation_id"), F.col("id").alias("source_id"), F.lit("confirmed").alias("relationship"), F.col("id").alias("seq"))).observation_sources,
    "SELECT * FROM os UNION ALL SELECT id, id, 'confirmed' FROM o WHERE id IN (SELECT id FROM s) AND NOT EXISTS (SELECT 1 FROM os WHERE os.observation_id = o.id AND os.source_id = o.id)",
)

# --- two stores
_add2("collision_report", merging.collisions, "SELECT 'projects' AS tbl, p.name, p.uuid AS uuid_a, p2.uuid AS uuid_b FROM p JOIN p2 ON p.name = p2.name AND p.uuid <> p2.uuid UNION ALL SELECT 'concepts', c.name, c.uuid, c2.uuid FROM c JOIN c2 ON c.name = c2.name AND c.uuid <> c2.uuid")


def _reconciled(a: Snapshot, b: Snapshot) -> DataFrame:
    b = merging.reconcile(b, merging.collisions(a, b))
    return _with_table("projects", b.projects.select("id", "name", "uuid")).unionByName(_with_table("concepts", b.concepts.select("id", "name", "uuid")))


def _with_table(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("tbl"), *df.columns)


_add2(
    "reconcile_collisions", _reconciled,
    "SELECT 'projects' AS tbl, p2.id, p2.name, coalesce(p.uuid, p2.uuid) AS uuid FROM p2 LEFT JOIN p ON p.name = p2.name UNION ALL SELECT 'concepts', c2.id, c2.name, coalesce(c.uuid, c2.uuid) FROM c2 LEFT JOIN c ON c.name = c2.name",
)


def _united_sql(table: str, a: str, b: str) -> str:
    names = [n for n in SCHEMAS[table].names if n != "id"]
    keys = "AND name NOT IN (SELECT name FROM {0})" if table != "sources" else "AND NOT (identifier_type <> '' AND identifier_value <> '' AND (identifier_type, identifier_value) IN (SELECT (identifier_type, identifier_value) FROM {0}))"
    return f"m_{a} AS (SELECT id, {', '.join(names)} FROM {a} UNION ALL SELECT {_grown(a, 'id', 'id')}, {', '.join(names)} FROM {b} WHERE uuid NOT IN (SELECT uuid FROM {a}) {keys.format(a)})"


_MERGED = f""", {_united_sql('projects', 'p', 'p2')}, {_united_sql('concepts', 'c', 'c2')}, {_united_sql('sources', 's', 's2')},
oa AS (SELECT o.* REPLACE (n.id AS project_id) FROM o JOIN p x ON x.id = o.project_id JOIN m_p n ON n.uuid = x.uuid),
ob AS (SELECT o.* REPLACE (n.id AS project_id) FROM o2 o JOIN p2 x ON x.id = o.project_id JOIN m_p n ON n.uuid = x.uuid),
m_o AS (SELECT * FROM oa UNION ALL SELECT (SELECT max(id) FROM oa) + row_number() OVER (ORDER BY id) AS id, project_id, kind, body, created_at, source_doi, uuid, origin_host FROM ob WHERE uuid NOT IN (SELECT uuid FROM oa)),
to_o AS (SELECT 0 AS side, o.id, n.id AS new FROM o JOIN m_o n ON n.uuid = o.uuid UNION ALL SELECT 1, o2.id, n.id FROM o2 JOIN m_o n ON n.uuid = o2.uuid),
to_c AS (SELECT 0 AS side, c.id, n.id AS new FROM c JOIN m_c n ON n.uuid = c.uuid UNION ALL SELECT 1, c2.id, n.id FROM c2 JOIN m_c n ON n.uuid = c2.uuid),
to_p AS (SELECT 0 AS side, p.id, n.id AS new FROM p JOIN m_p n ON n.uuid = p.uuid UNION ALL SELECT 1, p2.id, n.id FROM p2 JOIN m_p n ON n.uuid = p2.uuid),
to_s AS (SELECT 0 AS side, s.id, n.id AS new FROM s JOIN m_s n ON n.uuid = s.uuid UNION ALL SELECT 1, s2.id, n.id FROM s2 JOIN m_s n ON n.uuid = s2.uuid),
l_oc AS (SELECT 0 AS side, * FROM oc UNION ALL SELECT 1, * FROM oc2), l_pc AS (SELECT 0 AS side, * FROM pc UNION ALL SELECT 1, * FROM pc2), l_os AS (SELECT 0 AS side, * FROM os UNION ALL SELECT 1, * FROM os2),
m_oc AS (SELECT DISTINCT a.new AS observation_id, b.new AS concept_id FROM l_oc l JOIN to_o a ON a.side = l.side AND a.id = l.observation_id JOIN to_c b ON b.side = l.side AND b.id = l.concept_id),
m_pc AS (SELECT DISTINCT a.new AS project_id, b.new AS concept_id FROM l_pc l JOIN to_p a ON a.side = l.side AND a.id = l.project_id JOIN to_c b ON b.side = l.side AND b.id = l.concept_id),
m_os AS (SELECT a.new AS observation_id, b.new AS source_id, arg_min(l.relationship, l.side) AS relationship FROM l_os l JOIN to_o a ON a.side = l.side AND a.id = l.observation_id JOIN to_s b ON b.side = l.side AND b.id = l.source_id GROUP BY 1, 2)
"""


def _unique(s: Snapshot) -> Snapshot:
    """Stores keep their keys; the test tables repeat some empty uuids: such rows get one from their name."""
    fresh = F.concat(F.lit("new-"), F.md5("name"))
    return s.with_tables(projects=s.projects.withColumn("uuid", F.when(F.col("uuid") == "", fresh).otherwise(F.col("uuid"))), concepts=s.concepts.withColumn("uuid", F.when(F.col("uuid") == "", fresh).otherwise(F.col("uuid"))))


_FRESH = "CASE WHEN uuid = '' THEN 'new-' || md5(name) ELSE uuid END AS uuid"


def _add_merge(name: str, run: Callable[[Snapshot, Snapshot], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, folder: run(_unique(store_of(spark, folder, pinned=True)), _unique(store_of(spark, folder, True, pinned=True)))
    first, second = store_sql(), store_sql(True, "2")
    for t in ("p", "c"):
        first = first.replace(f"\n{t} AS (", f"\n{t}_ AS (", 1).replace(f"\n{t}_ AS (", f"\n{t}_ AS (", 1)
        second = second.replace(f"\n{t}2 AS (", f"\n{t}2_ AS (", 1)
    first = first.replace("\ns AS (", f"\np AS (SELECT * REPLACE ({_FRESH}) FROM p_),\nc AS (SELECT * REPLACE ({_FRESH}) FROM c_),\ns AS (", 1)
    second = second.replace("\ns2 AS (", f"\np2 AS (SELECT * REPLACE ({_FRESH}) FROM p2_),\nc2 AS (SELECT * REPLACE ({_FRESH}) FROM c2_),\ns2 AS (", 1)
    # keys are taken before the empty uuids are filled
    first = first.replace("FROM p GROUP BY 1", "FROM p_ GROUP BY 1").replace("FROM c GROUP BY 1", "FROM c_ GROUP BY 1")
    second = second.replace("FROM p2 GROUP BY 1", "FROM p2_ GROUP BY 1").replace("FROM c2 GROUP BY 1", "FROM c2_ GROUP BY 1")
    ORACLES[name] = f"WITH {first}, {second} {_MERGED} {sql}"


for _table, _short in zip(SCHEMAS, ("p", "o", "c", "s", "oc", "pc", "os")):
    _key = {"projects": "merge_projects", "observations": "merge_observations", "concepts": "merge_concepts", "sources": "merge_sources", "observation_concepts": "merge_observation_concept_links", "project_concepts": "merge_project_concept_links", "observation_sources": "merge_observation_source_links"}[_table]
    _add_merge(_key, lambda a, b, t=_table: getattr(merging.merge(a, b), t), f"SELECT * FROM m_{_short}")
_add_merge(
    "merge_summary", lambda a, b: merging.merge_summary(a, b, merging.merge(a, b)),
    " UNION ALL ".join(f"SELECT {i} AS nth, '{t}' AS tbl, (SELECT count(*) FROM {x}) AS from_a, (SELECT count(*) FROM {x}2) AS from_b, (SELECT count(*) FROM m_{x}) AS merged" for i, (t, x) in enumerate(zip(SCHEMAS, ("p", "o", "c", "s", "oc", "pc", "os")), 1)),
)

# --- export
_STAMP = "strftime(timezone('UTC', {0}), '%Y-%m-%dT%H:%M:%SZ') AS {0}"
_ENDS = {
    "observation_concept": "SELECT o.uuid AS observation_uuid, c.uuid AS concept_uuid FROM oc JOIN o ON o.id = observation_id JOIN c ON c.id = concept_id",
    "project_concept": "SELECT p.uuid AS project_uuid, c.uuid AS concept_uuid FROM pc JOIN p ON p.id = project_id JOIN c ON c.id = concept_id",
    "observation_source": "SELECT o.uuid AS observation_uuid, s.uuid AS source_uuid, relationship FROM os JOIN o ON o.id = observation_id JOIN s ON s.id = source_id",
}
_ALL = {
    "project": "SELECT * FROM p", "concept": "SELECT * FROM c", "source": "SELECT * FROM s", "observation": "SELECT o.*, p.uuid AS project_uuid FROM o JOIN p ON p.id = o.project_id", **_ENDS,
}


def _columns(kind: str) -> str:
    return ", ".join(_STAMP.format(n) if n in ("created_at", "first_seen_at") else n for n in exchange.RECORDS[kind])


def _exported(s: Snapshot, kind: str, project: str | None = None) -> DataFrame:
    df = exchange.export_tables(s, project)[kind]
    return df.select(*(F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(n) if n in ("created_at", "first_seen_at") else F.col(n) for n in exchange.RECORDS[kind]))


_add("export_projects", lambda s: _exported(s, "project"), f"SELECT {_columns('project')} FROM ({_ALL['project']})")
_add("export_observations", lambda s: _exported(s, "observation"), f"SELECT {_columns('observation')} FROM ({_ALL['observation']})")
_add(
    "export_links", lambda s: _exported(s, "observation_concept").select(F.lit("observation_concept").alias("type"), F.col("observation_uuid").alias("a"), F.col("concept_uuid").alias("b"), F.lit("").alias("relationship"))
    .unionByName(_exported(s, "project_concept").select(F.lit("project_concept").alias("type"), F.col("project_uuid").alias("a"), F.col("concept_uuid").alias("b"), F.lit("").alias("relationship")))
    .unionByName(_exported(s, "observation_source").select(F.lit("observation_source").alias("type"), F.col("observation_uuid").alias("a"), F.col("source_uuid").alias("b"), "relationship")),
    f"SELECT 'observation_concept' AS type, observation_uuid AS a, concept_uuid AS b, '' AS relationship FROM ({_ENDS['observation_concept']}) UNION ALL SELECT 'project_concept', project_uuid, concept_uuid, '' FROM ({_ENDS['project_concept']}) UNION ALL SELECT 'observation_source', observation_uuid, source_uuid, relationship FROM ({_ENDS['observation_source']})",
)
_IN = f"(SELECT id FROM p WHERE name = {_PROJECT})"
_add("export_scoped_concepts", lambda s: _exported(s, "concept", _first_project(s)), f"SELECT {_columns('concept')} FROM c WHERE id IN (SELECT concept_id FROM pc WHERE project_id IN {_IN} UNION SELECT concept_id FROM oc JOIN o ON o.id = observation_id WHERE o.project_id IN {_IN})")
_add("export_scoped_sources", lambda s: _exported(s, "source", _first_project(s)), f"SELECT {_columns('source')} FROM s WHERE id IN (SELECT source_id FROM os JOIN o ON o.id = observation_id WHERE o.project_id IN {_IN})")
_add("export_counts", lambda s: exchange.export_lines(s).groupBy("section").agg(F.count("*").alias("lines")), " UNION ALL ".join(f"SELECT {i} AS section, count(*) AS lines FROM ({sql})" for i, sql in enumerate(_ALL.values(), 1)))


def _compared(lines: DataFrame) -> DataFrame:
    """Lines by their parsed fields, as the writing of JSON is not what is compared."""
    names = sorted({n for ns in exchange.RECORDS.values() for n in ns})
    parsed = exchange.parsed_lines(lines.select(F.lit(1).cast("long").alias("line_no"), "line"), check=False)
    return parsed.select("type", *(F.try_element_at("record", F.lit(n)).alias(n) for n in names))


def _all_sql(parts: dict[str, str]) -> str:
    names = sorted({n for ns in exchange.RECORDS.values() for n in ns})
    out = []
    for kind, sql in parts.items():
        have = exchange.RECORDS[kind]
        columns = ", ".join((f"CAST({n} AS VARCHAR) AS {n}" if n == "retracted" else _STAMP.format(n) if n in ("created_at", "first_seen_at") else n) if n in have else f"CAST(NULL AS VARCHAR) AS {n}" for n in names)
        out.append(f"SELECT '{kind}' AS type, {columns} FROM ({sql})")
    return " UNION ALL ".join(out)


_SCOPED = {
    "project": f"SELECT * FROM p WHERE id IN {_IN}",
    "concept": f"SELECT * FROM c WHERE id IN (SELECT concept_id FROM pc WHERE project_id IN {_IN} UNION SELECT concept_id FROM oc JOIN o ON o.id = observation_id WHERE o.project_id IN {_IN})",
    "source": f"SELECT * FROM s WHERE id IN (SELECT source_id FROM os JOIN o ON o.id = observation_id WHERE o.project_id IN {_IN})",
    "observation": f"{_ALL['observation']} WHERE o.project_id IN {_IN}",
    "observation_concept": f"{_ENDS['observation_concept']} WHERE o.project_id IN {_IN}",
    "project_concept": f"{_ENDS['project_concept']} WHERE p.id IN {_IN}",
    "observation_source": f"{_ENDS['observation_source']} WHERE o.project_id IN {_IN}",
}
_add("export_all", lambda s: _compared(exchange.export_lines(s)), _all_sql(_ALL))
_add("export_scoped", lambda s: _compared(exchange.export_lines(s, _first_project(s))), _all_sql(_SCOPED))

# --- import: the second store's export comes into the first
_EXTRA = ('{"type":"mystery","uuid":"x"}', '  ', '{"type":"observation_concept","observation_uuid":"nowhere","concept_uuid":"nowhere"}')


def _incoming(b: Snapshot) -> DataFrame:
    """The export, its lines numbered in their order, each twice, and before them some that lead nowhere."""
    ordered = exchange.export_lines(b).orderBy("section", "place").select((F.monotonically_increasing_id() + 10).alias("line_no"), "line")
    once = materialise(ordered, "export")
    extra = b.projects.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(_EXTRA)], "line_no long, line string")
    return once.unionByName(once.withColumn("line_no", F.col("line_no") + (1 << 60))).unionByName(extra)


def _imported(table: str) -> Callable[[Snapshot, Snapshot], DataFrame]:
    natural = {
        "projects": ["name", "description", "status", "uuid", "origin_host"], "concepts": ["name", "description", "identifier_type", "identifier_value", "uuid", "origin_host"],
        "sources": ["title", "identifier_type", "identifier_value", "authors", "uuid", "origin_host"], "observations": ["project_id", "kind", "body", "source_doi", "uuid", "origin_host"],
    }

    def run(a: Snapshot, b: Snapshot) -> DataFrame:
        return getattr(exchange.import_lines(a, _incoming(b), _now())[0], table).select(*natural[table])

    return run


_add2("import_parse", lambda a, b: exchange.parsed_lines(_incoming(b)).groupBy("type").agg(F.count("*").alias("n")), " UNION ALL ".join(f"SELECT '{k}' AS type, 2 * count(*) + {1 if k == 'observation_concept' else 0} AS n FROM ({sql.replace('FROM p', 'FROM p2').replace('FROM c', 'FROM c2').replace('FROM s', 'FROM s2').replace('FROM oc', 'FROM oc2').replace('FROM c22', 'FROM c2')})" for k, sql in {"project": "SELECT * FROM p", "concept": "SELECT * FROM c", "source": "SELECT * FROM s"}.items()) + " UNION ALL SELECT 'observation', 2 * count(*) FROM o2 WHERE project_id IS NOT NULL UNION ALL SELECT 'observation_concept', 2 * count(*) + 1 FROM oc2 UNION ALL SELECT 'project_concept', 2 * count(*) FROM pc2 UNION ALL SELECT 'observation_source', 2 * count(*) FROM os2 UNION ALL SELECT 'mystery', 1")
_add2("import_projects", _imported("projects"), "SELECT name, description, status, uuid, origin_host FROM p UNION ALL SELECT name, description, status, uuid, origin_host FROM p2 WHERE name NOT IN (SELECT name FROM p)")
_add2("import_concepts", _imported("concepts"), "SELECT name, description, identifier_type, identifier_value, uuid, origin_host FROM c UNION ALL SELECT name, description, identifier_type, identifier_value, uuid, origin_host FROM c2 WHERE name NOT IN (SELECT name FROM c)")
_FROM_FILE = f""", gp AS (SELECT id, name, uuid FROM p UNION ALL
  SELECT (SELECT max(id) FROM p) + row_number() OVER (ORDER BY created_at NULLS FIRST, id), name, uuid FROM p2 WHERE name NOT IN (SELECT name FROM p)),
gc AS (SELECT id, name, uuid FROM c UNION ALL SELECT (SELECT max(id) FROM c) + row_number() OVER (ORDER BY name), name, uuid FROM c2 WHERE name NOT IN (SELECT name FROM c)),
s_fresh AS (SELECT * FROM s2 WHERE NOT ({_PAIR} AND (identifier_type, identifier_value) IN (SELECT (identifier_type, identifier_value) FROM s)) AND uuid NOT IN (SELECT uuid FROM s WHERE uuid <> '')),
s_pair AS (SELECT *, row_number() OVER (PARTITION BY identifier_type, identifier_value ORDER BY id) AS a FROM s_fresh),
s_once AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY id) AS b FROM s_pair WHERE a = 1 OR NOT ({_PAIR})),
s_new AS (SELECT * FROM s_once WHERE b = 1 OR uuid = ''),
gs AS (SELECT id, identifier_type, identifier_value, uuid FROM s UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY id), identifier_type, identifier_value, uuid FROM s_new),
fp AS (SELECT p2.uuid, max(gp.id) AS id FROM p2 JOIN gp ON gp.name = p2.name WHERE p2.uuid <> '' GROUP BY 1),
fc AS (SELECT c2.uuid, max(gc.id) AS id FROM c2 JOIN gc ON gc.name = c2.name WHERE c2.uuid <> '' GROUP BY 1),
pair AS (SELECT identifier_type, identifier_value, min(id) AS id FROM gs WHERE {_PAIR} GROUP BY 1, 2),
same AS (SELECT uuid, min(id) AS id FROM gs WHERE uuid <> '' GROUP BY 1),
fs AS (SELECT s2.uuid, max(coalesce(pair.id, same.id)) AS id FROM s2 LEFT JOIN pair ON pair.identifier_type = s2.identifier_type AND pair.identifier_value = s2.identifier_value
  LEFT JOIN same ON same.uuid = s2.uuid WHERE s2.uuid <> '' GROUP BY 1 HAVING max(coalesce(pair.id, same.id)) IS NOT NULL),
rp AS (SELECT uuid, id FROM fp UNION ALL SELECT uuid, min(id) FROM gp WHERE uuid <> '' AND uuid NOT IN (SELECT uuid FROM fp) GROUP BY 1),
rc AS (SELECT uuid, id FROM fc UNION ALL SELECT uuid, min(id) FROM gc WHERE uuid <> '' AND uuid NOT IN (SELECT uuid FROM fc) GROUP BY 1),
rs AS (SELECT uuid, id FROM fs UNION ALL SELECT uuid, id FROM same WHERE uuid NOT IN (SELECT uuid FROM fs)),
o_new AS (SELECT o2.* REPLACE (rp.id AS project_id) FROM o2 JOIN p2 ON p2.id = o2.project_id JOIN rp ON rp.uuid = p2.uuid WHERE o2.uuid NOT IN (SELECT uuid FROM o)),
go AS (SELECT id, uuid FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY created_at NULLS FIRST, id), uuid FROM o_new),
oc_new AS (SELECT DISTINCT go.id AS observation_id, rc.id AS concept_id FROM oc2 JOIN o2 ON o2.id = oc2.observation_id JOIN c2 ON c2.id = oc2.concept_id JOIN go ON go.uuid = o2.uuid JOIN rc ON rc.uuid = c2.uuid EXCEPT SELECT * FROM oc),
pc_new AS (SELECT DISTINCT rp.id AS project_id, rc.id AS concept_id FROM pc2 JOIN p2 ON p2.id = pc2.project_id JOIN c2 ON c2.id = pc2.concept_id JOIN rp ON rp.uuid = p2.uuid JOIN rc ON rc.uuid = c2.uuid EXCEPT SELECT * FROM pc),
os_new AS (SELECT go.id AS observation_id, rs.id AS source_id, arg_min(os2.relationship, (o2.uuid, s2.uuid)) AS relationship FROM os2 JOIN o2 ON o2.id = os2.observation_id JOIN s2 ON s2.id = os2.source_id
  JOIN go ON go.uuid = o2.uuid JOIN rs ON rs.uuid = s2.uuid WHERE (go.id, rs.id) NOT IN (SELECT (observation_id, source_id) FROM os) GROUP BY 1, 2)
"""
_S_NAMES = "title, identifier_type, identifier_value, authors, uuid, origin_host"
_add2("import_sources", _imported("sources"), f"{_FROM_FILE} SELECT {_S_NAMES} FROM s UNION ALL SELECT {_S_NAMES} FROM s_new")
_O_NAMES = "project_id, kind, body, source_doi, uuid, origin_host"
_add2("import_observations", _imported("observations"), f"{_FROM_FILE} SELECT {_O_NAMES} FROM o UNION ALL SELECT {_O_NAMES} FROM o_new")


def _all_links(s: Snapshot) -> DataFrame:
    parts = [
        df.select(F.lit(t).alias("tbl"), F.col(a).alias("a"), F.col(b).alias("b"), relationship.alias("relationship"))
        for t, df, a, b, relationship in (
            ("observation_concepts", s.observation_concepts, "observation_id", "concept_id", F.lit("")),
            ("project_concepts", s.project_concepts, "project_id", "concept_id", F.lit("")),
            ("observation_sources", s.observation_sources, "observation_id", "source_id", F.col("relationship")),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_add2(
    "import_links", lambda a, b: _all_links(exchange.import_lines(a, _incoming(b), _now())[0]),
    f"""{_FROM_FILE} SELECT 'observation_concepts' AS tbl, observation_id AS a, concept_id AS b, '' AS relationship FROM (SELECT * FROM oc UNION ALL SELECT * FROM oc_new)
    UNION ALL SELECT 'project_concepts', project_id, concept_id, '' FROM (SELECT * FROM pc UNION ALL SELECT * FROM pc_new)
    UNION ALL SELECT 'observation_sources', observation_id, source_id, relationship FROM (SELECT * FROM os UNION ALL SELECT * FROM os_new)""",
)
# the lines before the export are a mystery and an observation_concept; the sections follow in their order
_READ = (
    ("mystery", 1, "0", "0", 1), ("observation_concept", 2, "(SELECT count(*) FROM oc2)", "(SELECT count(*) FROM oc_new)", 1), ("project", 3, "(SELECT count(*) FROM p2)", "(SELECT count(*) FROM p2 WHERE name NOT IN (SELECT name FROM p))", 0),
    ("concept", 4, "(SELECT count(*) FROM c2)", "(SELECT count(*) FROM c2 WHERE name NOT IN (SELECT name FROM c))", 0), ("source", 5, "(SELECT count(*) FROM s2)", "(SELECT count(*) FROM s_new)", 0),
    ("observation", 6, "(SELECT count(*) FROM o2 WHERE project_id IS NOT NULL)", "(SELECT count(*) FROM o_new)", 0), ("project_concept", 7, "(SELECT count(*) FROM pc2)", "(SELECT count(*) FROM pc_new)", 0),
    ("observation_source", 8, "(SELECT count(*) FROM os2)", "(SELECT count(*) FROM os_new)", 0),
)
_add2(
    "import_summary", lambda a, b: exchange.import_lines(a, _incoming(b), _now())[1],
    f"{_FROM_FILE}, counted AS (" + " UNION ALL ".join(f"SELECT '{t}' AS type, {at} AS first, 2 * {n} + {extra} AS read, {new} AS imported" for t, at, n, new, extra in _READ)
    + ") SELECT row_number() OVER (ORDER BY first) AS nth, type, read, imported, CASE WHEN type = 'mystery' THEN 0 ELSE read - imported END AS skipped FROM counted WHERE read > 0",
)

# --- migrations
_add("schema_complete", lambda s: _completed(s.concepts.drop("identifier_type", "identifier_value", "uuid", "origin_host")), "SELECT id, name, description, created_at, '' AS identifier_type, '' AS identifier_value, '' AS uuid, '' AS origin_host FROM c")
_add("backfill_created_at", lambda s: migrating.backfill_created_at(s.with_tables(concepts=s.concepts.withColumn("created_at", F.when(F.col("identifier_type") != "", F.col("created_at")))), _now()).concepts.select("id", "created_at"), f"SELECT id, CASE WHEN identifier_type <> '' THEN created_at ELSE {NOW} END AS created_at FROM c")
_DOI = "SELECT source_doi, min(id) AS seq FROM o WHERE source_doi <> '' AND source_doi NOT IN (SELECT identifier_value FROM s WHERE identifier_type = 'doi') GROUP BY 1"
_add(
    "promote_doi_sources", lambda s: migrating.promote_dois(s, _now(), F.md5("identifier_value")).sources.select("id", "title", "identifier_type", "identifier_value", "uuid"),
    f"SELECT id, title, identifier_type, identifier_value, uuid FROM s UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY seq), 'Source (DOI: ' || source_doi || ')', 'doi', source_doi, md5(source_doi) FROM ({_DOI})",
)
_add(
    "link_promoted_sources", lambda s: migrating.promote_dois(s, _now(), F.md5("identifier_value")).observation_sources,
    f"""SELECT * FROM os UNION ALL SELECT o.id, x.id, 'cited' FROM o JOIN (SELECT id, identifier_value FROM s UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY seq), source_doi FROM ({_DOI})) x
    ON x.identifier_value = o.source_doi WHERE o.source_doi <> '' AND NOT EXISTS (SELECT 1 FROM os WHERE os.observation_id = o.id AND os.source_id = x.id)""",
)
_BACKFILLED = (("projects", "p", "name"), ("observations", "o", "body"), ("concepts", "c", "name"), ("sources", "s", "title"))


def _backfilled(s: Snapshot) -> DataFrame:
    """All four tables; of observations and sources, which all have a uuid here, every fifth one loses it first."""
    out = None
    for name, _, text in _BACKFILLED:
        df = getattr(s, name)
        if name in ("observations", "sources"):
            df = df.withColumn("uuid", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("uuid")))
        part = _with_table(name, migrating.backfill_uuids(df, F.md5(text)).select("id", "uuid", "origin_host"))
        out = part if out is None else out.unionByName(part)
    return out


def _backfilled_sql() -> str:
    parts = []
    for name, x, text in _BACKFILLED:
        empty = "(uuid = '' OR id % 5 = 0)" if name in ("observations", "sources") else "uuid = ''"
        parts.append(f"SELECT '{name}' AS tbl, id, CASE WHEN {empty} THEN md5({text}) ELSE uuid END AS uuid, CASE WHEN {empty} THEN 'unknown' ELSE origin_host END AS origin_host FROM {x}")
    return " UNION ALL ".join(parts)


_add("uuid_backfill", _backfilled, _backfilled_sql())


def _legacy(a: Snapshot, b: Snapshot) -> Snapshot:
    """The second store's projects as legacy experiments; every other observation of the first store that has no project belongs to one."""
    experiments = b.projects.select("id", "name", F.col("description").alias("language"), F.col("origin_host").alias("repo_url"))
    links = b.project_concepts.join(a.concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").withColumnRenamed("project_id", "experiment_id")
    last = b.projects.agg(F.max("id").alias("last"))
    observations = a.observations.crossJoin(F.broadcast(last)).withColumn("experiment_id", F.when(F.col("id") % 2 == 0, 1 + F.pmod("id", "last"))).drop("last")
    return migrating.adopt_legacy(a.with_tables(observations=observations), experiments, links, _now(), F.md5("name"))


_ADOPTED = """, g AS (SELECT id, name, description, status, uuid FROM p UNION ALL
  SELECT (SELECT max(id) FROM p) + row_number() OVER (ORDER BY id), name, concat_ws(' — ', nullif(description, ''), nullif(origin_host, '')), 'active', md5(name) FROM p2 WHERE name NOT IN (SELECT name FROM p)),
e AS (SELECT p2.id AS experiment_id, g.id AS project_id FROM p2 JOIN g ON g.name = p2.name)"""
_add2("legacy_migration", lambda a, b: _legacy(a, b).projects.select("id", "name", "description", "status", "uuid"), f"{_ADOPTED} SELECT * FROM g")
_add2(
    "legacy_observations", lambda a, b: _legacy(a, b).observations.select("id", "project_id"),
    f"{_ADOPTED} SELECT o.id, coalesce(o.project_id, e.project_id) AS project_id FROM o LEFT JOIN e ON o.id % 2 = 0 AND e.experiment_id = 1 + o.id % (SELECT max(id) FROM p2)",
)
_add2(
    "legacy_links", lambda a, b: _legacy(a, b).project_concepts,
    f"{_ADOPTED} SELECT project_id, concept_id FROM pc UNION SELECT e.project_id, pc2.concept_id FROM pc2 JOIN e ON e.experiment_id = pc2.project_id WHERE pc2.concept_id IN (SELECT id FROM c)",
)


def _completed(concepts: DataFrame) -> DataFrame:
    return completed(concepts, "concepts")


# --- retraction sweep: the feed names the DOIs of every other source
def _feed(s: Snapshot) -> DataFrame:
    listed = s.sources.where("identifier_type = 'doi' AND id % 2 = 0")
    reason = F.when(F.col("version") == "", "").otherwise(F.concat(F.lit("Version "), "version"))
    return listed.select(F.col("id").alias("seq"), F.col("identifier_value").alias("doi"), reason.alias("reason"), F.when(F.col("publisher") == "", "").otherwise("2024-05-01").alias("retraction_date"))


_SWEPT = """, feed AS (SELECT identifier_value AS doi, arg_min(version, id) AS version, arg_min(publisher, id) AS publisher FROM s WHERE identifier_type = 'doi' AND id % 2 = 0 GROUP BY 1),
due AS (SELECT s.id, feed.doi IS NOT NULL AS hit, CASE WHEN feed.version <> '' AND feed.publisher <> '' THEN 'Version ' || feed.version || ' (2024-05-01)' WHEN feed.version <> '' THEN 'Version ' || feed.version
  WHEN feed.publisher <> '' THEN '2024-05-01' ELSE 'Retracted (Retraction Watch)' END AS note FROM s LEFT JOIN feed ON feed.doi = s.identifier_value WHERE s.identifier_type = 'doi' AND NOT s.retracted)"""
_add(
    "retraction_sweep", lambda s: retracting.sweep(s, retracting.notes_from_feed(_feed(s)), _now())[0].sources.select("id", "retracted", "retraction_note", "last_checked_at"),
    f"""{_SWEPT} SELECT s.id, retracted OR coalesce(hit, false) AS retracted, CASE WHEN hit THEN note ELSE retraction_note END AS retraction_note,
      CASE WHEN due.id IS NOT NULL THEN {NOW} ELSE last_checked_at END AS last_checked_at FROM s LEFT JOIN due ON due.id = s.id""",
)
_add("retraction_counts", lambda s: retracting.sweep(s, retracting.notes_from_feed(_feed(s)), _now())[1], f"{_SWEPT} SELECT count(*) AS checked, count(*) FILTER (hit) AS updated FROM due")
