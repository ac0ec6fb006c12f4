import json
import random
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstrata.operators import merging, migrating, reading, reporting, retracting, search, writing
from quillstrata.sources import exchange
from quillstrata.sources.store import SCHEMAS, Snapshot, Store, broken_references, completed, repeated_keys, uuid_v7

T0, T1, T2 = (datetime(2024, 1, d) for d in (1, 2, 3))
def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp")



def two_projects(spark) -> Snapshot:
    """Two projects; one concept of the first, one reached through its observation; a cited source; an observation apart."""
    rows = {
        "projects": [(1, "alpha", "first", "active", T0, T0, "pa", "h"), (2, "beta", "", "paused", T1, T1, "pb", "h")],
        "observations": [(1, 1, "note", "Docker café uses WAL mode", T0, "", "oa", "h"), (2, 2, "finding", "nothing here", T1, "10.1/x", "ob", "h")],
        "concepts": [(1, "docker", "boxes", T0, "", "", "ca", "h"), (2, "wal", "log", T0, "ror", "r1", "cb", "h")],
        "sources": [(1, "a page", "", "", "", "", "", "", "", False, "", T0, T0, "sa", "h")],
        "observation_concepts": [(1, 2)],
        "project_concepts": [(1, 1)],
        "observation_sources": [(1, 1, "cited")],
    }
    return Snapshot(**{n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()})


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.read().projects.count() == 0
    s = two_projects(spark)
    assert store.write(s) == 1
    assert store.write(store.read().with_tables(projects=store.read().projects.where("id = 1"))) == 2
    assert (store.read(1).projects.count(), store.read().projects.count()) == (2, 1)
    assert broken_references(store.read()).select("tbl", "value").collect() == [("observations", 2)]
    assert repeated_keys(s).count() == 0
    with pytest.raises(RuntimeError):  # another writer went on from the same version
        store.write(s, base=1)
    assert store.write(s, {"projects"}) == 3 and store._folders(3)["concepts"] == store._folders(2)["concepts"] != store._folders(3)["projects"]
    assert Store(spark, f"file://{tmp_path}/store").read().projects.count() == 2
    bare = s.with_tables(concepts=s.concepts.withColumns({"uuid": F.lit(""), "created_at": F.lit(None).cast("timestamp")}))
    store.write(bare)
    opened = store.open(now())
    assert {(len(r.uuid), r.origin_host, r.created_at.year) for r in opened.concepts.collect()} == {(36, "unknown", 2030)}
    assert opened.sources.count() == 2 and opened.observation_sources.count() == 2  # the cited DOI is a source now
    assert store.version() == 5 and store.open(now()) and store.version() == 5
    old = s.concepts.drop("identifier_type", "uuid")
    assert completed(old, "concepts").columns == SCHEMAS["concepts"].names
    ids = [r[0] for r in spark.range(50).select(uuid_v7(F.current_timestamp())).collect()]
    assert len(set(ids)) == 50 and all(len(i) == 36 and i[14] == "7" and i[19] in "89ab" for i in ids)


def test_export_and_import(spark):
    s = two_projects(spark)
    count = lambda df: [r.n for r in df.groupBy("section").agg(F.count("*").alias("n")).orderBy("section").collect()]
    assert count(exchange.export_lines(s)) == [2, 2, 1, 2, 1, 1, 1]
    assert count(exchange.export_lines(s, "alpha")) == [1, 2, 1, 1, 1, 1, 1]
    with pytest.raises(reading.NotFound):
        exchange.export_lines(s, "missing")
    texts = [r.line for r in exchange.export_lines(s).orderBy("section", "place").collect()]
    assert [json.loads(x)["type"] for x in texts][:3] == ["project", "project", "concept"]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(reversed(["", *texts]), 1)], "line_no long, line string")
    grown, summary = exchange.import_lines(Snapshot.empty(spark), lines, now())
    assert {(r.type, r.read, r.imported, r.skipped) for r in summary.collect()} == {("project", 2, 2, 0), ("concept", 2, 2, 0), ("source", 1, 1, 0), ("observation", 2, 2, 0), ("observation_concept", 1, 1, 0), ("project_concept", 1, 1, 0), ("observation_source", 1, 1, 0)}
    again, summary = exchange.import_lines(grown, lines, now())
    assert all((r.imported, r.skipped) == (0, r.read) for r in summary.collect())
    assert sorted(r.line for r in exchange.export_lines(again).collect()) == sorted(texts)


def test_import_rules(spark):
    s = two_projects(spark)
    new = [
        {"type": "project", "uuid": "other", "name": "alpha", "description": "ignored", "status": "odd"},
        {"type": "observation", "uuid": "oc", "project_uuid": "other", "kind": "odd", "body": "b"},
        {"type": "observation", "uuid": "od", "project_uuid": "nowhere", "kind": "note", "body": "b"},
        {"type": "observation_concept", "observation_uuid": "oc", "concept_uuid": "missing"},
        {"type": "mystery"},
    ]
    lines = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(new, 1)], "line_no long, line string")
    grown, summary = exchange.import_lines(s, lines, now())
    assert [(r.type, r.read, r.imported, r.skipped) for r in summary.orderBy("nth").collect()] == [("project", 1, 0, 1), ("observation", 2, 1, 1), ("observation_concept", 1, 0, 1), ("mystery", 1, 0, 0)]
    row = grown.observations.where("uuid = 'oc'").first()
    assert (row.project_id, row.kind) == (1, "note")
    with pytest.raises(exchange.Malformed, match="line 2"):
        exchange.import_lines(s, spark.createDataFrame([(1, "{}"), (2, '{"type":'), (3, "x")], "line_no long, line string"))


def test_writes(spark):
    s = two_projects(spark)
    batch = spark.createDataFrame([(1, "alpha", "new", "paused", "u1", "h"), (2, "gamma", "g", "active", "u2", "h"), (3, "gamma", "later", "active", "u3", "h")], "seq long, name string, description string, status string, uuid string, origin_host string")
    rows = {r.name: r for r in writing.upsert_projects(s, batch, now()).projects.collect()}
    assert (rows["alpha"].description, rows["alpha"].status, rows["alpha"].uuid, rows["alpha"].updated_at.year) == ("first", "active", "pa", 2030)
    assert (rows["gamma"].id, rows["gamma"].description) == (3, "g")
    with pytest.raises(writing.Refused):
        writing.upsert_projects(s, batch.withColumn("status", F.lit("odd")), now())
    with pytest.raises(writing.Refused):
        writing.set_status(s, batch.select("seq", F.lit("none").alias("name"), "status"), now())
    with pytest.raises(writing.Refused):
        writing.remove_sources(s, spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(writing.Refused):
        writing.link(s, "observation_concepts", spark.createDataFrame([(9, 1, 1)], "observation_id long, concept_id long, seq long"))
    again = writing.link(s, "observation_sources", spark.createDataFrame([(1, 1, "supports", 1), (2, 1, "x", 2), (2, 1, "y", 3)], "observation_id long, source_id long, relationship string, seq long"))
    assert sorted((r.observation_id, r.relationship) for r in again.observation_sources.collect()) == [(1, "cited"), (2, "x")]
    concepts = spark.createDataFrame([(1, "wal", "d1", "", "v2", "u", "h"), (2, "wal", "d2", "", "", "u", "h"), (3, "new", "d", "", "", "u9", "h")], "seq long, name string, description string, identifier_type string, identifier_value string, uuid string, origin_host string")
    rows = {r.name: r for r in writing.upsert_concepts(s, concepts, now()).concepts.collect()}
    assert (rows["wal"].description, rows["wal"].identifier_type, rows["wal"].identifier_value, rows["new"].id) == ("d2", "ror", "v2", 3)
    promoted = migrating.promote_dois(s, now(), F.md5("identifier_value"))
    assert promoted.sources.count() == 2 and promoted.observation_sources.count() == 2
    assert migrating.promote_dois(promoted, now(), F.md5("identifier_value")).sources.count() == 2
    legacy = spark.createDataFrame([(7, "old", "go", "url"), (8, "old", None, ""), (9, "alpha", None, "")], "id long, name string, language string, repo_url string")
    adopted = migrating.adopt_legacy(s, legacy, spark.createDataFrame([(7, 1), (8, 1)], "experiment_id long, concept_id long"), now(), F.md5("name"))
    assert [(r.name, r.description) for r in adopted.projects.where("id > 2").collect()] == [("old", "go — url")] and adopted.project_concepts.count() == 2


def test_sweep(spark):
    s = two_projects(spark)
    rows = [(i, "t", kind, value, "", "", "", "", "", done, "was" if done else "", T0, T0, f"s{i}", "h") for i, (kind, value, done) in enumerate([("url", "10.1/a", False), ("doi", "10.1/b", False), ("doi", "10.1/a", False), ("doi", "10.1/a2", True)], 1)]
    s = s.with_tables(sources=spark.createDataFrame(rows, SCHEMAS["sources"]))

    def check(doi):
        if doi == "10.1/b":
            raise OSError("no answer")
        return doi == "10.1/a", "bad data"

    swept, counts = retracting.sweep(s, retracting.notes_from_checker(reading.unretracted_dois(s), check), now())
    assert counts.collect() == [(2, 1)]
    assert [(r.id, r.retracted, r.retraction_note, r.last_checked_at.year) for r in swept.sources.orderBy("id").collect()] == [(1, False, "", 2024), (2, False, "", 2030), (3, True, "bad data", 2030), (4, True, "was", 2024)]


def test_reports(spark):
    s = two_projects(spark)
    assert reporting.summary(s) == "  [1] alpha  (active)\n      first\n      concepts: docker\n      [note] Docker café uses WAL mode\n\n  [2] beta  (paused)\n      [finding] nothing here\n\n"
    assert reporting.markdown(s, 9) == "" and reporting.markdown(s).startswith("# Notes\n\n## Project: alpha\n\nfirst\n\n**Concepts:** docker\n\n**[note]**")
    assert reporting.summary(Snapshot.empty(spark)) == reporting.NO_PROJECTS


def test_merge_against_sequential(spark):
    rng = random.Random(4)
    for _ in range(2):
        sides = []
        for _side in range(2):
            names, uuids = rng.sample("abcdefgh", 5), rng.sample("12345678", 5)
            sides.append([(i + 1, n, "", "active", T0, T0, u, "h") for i, (n, u) in enumerate(zip(names, uuids))])
        a, b = (Snapshot.empty(spark).with_tables(projects=spark.createDataFrame(r, SCHEMAS["projects"])) for r in sides)
        kept: list = []
        for row in [*sides[0], *sides[1]]:
            if not any(k[1] == row[1] or k[6] == row[6] for k in kept):
                kept.append(row)
        assert sorted((r.name, r.uuid) for r in merging.merge(a, b).projects.collect()) == sorted((k[1], k[6]) for k in kept)
    a, b = two_projects(spark), two_projects(spark)
    b = b.with_tables(projects=b.projects.withColumn("uuid", F.when(F.col("id") == 1, "pz").otherwise(F.col("uuid"))), observations=b.observations.withColumn("uuid", F.concat("uuid", F.lit("2"))))
    with pytest.raises(merging.Collisions):
        merging.merge_stores(a, b)
    assert merging.merge(a, b).observations.count() == 3  # the loser's observation goes with it
    merged, summary = merging.merge_stores(a, b, force=True)
    assert merged.observations.count() == 4
    assert [(r.tbl, r.from_a, r.from_b, r.merged) for r in summary.where("tbl IN ('projects', 'observations')").orderBy("nth").collect()] == [("projects", 2, 2, 2), ("observations", 2, 2, 4)]


QUERIES = ["glacier", "glacier storm", "glacier OR pollen", "glacier NOT storm pollen", "calib*", '"pollen sample"', "pollen + sample", "kind:finding glacier", "body:(glacier OR ice) AND kind:note", "NEAR(glacier storm, 3)", "^glacier", "cafe", "glacier glacier", "-kind:finding glacier", "{body kind}:finding", "NEAR(glacier storm, 0)", 'NEAR("pollen sample" ice glacier, 6)', "NEAR(ice ice, 2)", "한국", "йод", "がく", "ἄνθρωπος", "ΆΝΘΡΩΠΟΣ", "ЙОД OR がく", "日本*", "İce OR straße"]


def test_search_against_fts(spark):
    rng = random.Random(2)
    words = "glacier storm pollen sample ice calibration Café finding note 한국 йод がく ἄνθρωπος 日本語 straße".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(3, 12))), rng.choice(["note", "finding"])) for i in range(1, 80)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(body, kind)")
    db.executemany("INSERT INTO f(rowid, body, kind) VALUES (?, ?, ?)", docs)
    s = Snapshot.empty(spark).with_tables(observations=spark.createDataFrame([(i, None, k, b, T0, "", f"u{i}", "h") for i, b, k in docs], SCHEMAS["observations"]))
    held = search.indexed(search.documents(s)).cache()
    for text in QUERIES:
        wanted = {i: round(score, 6) for i, score in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (text,))}
        found = {r.source_id: r.score for r in search.search(s, text, 1000, held).collect()}
        assert found.keys() == wanted.keys(), text
        assert all(abs(found[i] - wanted[i]) < 2e-6 for i in wanted), text
    for text in ("", '"', "it's", "(a OR b) c", "wal-mode", "nope:x", "a AND"):
        with pytest.raises(search.BadQuery):
            search.parse(text)
