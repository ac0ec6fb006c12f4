import itertools
import json
import random

from quillstrata.operators import drift as d


def test_assignment_is_least():
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        costs = [[rng.randint(0, 9) + rng.random() for _ in range(m)] for _ in range(n)]
        pairs = d._assignment(costs)
        short, long = (n, m) if n <= m else (m, n)
        least = min(sum(costs[i][j] if n <= m else costs[j][i] for i, j in enumerate(p)) for p in itertools.permutations(range(long), short))
        assert len(pairs) == short and abs(sum(costs[i][j] for i, j in pairs) - least) < 1e-9


def test_script():
    values = {i: i * 7 for i in range(50)}
    other = {i: i * 7 + 1 for i in range(50)}
    before = {("a",): ("string", values), ("b",): ("string", other), ("o",): ("object", {1: 1}), ("o", "k"): ("string", {2: 2, 3: 3})}
    after = {("A",): ("string", values), ("b",): ("number", other), ("k",): ("string", {2: 2, 3: 3}), ("o",): ("object", {1: 1}), ("c",): (None, {})}
    assert d.edit_script(before, after) == [("added", ("c",), ""), ("moved", ("o", "k"), "k"), ("renamed", ("a",), "A"), ("retyped", ("b",), "number")]
    assert d.edit_script(before, before) == [] and d.edit_script({}, {}) == []


def test_lines():
    assert [d.parsed_object(x) for x in (None, "", " ", "[1]", "null", "{", '{"a": 1, "a": 2}', '{"a": NaN}', "[" * 100_000)] == [None] * 9
    deep = d.parsed_object(' {"a": {"b": {"c": {"d": {"e": [1]}}}}, "f": null} ')
    assert sorted(p for p, _ in d.fields_of(deep)) == [("a",), ("a", "b"), ("a", "b", "c"), ("a", "b", "c", "d"), ("a", "b", "c", "d", "e"), ("f",)]


def test_deep_changes_and_plan(spark):
    def line(leaf):
        return json.dumps({"a": {"b": {"c": {"d": {"e": leaf}}}}})

    df = spark.createDataFrame([("s", n, line(f"x{i}" if n == 1 else i)) for n in (1, 2) for i in range(20)], "series string, file_no int, payload string")
    changes = d.schema_changes(d.schema_trees(df))
    assert [(r.change, r.field, r.new_value, r.depth) for r in changes.collect()] == [("retyped", "a.b.c.d.e", "number", 5)]
    plan = d.schema_changes(d.schema_trees(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2 and plan.count("Exchange ") <= 6


def test_files(spark):
    def lines(n, make):
        return [("projects-x", n, 100 * n + i, json.dumps(make(i))) for i in range(20)]

    rows = lines(1, lambda i: {"uuid": f"u{i}", "created": f"t{i}", "tag": None}) + lines(2, lambda i: {"uuid": i, "created_at": f"t{i}", "tag": None}) + lines(3, lambda i: {"uuid": i, "CreatedAt": f"t{i}", "extra": {"a": i}})
    rows += [("projects-x", 2, 1, '{"broken": '), ("projects-x", 2, 2, ""), ("projects-x", 2, 3, None), ("projects-x", 2, 4, "[1]"), ("projects-x", 4, 5, "no line is valid"), ("lone", 1, 6, "{}")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "series string, file_no int, rec_no long, payload string, nodes string")
    changes, table = d.drift(df, {"projects": ("uuid", "created_at")})
    found = sorted((r.file_no, r.change, r.field, r.new_value) for r in changes.where("depth = 1").collect())
    assert found == [
        (2, "renamed", "created", "created_at"), (2, "retyped", "uuid", "number"),
        (3, "added", "extra", ""), (3, "removed", "tag", ""), (3, "renamed", "created_at", "CreatedAt"),
        (4, "removed", "CreatedAt", ""), (4, "removed", "extra", ""), (4, "removed", "uuid", ""),
    ]
    fields = {r.rec_no: r.fields for r in table.collect()}
    assert len(fields) == 61 and fields[6] == {}
    assert all(json.loads(fields[100 * n + 3]["created_at"]) == "t3" for n in (1, 2, 3))
    changes, table = d.drift(df.limit(0), {})
    assert changes.count() == 0 and table.count() == 0
