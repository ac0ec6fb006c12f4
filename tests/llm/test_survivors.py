import itertools
import random

from pyspark.sql import functions as F

from quillstrata.llm import survivors as s
from quillstrata.llm.components import components


def test_components_against_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randint(1, 120), rng.randint(1, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(500, 500), (7, 7)] + [(1000, i) for i in range(1001, 1200)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {x: find(x) for x in parent}
    assert components(df.limit(0)).count() == 0


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "grp string, row_id long, text string, trust long, bundle string")


def chosen(spark, rows):
    bundles = {"text": (F.col("text"), s.without_cut_mark(F.col("text")), {"value": F.col("text")})}
    return sorted((r.group_id, r.row_id) for r in s.survivors(frame(spark, rows), bundles, [F.col("trust")]).collect())


def test_rules(spark):
    long = "The glacier model shifts the northern transect over the winter."
    rows = [
        ("a", 1, "The glacier model shifts the nor …", 1), ("a", 2, long, 2), ("a", 3, long, 2), ("a", 4, "n/a", 1), ("a", 5, None, 1), ("a", 6, " ", 1), ("a", 7, "The", 1),
        ("b", 10, "x", 1), ("c", 11, "TBD", 1), ("c", 12, "", 1), (None, 13, "x", 1), (None, 14, "x", 1),
        ("d", 20, "alone …", 3), ("d", 21, "other", 4), ("e", 30, "same", 1), ("e", 31, "same", 1),
    ]
    assert chosen(spark, rows) == [(1, 2), (20, 20), (30, 30)]
    assert chosen(spark, []) == []


def test_cut_off_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 40))) for _ in range(120)]
    words += [w[: rng.randint(1, len(w))] for w in words]
    rows = [(rng.choice("xyz"), i, w, rng.randint(1, 3)) for i, w in enumerate(words, 1)]
    values = s.distinct_values(frame(spark, rows).drop("bundle"), {"text": (F.col("text"), F.col("text"), {"value": F.col("text")})}, [F.col("trust")])
    found = {(r.grp, r.v) for r in s.without_cut_off(values).collect()}
    held = {(g, w) for g, _, w, _ in rows}
    assert found == {(g, w) for g, w in held if not any(h == g and v != w and v.startswith(w) for h, v in held)}


def test_branch_and_bound():
    rng = random.Random(9)
    branched = 0
    for _ in range(300):
        order = ["a", "b", "c"]
        lists = {
            n: sorted(((rng.randint(1, 3),), i, {"as": rng.choice("pq"), **{f"with.{m}": rng.choice(["p", "q", ""]) for m in "abc"}}) for i in range(rng.randint(1, 4)))
            for n in rng.sample(order, rng.randint(1, 3))
        }
        dependencies = [("a", "b"), ("c", "b"), ("b", "a")]

        def allowed(pick):
            return all(not (x in pick and y in pick and pick[x][2][f"with.{y}"]) or pick[x][2][f"with.{y}"] == pick[y][2]["as"] for x, y in dependencies)

        names = [n for n in order if n in lists]
        picks = [{n: c for n, c in zip(names, p) if c} for p in itertools.product(*([*lists[n], None] for n in names))]
        cost = lambda pick: (len(names) - len(pick), [(*pick[n][0], pick[n][1]) if n in pick else (9e99, 9e99) for n in names])
        least = min(map(cost, filter(allowed, picks)))
        best, proven = s.branch_and_bound(lists, {}, order, dependencies)
        assert proven and allowed(best) and cost(best) == least
        branched += best != {n: lists[n][0] for n in names}
    assert branched > 50


def test_search_goes_on_until_proven(spark):
    """The records that agree come after the first candidates; another group is not in conflict."""
    rows = [("g", n, f"{n}{i}", {"r0": i, "row_id": i, "fields": {"as": "good" if i == 9 else f"{n}{i}", "with.b": "good"}}) for n in "ab" for i in range(1, 12)]
    rows += [("free", n, f"{n}1", {"r0": 1, "row_id": 1, "fields": {"as": "x", "with.b": "x"}}) for n in "ab"]
    df = spark.createDataFrame(rows, "grp string, bundle string, v string, best struct<r0:bigint,row_id:bigint,fields:map<string,string>>")
    found = {(r.grp, r.bundle): r.row_id for r in s.best_bundles(df, ["a", "b"], [("a", "b")]).collect()}
    assert found == {("g", "a"): 1, ("g", "b"): 9, ("free", "a"): 1, ("free", "b"): 1}
    assert {r.grp: r.conflict for r in s.free_choice(df, ["a", "b"], [("a", "b")]).collect()} == {"g": True, "free": False}
    free = {(r.grp, r.bundle): r.row_id for r in s.best_bundles(df, ["a", "b"]).collect()}
    assert free[("g", "b")] == 1  # without the dependency another row survives


def test_type_follows_value(spark):
    """The most trusted record has a type but no value; the value's record says of which type it is."""
    rows = [("g", 1, "doi", "n/a", 1), ("g", 2, "orcid", "0000-1", 2), ("g", 3, "doi", "10.1/x", 3), ("h", 4, "doi", "10.1/y", 1), ("h", 5, "", "10.1/y", 2), ("lone", 6, "doi", "z", 1)]
    df = spark.createDataFrame(rows, "grp string, row_id long, kind string, id string, trust long")
    said = F.when(s.counts_as_value(F.col("kind")), F.col("kind"))
    bundles = {"id": (F.col("id"), F.col("id"), {"value": F.col("id"), "with.kind": said}), "kind": (F.col("kind"), F.concat(said, F.lit("|")), {"value": F.col("kind"), "as": said})}
    rows_of = lambda dependencies: sorted((r.grp, r.field, r.row_id, r.value) for r in s.survivors(df, bundles, [F.col("trust")], dependencies).collect())
    assert rows_of([("id", "kind")]) == [("g", "id", 2, "0000-1"), ("g", "kind", 2, "orcid"), ("h", "id", 4, "10.1/y"), ("h", "kind", 4, "doi")]
    assert ("g", "kind", 1, "doi") in rows_of([])
