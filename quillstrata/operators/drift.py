"""Schemas that drift between files: what changed, and one table from all of them.

Each file of a series is reduced to a schema tree: its fields (nested ones
below their parents), the JSON type of each, and a sketch of its values. The
sketch is a one-permutation min-hash: per bin the least hash of the values, a
minimum that combines on the map side, has a fixed size and sees every value.
Consecutive trees are compared by a tree edit distance in which siblings have
no order: at each level the nodes that keep their names are matched, and those
that vanish are assigned to those that appear at least total cost, where a
rename costs the share of values that do not go on, a change of type half a
node, and what stays unassigned is removed or added with all below it. A
subtree that vanishes under one parent and appears under another with the same
values is a move.

The scripts compile into one projection per file (name in the file to name in
the consistent table), applied to all its lines without exploding them.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.session import materialise

BINS = 128  # of a value sketch
#: Parts of a sketch that a worker holds before it hands them on; combining them again costs nothing but time.
HELD = 200_000
SAME_VALUES = 0.3  # least share of common values for a rename or a move
RETYPE_COST = 0.5

CHANGES = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("file_no", T.IntegerType()),
        T.StructField("change", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("depth", T.IntegerType()),
    ]
)

Node = tuple[str | None, dict[int, int]]  # type, sketch
Tree = dict[tuple[str, ...], Node]


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a name comes twice")
    return found


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


#: Reads as the JVM's parser does: repeated names, NaN and the infinities are no JSON.
_JSON = json.JSONDecoder(object_pairs_hook=_pairs, parse_constant=_no_constant)


def parsed_object(text: str | None) -> dict | None:
    """The JSON object a line holds, None for anything else."""
    if text is None:
        return None
    try:
        value = _JSON.decode(text.strip(" \t\r\n"))
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _kind(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", dict: "object", list: "array"}.get(type(value), "number")


def _hash(value: object) -> int:
    text = value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def fields_of(line: dict) -> Iterator[tuple[tuple[str, ...], object]]:
    """(path, value) of every field of a line, however deep."""
    waiting: list[tuple[tuple[str, ...], dict]] = [((), line)]
    while waiting:
        at, held = waiting.pop()
        for name, value in held.items():
            path = (*at, name)
            yield path, value
            if isinstance(value, dict):
                waiting.append((path, value))


_PARTS = "series string, file_no int, path array<string>, kind string, bin int, n long, least long"


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each file's fields with their types and the parts of their sketches, combined as far as a worker holds them; a row with path null for each file."""
    held: dict[tuple, list[int]] = {}
    seen: set[tuple] = set()

    def rows() -> pd.DataFrame:
        out = pd.DataFrame([(*f, None, None, None, 0, None) for f in seen] + [(s, f, list(p), k, b, n, least) for (s, f, p, k, b), (n, least) in held.items()], columns=[c.split()[0] for c in _PARTS.split(", ")])
        held.clear()
        seen.clear()
        return out.astype({"file_no": "Int32", "bin": "Int32", "n": "int64", "least": "Int64"})

    for batch in batches:
        for series, file_no, payload in zip(batch["series"], batch["file_no"], batch["payload"]):
            seen.add((series, file_no))
            for path, value in fields_of(parsed_object(payload) or {}):
                h = _hash(value)
                part = held.setdefault((series, file_no, path, _kind(value), h % BINS), [0, h])
                part[0] += 1
                part[1] = min(part[1], h)
        if len(held) >= HELD:
            yield rows()
    yield rows()


def schema_trees(lines: DataFrame) -> DataFrame:
    """Rows ``(series, file_no, nodes)`` from the lines ``(series, file_no, payload)``.

    nodes: array of (path, type, bins), null for a file without valid lines. A
    line that is no JSON object (broken, blank, null, another value) is not
    valid and says nothing. Lines are parsed once, and what a worker hands on
    are sketches.
    """
    parts = lines.select("series", F.col("file_no").cast("int").alias("file_no"), "payload").mapInPandas(_sketched, _PARTS)
    # spread by all keys first, as one file may hold a third of all lines; then the files' sketches of bounded size meet
    binned = parts.groupBy("series", "file_no", "path", "kind", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least")).repartition("series", "file_no")
    per_kind = binned.groupBy("series", "file_no", "path", "kind").agg(F.sum("n").alias("n"), F.collect_list(F.struct("bin", "least")).alias("bins"))
    # one type per field: the most frequent, then by name; nulls have none
    per_field = per_kind.groupBy("series", "file_no", "path").agg(
        F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("kind"),
        F.flatten(F.collect_list(F.when(F.col("kind").isNotNull(), F.col("bins")))).alias("bins"),
    )
    trees = per_field.groupBy("series", "file_no").agg(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "kind", "bins"))).alias("nodes"))
    return trees.select("series", "file_no", F.when(F.size("nodes") > 0, F.col("nodes")).alias("nodes"))


def schema_changes(trees: DataFrame) -> DataFrame:
    """Edit scripts from each file's tree to that of the next in its series: CHANGES.

    change is added, removed, renamed, moved or retyped; field is the name in
    the file before (in this file for added), with dots between levels;
    new_value the new name, place or type. The first file of a series has none.
    """
    order = Window.partitionBy("series").orderBy("file_no")
    pairs = trees.withColumn("nth", F.row_number().over(order)).withColumn("before", F.lag("nodes").over(order)).where("nth > 1").select("series", "file_no", "before", "nodes")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for series, file_no, before, after in zip(batch["series"], batch["file_no"], batch["before"], batch["nodes"]):
                for change, path, new in edit_script(_tree(before), _tree(after)):
                    out.append((series, int(file_no), change, ".".join(path), new, len(path)))
            yield pd.DataFrame(out, columns=CHANGES.names).astype({"file_no": "int32", "depth": "int32"})

    return pairs.mapInPandas(compare, CHANGES)


def _tree(nodes) -> Tree:
    out: Tree = {}
    for node in [] if nodes is None else nodes:
        least: dict[int, int] = {}
        for pair in node["bins"]:
            at, value = int(pair["bin"]), int(pair["least"])
            least[at] = min(value, least.get(at, value))
        out[tuple(node["path"])] = (node["kind"], least)
    return out


def resemblance(a: Mapping[int, int], b: Mapping[int, int]) -> float:
    """Estimated share of the values of both that both have; 0 if either has none."""
    if not a or not b:
        return 0.0
    return sum(1 for at, value in a.items() if b.get(at) == value) / len(a.keys() | b.keys())


def edit_script(before: Tree, after: Tree) -> list[tuple[str, tuple[str, ...], str]]:
    """The cheapest changes that turn one schema tree into the other: (change, path, new value)."""
    script: list[tuple[str, tuple[str, ...], str]] = []
    _compare(before, after, _Family(before), _Family(after), (), (), script)
    return sorted(_with_moves(before, after, script))


class _Family:
    """A tree's children by parent, and how many nodes stand below each, itself included."""

    def __init__(self, tree: Tree) -> None:
        self.children: dict[tuple[str, ...], list[tuple[str, ...]]] = defaultdict(list)
        self.size: dict[tuple[str, ...], int] = defaultdict(int)
        for path in sorted(tree):
            self.children[path[:-1]].append(path)
            for length in range(1, len(path) + 1):
                self.size[path[:length]] += 1


def _compare(before: Tree, after: Tree, olds: _Family, news: _Family, at_before: tuple[str, ...], at_after: tuple[str, ...], script: list) -> float:
    old = {p[-1]: p for p in olds.children[at_before]}
    new = {p[-1]: p for p in news.children[at_after]}
    gone = [p for name, p in old.items() if name not in new]
    come = [p for name, p in new.items() if name not in old]
    cost = 0.0
    matched = [(p, new[name]) for name, p in old.items() if name in new]
    if gone and come:
        no_pair = max(olds.size[p] for p in gone) + max(news.size[p] for p in come)
        costs = [[_rename_cost(before, after, olds, news, a, b) for b in come] for a in gone]
        for i, j in _assignment([[min(c, no_pair) for c in line] for line in costs]):
            if costs[i][j] < olds.size[gone[i]] + news.size[come[j]]:
                matched.append((gone[i], come[j]))
    taken_old, taken_new = {a for a, _ in matched}, {b for _, b in matched}
    for path in gone:
        if path not in taken_old:
            script.append(("removed", path, ""))
            cost += olds.size[path]
    for path in come:
        if path not in taken_new:
            script.append(("added", path, ""))
            cost += news.size[path]
    for a, b in matched:
        if a[-1] != b[-1]:
            script.append(("renamed", a, b[-1]))
            cost += 1 - resemblance(before[a][1], after[b][1])
        if before[a][0] and after[b][0] and before[a][0] != after[b][0]:
            script.append(("retyped", a, after[b][0]))
            cost += RETYPE_COST
        cost += _compare(before, after, olds, news, a, b, script)
    return cost


def _rename_cost(before: Tree, after: Tree, olds: _Family, news: _Family, a: tuple[str, ...], b: tuple[str, ...]) -> float:
    same = resemblance(before[a][1], after[b][1])
    if same < SAME_VALUES:
        return float("inf")
    unlike = 0.0 if _plain(a[-1]) == _plain(b[-1]) else 0.01  # between equal costs, the name that is nearer
    return 1 - same + unlike + (RETYPE_COST if before[a][0] != after[b][0] else 0) + _compare(before, after, olds, news, a, b, [])


def _plain(name: str) -> str:
    return re.sub(r"[^0-9a-z]", "", name.lower())


def _with_moves(before: Tree, after: Tree, script: list) -> list:
    """A removed and an added node on different levels or under different parents with the same values are one move."""
    removed = [p for change, p, _ in script if change == "removed"]
    added = [p for change, p, _ in script if change == "added"]
    pairs = sorted(((-resemblance(before[a][1], after[b][1]), a, b) for a in removed for b in added if a[:-1] != b[:-1]), key=lambda x: x)
    used: set = set()
    for likeness, a, b in pairs:
        if -likeness >= SAME_VALUES and ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            script = [s for s in script if not (s[0] == "removed" and s[1] == a or s[0] == "added" and s[1] == b)]
            script.append(("moved", a, ".".join(b)))
    return script


def _assignment(costs: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, one per row or column, whichever are fewer (shortest augmenting paths)."""
    flipped = len(costs) > len(costs[0])
    table = [list(line) for line in (zip(*costs) if flipped else costs)]
    width = len(table[0])
    holder = [-1] * width
    row_price, column_price = [0.0] * len(table), [0.0] * width
    for row in range(len(table)):
        distance = [float("inf")] * width
        reached_from = [-1] * width
        done = [False] * width
        at_row, at_column, low = row, -1, 0.0
        while True:
            for c in range(width):
                if not done[c]:
                    d = low + table[at_row][c] - row_price[at_row] - column_price[c]
                    if d < distance[c]:
                        distance[c], reached_from[c] = d, at_column
            at_column = min((c for c in range(width) if not done[c]), key=distance.__getitem__)
            low = distance[at_column]
            done[at_column] = True
            if holder[at_column] < 0:
                break
            at_row = holder[at_column]
        for c in range(width):
            if done[c]:
                change = low - distance[c]
                column_price[c] -= change
                if holder[c] >= 0:
                    row_price[holder[c]] += change
        row_price[row] += low
        while at_column >= 0:
            previous = reached_from[at_column]
            holder[at_column] = row if previous < 0 else holder[previous]
            at_column = previous
    pairs = [(r, c) for c, r in enumerate(holder) if r >= 0]
    return [(c, r) if flipped else (r, c) for r, c in pairs]


def projections(trees: DataFrame, changes: DataFrame, declared: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows ``(series, file_no, projection)``: the map from each file's top-level names to those of the consistent table.

    A field keeps, along the renames of its series, the declared name that any
    of its spellings fits (letter case and signs apart), else its first name.
    ``declared`` has the names by what a series' name begins with.
    """
    names = trees.select("series", "file_no", F.transform(F.filter("nodes", lambda n: F.size(n["path"]) == 1), lambda n: n["path"][0]).alias("fields"))
    renames = changes.where("change = 'renamed' AND depth = 1").groupBy("series", "file_no").agg(F.collect_list(F.struct("field", "new_value")).alias("renames"))
    # a series' files, each by its names only: a few hundred bytes a file
    whole = names.join(renames, ["series", "file_no"], "left").groupBy("series").agg(F.array_sort(F.collect_list(F.struct("file_no", "fields", "renames"))).alias("files"))
    schema = "series string, file_no int, projection map<string,string>"

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for series, files in zip(batch["series"], batch["files"]):
                fits = {_plain(n): n for prefix, ns in declared.items() if series.startswith(prefix) for n in ns}
                line_of: dict[str, int] = {}
                spellings: list[list[str]] = []
                per_file = []
                for file in files:
                    before = dict(line_of)
                    for pair in [] if file["renames"] is None else file["renames"]:
                        line_of.pop(pair["field"], None)
                    for pair in [] if file["renames"] is None else file["renames"]:
                        if pair["field"] in before:
                            line_of[pair["new_value"]] = before[pair["field"]]
                            spellings[before[pair["field"]]].append(pair["new_value"])
                    for field in [] if file["fields"] is None else file["fields"]:
                        if field not in line_of:
                            line_of[field] = len(spellings)
                            spellings.append([field])
                    per_file.append((int(file["file_no"]), {f: line_of[f] for f in ([] if file["fields"] is None else file["fields"])}))
                final = [next((fits[_plain(s)] for s in line if _plain(s) in fits), line[0]) for line in spellings]
                out += [(series, n, {f: final[i] for f, i in lines.items()}) for n, lines in per_file]
            yield pd.DataFrame(out, columns=["series", "file_no", "projection"]).astype({"file_no": "int32"})

    return whole.mapInPandas(chain, schema)


def consistent_rows(lines: DataFrame, compiled: DataFrame) -> DataFrame:
    """Every valid line as ``(rec_no, series, file_no, fields)`` with fields a map from consistent names to JSON texts.

    Where two names of a file lead to one column, the last in the line's order holds.
    """
    parsed = lines.select("rec_no", "series", F.col("file_no").cast("int").alias("file_no"), F.try_parse_json("payload").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    entries = F.map_entries(F.expr("try_variant_get(v, '$', 'map<string,variant>')"))
    joined = parsed.join(compiled, ["series", "file_no"], "left")
    named = F.transform(entries, lambda e: F.struct(F.coalesce(F.try_element_at("projection", e["key"]), e["key"]).alias("key"), F.to_json(e["value"]).alias("value")))
    merged = F.aggregate(
        named, F.expr("CAST(map() AS map<string,string>)"),
        lambda done, e: F.map_concat(F.map_filter(done, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))),
    )
    return joined.select("rec_no", "series", "file_no", merged.alias("fields"))


def drift(lines: DataFrame, declared: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Both results: the changes (CHANGES) and the consistent rows."""
    trees = materialise(schema_trees(lines), "trees")
    changes = schema_changes(trees)
    return changes, consistent_rows(lines, projections(trees, changes, declared))
