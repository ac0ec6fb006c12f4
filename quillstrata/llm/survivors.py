"""The best representative of each group of duplicate records, bundle by bundle.

Fields that depend on each other form a bundle and come from one record, whole.
Records are first reduced to the distinct values of each bundle with their best
donor, a minimum that combines on the map side, so a group of very many copies
shrinks before it is shuffled. Values that are only the beginning of another
value are found between neighbours in sorted order, not by comparing pairs.

Functional dependencies tie bundles: the record that gives one bundle may say
what another one must be (an identifier's record says of which type it is).
Each group first takes the best donor of every bundle, a minimum again. Where
that breaks no dependency no choice can be better, and the group is done. Only
the groups in conflict are searched, by branch and bound: bundles are fixed in
the order of their importance, best donor first; a branch ends when what it can
still reach does not beat the best choice found, or when it breaks a
dependency. Candidates are given to the search best first and so many at a
time; a group in which those do not prove the best choice is searched again
with more, until it is proven. So no group is collected as a whole, and none is
cut short.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.session import materialise

#: Candidates per bundle that a group is searched with at first, and by what more are taken.
FIRST_CANDIDATES = 4
MORE = 8
#: Values are neighbours in sorted order within groups of a common beginning of so many characters.
COMMON = 24

# Texts that stand for "no value".
NO_VALUE = r"(?i)^(?:n/?a|n\.a\.?|none|null|nil|nan|unknown|tbd|todo|\(?no description\)?|\(none\)|[-–—?._*/\s]*)$"

Rank = tuple[int, ...]  # smaller is better, compared from the left


def counts_as_value(text: Column) -> Column:
    """Neither null nor blank nor a text for "no value"."""
    return F.coalesce(~F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").rlike(NO_VALUE), F.lit(False))


def without_cut_mark(text: Column) -> Column:
    """Without surrounding blanks and the dots that mark a cut."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}]*(?:…|\.\.\.)$", "")


#: Of a bundle: the value that decides whether it counts, the form in which values are the same, and its fields by name.
Bundle = tuple[Column, Column, Mapping[str, Column]]


def distinct_values(rows: DataFrame, bundles: Mapping[str, Bundle], rank: Sequence[Column]) -> DataFrame:
    """Rows ``(grp, bundle, v, best)``: each distinct value of each bundle with its best donor.

    ``rows`` has ``grp`` and ``row_id``; ``rank`` is compared from the left,
    the row id last. best.fields has the bundle's fields as text, those named
    ``with.NAME`` being what its record says of another bundle.
    """
    ranks = [c.alias(f"r{i}") for i, c in enumerate(rank)]
    offers = F.array(
        *(
            F.when(
                counts_as_value(value),
                F.struct(F.lit(name).alias("bundle"), compared.alias("v"), F.create_map(*(x for n, c in fields.items() for x in (F.lit(n), c.cast("string")))).alias("fields")),
            )
            for name, (value, compared, fields) in bundles.items()
        )
    )
    order = F.struct(*ranks, F.col("row_id"))
    found = rows.select("grp", order.alias("order"), F.explode(offers).alias("o")).where("o.v <> ''")
    best = F.struct("order.*", F.col("o.fields").alias("fields"))
    return found.select("grp", "o.bundle", "o.v", "order", best.alias("best")).groupBy("grp", "bundle", "v").agg(F.min_by("best", "order").alias("best"))


def without_cut_off(values: DataFrame) -> DataFrame:
    """The values of ``(grp, bundle, v, best)`` that are not just the beginning of another one of their group.

    In sorted order a beginning stands right before what it is the beginning
    of. Sorting is done apart for each common beginning of COMMON characters;
    values shorter than that are held against the beginnings of the others by
    an equality join.
    """
    keys = ["grp", "bundle"]
    long = values.where(F.length("v") >= COMMON)
    order = Window.partitionBy(*keys, F.substring("v", 1, COMMON)).orderBy("v")
    kept = long.withColumn("next", F.lead("v").over(order)).where(~F.coalesce(F.col("next").startswith(F.col("v")), F.lit(False))).drop("next")
    short = values.where(F.length("v") < COMMON)
    groups = short.select(*keys).distinct()
    beginnings = (
        values.select(*keys, "v")
        .join(groups, keys, "left_semi")
        .select(*keys, F.explode(F.expr(f"transform(sequence(1, {COMMON - 1}), i -> CASE WHEN i < length(v) THEN substring(v, 1, i) END)")).alias("v"))
        .where("v IS NOT NULL")
        .distinct()
    )
    return kept.unionByName(short.join(beginnings, [*keys, "v"], "left_anti"))


def free_choice(candidates: DataFrame, order: Sequence[str], dependencies: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``(grp, chosen, conflict)``: the best donor of each bundle, and whether these together break a dependency.

    chosen has one field a bundle, null where the group has no candidate.
    """
    donor = F.col("best").dropFields("fields")
    picks = candidates.groupBy("grp").agg(*(F.min_by("best", F.when(F.col("bundle") == name, donor)).alias(name) for name in order))
    broken = [_breaks(F.col(giver), F.col(holder), holder) for giver, holder in dependencies]
    return picks.select("grp", F.struct(*order).alias("chosen"), reduce(lambda a, b: a | b, broken, F.lit(False)).alias("conflict"))


def _breaks(giver: Column, holder: Column, name: str) -> Column:
    said = F.try_element_at(giver["fields"], F.lit(f"with.{name}"))
    held = F.try_element_at(holder["fields"], F.lit("as"))
    return F.coalesce((said != "") & held.isNotNull() & (said != held), F.lit(False))


def best_bundles(candidates: DataFrame, order: Sequence[str], dependencies: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows ``(grp, bundle, row_id, fields)``: the chosen donor of each bundle of each group.

    ``candidates``: ``(grp, bundle, v, best)``; ``order``: the bundles, the
    most important first. ``dependencies``: pairs of bundles (x, y): if the
    record that gives x says what y is (its field ``with.y``), then the chosen
    y must be that (its field ``as``), or y stays empty. The choice leaves as
    few bundles empty as can be; then the more important bundle has the better
    donor.
    """
    ranks = [f.name for f in candidates.schema["best"].dataType.fields if f.name not in ("row_id", "fields")]
    free = free_choice(candidates, order, dependencies)
    kind = "struct<bundle:string,row_id:bigint,fields:map<string,string>>"
    schema = f"grp string, proven boolean, chosen array<{kind}>"

    def listed(rows: DataFrame) -> DataFrame:
        each = F.array_compact(F.array(*(F.when(F.col(f"chosen.{n}").isNotNull(), F.struct(F.lit(n).alias("bundle"), F.col(f"chosen.{n}.row_id").alias("row_id"), F.col(f"chosen.{n}.fields").alias("fields"))) for n in order)))
        return rows.select("grp", F.explode(each).alias("c")).select("grp", "c.*")

    if not dependencies:
        return listed(free)
    free = materialise(free, "free")
    out = listed(free.where("NOT conflict"))
    left, take = candidates.join(free.where("conflict").select("grp"), "grp", "left_semi"), FIRST_CANDIDATES
    by_rank = Window.partitionBy("grp", "bundle").orderBy(*(F.col(f"best.{r}") for r in ranks), "best.row_id")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for grp, members in zip(batch["grp"], batch["members"]):
                lists: dict[str, list[Candidate]] = {}
                more: dict[str, bool] = {}
                for m in members:
                    if m["nth"] > take:
                        more[m["bundle"]] = True
                        continue
                    b = m["best"]
                    lists.setdefault(m["bundle"], []).append((tuple(int(b[r]) for r in ranks), int(b["row_id"]), dict(b["fields"])))
                for donors in lists.values():
                    donors.sort(key=lambda c: c[:2])
                choice, proven = branch_and_bound(lists, more, order, dependencies)
                rows.append((grp, proven, [{"bundle": n, "row_id": c[1], "fields": c[2]} for n, c in choice.items()]))
            yield pd.DataFrame(rows, columns=["grp", "proven", "chosen"])

    while not left.isEmpty():
        # one beyond `take`, to know whether there are more; each partition keeps its own first ones before the shuffle
        ranked = left.withColumn("nth", F.row_number().over(by_rank)).where(F.col("nth") <= take + 1)
        members = ranked.groupBy("grp").agg(F.collect_list(F.struct("bundle", "nth", "best")).alias("members"))
        solved = materialise(members.mapInPandas(search, schema), "chosen")
        out = out.unionByName(solved.where("proven").select("grp", F.explode("chosen").alias("c")).select("grp", "c.*"))
        left = left.join(solved.where("NOT proven").select("grp"), "grp", "left_semi")
        take *= MORE
    return out


Candidate = tuple[Rank, int, dict]


def branch_and_bound(lists: Mapping[str, Sequence[Candidate]], more: Mapping[str, bool], order: Sequence[str], dependencies: Sequence[tuple[str, str]]) -> tuple[dict[str, Candidate], bool]:
    """The best choice that breaks no dependency, and whether no candidate beyond those given can beat it.

    lists: per bundle the candidates, best first. more: bundles that have
    others, each no better than the last given. A choice costs the number of
    bundles left empty, then the ranks of its donors in the order of the
    bundles.
    """
    names = [n for n in order if n in lists]
    width = max((len(c[0]) for cs in lists.values() for c in cs), default=0)
    nothing: Rank = ((1 << 62),) * (width + 1)

    def price(candidate: Candidate | None) -> tuple[int, Rank]:
        return (1, nothing) if candidate is None else (0, (*candidate[0], candidate[1]))

    # the least that the bundles from each on can cost
    rest = [tuple(price(lists[n][0])[1] for n in names[i:]) for i in range(len(names) + 1)]
    best_cost: tuple | None = None
    best: dict[str, Candidate] = {}

    def agrees(chosen: Mapping[str, Candidate], name: str, candidate: Candidate) -> bool:
        for x, y in dependencies:
            giver = candidate if x == name else chosen.get(x)
            holder = candidate if y == name else chosen.get(y)
            if name in (x, y) and giver is not None and holder is not None:
                said, held = giver[2].get(f"with.{y}"), holder[2].get("as")
                if said and held is not None and said != held:
                    return False
        return True

    def go(i: int, empty: int, cost: tuple[Rank, ...], chosen: dict[str, Candidate]) -> None:
        nonlocal best_cost, best
        if best_cost is not None and (empty, cost + rest[i]) >= best_cost:
            return
        if i == len(names):
            best_cost, best = (empty, cost), dict(chosen)
            return
        for candidate in lists[names[i]]:
            further = cost + (price(candidate)[1],)
            if best_cost is not None and (empty, further + rest[i + 1]) >= best_cost:
                break
            if agrees(chosen, names[i], candidate):
                chosen[names[i]] = candidate
                go(i + 1, empty, further, chosen)
                del chosen[names[i]]
        go(i + 1, empty + 1, cost + (nothing,), chosen)

    go(0, 0, (), {})
    # the least that any choice with an unseen candidate could cost
    proven = all(
        best_cost is not None and best_cost <= (0, tuple(price(lists[m][-1 if m == n else 0])[1] for m in names)) for n in names if more.get(n)
    )
    return best, proven


def survivors(rows: DataFrame, bundles: Mapping[str, Bundle], rank: Sequence[Column], dependencies: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows ``(grp, group_id, field, row_id, value)``: for each group of two or more rows and each bundle the surviving donor.

    ``rows`` has ``grp`` (null: in no group) and ``row_id``; ``bundles`` gives
    by name, the most important first, (value, compared form, fields); value in
    the result is the field ``value`` of the bundle. Defined cases: groups of
    one give nothing, nor do bundles in which no value counts, or which no
    donor can fill under the dependencies; null ranks go last (the caller says
    how); equal ranks go to the least row id; repeated rows with one id count
    once as donors; empty tables give no rows; other columns do not matter.
    """
    chosen = best_bundles(surviving_candidates(rows, bundles, rank), list(bundles), dependencies)
    grouped = rows.where("grp IS NOT NULL")
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("n"), F.min("row_id").alias("group_id")).where("n > 1")
    return chosen.join(sizes, "grp").select("grp", F.col("group_id").cast("long"), F.col("bundle").alias("field"), F.col("row_id").cast("long"), F.try_element_at("fields", F.lit("value")).alias("value"))


def surviving_candidates(rows: DataFrame, bundles: Mapping[str, Bundle], rank: Sequence[Column]) -> DataFrame:
    """Rows ``(grp, bundle, v, best)`` of the values that can survive; written, as what follows reads them several times."""
    # a group of very many copies has shrunk to its distinct values here
    held = materialise(distinct_values(rows.where("grp IS NOT NULL"), bundles, rank), "values")
    return materialise(without_cut_off(held), "candidates")
