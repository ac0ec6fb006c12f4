"""Mixed ways of writing time, brought to one form by the cheapest path of readings.

Every text gets the array of all its valid readings, once. Over the records of
a source, in their order, the readings form a trellis; a path pays for readings
against the source's declarations, for each change of the way of writing and
for each step back in time. The cheapest path (Viterbi) says what is meant.

Another reading of one record changes what its neighbours' steps cost by
AT_STAKE at most; a reading that costs more than that beyond the record's best
one is on no cheapest path and left out. Sources in which every record then has
one reading have one path, and need no order. The others are laid out:

A source may hold a third of all rows, so its path is not found in one task.
Rows are laid out by (source, order) over range partitions and written once.
In a first pass each partition reduces its stretch of a source to a small
matrix: the least cost from each reading of the stretch's first row to each
reading of its last. Only a partition's first and last source can go on in
another one, so the driver chains two matrices a partition at most, whatever
the number of rows and sources. That fixes the readings at all partition
borders, and a second pass finds the path within each partition. A row with one
reading is an anchor: the path before it is settled there, so what a task keeps
is the stretch since the last anchor.

Ties go to the reading listed first, the declared one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.functions.instants import Reading
from quillstrata.session import materialise, shared_folder

SWITCH = 1  # cost of another way of writing than the record before
BACKWARD = 1  # cost of a time before that of the record before
AT_STAKE = 2 * (SWITCH + BACKWARD)  # of the steps to a record and from it

#: Clock and order of day and month of sources that declare none.
UNDECLARED = ("UTC", "dmy")

Reader = Callable[[str | None, str, str], list[Reading]]
Brief = tuple[str, int, int]  # style, value, cost

READINGS = "tbl string, source string, seq long, row_id long, exact boolean, styles array<string>, times array<long>, costs array<int>, norms array<string>"


def _step(before: Brief, now: Brief) -> int:
    return now[2] + (SWITCH if before[0] != now[0] else 0) + (BACKWARD if now[1] < before[1] else 0)


def undominated(readings: list[Reading]) -> list[Reading]:
    """Those that can be on a cheapest path."""
    if len(readings) < 2:
        return readings
    least = min(r[2] for r in readings)
    return [r for r in readings if r[2] - least <= AT_STAKE]


def all_readings(
    df: DataFrame,
    group: Column,
    source: Column,
    order: Column,
    row_id: Column,
    text: Column,
    conventions: DataFrame | None,
    readers: Mapping[str, tuple[Reader, Callable[[str], bool]]],
) -> DataFrame:
    """Rows READINGS of the texts that have any, written once; the arguments are those of ``chosen_readings``."""
    rows = df.select(
        group.alias("tbl"), F.coalesce(source, F.lit("")).alias("source"), order.cast("long").alias("seq"), row_id.cast("long").alias("row_id"), text.cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    if conventions is None:
        rows = rows.withColumns({"zone": F.lit(UNDECLARED[0]), "date_order": F.lit(UNDECLARED[1])})
    else:
        declared = conventions.where("source IS NOT NULL").groupBy("source").agg(F.min(F.struct("zone", "date_order")).alias("d"))
        rows = rows.join(declared, "source", "left").select(
            "tbl", "source", "seq", "row_id", "text", F.coalesce("d.zone", F.lit(UNDECLARED[0])).alias("zone"), F.coalesce("d.date_order", F.lit(UNDECLARED[1])).alias("date_order")
        )
    rows = rows.select("tbl", "source", "seq", "row_id", "text", "zone", "date_order")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, exact, parts = [], [], ([], [], [], [])
            texts, zones, orders, groups = (batch.column(i).to_pylist() for i in (4, 5, 6, 0))
            for i, (value, zone, date_order, tbl) in enumerate(zip(texts, zones, orders, groups)):
                reader, is_exact = readers[tbl]
                if found := undominated(reader(value, zone, date_order)):
                    kept.append(i)
                    exact.append(is_exact(value))
                    for part, values in zip(parts, zip(*found)):
                        part.append(values)
            at = pa.array(kept, pa.int64())
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(at) for i in range(4)), pa.array(exact, pa.bool_()), *(pa.array(p, pa.list_(k)) for p, k in zip(parts, kinds))],
                names=[f.split()[0] for f in READINGS.split(", ")],
            )

    return materialise(rows.mapInArrow(read, READINGS), "readings")


def chosen_readings(
    df: DataFrame,
    group: Column,
    source: Column,
    order: Column,
    row_id: Column,
    text: Column,
    conventions: DataFrame | None,
    readers: Mapping[str, tuple[Reader, Callable[[str], bool]]],
) -> DataFrame:
    """Rows ``(tbl, row_id, norm)`` for each text that denotes a time and is not in normal form already.

    ``group`` names which of ``readers`` applies; sources of different groups
    are apart. A reader gives the readings of a text, its companion says
    whether the text needs none. ``conventions(source, zone, date_order)``
    gives the clock and the order of day and month of each source.

    Defined cases: null, blank and unusable texts have no reading, give no row
    and do not part the records around them; sources without declaration keep
    UTC and day-month-year; null sources count as ''; equal order values are
    taken by row id; repeated rows are each given; an empty table gives none.
    """
    parsed = all_readings(df, group, source, order, row_id, text, conventions, readers)
    contested = parsed.where(F.size("times") > 1).select("tbl", "source").distinct()
    if contested.isEmpty():
        return _single(parsed)
    return _single(parsed.join(contested, ["tbl", "source"], "left_anti")).unionByName(_by_path(parsed.join(contested, ["tbl", "source"], "left_semi")))


def _single(parsed: DataFrame) -> DataFrame:
    return parsed.where("NOT exact").select("tbl", "row_id", F.col("norms")[0].alias("norm"))


def _by_path(parsed: DataFrame) -> DataFrame:
    shared_folder(parsed.sparkSession)
    # reliable, keeps partitions and their order, and fixes the sampled borders for both passes
    laid = parsed.select(*(f.split()[0] for f in READINGS.split(", "))).repartitionByRange("tbl", "source", "seq", "row_id").sortWithinPartitions("tbl", "source", "seq", "row_id").checkpoint()
    borders = _borders(laid)
    schema = T.StructType([T.StructField("tbl", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("norm", T.StringType())])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition = TaskContext.get().partitionId()
        track: _Track | None = None
        for batch in batches:
            out: list[tuple[str, int, str]] = []
            for tbl, source, row, exact, *parts in zip(*(batch[c] for c in ("tbl", "source", "row_id", "exact", "styles", "times", "costs", "norms"))):
                if track is None or track.stream != (tbl, source):
                    if track is not None:
                        track.close(out)
                    track = _Track((tbl, source), borders.get((partition, tbl, source)))
                track.add(row, exact, list(zip(*parts)), out)
            yield pd.DataFrame(out, columns=["tbl", "row_id", "norm"]).astype({"row_id": "int64"})
        if track is not None:
            out = []
            track.close(out)
            yield pd.DataFrame(out, columns=["tbl", "row_id", "norm"]).astype({"row_id": "int64"})

    return laid.mapInPandas(decode, schema)


class _Track:
    """The path through one source's stretch within one partition."""

    def __init__(self, stream: tuple[str, str], border: tuple[list[Brief], list[int], int] | None) -> None:
        self.stream = stream
        self.before, self.costs, self.last = border if border else ([], [], None)
        self.open: list[tuple[int, bool, list[Reading], list[int]]] = []

    def add(self, row: int, exact: bool, readings: list[Reading], out: list) -> None:
        costs, back = [], []
        for now in readings:
            if not self.before:
                costs.append(now[2])
                back.append(0)
                continue
            steps = [c + _step(b, now[:3]) for b, c in zip(self.before, self.costs)]
            least = min(range(len(steps)), key=steps.__getitem__)
            costs.append(steps[least])
            back.append(least)
        self.open.append((row, exact, readings, back))
        self.before, self.costs = [r[:3] for r in readings], costs
        if len(readings) == 1:
            self._settle(0, out)
            self.costs = [0]

    def _settle(self, at: int, out: list) -> None:
        settled = []
        for row, exact, readings, back in reversed(self.open):
            if not exact:
                settled.append((self.stream[0], row, readings[at][3]))
            at = back[at]
        out.extend(reversed(settled))
        self.open = []

    def close(self, out: list) -> None:
        if self.open:
            # without a border the source ends in this partition
            self._settle(min(range(len(self.costs)), key=self.costs.__getitem__) if self.last is None else self.last, out)


def _borders(laid: DataFrame) -> dict[tuple[int, str, str], tuple[list[Brief], list[int], int]]:
    """For each partition and its first and last source: the readings before it, what it cost to get to each, and the reading to end with."""
    schema = "partition int, tbl string, source string, body string"

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition = TaskContext.get().partitionId()
        out: list[tuple[int, str, str, str]] = []
        stream, first, before, costs = None, [], [], []

        def flush() -> None:
            if stream is not None and first:
                del out[1:]  # only a partition's first and last source can go on in another
                out.append((partition, *stream, json.dumps([first, before, costs])))

        for batch in batches:
            for tbl, source, *parts in zip(*(batch[c] for c in ("tbl", "source", "styles", "times", "costs"))):
                if stream != (tbl, source):
                    flush()
                    stream, first = (tbl, source), []
                readings = [(style, int(time), int(cost)) for style, time, cost in zip(*parts)]
                if not first:
                    first, before = readings, readings
                    costs = [[0 if i == j else None for j in range(len(readings))] for i in range(len(readings))]
                    continue
                costs = [
                    [min((c + _step(b, now) for b, c in zip(before, line) if c is not None), default=None) for now in readings]
                    for line in costs
                ]
                before = readings
        flush()
        yield pd.DataFrame(out, columns=["partition", "tbl", "source", "body"])

    found = sorted(laid.mapInPandas(summarise, schema).collect(), key=lambda r: (r.tbl, r.source, r.partition))
    borders: dict = {}
    at = 0
    while at < len(found):
        end = at
        while end < len(found) and (found[end].tbl, found[end].source) == (found[at].tbl, found[at].source):
            end += 1
        borders |= _chain(found[at:end])
        at = end
    return borders


def _chain(pieces) -> dict:
    """Forward over the pieces of one source, then back to fix the reading each one ends with."""
    entries: list[tuple[list[Brief], list[int]]] = []
    backs: list[list[int]] = []  # per piece and last reading: the last reading of the piece before
    before: list[Brief] = []
    costs: list[int] = []
    for piece in pieces:
        first, last, matrix = json.loads(piece.body)
        entries.append((before, costs))
        enter, came = [], []
        for now in first:
            steps = [c + _step(tuple(b), tuple(now)) for b, c in zip(before, costs)] or [now[2]]
            least = min(range(len(steps)), key=steps.__getitem__)
            enter.append(steps[least])
            came.append(least)
        reached, back = [], []
        for j in range(len(last)):
            ways = [(enter[i] + matrix[i][j], i) for i in range(len(first)) if matrix[i][j] is not None]
            cost, i = min(ways)
            reached.append(cost)
            back.append(came[i])
        backs.append(back)
        before, costs = [tuple(b) for b in last], reached
    out = {}
    end = min(range(len(costs)), key=costs.__getitem__) if costs else 0
    for piece, (entry, entry_costs), back in zip(reversed(pieces), reversed(entries), reversed(backs)):
        out[(piece.partition, piece.tbl, piece.source)] = (entry, entry_costs, end)
        end = back[end]
    return out
