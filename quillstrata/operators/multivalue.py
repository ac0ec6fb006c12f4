"""Several values packed in one field: one row per value, with its place.

The packed texts are never touched one by one. A batch's Arrow string buffer is
read as one byte array; masks over all its bytes say what is quoted (parity of
the quotes counted from the start of each text), what lies in braces and where
delimiters stand. From these the child offsets follow, and the values come out
as an Arrow list array, which is flattened with the ordinals of its parents.

How a text is packed shows in itself:

* Enclosed values (quotes, braces, a JSON array): what is outside separates.
* ``;``, ``|``, tabs, line ends, bullets, ``(1)`` numbers and the words ``and``,
  ``und``, ``et``, ``och``, ``&`` separate wherever they are not enclosed; a joining word that
  belongs to a body's name (``Institute for Tides and Ice``) does not.
* A comma separates unless it stands between a family and a given name, which
  it does if all values at odd places in its stretch are single words (particles
  apart) and their number is even: ``Foso, D.S., Banu, F.`` is two persons,
  ``Togu S, Banu F`` two as well, ``Vihisa, Gaze Pone`` one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Delimiters of one byte, delimiters of several, joining words, what precedes the joining word
# within a body's name, remarks that no more are named, and texts for "no value".
STRONG = b";|\n\r\t"
STRONG_WIDE = ("；", "·", "•", "、", " / ")
WIDE_COMMA = "，"
JOINING = (" and ", " und ", " et ", " och ", " & ")
WITHIN_BODIES = (" of ", " for ", " on ", " für ")
REMARK = r"^\(?(?:and |und |& |with )?(?:et\.? al(?:ii|iae|ia)?|and others|others|und andere|u\. ?a|and \d+ (?:more|others)|\d+ (?:more|others)|etc)\.?\)?$|^(?:\.\.\.|…)$"
NO_VALUE = r"^(?:n/?a|n\.a\.?|none|null|nil|nan|unknown|tbd|todo|\(none\)|\(unknown\)|no authors?|not available|[-–—?._*/\s]*)$"


def _places(data: np.ndarray, row: np.ndarray, text: str) -> np.ndarray:
    """Mask of the bytes at which ``text`` begins; it lies within one row."""
    raw = text.encode()
    if len(data) < len(raw):
        return np.zeros(len(data), bool)
    hit = np.zeros(len(data), bool)
    inner = np.ones(len(data) - len(raw) + 1, bool)
    for i, byte in enumerate(raw):
        inner &= data[i : len(data) - len(raw) + 1 + i] == byte
    hit[: len(inner)] = inner & (row[: len(inner)] == row[len(raw) - 1 :])
    return hit


def _spread(starts: np.ndarray, length: int) -> np.ndarray:
    """Mask of all bytes of the occurrences that begin at ``starts``."""
    out = starts.copy()
    for i in range(1, length):
        out[i:] |= starts[:-i]
    return out


def _runs(cut: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each stretch without a cut byte; a stretch stays within its row."""
    n = len(cut)
    open_ = ~cut
    first = np.ones(n, bool)
    first[1:] = cut[:-1] | (row[1:] != row[:-1])
    last = np.ones(n, bool)
    last[:-1] = cut[1:] | (row[1:] != row[:-1])
    return np.flatnonzero(open_ & first), np.flatnonzero(open_ & last) + 1


def _last_before(mask: np.ndarray) -> np.ndarray:
    """For each byte the last place before it at which ``mask`` holds, -1 if none."""
    at = np.where(mask, np.arange(len(mask)), -1)
    seen = np.maximum.accumulate(at) if len(at) else at
    return np.concatenate([[-1], seen[:-1]]) if len(at) else seen


def split_packed(texts: pa.Array) -> pa.ListArray:
    """Lists of the values of each text; null, blank and "no value" texts give empty lists."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), WIDE_COMMA, ",")
    n = len(texts)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    total = int(offsets[-1] - offsets[0])
    if not total:
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    data = np.frombuffer(data_buffer, np.uint8, total, int(offsets[0]))
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    begin = offsets[:-1][row]  # of the byte's row
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=n)

    # what is quoted, what is in braces; texts in which these do not close are taken as they stand
    escaped = np.concatenate([[False], data[:-1] == 92])
    quote = (data == 34) & ~escaped
    closing = per_row(quote) % 2 == 0
    count = np.cumsum(quote)
    before = np.concatenate([[0], count])[begin]
    quoted = ((count - before) % 2 == 1) & closing[row]
    step = (data == 123).astype(np.int64) - (data == 125)
    step[quoted] = 0
    depth = np.cumsum(step)
    depth_before = np.concatenate([[0], depth])[begin]
    balanced = np.bincount(row, weights=step, minlength=n) == 0
    braced = ((depth - depth_before > 0) | (data == 125)) & balanced[row]
    free = ~quoted & ~braced

    blank = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    solid = np.flatnonzero(~blank)
    first_solid, last_solid = np.full(n, -1), np.full(n, -1)
    if len(solid):
        last_solid[row[solid]] = solid
        first_solid[row[solid[::-1]]] = solid[::-1]
    has = first_solid >= 0
    array = np.zeros(n, bool)
    array[has] = (data[first_solid[has]] == 91) & (data[last_solid[has]] == 93)
    cut = np.zeros(total, bool)
    cut[first_solid[array]] = True
    cut[last_solid[array]] = True
    enclosing = array | (per_row(quote) > 0) & closing | (per_row(data == 123) > 0) & balanced

    strong = free & np.isin(data, np.frombuffer(STRONG, np.uint8))
    for text in STRONG_WIDE:
        strong |= _spread(_places(data, row, text) & free, len(text.encode()))
    digit = (data >= 48) & (data <= 57)
    strong |= _numbers_in_parentheses(data, row, digit) & free
    remark = _places(lower, row, " et al") & free
    strong |= _spread(remark & _ends_word(data, row, len(" et al")), len(" et al"))
    comma = (data == 44) & free
    cut |= strong | comma & enclosing[row]

    joining = np.zeros(total, bool)
    for text in JOINING:
        joining |= _places(lower, row, text) & free & ~strong
    inside = np.zeros(total, bool)
    for text in WITHIN_BODIES:
        inside |= _places(lower, row, text) & free
    row_start = np.zeros(total, bool)
    row_start[offsets[:-1][lengths > 0]] = True
    barrier = np.maximum(_last_before(cut | comma | row_start), _last_before(joining))
    own = joining & (_last_before(inside) > barrier)  # part of a body's name
    separating = joining & ~own
    for text in JOINING:
        cut |= _spread(_places(lower, row, text) & separating, len(text))

    cut |= _commas_between_values(data, row, cut, comma & ~enclosing[row], blank)
    starts, ends = _runs(cut, row)
    if not len(starts):
        return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()))
    child_offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    children = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(child_offsets), pa.py_buffer(data[~cut].tobytes())])
    parents = row[starts]
    values = _cleaned(children, array[parents])
    keep = pc.and_(
        pc.not_equal(values, ""),
        pc.invert(pc.or_(pc.match_substring_regex(values, NO_VALUE, ignore_case=True), pc.match_substring_regex(values, REMARK, ignore_case=True))),
    )
    kept = np.asarray(keep)
    counts = np.bincount(parents[kept], minlength=n)
    list_offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(list_offsets), values.filter(keep))


def _numbers_in_parentheses(data: np.ndarray, row: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Mask of the bytes of (1), (12), … of any length."""
    out = np.zeros(len(data), bool)
    starts, ends = _runs(~digit, row)
    if len(starts):
        inner = (starts > 0) & (ends < len(data))
        starts, ends = starts[inner], ends[inner]
        whole = (data[starts - 1] == 40) & (data[ends] == 41) & (row[starts - 1] == row[starts]) & (row[ends] == row[starts])
        edges = np.zeros(len(data) + 1, np.int64)
        edges[starts[whole] - 1] += 1
        edges[ends[whole] + 1] -= 1
        out = np.cumsum(edges)[:-1] > 0
    return out


def _ends_word(data: np.ndarray, row: np.ndarray, length: int) -> np.ndarray:
    """At each byte: the text ``length`` further on has no letter next."""
    total = len(data)
    out = np.ones(total, bool)
    if total > length:
        after = data[length:]
        letter = (after >= 97) & (after <= 122) | (after >= 65) & (after <= 90) | (after >= 128)
        out[: total - length] = ~(letter & (row[length:] == row[:-length]))
    return out


def _commas_between_values(data: np.ndarray, row: np.ndarray, cut: np.ndarray, comma: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Mask of the commas that separate values, not the parts of an inverted name."""
    out = np.zeros(len(data), bool)
    if not comma.any():
        return out
    stretch_first, _ = _runs(cut, row)
    seg_first, seg_end = _runs(cut | comma, row)
    # words of each segment that carry a name: those that don't begin with a small letter (particles do), and those
    # in which something else follows a hyphen or an apostrophe (al-Nude, d'Arelo)
    solid = ~(blank | cut | comma)
    small = (data >= 97) & (data <= 122)
    previous_open = np.zeros(len(data), bool)
    previous_open[1:] = solid[:-1] & (row[1:] == row[:-1])
    word = solid & ~previous_open
    joined = np.zeros(len(data), bool)
    joined[1:] = np.isin(data[:-1], np.frombuffer(b"-'", np.uint8)) & previous_open[1:] & solid[1:] & ~small[1:]
    number_of_word = np.cumsum(word)
    later = np.zeros(int(number_of_word[-1]) + 1, bool)
    later[number_of_word[joined]] = True
    carrying = word & (~small | later[number_of_word])
    words = np.concatenate([[0], np.cumsum(word)])
    named = np.concatenate([[0], np.cumsum(carrying)])
    any_word = words[seg_end] - words[seg_first] > 0
    seg_first, seg_end = seg_first[any_word], seg_end[any_word]
    if not len(seg_first):
        return out
    weight = named[seg_end] - named[seg_first]
    stretch = np.searchsorted(stretch_first, seg_first, side="right") - 1
    new = np.concatenate([[True], stretch[1:] != stretch[:-1]])
    head = np.flatnonzero(new)
    number = np.arange(len(stretch)) - head[np.cumsum(new) - 1]
    size = np.diff(np.concatenate([head, [len(stretch)]]))[np.cumsum(new) - 1]
    family_ok = (number % 2 == 1) | (weight <= 1)
    group = np.cumsum(new) - 1
    inverted = (np.bincount(group, weights=~family_ok) == 0)[group] & (size % 2 == 0)
    # the comma that follows segment i separates, unless i is a family name with its given name next
    glued = inverted & (number % 2 == 0)
    separates = comma.copy()
    for_segment = np.searchsorted(seg_first, np.flatnonzero(comma), side="right") - 1
    places = np.flatnonzero(comma)
    ok = for_segment >= 0
    glue_here = np.zeros(len(places), bool)
    glue_here[ok] = glued[for_segment[ok]] & (row[seg_first[for_segment[ok]]] == row[places[ok]]) & (stretch[for_segment[ok]] == np.searchsorted(stretch_first, places[ok], side="right") - 1)
    separates[places[glue_here]] = False
    return separates


def _cleaned(values: pa.Array, from_array: np.ndarray) -> pa.Array:
    """Without surrounding blanks, enclosing signs, escapes and leading numbers."""
    blanks = "  \t\r\n　​﻿"
    values = pc.utf8_trim(values, blanks)
    quoted = pc.match_substring_regex(values, r'(?s)^".*"$')
    inner = pc.replace_substring_regex(values, r'(?s)^"(.*)"$', r"\1")
    doubled = pc.replace_substring(inner, '""', '"')
    values = pc.if_else(quoted, pc.if_else(pa.array(from_array), _unescaped(inner, from_array), doubled), values)
    values = pc.replace_substring_regex(values, r"(?s)^\{(.*)\}$", r"\1")
    values = pc.replace_substring_regex(values, r"^(?:\(?\d+[.)]\s+|\[\d+\]\s*)", "")
    # what a cut remark or a joining word may leave behind
    values = pc.replace_substring_regex(values, r"^[,&\s]+|[,\s]+$|^(?i:and|und|och)\s+", "")
    return pc.utf8_trim(values, blanks)


def _unescaped(values: pa.Array, from_array: np.ndarray) -> pa.Array:
    """JSON escapes resolved; only the few values that have any are touched one by one."""
    escaped = pc.and_(pc.match_substring(values, "\\"), pa.array(from_array))
    if not pc.any(escaped).as_py():
        return values
    plain = []
    for text in values.filter(escaped).to_pylist():
        try:
            plain.append(json.loads(f'"{text}"', strict=False))
        except ValueError:
            plain.append(text)
    return pc.replace_with_mask(values, escaped, pa.array(plain, pa.string()))


def exploded_values(df: DataFrame, id_column: str, packed_column: str, id_name: str, value_name: str) -> DataFrame:
    """Rows ``(id_name, position, value_name)``, position from 1 in the order of the field.

    Defined cases: null, empty, blank and "no value" texts give no rows;
    repeated values keep their places; texts whose quotes or braces do not
    close are split as if these were ordinary signs; other columns are not
    read, whatever their names. No shuffle: each input partition is mapped.
    """
    schema = T.StructType([T.StructField(id_name, T.LongType()), T.StructField("position", T.IntegerType()), T.StructField(value_name, T.StringType())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = split_packed(batch.column(1))
            parent = pc.list_parent_indices(lists)
            starts = np.asarray(lists.offsets)[np.asarray(parent)] if len(parent) else np.zeros(0, np.int64)
            position = np.arange(len(parent)) - starts + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(parent).cast(pa.int64()), pa.array(position, pa.int32()), lists.flatten()],
                names=[id_name, "position", value_name],
            )

    narrow = df.select(df[id_column].cast("long").alias("id"), df[packed_column].cast("string").alias("packed"))
    return narrow.mapInArrow(batches, schema)
