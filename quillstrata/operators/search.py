"""Ranked full-text search: words, phrases, prefixes, columns, nearness and Boolean operators, scored by BM25.

A query text is parsed on the driver into a tree; the tree becomes column
expressions over the arrays of words of each document, so that matching and
counting stay in generated JVM code. One aggregate gives the number of
documents, their mean length and in how many each phrase occurs; its single row
is broadcast, and the best rows are taken per partition before they meet.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstrata.functions.text import FOLD_FROM, FOLD_TO
from quillstrata.sources.store import Snapshot

# BM25's two numbers, the least weight of a phrase, the columns, and how many rows a search gives.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
COLUMNS = ("body", "kind")
STORED = ("label", "descr", "source_type", "source_id", "project_id")
LIMIT = 50
NEAR_DEFAULT = 10
WORD = r"[\p{L}\p{N}\p{Co}]+"


class BadQuery(ValueError):
    """A query text that does not parse."""


#: Marks that are written onto the letter before; those of other scripts part words.
MARKS = "[\u0300-\u036f]+"


def tokens(text: Column) -> Column:
    """Lower-case words without marks: runs of letters, digits and private-use signs; of Latin letters the one without its mark."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), MARKS, "")), F.lit(WORD), F.lit(0))


def python_tokens(text: str) -> list[str]:
    """The words of a query's string, as ``tokens`` gives them."""
    plain = re.sub(MARKS, "", text.translate(str.maketrans(FOLD_FROM, FOLD_TO))).lower()
    kept = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in plain)
    return kept.split()


def documents(s: Snapshot) -> DataFrame:
    """What can be found: observations by body, projects and concepts by name and description; each by its kind too."""
    names = F.concat("name", F.lit(" "), F.col("description"))
    return (
        s.observations.select("body", "kind", F.lit("").alias("label"), F.lit("").alias("descr"), F.lit("observation").alias("source_type"), F.col("id").alias("source_id"), "project_id")
        .unionByName(s.projects.select(names.alias("body"), F.lit("project").alias("kind"), F.col("name").alias("label"), F.col("description").alias("descr"), F.lit("project").alias("source_type"), F.col("id").alias("source_id"), F.col("id").alias("project_id")))
        .unionByName(s.concepts.select(names.alias("body"), F.lit("concept").alias("kind"), F.col("name").alias("label"), F.col("description").alias("descr"), F.lit("concept").alias("source_type"), F.col("id").alias("source_id"), F.lit(0).cast("long").alias("project_id")))
    )


def indexed(docs: DataFrame) -> DataFrame:
    """Documents with their words, ``body_words`` and ``kind_words``, and their number ``dl``; worth writing for many queries."""
    return docs.withColumn("body_words", tokens(F.coalesce("body", F.lit("")))).withColumn("kind_words", tokens(F.coalesce("kind", F.lit("")))).withColumn("dl", F.size("body_words") + F.size("kind_words"))


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: tuple[str, ...] = COLUMNS

    def positions(self, column: str) -> Column:
        """Places of the phrase's first word in a column, from 0."""
        words = F.col(f"{column}_words")

        def begins(_, i):
            ok = i == 0 if self.initial else F.lit(True)
            for k, w in enumerate(self.words):
                word = F.get(words, i + k)
                here = word.startswith(w) if self.prefix and k == len(self.words) - 1 else word == w
                ok = ok & F.coalesce(here, F.lit(False))
            return ok

        places = F.transform(words, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        return F.transform(F.filter(places, lambda p: begins(p["w"], p["i"])), lambda p: p["i"])

    def count(self) -> Column:
        total = F.lit(0)
        for column in self.columns:
            words = F.col(f"{column}_words")
            if len(self.words) == 1 and not self.initial:
                w = self.words[0]
                total = total + F.size(F.filter(words, (lambda x: x.startswith(w)) if self.prefix else (lambda x: x == w)))
            else:
                total = total + F.size(self.positions(column))
        return total

    def near_count(self) -> Column:
        """Occurrences that count for the score."""
        return self.count()


@dataclass(frozen=True)
class NearPhrase(Phrase):
    """A phrase of a NEAR group, of which only the occurrences in a near match count."""

    group: tuple[Phrase, ...] = ()
    distance: int = NEAR_DEFAULT

    def near_count(self) -> Column:
        """Occurrences x for which some word M of the group follows such that every phrase begins at most its length and ``distance`` words before M, and not after it."""
        total = F.lit(0)
        for column in self.columns:
            spans = [(p.positions(column), len(p.words) + self.distance) for p in self.group]
            total = total + F.size(F.filter(self.positions(column), _near(spans, len(self.words) + self.distance)))
        return total


def _near(spans: list[tuple[Column, int]], reach: int) -> Callable[[Column], Column]:
    """Whether an occurrence belongs to a near match of ``spans``: places of each phrase, and how far before M they may begin."""
    words = F.concat(*(places for places, _ in spans))

    def within(m: Column, most: int) -> Callable[[Column], Column]:
        return lambda place: (place <= m) & (m - place <= most)

    def complete(x: Column) -> Callable[[Column], Column]:
        def check(m: Column) -> Column:
            ok = (m >= x) & (m - x <= reach)
            for places, most in spans:
                ok = ok & F.exists(places, within(m, most))
            return ok

        return check

    return lambda x: F.exists(words, complete(x))


@dataclass(frozen=True)
class Query:
    """What must hold, the phrases, and by phrase the condition under which it counts (None: never)."""

    match: Column
    phrases: tuple[Phrase, ...]
    counts: tuple[Column | None, ...]


@dataclass
class _Parser:
    text: str
    items: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0
    phrases: list[Phrase] = field(default_factory=list)
    gates: dict[int, Column | None] = field(default_factory=dict)

    _LEX = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[A-Za-z0-9_\u0080-\U0010ffff\x1a]+)|(?P<sign>[(){}:+*^,\-]))')

    def __post_init__(self) -> None:
        at = 0
        while self.text[at:].strip():
            m = self._LEX.match(self.text, at)
            if not m:
                raise BadQuery(f"search {self.text!r}: syntax error near {self.text[at:].strip()[:20]!r}")
            self.items.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        if not self.items:
            raise BadQuery(f"search {self.text!r}: the query is empty")

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("", "")

    def take(self) -> tuple[str, str]:
        item = self.peek()
        self.at += 1
        return item

    def fail(self) -> None:
        raise BadQuery(f"search {self.text!r}: syntax error near {self.peek()[1]!r}")

    def is_operator(self, name: str) -> bool:
        return self.peek() == ("word", name)

    def gate(self, since: int, condition: Column | None) -> Column | None:
        """Phrases parsed since count only where what they are a part of holds as a whole; those to be absent never."""
        for i in range(since, len(self.phrases)):
            held = self.gates.get(i, F.lit(True))
            self.gates[i] = None if condition is None or held is None else held & condition
        return condition

    def whole(self) -> Column:
        out = self.either(COLUMNS)
        if self.peek()[0]:
            self.fail()
        return out

    def either(self, columns: tuple[str, ...]) -> Column:
        out = self.both(columns)
        while self.is_operator("OR"):
            self.take()
            out = out | self.both(columns)
        return out

    def both(self, columns: tuple[str, ...]) -> Column:
        since, out, several = len(self.phrases), self.without(columns), False
        while self.is_operator("AND"):
            self.take()
            out, several = out & self.without(columns), True
        if several:
            self.gate(since, out)
        return out

    def without(self, columns: tuple[str, ...]) -> Column:
        since, out, several = len(self.phrases), self.sequence(columns), False
        while self.is_operator("NOT"):
            self.take()
            absent = len(self.phrases)
            out, several = out & ~self.sequence(columns), True
            self.gate(absent, None)
        if several:
            self.gate(since, out)
        return out

    def sequence(self, columns: tuple[str, ...]) -> Column:
        """Phrases side by side are all wanted; a parenthesis stands alone."""
        since, several = len(self.phrases), False
        out, grouped = self.primary(columns)
        while not grouped and self.starts_phrase():
            more, grouped_more = self.primary(columns)
            if grouped_more:
                self.fail()
            out, several = out & more, True
        if several:
            self.gate(since, out)
        return out

    def starts_phrase(self) -> bool:
        kind, text = self.peek()
        return kind == "string" or kind == "word" and text not in ("AND", "OR", "NOT") or (kind, text) in (("sign", "^"), ("sign", "{"), ("sign", "-"))

    def primary(self, columns: tuple[str, ...]) -> tuple[Column, bool]:
        wanted = self.column_filter()
        if wanted is not None:
            columns = tuple(c for c in columns if c in wanted)
        if self.peek() == ("sign", "("):
            self.take()
            out = self.either(columns)
            if self.take() != ("sign", ")"):
                self.at -= 1
                self.fail()
            return out, True
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            return self.near(columns), False
        phrase = self.phrase(columns)
        if phrase is None:
            return F.lit(True), False
        return self.phrase_matches(phrase), False

    def column_filter(self) -> tuple[str, ...] | None:
        start, negative = self.at, False
        if self.peek() == ("sign", "-"):
            self.take()
            negative = True
        names: list[str] = []
        if self.peek() == ("sign", "{"):
            self.take()
            while self.peek()[0] in ("word", "string"):
                names.append(self.take()[1].strip('"'))
            if self.take() != ("sign", "}"):
                self.fail()
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("sign", ":"):
            names.append(self.take()[1].strip('"'))
        if not names or self.peek() != ("sign", ":"):
            if negative or names:
                self.fail()
            self.at = start
            return None
        self.take()
        for name in names:
            if name.lower() not in COLUMNS + STORED:
                raise BadQuery(f"search {self.text!r}: no such column: {name}")
        chosen = [n.lower() for n in names]
        return tuple(c for c in COLUMNS if (c in chosen) != negative)

    def phrase(self, columns: tuple[str, ...]) -> Phrase | None:
        initial = False
        if self.peek() == ("sign", "^"):
            self.take()
            initial = True
        words: list[str] = []
        while True:
            kind, text = self.peek()
            if kind == "string":
                text = text[1:-1].replace('""', '"')
            elif kind != "word" or text in ("AND", "OR", "NOT"):
                self.fail()
            self.take()
            words += python_tokens(text)
            if self.peek() != ("sign", "+"):
                break
            self.take()
        prefix = self.peek() == ("sign", "*")
        if prefix:
            self.take()
        return Phrase(tuple(words), prefix, initial, columns) if words else None

    def phrase_matches(self, phrase: Phrase) -> Column:
        self.phrases.append(phrase)
        return F.col(f"tf{len(self.phrases) - 1}") > 0

    def near(self, columns: tuple[str, ...]) -> Column:
        self.take()
        self.take()
        inner: list[Phrase] = []
        while self.starts_phrase():
            if (phrase := self.phrase(columns)) is not None:
                inner.append(phrase)
        distance = NEAR_DEFAULT
        if self.peek() == ("sign", ","):
            self.take()
            kind, text = self.take()
            if kind != "word" or not text.isdigit():
                self.fail()
            distance = int(text)
        if self.take() != ("sign", ")") or not inner:
            self.at -= 1
            self.fail()
        since = len(self.phrases)
        self.phrases += [NearPhrase(p.words, p.prefix, p.initial, p.columns, tuple(inner), distance) for p in inner]
        out = F.col(f"tf{since}") > 0  # in a near match every phrase has an occurrence
        self.gate(since, out)
        return out


def parse(text: str) -> Query:
    """The query's condition over the counts tf0, tf1, … of its phrases."""
    parser = _Parser(text)
    match = parser.whole()
    return Query(match, tuple(parser.phrases), tuple(parser.gates.get(i, F.lit(True)) for i in range(len(parser.phrases))))


def search(s: Snapshot, text: str, limit: int = LIMIT, docs: DataFrame | None = None) -> DataFrame:
    """Rows ``(nth, kind, label, snippet, source_type, source_id, score)``, the best first (the least score).

    ``docs``: ``indexed(documents(s))`` if it is held already. Equal scores go
    by source_type and source_id. No document or no hit: no rows.
    """
    query = parse(text)
    held = indexed(documents(s)) if docs is None else docs
    stored = ("body", "kind", "label", "descr", "source_type", "source_id", "project_id")
    counted = held.select(*stored, "dl", *(p.near_count().alias(f"tf{i}") for i, p in enumerate(query.phrases)))
    # in how many documents a phrase occurs does not depend on what else is asked for
    stats = held.select("dl", *(p.count().alias(f"tf{i}") for i, p in enumerate(query.phrases))).agg(
        F.count("*").alias("n"), F.avg("dl").alias("mean"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"n{i}") for i in range(len(query.phrases)))
    )
    score = F.lit(0.0)
    for i, counts in enumerate(query.counts):
        if counts is None:
            continue
        tf, n = F.col(f"tf{i}").cast("double"), F.col(f"n{i}")
        idf = F.log((F.col("n") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        score = score - F.when(counts, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("mean")))).otherwise(0.0)
    place = ("exact", "source_type", "source_id")
    best = counted.where(query.match).crossJoin(F.broadcast(stats)).select(*stored, score.alias("exact")).orderBy(*place).limit(limit)
    names = s.projects.select(F.col("id").alias("pid"), F.col("name").alias("project"))
    observed = F.col("source_type") == "observation"
    return best.join(names, observed & (F.col("project_id") == F.col("pid")), "left").select(
        F.row_number().over(Window.orderBy(*place)).alias("nth"), "kind",
        F.when(observed, F.coalesce("project", F.lit(""))).otherwise(F.col("label")).alias("label"),
        F.when(observed, F.col("body")).otherwise(F.col("descr")).alias("snippet"), "source_type", "source_id", F.round("exact", 6).alias("score"),
    )
