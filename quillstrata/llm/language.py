"""Languages of documents and of their stretches, word first and by letters where words fail.

A known word is scored by its frequency in each language. A word that is not
known falls back to its longest letter sequences that are, from FIRST_GRAM
letters down to one. The scores of a sentence's words add up; over the
sentences of a text the cheapest path decides, with a price for each change of
language, so that a foreign name or a heading of one word opens no stretch of
its own, while a whole sentence in another language does.

The model is fitted on a bounded sample of labelled documents (SAMPLE per
language, by a hash of the id), once more after its own first reading of them,
sentence by sentence, so that wrong labels and mixed documents in the sample
do not count. Its size is bounded with the sample. Everything else reads every
document as a whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.session import materialise

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "it", "sv")

# Codes (two and three letters) and names of the eight languages, as labels spell them.
LABELS = {
    "en": "en eng english englisch anglais ingles",
    "de": "de deu ger german deutsch allemand",
    "fr": "fr fra fre french francais franzosisch",
    "es": "es spa spanish espanol castellano spanisch",
    "pt": "pt por portuguese portugues portugiesisch",
    "nl": "nl nld dut dutch nederlands niederlandisch",
    "it": "it ita italian italiano italienisch",
    "sv": "sv swe swedish svenska schwedisch",
}

#: Labelled documents per language the model is fitted on, at most.
SAMPLE = 2000
#: Times the sample that are read of it, so that nulls and the spread of hashes leave enough.
SPARE = 2
FIRST_GRAM = 5
#: What an unknown word counts against a known one: names and codes are unknown in every language.
UNKNOWN_WEIGHT = 0.25
#: Occurrences in the sample that make a word known; a word must also have come up in two documents.
KNOWN_FROM = 3
#: Nats that a change of language between two sentences costs.
CHANGE = 6.0
#: Words a worker remembers; when full it starts anew, which changes no result.
REMEMBERED = 300_000
#: Words told apart, by themselves or by their letters, that a stretch among others must have: a single foreign word
#: makes none. A text needs one; without any it is in no language.
STRETCH_WORDS = 2

# a sentence ends at its sign before a blank, or with its line; signs, marks and numbers begin none
_SENTENCE = regex.compile(r"[^\n.!?…。]*(?:[.!?…。]+(?=[\s\"'”’)\]»*_]|$)[\"'”’)\]»*_]*|[.!?…。]+|\n+|$)")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’]\p{L}+)?")
_NOT_TEXT = re.compile(r"```.*?(?:```|$)|`[^`\n]*`|<?https?://\S+|\b\w+://\S+|[\w.+-]+@[\w.-]+|\[doi:[^\]]*\]|\(10\.\d[^)\s]*\)|\b0x\w+|\b(?=\w*\d)\w+\b", re.DOTALL)


def label_language(label: Column) -> Column:
    """The language of LANGUAGES a label names, in whatever spelling or with whatever region; null if none of them."""
    plain = F.translate(F.lower(F.trim(label)), "ñçöäéê", "ncoaee")
    code = F.regexp_extract(plain, r"^([a-z]+)", 1)
    table = F.create_map(*(F.lit(x) for language, names in LABELS.items() for name in names.split() for x in (name, language)))
    return F.try_element_at(table, code)


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence with what follows it, without gaps."""
    out: list[tuple[int, int]] = []
    at = 0
    for m in _SENTENCE.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def words(text: str) -> list[str]:
    """Lower-case words; code, addresses, references and anything with digits have none."""
    return _WORD.findall(without_code(text).lower())


def without_code(text: str) -> str:
    """The text with blanks for what belongs to no language; as long as before."""
    return _NOT_TEXT.sub(lambda m: " " * len(m[0]), text)


class Model:
    def __init__(self, word_counts: dict[str, Counter]) -> None:
        languages = LANGUAGES
        totals = [sum(word_counts[l].values()) or 1 for l in languages]
        vocabulary = sorted({w for l in languages for w, n in word_counts[l].items()})
        self.known = {}
        floor = 0.1 / max(totals)  # one for all, so that a language with few words in the sample gains nothing by it
        for word in vocabulary:
            counts = [word_counts[l][word] for l in languages]
            if sum(counts) >= KNOWN_FROM:
                self.known[word] = self._centred([math.log(n / t + floor) for n, t in zip(counts, totals)])
        grams: list[dict[str, list[int]]] = [{} for _ in range(FIRST_GRAM + 1)]
        for i, language in enumerate(languages):
            for word, n in word_counts[language].items():
                for size in range(1, FIRST_GRAM + 1):
                    for gram in self._grams(word, size):
                        grams[size].setdefault(gram, [0] * len(languages))[i] += n
        self.grams: list[dict[str, tuple[float, ...]]] = [{}]
        for size in range(1, FIRST_GRAM + 1):
            sums = [sum(c[i] for c in grams[size].values()) or 1 for i in range(len(languages))]
            self.grams.append({g: self._centred([math.log(n / t + 0.5 / max(sums)) for n, t in zip(c, sums)]) for g, c in grams[size].items() if sum(c) >= KNOWN_FROM})

    @staticmethod
    def _grams(word: str, size: int) -> list[str]:
        padded = f"^{word}$" if size > 1 else word
        return [padded[i : i + size] for i in range(len(padded) - size + 1)]

    @staticmethod
    def _centred(logs: list[float]) -> tuple[float, ...]:
        top = max(logs)
        return tuple(max(x - top, -8.0) for x in logs)

    def word(self, word: str) -> tuple[tuple[float, ...], bool]:
        """Scores by language, 0 for the best; whether the word is known."""
        if word in self.known:
            return self.known[word], True
        for size in range(FIRST_GRAM, 0, -1):
            table = self.grams[size]
            hits = [table[g] for g in self._grams(word, size) if g in table]
            if hits:
                return tuple(UNKNOWN_WEIGHT * sum(h[i] for h in hits) / len(hits) for i in range(len(LANGUAGES))), False
        return (0.0,) * len(LANGUAGES), False


class Reader:
    """A model with what a worker has looked up so far: one row of scores per word seen, 0 for none."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(LANGUAGES)))
        self.is_told = np.zeros(1024, np.int64)

    def _look_up(self, word: str) -> int:
        at = self.place[word] = len(self.place) + 1
        if at >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.is_told = np.concatenate([self.is_told, np.zeros_like(self.is_told)])
        self.scores[at], known = self.model.word(word)
        # letters that score alike in every language tell nothing
        self.is_told[at] = known or np.ptp(self.scores[at]) > 0
        return at

    def score(self, parts: Sequence[Sequence[str]]) -> list[tuple[list[float], int]]:
        """Of each part's words the summed scores by language and the number of those told apart."""
        if len(self.place) > REMEMBERED:
            self._forget()
        place, look_up = self.place, self._look_up
        flat, begins = [0], []  # the leading 0 keeps every part's begin within bounds
        for part in parts:
            flat.append(0)
            begins.append(len(flat) - 1)
            flat += [place.get(w) or look_up(w) for w in part]
        at = np.array(flat)
        sums = np.add.reduceat(self.scores[at], begins).tolist()
        return list(zip(sums, np.add.reduceat(self.is_told[at], begins).tolist()))

    def stretches(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        """(begin, end, language, confidence, words told apart) of each stretch in one language, in order; none for a text without words."""
        if not text:
            return []
        spans = sentences(text)
        plain = without_code(text)
        scored = self.score([_WORD.findall(plain[a:b].lower()) for a, b in spans])
        if not sum(k for _, k in scored):
            return []
        path = _cheapest_path([s for s, _ in scored])
        while True:
            runs = _runs(path, scored)
            weak = [r for r in runs if r[3] < STRETCH_WORDS]
            if not weak or len(runs) == 1:
                break
            # the weakest goes to the neighbour that it fits better
            begin, end, language, _, _ = min(weak, key=lambda r: r[3])
            near = [r[2] for r in runs if r[1] == begin or r[0] == end]
            sums = [sum(scored[i][0][l] for i in range(begin, end)) for l in range(len(LANGUAGES))]
            path[begin:end] = [max(near, key=lambda l: sums[l])] * (end - begin)
        out = []
        for begin, end, language, told, sums in _runs(path, scored):
            out.append((spans[begin][0], spans[end - 1][1], LANGUAGES[language], _confidence(sums, language), told))
        return out


def _cheapest_path(scores: Sequence[Sequence[float]]) -> list[int]:
    n = len(LANGUAGES)
    table = np.array(scores)
    throughout = (table == table.max(axis=1, keepdims=True)).all(axis=0)
    if throughout.any():  # one language is the best of every sentence: no path can be better
        return [int(throughout.argmax())] * len(scores)
    best, backs = list(scores[0]), []
    for now in scores[1:]:
        top = max(range(n), key=best.__getitem__)
        came = [l if best[l] >= best[top] - CHANGE else top for l in range(n)]
        best = [now[l] + max(best[l], best[top] - CHANGE) for l in range(n)]
        backs.append(came)
    at = max(range(n), key=best.__getitem__)
    path = [at]
    for came in reversed(backs):
        at = came[at]
        path.append(at)
    return path[::-1]


def _runs(path: Sequence[int], scored) -> list[tuple[int, int, int, int, list[float]]]:
    out, begin = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[begin]:
            sums = [sum(scored[j][0][l] for j in range(begin, i)) for l in range(len(LANGUAGES))]
            out.append((begin, i, path[begin], sum(scored[j][1] for j in range(begin, i)), sums))
            begin = i
    return out


def _confidence(sums: Sequence[float], language: int) -> float:
    top = max(sums)
    return round(math.exp(sums[language] - top) / sum(math.exp(s - top) for s in sums), 6)


def fit(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents per language, those of least hash, in two rounds.

    A first scan counts the labels and reads no text. The counts give each
    label a bound of the hash under which some SPARE times the sample lies, so
    that the second scan, which reads the texts, keeps a bounded number of
    them; rows of one id count once. What is ranked has no texts.
    """
    hashed = F.xxhash64(F.col(id_column).cast("long"))
    labelled = documents.select(F.col(id_column).cast("long").alias("id"), hashed.alias("h"), F.col(text_column).alias("text"), label_language(F.col(label_column)).alias("label")).where("label IS NOT NULL")
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a language at most
    below = F.lit(False)
    for label, n in counts.items():
        share = min(1.0, SPARE * sample / n)
        bound = F.lit((1 << 63) - 1 if share == 1 else int(share * (1 << 64)) - (1 << 63))
        below = below | (F.col("label") == label) & (F.col("h") <= bound)
    near = materialise(labelled.where(below & F.col("text").isNotNull()).groupBy("label", "h", "id").agg(F.max("text").alias("text")), "sample")
    order = Window.partitionBy("label").orderBy("h", "id")
    first = near.select("label", "h", "id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample).drop("nth")
    chosen = near.join(first, ["label", "h", "id"], "left_semi").select("label", "text")
    first_model = Model(_counted(chosen, None))
    return Model(_counted(chosen, first_model))


def _counted(chosen: DataFrame, model: Model | None) -> dict[str, Counter]:
    """Word counts by language: by the label, or with a model by its reading of each sentence. Bounded with the sample."""
    shared = None if model is None else chosen.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None if shared is None else Reader(shared.value)
        for batch in batches:
            counts: dict[tuple[str, str], list[int]] = {}
            for label, text in zip(batch["label"], batch["text"]):
                parts = [(label, text)] if reader is None else [(s[2], text[s[0] : s[1]]) for s in reader.stretches(text) if s[3] > 0.99]
                for language, part in parts:
                    for word, n in Counter(words(part)).items():
                        held = counts.setdefault((language, word), [0, 0])
                        held[0] += n
                        held[1] += 1
            yield pd.DataFrame([(l, w, n, d) for (l, w), (n, d) in counts.items()], columns=["lang", "word", "n", "docs"])

    rows = chosen.mapInPandas(count, "lang string, word string, n long, docs long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where("docs >= 2")
    out: dict[str, Counter] = {language: Counter() for language in LANGUAGES}
    for row in rows.collect():
        out[row.lang][row.word] = row.n
    return out


SEGMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("seg_no", T.IntegerType()),
        T.StructField("begin", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("lang", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("segments", T.IntegerType()),
    ]
)


def language_segments(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """Rows SEGMENTS: seg_no 0 for the document, from 1 each stretch; begin and end in characters of the text.

    The document's language is that of most of its text by words told apart, the
    first stretch's if equal. label is the language the label names, null if
    none; segments the number of stretches. Defined cases: null, empty and blank texts and texts without words
    of a language have no rows; repeated rows are each given; other columns
    are not read. One pass, no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for batch in batches:
            out = []
            for doc, text, label in zip(batch["doc_id"], batch["text"], batch["label"]):
                found = reader.stretches(text)
                if not found:
                    continue
                weight: Counter = Counter()
                sure: Counter = Counter()
                for _, _, language, confidence, told in found:
                    weight[language] += told
                    sure[language] += told * confidence
                main = max(weight, key=lambda l: (weight[l], -LANGUAGES.index(l)))
                if weight[main] == weight[found[0][2]]:
                    main = found[0][2]
                total = sum(weight.values())
                out.append((doc, 0, 0, len(text), main, round(sure[main] / total, 6), label, len(found)))
                out += [(doc, i, a, b, language, confidence, label, len(found)) for i, (a, b, language, confidence, _) in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=SEGMENTS.names).astype({"doc_id": "int64", "seg_no": "int32", "begin": "int32", "end": "int32", "segments": "int32", "confidence": "float64"})

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), label_language(F.col(label_column)).alias("label"))
    return rows.mapInPandas(read, SEGMENTS)
