"""Evaluation texts in a training corpus: every document that holds at least half of an item's words.

Each shard of the corpus (the documents of some record batches) becomes one
array of word numbers with its suffix array. Every suffix of every test passage
is looked up in it by binary search, all suffixes at once: the two neighbours
of its place in the order hold its longest verbatim match. Items of which even
the longest matches of the whole shard hold too little are out. For the others
the range of places that begin like the suffix gives the locations; of these
only the documents are kept, each once, so that what is frequent costs no more
than the documents that have it. A pair of document and item is aligned only if
the runs of words that both have can suffice, by their number (AGREEING) and in
their order (``chains``). Both bounds are proven, so the search loses nothing
that the alignment would accept.

The alignment gives the best stretch, or ordered pair of stretches, by a
forward and a backward pass. What is counted is defined by HIT, MISS, LEAST and
LEAK_SHARE alone.

Only words that occur in some test passage have numbers; all others are one
number that matches nothing, so the index covers the part of the corpus that
can match at all. The corpus is read in one pass, without any shuffle, for each
block of test passages; a block is bounded and broadcast, and held-out suites
usually are one block.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a word that agrees adds to a stretch, and what a changed, dropped or added one takes: a stretch goes on over
#: single edits, even where every third word is one, and falls apart where every second is.
HIT, MISS = 2, 3
#: Share of an item's words that one stretch, or two, must span.
LEAK_SHARE = 0.5
#: Words that a stretch spans at least (fewer occur by chance in any text), but never more than half of the passage.
LEAST = 3
#: Words of the runs that are looked for; a passage of one or two words is looked for by its single words.
SEED = 2
#: Least share of what a stretch spans that stands in runs of SEED or more words, as follows from HIT and MISS: a stretch
#: of m agreeing words and e edits scores above 0, so e < m * r with r = HIT / MISS. Its first run has SEED words or more,
#: as it must outweigh the first edit. Its runs of a single word are e at most, as an edit parts any two runs. So
#: m <= w / (1 - r), where w are the words in runs of SEED or more, and it spans at most m + e < w * (1 + r) / (1 - r).
AGREEING = (MISS - HIT) / (MISS + HIT)

#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 400_000
#: Pairs of test suffix and document that are counted together; an item that has more of them is a lot of its own.
PAIRS_AT_ONCE = 1_000_000
#: Words of text that are aligned together.
ALIGNED_AT_ONCE = 1 << 15
#: Characters of a block of test passages; a longer passage is a block of its own.
BLOCK_CHARACTERS = 64_000_000

_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[ntr]")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑‒–]\s*(?:\n[\s>*#|]*)?(?=[^\W\d_])")
_INVISIBLE = re.compile(r"[­​-‏⁠﻿‪-‮]")
_EMPHASIS = re.compile(r"[*_`~]+")
_WORD = re.compile(r"[^\W_]+")
# Cyrillic and Greek letters that look like Latin ones, and the Latin ones.
_ALIKE = str.maketrans("аеорсухікмтвнАВЕКМНОРСТХІαοεικνρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxikmtbhabekmhopctxiaoeiknptuxabezhikmnoptyx")


def plain_words(text: str) -> list[str]:
    """Words without letter case, marks, markup, escapes, hyphenation and character variants."""
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(_ALIKE)
    text = _EMPHASIS.sub("", text)
    if "-" in text or "‐" in text or "–" in text:
        text = _HYPHEN.sub("", text)
    return _WORD.findall(text.casefold())


def _packed(text: np.ndarray, bits: int, per: int) -> np.ndarray:
    """At each place the words from there to the next 0, ``per`` at most, in one number that sorts as they do."""
    size = len(text) - per
    out, alive = np.zeros(size, np.int64), np.ones(size, bool)
    for i in range(per):
        word = np.where(alive, text[i : size + i], 0)
        alive = word > 0
        out = out << bits | word
    return out


class Tests:
    """The passages as one array of word numbers, 0 between them."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.numbers: dict[str, int] = {}
        self.ids: list[int] = []
        self.starts: list[int] = []
        lengths: list[int] = []
        flat: list[int] = []
        for item, passage in items:
            found = plain_words(passage)
            if not found:
                continue
            self.ids.append(item)
            self.starts.append(len(flat))
            lengths.append(len(found))
            flat += [self.numbers.setdefault(w, len(self.numbers) + 1) for w in found]
            flat.append(0)
        self.lengths = np.array(lengths, np.int64)
        self.longest = max(lengths, default=0)
        self.bits = max(1, int(len(self.numbers) + 1).bit_length())
        self.per = max(SEED, 63 // self.bits)
        self.text = np.array(flat + [0] * self.per, np.int64)
        self.keys = _packed(self.text, self.bits, self.per)
        self.owner = np.repeat(np.arange(len(lengths)), self.lengths + 1)
        self.needed = LEAK_SHARE * self.lengths
        self.least = np.minimum(LEAST, -(-self.lengths // 2))
        self.seed = np.minimum(SEED, self.least)
        # suffixes that have the words of a seed before their passage ends
        ends = np.array(self.starts, np.int64) + self.lengths
        places = np.flatnonzero(self.text[: len(flat)] > 0)
        self.suffixes = places[places + self.seed[self.owner[places]] <= ends[self.owner[places]]]

    def passage(self, item: int) -> np.ndarray:
        return self.text[self.starts[item] : self.starts[item] + self.lengths[item]]


def suffix_array(text: np.ndarray, keys: np.ndarray, per: int, depth: int) -> np.ndarray:
    """Places of words in the order of what follows them up to the next 0, told apart by ``depth`` words at least.

    Prefix doubling from ``per`` words on; only what is still alike is sorted again.
    """
    order = np.flatnonzero(text[: len(keys)] > 0)
    order = order[np.argsort(keys[order], kind="stable")]
    n = len(order)
    rank = np.zeros(len(text) + 1, np.int64)  # of the first that is alike, from 1; 0 where a text has ended
    ends = np.flatnonzero(text == 0)
    remaining = np.zeros(len(text) + 1, np.int64)  # words to the end of the text
    remaining[order] = ends[np.searchsorted(ends, order)] - order

    def group(at: np.ndarray, new: np.ndarray, known: int) -> np.ndarray:
        """Ranks the places ``at`` of the order; those that still have a like one and do not end within what is known."""
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[order[at]] = at[first] + 1
        alone = new & np.append(new[1:], True)
        return at[~alone & (remaining[order[at]] >= known)]

    if not n:
        return order
    key = keys[order]
    at = group(np.arange(n), np.append(True, key[1:] != key[:-1]), per)
    known = per
    while len(at) and known < depth:
        place = order[at]
        head, tail = rank[place], rank[place + known]
        by = np.argsort(head * (n + 2) + tail, kind="stable")
        order[at] = place[by]
        head, tail = head[by], tail[by]
        at = group(at, np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])), 2 * known)
        known *= 2
    return order


def _agreeing(a_keys: np.ndarray, a: np.ndarray, b_keys: np.ndarray, b: np.ndarray, bits: int, per: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from the places a and b on, and whether a sorts after b there."""
    length, after = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    going = np.arange(len(a))
    last = (1 << bits) - 1
    while len(going):
        x, y = a_keys[a[going] + length[going]], b_keys[b[going] + length[going]]
        whole = (x == y) & (x & last > 0)
        rest, p, q = going[~whole], x[~whole], y[~whole]
        after[rest] = p > q
        same = np.ones(len(rest), bool)
        for i in range(per):
            u, v = p >> bits * (per - 1 - i) & last, q >> bits * (per - 1 - i) & last
            same &= (u == v) & (u > 0)
            length[rest] += same
        going = going[whole]
        length[going] += per
    return length, after


def longest_matches(tests: Tests, keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By binary search in the suffix array the words of the longest match in the shard of each test suffix."""
    suffixes = tests.suffixes
    if not len(order) or not len(suffixes):
        return np.zeros(len(suffixes), np.int64)
    sorted_keys = keys[order]
    wanted = tests.keys[suffixes]
    low, high = np.searchsorted(sorted_keys, wanted, "left"), np.searchsorted(sorted_keys, wanted, "right")
    open_ = np.flatnonzero(low < high)  # these agree in the whole key: the words behind it decide
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        _, after = _agreeing(tests.keys, suffixes[open_], keys, order[middle], tests.bits, tests.per)
        low[open_[after]] = middle[after] + 1
        high[open_[~after]] = middle[~after]
        open_ = open_[low[open_] < high[open_]]
    best = np.zeros(len(suffixes), np.int64)
    for at in (low - 1, low):
        ok = (at >= 0) & (at < len(order))
        length, _ = _agreeing(tests.keys, suffixes[ok], keys, order[at[ok]], tests.bits, tests.per)
        best[ok] = np.maximum(best[ok], length)
    return best


class Shard:
    """Some documents as one array of word numbers, and where the seeds of the test passages stand in it."""

    def __init__(self, documents: list[tuple[int, str]], tests: Tests) -> None:
        self.tests = tests
        flat: list[int] = []
        self.ids, self.bounds = [], [0]
        number = tests.numbers.get
        for doc, text in documents:
            flat += [number(w, 0) for w in plain_words(text)]
            flat.append(0)
            self.ids.append(doc)
            self.bounds.append(len(flat))
        self.text = np.array(flat + [0] * tests.per, np.int64)
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))
        self.keys = _packed(self.text, tests.bits, tests.per)
        self.order = suffix_array(self.text, self.keys, tests.per, tests.longest)
        self.longest = longest_matches(tests, self.keys, self.order)
        self._number = np.full(len(self.ids), -1, np.int64)

    def _kinds(self, suffixes: np.ndarray) -> None:
        """Numbers the ranges of the suffix array that begin with a seed of ``suffixes``; each range's documents, each once.

        Ranges of one length have no place in common, so all of them together hold no more places than the shard has.
        """
        tests, sorted_keys = self.tests, self.keys[self.order]
        seeds = tests.seed[tests.owner[suffixes]]
        low, high = np.zeros(len(suffixes), np.int64), np.zeros(len(suffixes), np.int64)
        for seed in range(1, SEED + 1):
            own = seeds == seed
            shift = tests.bits * (tests.per - seed)
            heads, wanted = sorted_keys >> shift, tests.keys[suffixes[own]] >> shift
            low[own], high[own] = np.searchsorted(heads, wanted, "left"), np.searchsorted(heads, wanted, "right")
        ranges, self.kind = np.unique(low * (len(self.order) + 1) + high, return_inverse=True)
        low, high = ranges // (len(self.order) + 1), ranges % (len(self.order) + 1)
        self.low, self.size = low, high - low
        size = self.size
        kind = np.repeat(np.arange(len(ranges)), size)
        places = self.order[np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        self.suffixes, self.first_suffix = suffixes, np.searchsorted(tests.owner[suffixes], np.arange(len(tests.ids) + 1))
        held = np.unique(kind * len(self.ids) + self.owner[places])
        self.documents = held % len(self.ids)
        self.first = np.searchsorted(held, np.arange(len(ranges) + 1) * len(self.ids))

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """By item the documents that have so many words in common runs with it that there can be a leak."""
        tests = self.tests
        seeds = tests.seed[tests.owner[tests.suffixes]]
        there = self.longest >= seeds
        # words of each item that any match of the shard holds: no document can hold more
        edge = np.zeros(len(tests.text) + 1, np.int64)
        np.add.at(edge, tests.suffixes[there], 1)
        np.add.at(edge, (tests.suffixes + self.longest)[there], -1)
        covered = np.bincount(tests.owner, weights=(np.cumsum(edge) > 0)[: len(tests.owner)], minlength=len(tests.ids))
        possible = covered > AGREEING * tests.needed
        suffixes = tests.suffixes[there & possible[tests.owner[tests.suffixes]]]
        self._kinds(suffixes)
        items = tests.owner[suffixes]
        counts = self.first[self.kind + 1] - self.first[self.kind]
        before = np.append(0, np.cumsum(counts))
        item_edges = np.append(np.flatnonzero(np.append(True, items[1:] != items[:-1])), len(items)) if len(items) else np.zeros(1, np.int64)
        at = 0
        while at + 1 < len(item_edges):
            end = at + 1
            while end + 1 < len(item_edges) and before[item_edges[end + 1]] - before[item_edges[at]] <= PAIRS_AT_ONCE:
                end += 1
            begin, stop = item_edges[at], item_edges[end]
            at = end
            n = counts[begin:stop]
            place = np.repeat(suffixes[begin:stop], n)
            document = self.documents[np.repeat(self.first[self.kind[begin:stop]], n) + np.arange(n.sum()) - np.repeat(before[begin:stop] - before[begin], n)]
            by = np.argsort(document, kind="stable")  # by document, and in the order of the passages within
            document, place = document[by], place[by]
            item = tests.owner[place]
            new = np.append(True, (document[1:] != document[:-1]) | (item[1:] != item[:-1]))
            gained = tests.seed[item]
            gained[:-1] = np.where(new[1:], gained[:-1], np.minimum(gained[:-1], place[1:] - place[:-1]))
            heads = np.flatnonzero(new)
            enough = np.add.reduceat(gained, heads) > AGREEING * tests.needed[item[heads]] if len(heads) else np.zeros(0, bool)
            item, document = item[heads[enough]], document[heads[enough]]
            by = np.argsort(item, kind="stable")
            item, document = item[by], document[by]
            edges = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
            for a, b in zip(edges, np.append(edges[1:], len(item))):
                yield int(item[a]), document[a:b]

    def runs(self, item: int, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number in documents, place in text, place in passage, words) of all maximal runs the item has in common with these documents, by document and end in the text."""
        tests = self.tests
        own = slice(self.first_suffix[item], self.first_suffix[item + 1])
        seed, kinds = int(tests.seed[item]), self.kind[own]
        n = self.size[kinds]
        place = np.repeat(self.suffixes[own] - tests.starts[item], n)
        text_at = self.order[np.repeat(self.low[kinds], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        self._number[documents] = np.arange(len(documents))
        number = self._number[self.owner[text_at]]
        self._number[documents] = -1
        number, text_at, place = number[number >= 0], text_at[number >= 0], place[number >= 0]
        # a run is what goes on along one diagonal
        by = np.lexsort((text_at, text_at - place, number))
        number, text_at, place = number[by], text_at[by], place[by]
        new = np.ones(len(by), bool)
        new[1:] = (number[1:] != number[:-1]) | (text_at[1:] != text_at[:-1] + 1) | (place[1:] != place[:-1] + 1)
        heads = np.flatnonzero(new)
        number, text_at, place, words = number[heads], text_at[heads], place[heads], np.diff(np.append(heads, len(by))) + seed - 1
        by = np.lexsort((text_at + words, number))
        return number[by], text_at[by], place[by], words[by]


def chains(text_at: np.ndarray, place: np.ndarray, words: np.ndarray) -> tuple[list[int], list[int]]:
    """By run, in order of their ends in the text: bounds of what a stretch that ends with this run spans of the passage, and where in the text it begins.

    A stretch is a chain of runs of SEED or more words. Between two of them lie
    g words of the text or the passage, whichever are more; at most every
    second of these can agree, so the gap takes (HIT + MISS) * (g - 1) / 2 -
    MISS * g from the score at best, which must stay above 0. Where runs
    overlap the later one counts from there on. So no stretch spans more.
    """
    d0, q0, n = text_at.tolist(), place.tolist(), words.tolist()
    d1, q1 = (text_at + words).tolist(), (place + words).tolist()
    score, begins, first = [], [], []
    back = 0  # runs before it end too far away for any score
    far = 0
    for j in range(len(d0)):
        best, begin, q = HIT * n[j], d0[j], q0[j]
        while 2 * far - (MISS - HIT) * (d0[j] - d1[back]) <= 0 and back < j:
            back += 1
        for i in range(back, j):
            if q1[i] >= q1[j] or d1[i] >= d1[j]:
                continue
            cut = max(0, q1[i] - q0[j], d1[i] - d0[j])
            if cut >= n[j]:
                continue
            gap = max(q0[j] + cut - q1[i], d0[j] + cut - d1[i])
            left = score[i] - MISS * gap + (HIT + MISS) * (gap - 1) / 2
            if left > 0:
                best, begin, q = max(best, left + HIT * (n[j] - cut)), min(begin, begins[i]), min(q, first[i])
        score.append(best)
        begins.append(begin)
        first.append(q)
        far = max(far, best)
    return [b - a for a, b in zip(first, q1)], begins


def _widest(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> Iterator[np.ndarray]:
    """Of rows of passages and texts, after each word of a: by words of b, the most words of a that a stretch which ends there spans.

    A stretch is a local alignment (a word that agrees HIT, a changed, dropped
    or added one -MISS) whose every beginning and every end scores above 0, so
    that it grows over single edits and stops where too much differs. Places
    of b at which none ends have 0; the first column stands before b.
    """
    # a cell is score * unit + words of a spanned: of equal scores the wider one
    unit = a.shape[1] + 1
    kind = np.int32 if unit * HIT * (unit + b.shape[1]) < 1 << 30 else np.int64
    miss = kind(MISS * unit)
    column = np.arange(b.shape[1] + 1, dtype=kind)
    slope = miss * column
    before = np.zeros((len(b), len(column)), kind)
    peak_before = np.zeros_like(before)  # the highest score on the way to each cell
    b = np.where(b > 0, b, -1)
    gain, loss = kind(HIT * unit + 1), kind(1 - MISS * unit)
    for word in a.T[:, :, None]:
        hit = b == word
        diagonal = before[:, :-1] + np.where(hit, gain, loss)
        above = before[:, 1:] + loss
        take = np.maximum(diagonal, above)
        take[take < unit] = 0
        score = take // unit
        passed = np.where(diagonal >= above, peak_before[:, :-1], peak_before[:, 1:])
        now, peak = np.zeros_like(before), np.zeros_like(before)
        now[:, 1:] = take
        peak[:, 1:] = np.where(take > 0, np.maximum(passed, score), 0)
        # an agreeing word that raises the score above all before it ends a stretch
        width = np.where(hit & (score > passed), take - score * unit, 0)
        width[width < least] = 0
        yield width
        # a gap along the row is a running maximum of score + column
        with_gap = np.maximum.accumulate(now + slope, axis=1) - slope
        longer = (with_gap > now) & (with_gap >= unit)
        if longer.any():
            source = np.maximum.accumulate(np.where(with_gap == now, column, 0), axis=1)
            peak = np.where(longer, np.take_along_axis(peak, source, axis=1), peak)
            now = np.where(longer, with_gap, now)
        before, peak_before = now, peak


def _table(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of one length; zeros, which match nothing, fill them up."""
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def spanned(passages: list[np.ndarray], texts: list[np.ndarray], least: list[int]) -> list[int]:
    """Most words of each passage that one stretch spans in its text, or two, the second after the first in both."""
    a, b, bound = _table(passages), _table(texts), np.array(least)[:, None]
    kind = np.int16 if a.shape[1] < 1 << 14 else np.int32
    # first[i, :, j]: the widest within the first i words of the passage and the first j of the text
    first = np.zeros((a.shape[1] + 1, len(b), b.shape[1] + 1), kind)
    for i, width in enumerate(_widest(a, b, bound), 1):
        first[i, :, 1:] = np.maximum(first[i - 1, :, 1:], np.maximum.accumulate(width, axis=1))
    most = first[-1, :, -1].astype(np.int64)
    # from behind: what follows each place in passage and text
    behind = np.zeros((len(b), b.shape[1] + 1), kind)
    for i, width in enumerate(_widest(a[:, ::-1], b[:, ::-1], bound), 1):
        behind[:, 1:] = np.maximum(behind[:, 1:], np.maximum.accumulate(width, axis=1))
        most = np.maximum(most, (first[a.shape[1] - i] + behind[:, ::-1]).max(axis=1))
    return most.tolist()


def _aligned(windows: list[np.ndarray], items: list[int], tests: Tests) -> list[int]:
    """Words spanned in each window, windows of like size together."""
    out = [0] * len(items)
    order = sorted(range(len(items)), key=lambda i: (int(tests.lengths[items[i]]).bit_length(), len(windows[i])))
    while order:
        n = 1
        while n < len(order) and (n + 1) * len(windows[order[n]]) <= ALIGNED_AT_ONCE and tests.lengths[items[order[n]]] < 2 * tests.lengths[items[order[0]]]:
            n += 1
        lot, order = order[:n], order[n:]
        for i, held in zip(lot, spanned([tests.passage(items[i]) for i in lot], [windows[i] for i in lot], [int(tests.least[items[i]]) for i in lot])):
            out[i] = held
    return out


def _window(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """The parts of the text from begins to ends, both in order of the ends. What lies between is not taken: in its place stand zeros, as many as there were words, or as take the highest score of a passage of ``words``."""
    begins = np.minimum.accumulate(begins[::-1])[::-1]
    fresh = np.flatnonzero(begins[1:] > ends[:-1]) + 1
    starts, stops = begins[np.append(0, fresh)], ends[np.append(fresh - 1, -1)]
    gaps = np.minimum(starts[1:] - stops[:-1], HIT * words // MISS + 1)
    parts = [text[starts[0] : stops[0]]]
    for gap, a, b in zip(gaps, starts[1:], stops[1:]):
        parts += [np.zeros(gap, np.int64), text[a:b]]
    return np.concatenate(parts)


def leaks_in_shard(documents: list[tuple[int, str]], tests: Tests) -> list[tuple[int, int, int, int]]:
    """(document, item, words spanned, words of the item) of each leak in these documents."""
    shard = Shard(documents, tests)
    out: list[tuple[int, int, int, int]] = []
    lot: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def judge() -> None:
        for (item, document, _), held in zip(lot, _aligned([w[2] for w in lot], [w[0] for w in lot], tests)):
            if held >= tests.needed[item]:
                out.append((shard.ids[document], tests.ids[item], held, int(tests.lengths[item])))
        lot.clear()

    for item, documents_of in shard.candidates():
        number, text_at, place, words = shard.runs(item, documents_of)
        # one of two stretches spans half of what is needed, or more; most pairs have one run only
        enough = max(tests.needed[item] / 2, tests.least[item])
        edges = np.searchsorted(number, np.arange(len(documents_of) + 1))
        several = np.diff(edges) > 1
        for i in np.flatnonzero(several | (words[edges[:-1]] >= enough)).tolist():
            own = slice(edges[i], edges[i + 1])
            spans, begins = chains(text_at[own], place[own], words[own])
            if max(spans) < enough:
                continue
            good = np.array(spans) >= tests.least[item]
            window = _window(shard.text, np.array(begins)[good], (text_at + words)[own][good], int(tests.lengths[item]))
            lot.append((item, int(documents_of[i]), window))
            size += len(window)
            if size > 64 * ALIGNED_AT_ONCE:
                judge()
                size = 0
    judge()
    return out


LEAKS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "item_id", "words", "item_words")])


def item_blocks(items: DataFrame, item_column: str, passage_column: str, most: int = BLOCK_CHARACTERS) -> Iterator[list[tuple[int, str]]]:
    """The passages in blocks of bounded size, each by itself on the driver."""
    held = items.where(F.col(passage_column).isNotNull()).select(F.col(item_column).cast("long").alias("item"), F.col(passage_column).alias("passage"))
    whole = held.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-2 * whole.size // most)) if whole.size > most else 1
    while True:
        numbered = held.withColumn("block", F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)).cast("int"))
        fullest = 0 if blocks == 1 else numbered.groupBy("block").agg(F.sum(F.length("passage")).alias("n"), F.count("*").alias("c")).where("c > 1").agg(F.max("n")).first()[0] or 0
        if fullest <= most or blocks > 4 * whole.rows:
            break
        blocks *= 2
    for block in range(blocks):
        if rows := numbered.where(F.col("block") == block).select("item", "passage").collect():
            yield sorted((int(r[0]), r[1]) for r in rows)


def leaked_items(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", passage_column: str = "passage") -> DataFrame:
    """Rows LEAKS: documents that hold at least half of the words of an item's passage, in order, in one stretch or two.

    Defined cases: null, empty and wordless texts and passages take no part;
    repeated documents and repeated items are each reported; a passage of one
    or two words is held by every document that has one of them, one of three
    or four by two of its words side by side; other columns are not read. An
    empty corpus or no items give no rows.
    """
    out = None
    for block in item_blocks(items, item_column, passage_column):
        found = _leaks_of_block(documents, Tests(block), id_column, text_column)
        out = found if out is None else out.unionByName(found)
    return documents.sparkSession.createDataFrame([], LEAKS) if out is None else out


def _leaks_of_block(documents: DataFrame, tests: Tests, id_column: str, text_column: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(tests)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple[int, str]] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if text is None:
                    continue
                waiting.append((int(doc), text))
                size += len(text)
                if size >= 6 * SHARD_WORDS:
                    yield pd.DataFrame(leaks_in_shard(waiting, shared.value), columns=LEAKS.names, dtype="int64")
                    waiting, size = [], 0
        if waiting:
            yield pd.DataFrame(leaks_in_shard(waiting, shared.value), columns=LEAKS.names, dtype="int64")

    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInPandas(search, LEAKS)


def without_leaks(documents: DataFrame, leaks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The corpus without the affected documents."""
    return documents.join(leaks.select(F.col("doc_id").alias(id_column)).distinct(), id_column, "left_anti")
