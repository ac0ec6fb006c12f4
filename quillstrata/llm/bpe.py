"""Encoding of a corpus with a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves each pre-token
that is a token as a whole: it maps the 50 000 keys to 0..n-1 without gaps, a
batch of pre-tokens is looked up with a few array operations, and the stored
key decides whether it really is that one. What is not in the vocabulary is
merged byte by byte: the bytes form a linked list, a heap holds the rank of
each neighbouring pair, the least is merged and its new neighbours pushed, so a
pre-token of n bytes takes n log n steps, also one of a megabyte.

The vocabulary is fixed in size (some 2 MB with its tables) and is broadcast
once; each worker builds its encoder once. No shuffle: partitions are mapped.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter, never copied.
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the public pattern that splits a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Resolved pre-tokens a worker remembers; when full it starts anew, which changes no result.
REMEMBERED = 500_000
#: Longest pre-token (in characters) that is worth remembering.
REMEMBERED_LENGTH = 64


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings, by levels of collision-free bits."""

    def __init__(self, keys: list[bytes], space: float = 2.0) -> None:
        left = self.hashes(keys)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys must be distinct")
        self.levels: list[np.ndarray] = []
        while len(left):
            size = max(64, int(len(left) * space))
            at = self._at(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            left = left[~alone[at]]
        self.starts = np.concatenate([[0], np.cumsum([level.sum() for level in self.levels])])
        self.counts = [np.concatenate([[0], np.cumsum(level)])[:-1] for level in self.levels]
        self.size = len(keys)

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def _at(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        """Another place at each level: a multiplicative mix of the one hash of the key."""
        with np.errstate(over="ignore"):
            mixed = (hashes ^ np.uint64(level * 0x5851F42D4C957F2D & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(16)) % np.uint64(size)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """0..n-1 of each key; -1, or the place of another key, for what is not in the set."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self._at(hashes[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.starts[level] + self.counts[level][at[hit]]
            open_ = open_[~hit]
        return out


class Encoder:
    def __init__(self, rank_file: bytes) -> None:
        pairs = [line.split() for line in rank_file.splitlines() if line]
        keys = [base64.b64decode(token) for token, _ in pairs]
        self.ranks = dict(zip(keys, (int(rank) for _, rank in pairs)))
        self.hash = PerfectHash(keys)
        place = self.hash.places(PerfectHash.hashes(keys))
        self.key_at: list[bytes] = [b""] * len(keys)
        self.rank_at = np.zeros(len(keys), np.int64)
        for i, p in enumerate(place):
            self.key_at[p] = keys[i]
            self.rank_at[p] = self.ranks[keys[i]]
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        pieces = [self.split(text) if text else [] for text in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        distinct = set(chain.from_iterable(pieces))
        fresh = [p for p in distinct if p not in known]
        resolved = dict(zip(fresh, self.resolve([p.encode() for p in fresh])))
        long = {p: resolved.pop(p) for p in fresh if len(p) > REMEMBERED_LENGTH}
        known.update(resolved)
        if not long:
            return [list(chain.from_iterable(map(known.__getitem__, ps))) for ps in pieces]
        return [list(chain.from_iterable(long[p] if p in long else known[p] for p in ps)) for ps in pieces]

    def resolve(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: whole tokens by the perfect hash, the rest by merging."""
        if not tokens:
            return []
        places = self.hash.places(PerfectHash.hashes(tokens))
        ids = self.rank_at[places].tolist()
        return [[i] if p >= 0 and self.key_at[p] == t else self.merge(t) for t, p, i in zip(tokens, places.tolist(), ids)]

    def merge(self, token: bytes) -> list[int]:
        """Merges by a heap over linked bytes; of equal ranks the leftmost goes first."""
        n = len(token)
        ranks = self.ranks
        ends = list(range(1, n + 1))  # of the part that begins here; 0 for one that was merged away
        previous = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end or middle >= end:
                continue  # one of the two parts has changed since
            ends[i], ends[middle] = end, 0
            if end < n:
                previous[end] = i
                if (rank := ranks.get(token[i : ends[end]])) is not None:
                    heapq.heappush(heap, (rank, i, ends[end]))
            if (before := previous[i]) >= 0 and (rank := ranks.get(token[before:end])) is not None:
                heapq.heappush(heap, (rank, before, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[token[at : ends[at]]])
            at = ends[at]
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(rank_file: bytes) -> Encoder:
    """The worker's encoder for this vocabulary, built once."""
    name = xxhash.xxh3_64_hexdigest(rank_file)
    if name not in _encoders:
        _encoders[name] = Encoder(rank_file)
    return _encoders[name]


def token_ids(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Rows ``(doc_id, ids)``: each text by the vocabulary, without special tokens.

    Defined cases: null and empty texts give an empty list; the spelling of a
    special token in a text is ordinary text; repeated rows are each given;
    other columns are not read. Texts are encoded whole, however long.
    """
    with open(vocabulary, "rb") as file:
        ranks = documents.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks.value)
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "ids"])

    return documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("text")).mapInArrow(encode, schema)
