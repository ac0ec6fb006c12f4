import random
from pathlib import Path

import pytest

from quillstrata.llm.bpe import PATTERN, TOKENIZERS, Encoder, PerfectHash, token_ids

RANKS = Path(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not RANKS.exists(), reason="no vocabulary")


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.open("rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash():
    keys = [f"key {i}".encode() for i in range(5000)]
    table = PerfectHash(keys)
    assert sorted(table.places(PerfectHash.hashes(keys))) == list(range(5000))
    assert len(PerfectHash([]).places(PerfectHash.hashes([b"x"]))) == 1
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"])


def test_same_ids_as_reference():
    other, own, rng = reference(), Encoder(RANKS.read_bytes()), random.Random(1)
    texts = ["", " ", "\n\n", "<|endoftext|>", "don't  stop", "漢字かな", "👩‍🔬 naïve ½", "a" * 3000, "ab" * 20_000, " \t\r\n x"]
    texts += ["".join(rng.choice("abcdeéß漢 \n'st123-_​") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    assert own.encode(texts) == [other.encode_ordinary(t) for t in texts]
    assert own.encode([None, ""]) == [[], []]


def test_rows(spark):
    df = spark.createDataFrame([(1, "one text", "x"), (1, "one text", "x"), (2, None, None), (3, "", "")], "doc_id long, text string, ids string")
    rows = sorted((r.doc_id, list(r.ids)) for r in token_ids(df).collect())
    assert rows == [(1, reference().encode_ordinary("one text"))] * 2 + [(2, []), (3, [])]
    assert token_ids(df.limit(0)).count() == 0
