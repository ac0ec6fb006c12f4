import random

import numpy as np

from quillstrata.llm import leakage as L

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("abcdefghijklmnop", k=RNG.randint(2, 9))) for _ in range(900)]


def text(n):
    return " ".join(RNG.choices(WORDS, k=n))


ITEMS = [(i, text(60)) for i in range(1, 21)]


def test_suffix_array_and_longest_matches_against_brute_force():
    for letters, most in (("abcd", 12), ("ab", 9), ("abcdefgh" * 3, 30)):
        tests = L.Tests([(i, " ".join(RNG.choices(letters, k=RNG.randint(1, most)))) for i in range(4)])
        docs = [(i, " ".join(RNG.choices(letters + "z", k=RNG.choice([0, 1, 5, 90])))) for i in range(8)]
        shard = L.Shard([*docs, docs[-1]], tests)
        text = shard.text.tolist()

        def run(flat, at):
            out = []
            while flat[at]:
                out.append(flat[at])
                at += 1
            return out

        found = [run(text, at)[: tests.longest] for at in shard.order.tolist()]
        assert found == sorted(found) and sorted(shard.order.tolist()) == [i for i, w in enumerate(text) if w]
        agree = lambda x, y: next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        longest = [max((agree(run(tests.text.tolist(), q), run(text, at)) for at in shard.order.tolist()), default=0) for q in tests.suffixes.tolist()]
        assert longest == shard.longest.tolist()


def exact(passage, text):
    """Words spanned by the alignment of the whole passage with the whole text: no index, no bound, no window."""
    tests = L.Tests([(1, passage)])
    numbers = np.array([tests.numbers.get(w, 0) for w in L.plain_words(text)])
    return L.spanned([tests.passage(0)], [numbers], [int(tests.least[0])])[0], tests


def test_search_loses_nothing_of_the_alignment():
    """Edits at every second to tenth word, passages and second stretches of one to five words, chance echoes."""
    texts = []
    for n in (1, 2, 3, 4, 5, 7, 20, 60):
        for _ in range(6):
            p = RNG.choices(WORDS[:60], k=n)
            other = lambda k: RNG.choices(WORDS[:90], k=k)
            for every in range(2, 11):
                changed = [w if (i + 1) % every else "changed" for i, w in enumerate(p)]
                dropped = [w for i, w in enumerate(p) if (i + 1) % every]
                added = [x for i, w in enumerate(p) for x in ([w, "added"] if not (i + 1) % every else [w])]
                for form in (changed, dropped, added):
                    texts.append((p, other(30) + form + other(20)))
            for second in range(1, 6):
                first = max(0, -(-n // 2) - second)
                texts.append((p, other(9) + p[:first] + other(40) + p[n - second :] + other(9)))
            texts += [(p, other(200)), (p, p), (p, p[: n // 2] + p[: n // 2]), (p, [])]
    leaks = 0
    for p, words in texts:
        passage, text = " ".join(p), " ".join(words)
        held, tests = exact(passage, text) if words else (0, L.Tests([(1, passage)]))
        wanted = [(5, 1, held, len(p))] if held >= len(p) / 2 else []
        assert L.leaks_in_shard([(5, text)], tests) == wanted, (passage, text)
        leaks += bool(wanted)
    assert leaks > len(texts) / 3


def test_every_third_word_changed_is_a_leak():
    p = [f"p{i}" for i in range(60)]
    assert found(p, [w if (i + 1) % 3 else "x" for i, w in enumerate(p)]) == 59
    assert found(p, [w if (i + 1) % 2 else "x" for i, w in enumerate(p)]) is None


def test_chains_bound_single_stretches():
    for _ in range(60):
        p, text = RNG.choices("abcdefg", k=30), RNG.choices("abcdefgh", k=80)
        tests = L.Tests([(1, " ".join(p))])
        shard = L.Shard([(1, " ".join(text))], tests)
        if not list(shard.candidates()):
            continue
        _, at, place, words = shard.runs(0, np.array([0]))
        widest = max(int(w.max()) for w in L._widest(tests.passage(0)[None], shard.text[None, : len(text)], np.array([[3]])))
        assert max(L.chains(at, place, words)[0]) >= widest


def test_a_stock_phrase_stays_small():
    """Thousands of passages and texts share a phrase: five million pairs of places, each counted by its documents only."""
    import tracemalloc

    stock = " ".join(f"stock{i}" for i in range(7))
    unique = lambda k, n: " ".join(f"{k}x{n}x{i}" for i in range(30))
    tests = L.Tests([(i, f"{unique('p', i)} {stock} {unique('q', i)}") for i in range(1000)])
    docs = [(i, f"{unique('d', i)} {stock}") for i in range(5000)]
    tracemalloc.start()
    assert L.leaks_in_shard(docs, tests) == []
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_blocks_of_items(spark):
    items = spark.createDataFrame([(i, text(20)) for i in range(30)] + [(99, text(2000)), (98, None)], "item_id long, passage string")
    blocks = list(L.item_blocks(items, "item_id", "passage", 1500))
    assert len(blocks) > 2 and sorted(i for b in blocks for i, _ in b) == [*range(30), 99]
    assert all(len(b) == 1 or sum(len(p) for _, p in b) <= 1500 for b in blocks)
    assert list(L.item_blocks(items.limit(0), "item_id", "passage")) == []


def test_planted(spark):
    docs, wanted = [], set()
    for n, (item, passage) in enumerate(ITEMS):
        words = passage.split()
        edited = [w if RNG.random() > 0.1 else "changed" for w in words]
        half = len(words) // 2
        forms = [
            (passage.upper(), True),
            (" ".join(edited), True),
            ("**" + " ".join(words[:33]).replace(" ", "\n> ") + "**", True),
            (" ".join(words[:20]) + " " + text(40) + " " + " ".join(words[22:42]), True),
            ("<p>" + "-\n".join([" ".join(words)[:50], " ".join(words)[50:]]) + "</p>", True),
            (" ".join(words[: half - 9]), False),
            (" ".join(x for w in words for x in (w, RNG.choice(WORDS))), False),
            (text(60), False),
        ]
        for k, (form, leaked) in enumerate(forms):
            docs.append((100 * n + k, text(30) + ". " + form + ". " + text(25), "clash"))
            if leaked:
                wanted.add((100 * n + k, item))
    docs += [(9001, None, ""), (9002, "", ""), (9003, "--- ...", ""), docs[0], (9004, text(200_000) + " " + ITEMS[3][1] + " " + text(10), "")]
    wanted.add((9004, ITEMS[3][0]))
    corpus = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, (98, None), (99, "two words")], "item_id long, passage string")
    leaks = L.leaked_items(corpus, items)
    rows = leaks.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == wanted and len(rows) == len(wanted) + 1  # the repeated document
    assert corpus.count() - L.without_leaks(corpus, leaks).count() == len(wanted) + 1
    assert L.leaked_items(corpus.limit(0), items).count() == 0 and L.leaked_items(corpus, items.limit(0)).count() == 0


def test_plain_words():
    assert L.plain_words("Left‑handed of­ficer, **c​afé** &amp; ﬁne <b>x</b>\\nunter\\u00fcck unea-\nrthed") == "lefthanded officer cafe fine x unteruck unearthed".split()


def found(passage, *parts):
    """Words spanned of a passage by a document of these parts; none if it is no case."""
    rows = L.leaks_in_shard([(1, " ".join(" ".join(part) for part in parts))], L.Tests([(1, " ".join(passage))]))
    return rows[0][2] if rows else None


def test_repeated_parts():
    p, other = [f"p{i}" for i in range(76)], [f"o{i}" for i in range(700)]
    # two copies of one part and the other part far from both; a longer second part before and after the first
    assert found(p, p[:24], other[:10], p[:24], other[10:110], p[40:56]) == 40
    assert found(p, p[:24], other[:600], p[40:56], other[600:650], p[:24]) == 40
    assert found(p, p[40:64], other[:9], p[:20], other[9:18], p[40:60]) == 40
    # a wider stretch with edits beside a shorter one that scores more
    assert found(p, p[:9], other[:1], p[10:19], other[1:2], p[20:28], other[2:90], p[:22], other[90:99], p[50:62]) == 40
    # the wrong order, and the same words twice, are no case
    assert found(p, p[40:60], other[:30], p[:20]) is None
    assert found(p, p[:25], other[:40], p[:25], other[40:90], p[10:30]) is None


def test_short_second_stretch():
    p, other = [f"p{i}" for i in range(76)], [f"o{i}" for i in range(99)]
    assert found(p, p[:33], other[:30], p[50:55]) == 38
    # two changed words in the ten of the second stretch
    assert found(p, p[:30], other[:30], p[50:53], other[31:32], p[54:56], other[32:33], p[57:60]) == 40
    assert found(p, p[:32], other[:30], p[50:55]) is None
    # words that stand alone make no stretch
    assert found(p, p[:36], other[:30], p[50:52]) is None


def test_clean_corpus_is_whole(spark):
    import pytest
    from quillstrata.llm import registry
    from quillstrata.sources.tables import table

    folder = "/root/testdata/sf0.001"
    try:
        documents = table(spark, folder, "documents")
    except Exception:
        pytest.skip("no test tables")
    leaked = {r.doc_id for r in registry.p8_found(spark, folder).collect()}
    clean = registry.p8_clean(spark, folder)
    assert clean.columns == documents.columns and leaked
    assert {r.doc_id: r for r in clean.collect()} == {r.doc_id: r for r in documents.collect() if r.doc_id not in leaked}
