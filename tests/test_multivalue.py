import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstrata.operators.multivalue import exploded_values, split_packed

CASES = {
    '"Borodu, Buza","Mulo, Buji ""Dize"""': ["Borodu, Buza", 'Mulo, Buji "Dize"'],
    "Holo Kída\r\nZopa Jipi\r\n": ["Holo Kída", "Zopa Jipi"],
    "Soju Siri;; Piki Bife;;": ["Soju Siri", "Piki Bife"],
    "Minapa Institute for Tides and Ice; Mazi Hamaru": ["Minapa Institute for Tides and Ice", "Mazi Hamaru"],
    "Minapa Institute for Tides and Ice and Mazi Hamaru": ["Minapa Institute for Tides and Ice", "Mazi Hamaru"],
    "Foso, D.S., Banu, F.": ["Foso, D.S.", "Banu, F."],
    "Togu S, O'Gokaja TT": ["Togu S", "O'Gokaja TT"],
    "de la Hotagu, Jora": ["de la Hotagu, Jora"],
    "Sapi Hopo, Mubi Bazitu, et al.": ["Sapi Hopo", "Mubi Bazitu"],
    "Tofe Rapako, Zigi Menu Vupuri, Hijo Bedu et Rosa Jineju": ["Tofe Rapako", "Zigi Menu Vupuri", "Hijo Bedu", "Rosa Jineju"],
    "Gihi Rezeju et al.": ["Gihi Rezeju"],
    '["L\\u00eddi, Gegu", "Nafi \\"N\\" Gobi"]': ["Lídi, Gegu", 'Nafi "N" Gobi'],
    "(1) Ziju Tepaga (2) Hope Naja": ["Ziju Tepaga", "Hope Naja"],
    "(999) Aa Bb (1000) Cc Dd (x) (12a)": ["Aa Bb", "Cc Dd (x) (12a)"],
    "1024. Ziju Tepaga\n1025. Hope Naja": ["Ziju Tepaga", "Hope Naja"],
    "Joje al-Nude, Hato Zofebu": ["Joje al-Nude", "Hato Zofebu"],
    "al-Nude, Joje": ["al-Nude, Joje"],
    "Joje d'Arelo, Hato Zofebu": ["Joje d'Arelo", "Hato Zofebu"],
    "{Riba, Nesu}, {Vimite, Zoju}": ["Riba, Nesu", "Vimite, Zoju"],
    "Fife Lokaje, and Nusu Dunulu": ["Fife Lokaje", "Nusu Dunulu"],
    "Neho Dazogo • Pabo Padahi": ["Neho Dazogo", "Pabo Padahi"],
    "Mizi Zezoje；Golidi Observatory": ["Mizi Zezoje", "Golidi Observatory"],
    "n/a": [], " ": [], "": [], "-": [], "et al.": [],
    'Open "quote': ['Open "quote'],
}


def test_cases_together_and_alone():
    texts = list(CASES)
    assert split_packed(pa.array(texts)).to_pylist() == list(CASES.values())
    for text, wanted in CASES.items():
        assert split_packed(pa.array([text])).to_pylist() == [wanted]
    assert split_packed(pa.array([None, "", None], pa.string())).to_pylist() == [[], [], []]
    assert split_packed(pa.array(["A B", "C D;E F", "G H"]).slice(1)).to_pylist() == [["C D", "E F"], ["G H"]]


NAME = st.tuples(st.sampled_from(["Kegi", "Ámo", "Vufu"]), st.sampled_from(["Teza", "Bijo-Ra", "Lo"])).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(NAME, min_size=1, max_size=9), st.sampled_from(["; ", ";", " | ", "\n", "\t", " · ", ", ", " / ", " & "])), min_size=1, max_size=8))
def test_round_trip(rows):
    assert split_packed(pa.array([sep.join(names) for names, sep in rows])).to_pylist() == [names for names, _ in rows]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='ab"{}[];,\n\\é ()1&', max_size=30), max_size=6))
def test_never_breaks(rows):
    assert len(split_packed(pa.array(rows, pa.string()))) == len(rows)


def test_rows(spark):
    df = spark.createDataFrame([(1, "A B; C D", "x"), (1, "A B; C D", "x"), (2, None, None), (3, "A B" + "; A B" * 50_000, "")], "id long, authors string, author string")
    rows = exploded_values(df, "id", "authors", "source_id", "author").collect()
    assert sorted((r.source_id, r.position, r.author) for r in rows if r.source_id < 3) == [(1, 1, "A B")] * 2 + [(1, 2, "C D")] * 2
    assert sum(r.source_id == 3 for r in rows) == 50_001
    assert exploded_values(df.limit(0), "id", "authors", "source_id", "author").count() == 0


if __name__ == "__main__":
    pytest.main([__file__])
