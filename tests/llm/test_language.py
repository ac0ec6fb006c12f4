import random
from collections import Counter

from pyspark.sql import functions as F

from quillstrata.llm import language as L

SENTENCES = {
    "en": "the river was measured before the winter and nobody expected this result|we found that the station keeps its own record of the water|should the team check the old survey again after the storm",
    "de": "der Fluss wurde vor dem Winter gemessen und niemand hat dieses Ergebnis erwartet|wir haben gefunden dass die Station eine eigene Liste des Wassers behält|soll die Gruppe nach dem Sturm die alte Aufnahme noch einmal prüfen",
    "fr": "la rivière a été mesurée avant l'hiver et personne n'attendait ce résultat|nous avons trouvé que la station garde sa propre liste de l'eau|faut-il que l'équipe vérifie encore le vieux relevé après la tempête",
    "sv": "floden mättes före vintern och ingen hade väntat sig detta resultat|vi har funnit att stationen behåller sin egen lista över vattnet|ska gruppen kontrollera den gamla kartläggningen igen efter stormen",
}
RNG = random.Random(3)


def passage(lang, n):
    return " ".join(RNG.choice(SENTENCES[lang].split("|")).capitalize() + "." for _ in range(n))


def corpus(spark):
    rows = [(i, passage(lang, 4), lang if i % 10 else ("sv" if lang != "sv" else "en")) for i, lang in enumerate(list(SENTENCES) * 40, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_segments(spark):
    rows, train = corpus(spark)
    model = L.fit(train)
    docs = [
        (1, passage("en", 5), "en-GB"), (2, passage("de", 5), "n/a"), (3, passage("fr", 3), "English"), (4, passage("en", 3) + "\n" + passage("sv", 1) + "\n" + passage("en", 2), "eng"),
        (5, None, "en"), (6, "", "en"), (7, "12.5\t33.1 --- a9010b377376380", "de"), (8, passage("en", 2) + " The word Fluss is foreign in this record of the station.", "EN"), (8, passage("en", 2), "EN"),
        (9, passage("fr", 3000), None),
    ]
    found = L.language_segments(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, seg_no int"), model).collect()
    main = {r.doc_id: r for r in found if r.seg_no == 0}
    assert {d: r.lang for d, r in main.items()} == {1: "en", 2: "de", 3: "fr", 4: "en", 8: "en", 9: "fr"}
    assert {d: r.label for d, r in main.items()} == {1: "en", 2: None, 3: "en", 4: "en", 8: "en", 9: None}
    assert [r.lang for r in sorted((r for r in found if r.doc_id == 4 and r.seg_no), key=lambda r: r.seg_no)] == ["en", "sv", "en"]
    assert all(r.segments == 1 for r in found if r.doc_id != 4) and all(0.5 < r.confidence <= 1 for r in found)
    # held-out accuracy, on labels of which a tenth were wrong
    reader = L.Reader(model)
    right = Counter(reader.stretches(passage(lang, 1))[0][2] == lang for lang in list(SENTENCES) * 25)
    assert right[True] >= 98
    assert L.language_segments(train.limit(0), model).count() == 0


def test_labels_and_backoff(spark):
    df = spark.createDataFrame([(x,) for x in ("en_US", " DE ", "français", "da", "", None, "xx", "sv-FI", "Portuguese")], "l string").select(L.label_language(F.col("l")).alias("x"))
    assert [r.x for r in df.collect()] == ["en", "de", "fr", None, None, None, None, "sv", "pt"]
    model = L.Model({**{l: Counter() for l in L.LANGUAGES}, "en": Counter({"winter": 9, "printer": 9}), "de": Counter({"zwischen": 9})})
    assert model.word("winter")[1] and not model.word("splinter")[1]
    assert model.word("splinter")[0][0] == max(model.word("splinter")[0]) and model.word("ŋŋ")[0] == (0.0,) * 8


def test_letters_decide():
    model = L.Model({**{l: Counter() for l in L.LANGUAGES}, "en": Counter({"winter": 900, "the": 900, "thinking": 900, "with": 900}), "de": Counter({"zwischen": 900, "schnee": 900, "fisch": 900})})
    reader = L.Reader(model)
    langs = lambda text: [x[2] for x in reader.stretches(text)]
    # one known word; words of which only the letters are known
    assert langs("Zwischen") == ["de"] and langs("winter") == ["en"]
    assert not any(model.word(w)[1] for w in "fischen mischen tischen wischen waschen".split())
    assert langs("Fischen mischen tischen.") == ["de"]
    # a sentence of two words among others, and a single word that makes none
    assert langs("With the winter thinking. Zwischen Schnee. The winter with thinking.") == ["en", "de", "en"]
    assert langs("With the winter thinking. Zwischen. The winter with thinking.") == ["en"]
    # nothing told apart
    assert langs("ŋŋ ŋŋŋ 12") == [] == langs("")
