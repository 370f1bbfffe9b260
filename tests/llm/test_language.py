import numpy as np
from pyspark.sql import functions as F

from scrivener.llm.language import LANGUAGES, Model, count_grams, fit, infer, judge, label_language, languages, segment_languages, segments

SAMPLES = {
    "en": "The patient should take the tablet with water. This is not to be used by children. The dose was increased after a week.",
    "de": "Der Patient sollte die Tablette mit Wasser einnehmen. Das ist nicht für Kinder und wird bei Fieber gegeben. Die Dosis wurde nach einer Woche erhöht.",
    "fr": "Le patient doit prendre le comprimé avec de l'eau. Ce médicament ne doit pas être utilisé par les enfants. La dose a été augmentée dans une étude.",
    "es": "El paciente debe tomar la tableta con el agua. No se debe usar en los niños y las mujeres. La dosis fue aumentada por el médico en un estudio.",
    "it": "Il paziente deve prendere la compressa con gli alimenti. Non è per i bambini della scuola. La dose è stata aumentata dopo una settimana nel paziente.",
    "pt": "O paciente deve tomar o comprimido com a água. Não deve ser usado pelo doente em casa e na escola. A dose foi aumentada por um médico.",
    "nl": "De patiënt moet het tablet met water innemen. Dit is niet voor kinderen en wordt bij koorts gegeven. De dosis werd na een week verhoogd.",
    "ru": "Пациент должен принимать таблетку с водой. Это не для детей младшего возраста. Доза была увеличена через неделю.",
    "ja": "患者は水と一緒に錠剤を服用してください。これは子供には使用しないでください。用量は一週間後に増やされました。",
    "zh": "患者应当用水送服药片。本品不得用于儿童患者。剂量在一周之后增加。",
}


def model(spark):
    return fit(spark.createDataFrame([(t,) for t in SAMPLES.values()] * 3, "text string"))


def test_languages(spark):
    m = model(spark)
    mixed = SAMPLES["en"] + " " + SAMPLES["fr"] + "\n\n" + SAMPLES["zh"]
    rows = [*SAMPLES.items(), ("mixed", mixed), ("null", None), ("empty", ""), ("code", "0af3" * 2000), ("long", (SAMPLES["de"] + " ") * 500), ("en", SAMPLES["en"])]
    df = spark.createDataFrame(rows, "k string, text string").selectExpr("*", "1 as languages", "2 as lang")
    got = {}
    for r in languages(df, ["k"], "text", m).collect():
        got[r.k] = r.languages
    for k in LANGUAGES:
        assert [x.lang for x in got[k]] == [k] and got[k][0].confidence > 0.9
    assert {x.lang for x in got["mixed"]} == {"en", "fr", "zh"} and abs(sum(x.share for x in got["mixed"]) - 1) < 1e-9
    assert got["null"] == got["empty"] == [] and [x.lang for x in got["long"]] == ["de"]
    assert languages(df.limit(0), ["k"], "text", m).count() == 0


def test_names_and_headings_make_no_language(spark):
    m = model(spark)
    assert judge("VELQORA\n" + SAMPLES["de"] + " (in vivo)", m)[0] == ["de"]
    assert judge("Fachinformation\n" + SAMPLES["en"], m)[0] == ["en"]


def test_segments():
    assert segments("One line bro-\nken here. Next.\n\nThird | Fourth") == ["One line broken here.", "Next.", "Third", "Fourth"]
    assert all(len(s.split()) <= 13 for s in segments("word " * 100))


def test_inference_drops_what_costs_little():
    like = np.array([[-10.0, -50.0, -60.0], [-12.0, -11.5, -40.0], [-80.0, -90.0, -30.0]])
    p, r = infer(like, np.ones(3))
    assert p[1] == 0 and r.argmax(1).tolist() == [0, 0, 2]
    assert Model({}).likelihoods([])[0].shape == (0, len(LANGUAGES))


def test_labels(spark):
    rows = {"en_US": "en", " German ": "de", "zh-CN": "zh", "Japanese": "ja", "": None, "und": None, "n/a": None, "pt-BR": "pt", None: None, "??": None, "Español": "es"}
    df = spark.createDataFrame([(k,) for k in rows], "x string").select("x", label_language(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == rows


def test_stretches_of_one_language(spark):
    m = model(spark)
    rows = [(1, SAMPLES["en"] + " " + SAMPLES["fr"] + " 12 345. " + SAMPLES["en"]), (2, SAMPLES["de"]), (3, None), (4, ""), (5, "12 345")]
    got = [tuple(r) for r in segment_languages(spark.createDataFrame(rows, "k int, text string"), ["k"], "text", m).orderBy("k", "no").select("k", "no", "lang", "confidence").collect()]
    assert [r[:3] for r in got] == [(1, 1, "en"), (1, 2, "fr"), (1, 3, "en"), (2, 1, "de")] and all(r[3] > 0.9 for r in got)


def test_sentences_of_no_certain_language_count_with_their_text(spark):
    text = SAMPLES["pt"] + " Conservar abaixo de 25 graus."
    grams = {(r.lang, r.gram): r.n for r in count_grams(spark.createDataFrame([(text,)], "text string")).collect()}
    assert grams["pt", " ^c"] >= 2 and not any(k != "pt" for k, _ in grams)
