import random

from pyspark.sql import functions as F

from scrivener.functions import correction, metrics, quality, text
from scrivener.operators.dedup import distinct_parts
from scrivener.operators.matching import alias_positions, correct_words, cosine_best, fuzzy_brands, tfidf_best
from scrivener.operators.tables import missing, newest, page_of, soft_delete, upsert


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_cleaning(spark):
    assert one(spark, "a\r\nb \t c\n\n\n\nd \n", text.clean_text) == "a\n\nb c\n\nd"
    assert one(spark, None, text.clean_text) == "" and one(spark, " 　\x1c\n", text.clean_text) == ""
    assert one(spark, "Größe: 5 MG!", text.metric_text) == "gr e 5 mg"
    assert one(spark, "ab cd efgh", lambda c: text.trim_to_word(c, 7)) == "ab cd..."
    assert one(spark, "abcdefgh", lambda c: text.trim_to_word(c, 3)) == "abc..."
    assert one(spark, "One. Two! Three\nFour", text.sentences) == ["One.", "Two!", "Three", "Four"]
    assert one(spark, "x\nACME PLUS (5 MG)\ny", text.first_caps_line) == "acme plus"
    assert one(spark, "a/B.C.Pdf", text.extension) == ".pdf"
    assert one(spark, 125.5, text.clock, "double") == "02:06"


def test_windows_and_ngrams(spark):
    w = one(spark, [str(i) for i in range(40)], lambda c: text.windows(c, 45, 10), "array<string>")
    assert [len(x.split()) for x in w] == [40, 5]
    assert one(spark, [], lambda c: text.windows(c, 45, 10), "array<string>") == []
    assert one(spark, ["a", "b", "c"], lambda c: text.ngrams(c, 2, 4), "array<string>") == ["a b", "b c", "a b c"]


def test_terms(spark):
    assert one(spark, "50% of", lambda c: text.has_any(c, ["%"])) is False
    assert one(spark, "side effect seen", lambda c: text.has_any(c, ["side effect", "xx"])) is True
    assert one(spark, "A-B", text.brand_aliases) == ["a-b"]
    assert one(spark, "Zorvex (Tablets)", text.brand_aliases) == ["zorvex (tablets)", "zorvex"]
    assert one(spark, ["adults video", "Blue sky!", "sky", "blue sky high", "x y"], lambda c: text.distinct_keywords(c, 5), "array<string>") == ["blue sky", "x y"]
    assert one(spark, ["a", "b", "c"], text.listed, "array<string>") == "a, b, and c"


def test_quality(spark):
    assert one(spark, "", quality.text_quality) == 0.0 and one(spark, "!!!", quality.text_quality) == 5.0
    assert one(spark, "", quality.noise_ratio) == 1.0
    assert one(spark, "a a a a a a", quality.is_garbage_transcript) and not one(spark, "The patient takes it daily", quality.is_garbage_transcript)
    assert one(spark, "| .", quality.is_noise_line) and not one(spark, "Readable words", quality.is_noise_line)
    row = spark.createDataFrame([("hello good people", "0.7", "-0.9", None)], "t string, a string, b string, c string")
    assert row.select(quality.is_usable_segment(F.col("t"), F.col("a"), F.col("b"), F.col("c")).alias("y")).first().y is False


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    random.seed(1)
    pairs = [("", ""), ("", "x"), ("a b c d", "a b x d"), ("a", "a b c"), (None, "y")]
    pairs += [(" ".join(random.choices("abcdef", k=random.randint(0, 12))), " ".join(random.choices("abcdef", k=random.randint(0, 12)))) for _ in range(40)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = metrics.word_rates(df, metrics.evaluation_tokens(F.col("a")), metrics.evaluation_tokens(F.col("b")), "r")
    df = metrics.token_f1(df, F.col("a"), F.col("b"), "f1").withColumn("cer", metrics.cer(F.col("a"), F.col("b")))
    for r in df.collect():
        a, b = (r.a or "").split(), (r.b or "").split()
        want = 0.0 if not a and not b else 1.0 if not a else distance(a, b) / len(a)
        assert abs(r.r - want) < 1e-12
        common = sum(min(a.count(w), b.count(w)) for w in set(a))
        f1 = 100.0 if not a and not b else 0.0 if not a or not b or not common else round(200 * common / (len(a) + len(b)), 2)
        assert abs(r.f1 - f1) < 0.011
    assert [r.cer for r in df.orderBy("i").collect()][:2] == [0.0, 1.0]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [round(r.y, 6) for r in df.select(metrics.cosine(F.col("a"), F.col("b")).alias("y")).collect()] == [0.707107, 0.0, 0.0, 0.0]


def test_correction(spark):
    rules = [("vv", "w", "word_start"), ("0", "o", "word_only"), ("1", "l", "between_vowels"), ("|", "I", "any")]
    assert one(spark, "vvord b0dy 100 a1a |", lambda c: correction.apply_rules(c, rules)) == "word body 100 ala I"
    assert one(spark, "10 mg and 5 MLx", lambda c: correction.join_dosage(c, ["mg", "ml"])) == "10mg and 5 MLx"
    assert correction.indel_ratio("abcd", "abxd") == 75.0 and correction.indel_ratio("", "") == 100.0


def test_distinct_parts(spark):
    df = spark.createDataFrame([(1, ["A b", "a B!", "", "c"]), (2, None), (3, [])], "k int, p array<string>")
    assert {r.k: r.p for r in distinct_parts(df, "p", text.line_key).collect()} == {1: ["A b", "c"], 2: [], 3: []}


def test_tables(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c"), (None, 3, "d")], "k int, t int, v string")
    best = newest(df, ["k"], ["t"])
    assert {r.k: r.v for r in best.collect()} == {1: "b", 2: "c", None: "d"}
    new = spark.createDataFrame([(1, 9, "x"), (5, 9, "y"), (None, 9, "z")], "k int, t int, v string")
    assert {r.k: (r.t, r.v) for r in upsert(best, new, ["k"], keep=["t"]).collect()} == {1: (2, "x"), 2: (None, "c"), 5: (9, "y"), None: (3, "z")}
    assert [r.k for r in missing(new, df, "k").where("k is not null").collect()] == [5]
    assert page_of(df, [F.asc("v")], 1, 2).select("v").toPandas().v.tolist() == ["b", "c"]
    gone = soft_delete(df.withColumn("active", F.lit(True)), F.col("k") == 1)
    assert gone.where("not active").count() == 2


def test_matching(spark):
    units = spark.createDataFrame([(1, "Use Zorvex now, zorvexx"), (2, None), (3, "xzorvex zorvqx")], "id int, text string")
    assert {r.id: r.position for r in alias_positions(units, "id", "text", ["zorvex"]).collect()} == {1: 4}
    names = spark.createDataFrame([("zorvex",)], "alias string")
    assert {r.id: round(r.score, 2) for r in fuzzy_brands(units, "id", "text", names).collect()} == {1: 1.0, 3: 1.0}
    words = spark.createDataFrame([("treatmant",), ("abc",), ("x9yz",), ("patient",)], "word string")
    terms = spark.createDataFrame([("treatment",), ("patients",)], "term string")
    assert {r.word: r.best for r in correct_words(words, terms).collect()} == {"treatmant": "treatment", "patient": "patients"}
    q = spark.createDataFrame([(7, "renal function monitoring")], "q int, text string")
    c = spark.createDataFrame([(1, "renal function"), (2, "other words"), (3, None)], "c int, text string")
    assert [r.c for r in tfidf_best(q, c, "q", "c", "text", 2, 0.05).collect()] == [1]
    a = spark.createDataFrame([(1, [1.0, 0.0])], "a long, v array<float>")
    b = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [float("nan"), 1.0])], "b long, v array<float>")
    assert [(r.b, r.place) for r in cosine_best(a, b, "a", "v", "b", "v", 2, 2).orderBy("place").collect()] == [(2, 1), (3, 2)]
