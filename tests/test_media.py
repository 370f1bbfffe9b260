from pyspark.sql import functions as F

from scrivener.functions import evidence, media

SEGMENT = "struct<start:string,end:string,text:string,avg_logprob:string,no_speech_prob:string,compression_ratio:string>"


def test_segments(spark):
    rows = [(1, [("-1", "2.5", "hello good team", "-0.3", "0.1", "1.2"), ("3", "x", "aaaaaaaaaaaa", "-0.3", None, None)], "raw"), (2, [], " raw  text "), (3, [("0", "9", "ok", "-2", "0", "1")], "raw")]
    df = spark.createDataFrame(rows, f"k int, s array<{SEGMENT}>, raw string")
    out = {r.k: r for r in df.select("k", media.segments(F.col("s")).alias("s"), media.usable_text(F.col("s"), F.col("raw")).alias("t"), media.duration(F.col("s")).alias("d"), media.speech_confidence(F.col("s")).alias("c")).collect()}
    assert (out[1].s[0].start, out[1].s[0].end, out[1].s[0].confidence) == (0.0, 2.5, 0.7) and out[1].s[1].end == 3.0
    assert out[1].t == "hello good team" and out[2].t == "raw text" and out[3].t == ""
    assert out[1].d == 2.5 and out[2].d == 0.0 and out[2].c == 0.0 and 0.9 < out[1].c <= 1


def test_frames(spark):
    rows = [("v", 0.0, [0.0, 0.0]), ("v", 1.0, [1.0, 1.0]), ("v", 2.0, [90.0, 90.0]), ("v", 3.0, [0.5, 0.5]), ("v", 4.0, [200.0, 100.0]), ("w", None, [1.0]), ("w", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, at double, s array<double>")
    got = [(r.k, r["at"], r.reason) for r in media.chosen_frames(df, "k", "at", "s").orderBy("at").collect()]
    assert got == [("v", 0.0, "first"), ("v", 2.0, "scene"), ("v", 4.0, "scene")]


def test_pages(spark):
    df = spark.createDataFrame([(1, "intro\nPAGE 1 - One\na\nb\nPage No: 2\nc"), (2, None), (3, "plain")], "k int, text string")
    assert [(r.k, r.page_no, r.title, r.text) for r in media.page_texts(df, "k", "text").orderBy("k", "page_no").collect()] == [
        (1, 0, None, "intro"), (1, 1, "One", "a\nb"), (1, 2, None, "c"), (3, 0, None, "plain")]


def test_evidence(spark):
    rows = [(1, "Zorvex lowers pain quickly.\nNothing here\nZorvex LOWERS pain, quickly!\nThe renal function values", "Zorvex", "renal function"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "k int, text string, brand string, message string")
    got = {r.k: r.description for r in evidence.evidence_lines(df, "k", "text", "brand", "message").collect()}
    assert got == {1: "Zorvex lowers pain quickly.; The renal function values"}
    text = " ".join(f"This is sentence number {i}." for i in range(9))
    p = spark.createDataFrame([(text,), (None,)], "t string").select(evidence.points(F.col("t")).alias("p")).collect()
    assert len(p[0].p) == 3 and p[0].p[0].title == "This is sentence number 0. This is"[:len(p[0].p[0].title)] and p[1].p == []
    m = spark.createDataFrame([("whisper", None), ("ocr", "x"), ("keywords", ""), (None, None)], "a string, b string")
    assert [r.m for r in m.select(evidence.metric_of(F.col("a"), F.col("b")).alias("m")).collect()] == ["word_error", "word_accuracy", "f1", "similarity"]
    b = spark.createDataFrame([("acme plus", "Acme"), ("", "Acme"), (None, None)], "a string, b string")
    assert [r.m for r in b.select(evidence.possible_brand(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, False]
