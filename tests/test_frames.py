from pyspark.sql import functions as F

from scrivener.functions.frames import clean_token, frame_blocks, frame_content, is_frame_noise, is_product_line, is_repetitive, is_weak_caption
from scrivener.functions.media import sampled_frames
from scrivener.functions.quality import completeness
from scrivener.functions.text import clock_parts, seeded_keywords, short_clock


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_blocks(spark):
    text = "intro\n00:05 Frame 1: Stop pain.\nStop pain\nAsk us;\nFrame 2:\nstop PAIN\nask us\nFrame 3: New"
    want = "00:05 Frame 1: On-screen content shows Stop pain; Ask us.\nFrame 3: On-screen content shows New."
    assert frame_blocks(text) == want and column(spark, [text, None, "", "no label"], frame_content) == [want, "", "", ""]
    assert len(frame_blocks("\n".join(f"Frame {i}: line {i}" for i in range(20))).split("\n")) == 6


def test_lines(spark):
    assert column(spark, ["", "0af3" * 9, "aaaaaaaaaa", "1234 " * 12, "Ask your doctor"], is_frame_noise) == [True, True, True, True, False]
    assert column(spark, ["Zorvex Cream", "visible content", "take one tablet of it every day now please", "plain words here", "Zorvex"], is_product_line) == [True, False, False, False, True]
    assert column(spark, ["N/A", "I don't know it", "poster", "a photo of two people", None], is_weak_caption) == [True, True, True, False, True]
    assert column(spark, ["one two", "a b a c a d a", "the patient takes one tablet", None], is_repetitive) == [True, True, False, True]
    assert column(spark, ["(Treatment,", "xkcdqrst", "of", "5mg", "A", "trea-t", ""], clean_token) == ["Treatment", "", "", "5mg", "", "", ""]


def test_shapes(spark):
    assert column(spark, [59.9, 61.0, 0.0], short_clock, "double") == ["0:59", "1:01", "0:00"] and column(spark, ["01:05 x", "x", None], clock_parts) == [65, None, None]
    df = spark.createDataFrame([(3, 4), (0, 0), (95, 100)], "a int, b int").select(completeness(F.col("a"), F.col("b")).alias("c"))
    assert [tuple(r.c) for r in df.collect()] == [(75.0, "Some elements failed to extract"), (0.0, "Some elements failed to extract"), (95.0, None)]
    rows = spark.createDataFrame([(["Zorvex"], ["zorvex tablet", "renal function"]), (None, ["renal function", "renal"])], "s array<string>, f array<string>")
    assert [r.k for r in rows.select(seeded_keywords(F.col("s"), F.col("f"), 2).alias("k")).collect()] == [["zorvex", "renal function"], ["renal function"]]


def test_frames_at_intervals(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 0.5, 2.1, 3.9, 4.0, None)] + [("b", 7.0)], "k string, at double")
    assert sorted(map(tuple, sampled_frames(df, "k", "at", 2.0).collect())) == [("a", 0.0), ("a", 2.1), ("a", 4.0), ("b", 7.0)]
