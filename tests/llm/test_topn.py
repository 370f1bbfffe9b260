import random

from scrivener.llm.topn import top_n

SCHEMA = "k string, s double, i long"


def test_like_brute_force_with_hot_group(spark):
    random.seed(3)
    rows = [("hot" if random.random() < 0.6 else random.choice(["a", "b", None]), random.choice([None, float("nan"), -0.0, 0.0, 0.5, 0.75, 1.0]), i) for i in range(2000)]
    rows += random.sample(rows, 100)
    got = {}
    for r in top_n(spark.createDataFrame(rows, SCHEMA), ["k"], "s", "i", 5).collect():
        got.setdefault(r.k, []).append((r.place, r.i))
    for k in ("hot", "a", "b", None):
        good = sorted({(-(s + 0.0), i) for g, s, i in rows if g == k and s is not None and s == s})
        assert sorted(got[k]) == [(p, i) for p, (_, i) in enumerate(good[:5], 1)]


def test_edges(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), ["k"], "s", "i", 5).count() == 0
    df = spark.createDataFrame([("x", 1.0, 7), ("x", 1.0, 7), ("y", 1.0, None), ("z", None, 1)], SCHEMA).selectExpr("*", "9 as place", "1 as salt", "2 as t", "3 as r")
    out = top_n(df, ["k"], "s", "i", 3).collect()
    assert [(r.k, r.i, r.place) for r in out] == [("x", 7, 1)]
    assert top_n(df, ["k"], "s", "i", 0).count() == 0
