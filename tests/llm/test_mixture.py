import numpy as np

from scrivener.llm.mixture import mix, pivotal, plan, report


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 100, 50).astype(float)
    p = rng.random(50)
    total = np.zeros(50)
    for i in range(3000):
        out = pivotal(p, size, np.random.default_rng(i))
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        total += out
    assert np.abs(total / 3000 - p).max() < 0.05


def test_plan():
    shares = plan({"a": (10, 1000), "b": (10, 100)}, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 9), ("d", None, 1)])
    by = {s.source: s for s in shares}
    assert by["c"].copies == by["d"].copies == 0 and by["b"].copies == 2
    assert abs(by["a"].copies * 1000 / (by["b"].copies * 100) - 5 / 3) < 1e-9


def test_mixture(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    docs = [(i, "big" if i % 3 else "small", " ".join(words[: 1 + i % 8]) + f" {i}") for i in range(3000)]
    docs += [(5000 + i, "small", docs[0][2]) for i in range(50)] + [(6000, "big", None), (6001, "big", ""), (6002, None, "x"), (6003, "other", "y")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "1 as n_tokens", "2 as copies", "3 as p", "4 as bucket")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("none", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix(d, t)
    rows = {r.source: r for r in report(chosen, shares).collect()}
    assert set(rows) == {"big", "small", "none"} and rows["none"].actual_share == 0
    assert abs(rows["big"].actual_share - 5 / 9) < 0.002 and abs(rows["small"].actual_share - 4 / 9) < 0.002
    picked = chosen.collect()
    assert max(r.copies for r in picked if r.source == "small") == 2 and all(r.copies == 1 for r in picked if r.source == "big")
    assert len({r.doc_id for r in picked}) == len(picked) and not any(r.doc_id >= 5000 for r in picked)
    assert sorted((r.doc_id, r.copies) for r in mix(d, t)[0].collect()) == sorted((r.doc_id, r.copies) for r in picked)
    assert mix(d.limit(0), t)[0].count() == 0 and mix(d, t.limit(0))[0].count() == 0
