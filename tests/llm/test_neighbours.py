import numpy as np

from scrivener.llm.neighbours import nearest, scan

DIMS = 16


def brute(vectors, k, least):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = set()
    for a, i in enumerate(ids):
        s = np.round(x @ x[a], 6)
        order = [b for b in np.lexsort((ids, -s)) if b != a and s[b] >= least][:k]
        out |= {(int(i), int(ids[b]), p) for p, b in enumerate(order, 1)}
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.standard_normal(DIMS) for i in range(600)}
    for i in range(600, 900):
        vectors[i] = vectors[rng.integers(600)] + 0.15 * rng.standard_normal(DIMS)
    hot = rng.standard_normal(DIMS)
    for i in range(900, 1300):  # a third of all rows is one vector
        vectors[i] = hot
    vectors = {i: np.float32(v) for i, v in vectors.items()}
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(5, vectors[5].tolist())]
    rows += [(2000, None), (2001, []), (2002, [0.0] * DIMS), (2003, [float("nan")] * DIMS), (2004, [1.0]), (None, [1.0] * DIMS)]
    df = spark.createDataFrame(rows, "id long, e array<float>").selectExpr("*", "1 as rep", "2 as v", "3 as h1")
    got = {(r.id, r.other, r.place) for r in nearest(df, "id", "e", 5, 0.8, dims=DIMS).collect()}
    want = brute(vectors, 5, 0.8)
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.03 * len(got)
    assert all((i, o, p) in got for i, o, p in want if i >= 900)


def test_empty(spark):
    assert nearest(spark.createDataFrame([], "id long, e array<float>"), "id", "e", 5, 0.8, dims=DIMS).count() == 0


def test_scan_against_all_pairs():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[1500:] = x[:1500] + 0.3 * rng.standard_normal((1500, 64)).astype(np.float32)
    ids = np.arange(3000)
    i, j, s = scan(x[:200], x, ids[:200], ids, 0.8, 5)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    full = np.round(u[:200] @ u.T, 6)
    full[np.arange(200), np.arange(200)] = -1
    want = {(a, b) for a, b in zip(*np.nonzero(full >= 0.8))}
    assert len(want & set(zip(i.tolist(), j.tolist()))) >= 0.97 * len(want)
    assert all(abs(full[a, b] - c) < 1e-9 for a, b, c in zip(i, j, s))
