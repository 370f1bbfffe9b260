import numpy as np

from scrivener.llm.neighbours import nearest, scan
from tests.llm.test_neighbours import DIMS, brute


def test_five_for_every_vector(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.standard_normal(DIMS) for i in range(500)}  # few have others of 0.8
    for i in range(500, 600):
        vectors[i] = vectors[rng.integers(500)] + 0.15 * rng.standard_normal(DIMS)
    for i in range(600, 620):
        vectors[i] = vectors[0]
    vectors = {i: np.float32(v) for i, v in vectors.items()}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, e array<float>")
    got = {(r.id, r.other, r.place) for r in nearest(df, "id", "e", 5, dims=DIMS).collect()}
    want = brute(vectors, 5, -2)
    assert len(got) == len(want) == 5 * len(vectors) and len(got & want) >= 0.99 * len(want)


def test_scan_without_floor():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    ids = np.arange(3000)
    i, j, s = scan(x[:100], x, ids[:100], ids, None, 5)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    full = np.round(u[:100] @ u.T, 6)
    full[np.arange(100), np.arange(100)] = -2
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(100) for b in np.lexsort((ids, -full[a]))[:5].tolist()}
    assert all(abs(full[a, b] - c) < 1e-9 for a, b, c in zip(i, j, s))


def test_many_lists_and_blocks(spark, monkeypatch):
    """Lists fitted in two steps, lists of several blocks, questions of several blocks."""
    from scrivener.llm import neighbours

    for name, value in (("BLOCK", 40), ("QUESTIONS", 70), ("GROUP_QUESTIONS", 200), ("FITTED_AT_ONCE", 8), ("SAMPLE_OF_LIST", 8)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    vectors = {i: np.float32(rng.standard_normal(DIMS)) for i in range(-300, 300)}
    for i in range(300, 700):
        vectors[i] = np.float32(vectors[int(rng.integers(300))] + 0.15 * rng.standard_normal(DIMS))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, e array<float>")
    got = {(r.id, r.other) for r in nearest(df, "id", "e", 5, 0.8, dims=DIMS).collect()}
    want = {(i, o) for i, o, _ in brute(vectors, 5, 0.8)}
    assert len(got & want) >= 0.95 * len(want)


def test_lists_grow_with_the_vectors():
    from scrivener.llm.neighbours import BLOCK, FITTED_AT_ONCE, _groups, fit_lists

    x = np.random.default_rng(6).standard_normal((3 * FITTED_AT_ONCE, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert abs(len(fit_lists(x, FITTED_AT_ONCE + 100)) - FITTED_AT_ONCE - 100) < 40 and len(fit_lists(x, 50)) == 50
    group_of, blocks, _ = _groups(np.array([10, BLOCK - 10, 1, 3 * BLOCK + 1, 5]), np.ones(5, np.int64))
    assert group_of.tolist() == [0, 0, 1, 2, 3] and blocks.tolist() == [1, 1, 4, 1]
