import numpy as np

from srcatlas.llm import neighbours as N

SCHEMA = "id string, vector array<float>, cosine string"


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8 + 1, N.DIMENSION))
    return (centres[rng.integers(0, len(centres), n)] + 0.35 * rng.standard_normal((n, N.DIMENSION))).astype(np.float32)


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, r in enumerate(np.argsort(-s, 1)[:, :k]) for j in r}


def test_recall_against_brute_force(spark):
    x = clustered(3000)
    ids = [f"{i:05}" for i in range(len(x))]
    rows = [(i, v.tolist(), "c") for i, v in zip(ids, x)]
    rows += rows[:50] + [
        ("n1", None, ""),
        ("n2", [], ""),
        ("n3", [0.0] * N.DIMENSION, ""),
        ("n4", [1.0] * 64, ""),
        ("n5", [float("nan")] * N.DIMENSION, ""),
        ("n6", [float("inf")] * N.DIMENSION, ""),
        (None, x[0].tolist(), ""),
    ]
    got = {tuple(r) for r in N.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(ids, x, 5)
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97
    assert not {i for p in got for i in p} & {"n1", "n2", "n3", "n4", "n5", "n6"}


def test_third_of_rows_are_copies(spark):
    x = clustered(400, 1)
    rows = [(f"a{i:04}", v.tolist(), "") for i, v in enumerate(x)] + [(f"c{i:04}", x[7].tolist(), "") for i in range(200)]
    near = N.nearest_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    per = {}
    for r in near:
        per.setdefault(r["id"], []).append(r["near_id"])
    assert len(per) == 600 and all(len(v) == 5 and k not in v for k, v in per.items())
    assert set(per["c0150"]) == {"a0007", "c0000", "c0001", "c0002", "c0003"}


def test_small_and_conflicting(spark):
    one = [1.0, *[0.0] * (N.DIMENSION - 1)]
    two = [0.9, 0.1, *[0.0] * (N.DIMENSION - 2)]
    assert N.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.similar_pairs(spark.createDataFrame([("a", one, "")], SCHEMA)).count() == 0
    rows = [("a", one, ""), ("a", two, ""), ("b", two, "")]
    assert [tuple(r) for r in N.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [("a", "b")]


def test_scan_equals_exact_search_where_the_test_is_loose():
    x = clustered(500, 2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home = np.arange(500) % 3
    d, i = N.scan_cells(x, home, [np.array([h, (h + 1) % 3, (h + 2) % 3]) for h in home], np.arange(500), 5, epsilon=50.0)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    assert all(set(a) == set(b) for a, b in zip(i, np.argsort(-s, 1)[:, :5])) and (np.diff(d, axis=1) >= 0).all()


def test_scaled_copies_of_a_third_of_the_rows(spark):
    x = clustered(400, 3)
    rows = [(f"a{i:04}", v.tolist(), "") for i, v in enumerate(x)] + [
        (f"c{i:04}", (x[9] * np.float32(2.0 ** (i % 7 - 3))).tolist(), "") for i in range(200)
    ]
    per = {}
    for r in N.nearest_vectors(spark.createDataFrame(rows, SCHEMA)).collect():
        per.setdefault(r["id"], []).append(r["near_id"])
    assert len(per) == 600 and all(len(v) == 5 and k not in v for k, v in per.items())
    assert set(per["c0150"]) == {"a0009", "c0000", "c0001", "c0002", "c0003"}


def test_crowded_lists_have_indexes_of_their_own(spark, monkeypatch):
    rng = np.random.default_rng(5)
    crowd = clustered(1, 4)[0] + 0.05 * rng.standard_normal((1500, N.DIMENSION)).astype(np.float32)
    x = np.concatenate([clustered(1500, 6), crowd])
    ids = [f"{i:05}" for i in range(len(x))]
    monkeypatch.setattr(N, "ROWS_PER_SLICE", 400)
    frame = spark.createDataFrame([(i, v.tolist(), "") for i, v in zip(ids, x)], SCHEMA)
    got = {tuple(r) for r in N.similar_pairs(frame, probes=64).collect()}
    want = brute(ids, x, 5)
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97


def test_slices_and_blocks_cover_all_pairs():
    x = N._unit(clustered(300, 7))
    ix = N.fit_index(x, 300, 1, 1, rows_per_slice=60)
    assert ix.slices.max() > 1
    salt = np.arange(300) * 7919 % 1013
    row, coarse, group, home, asked, _ = N._targets(ix, x, salt, np.ones(300, bool), np.ones(300, bool), len(ix.centroids), np.zeros(300, np.int64))
    assert max(coarse) == -1
    lives, met = {}, {}
    for i, g, h in zip(row, group, home):
        if h >= 0:
            lives.setdefault((g, h), set()).add(i)
    for i, g, cells in zip(row, group, asked):
        for c in np.frombuffer(cells, np.int32):
            met.setdefault(i, []).extend(lives.get((g, int(c)), ()))
    assert all(sorted(met[i]) == list(range(300)) for i in range(300))
