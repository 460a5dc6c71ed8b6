import numpy as np
import pytest

from lodestrata.llm import neighbours as N

SCHEMA = "id string, embeddings array<float>, node string, vec int"


def make(spark, x, ids=None):
    ids = ids or [f"v{i:04}" for i in range(len(x))]
    return spark.createDataFrame([(i, [float(c) for c in v], "clash", 1) for i, v in zip(ids, x, strict=True)], SCHEMA)


def exact(x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 900)] + rng.normal(size=(900, 16)) * 0.25
    return x * rng.uniform(0.1, 9, size=(900, 1))


def test_recall_against_brute_force_with_small_leaves(spark, clustered):
    got = N.most_similar(make(spark, clustered), dim=16, leaf=64, trees=2).collect()
    s = exact(clustered)
    hits = sum(s[int(r.id[1:]), int(r.other_id[1:])] >= np.sort(s[int(r.id[1:])])[-5] - 1e-6 for r in got)
    assert hits / (5 * len(clustered)) >= 0.9
    assert all(abs(s[int(r.id[1:]), int(r.other_id[1:])] - r.similarity) < 1e-5 for r in got[:300])


def test_close_pairs_are_found_over_leaves(spark, clustered):
    near = N.most_similar(make(spark, clustered), dim=16, least=0.97, leaf=64)
    s = exact(clustered)
    want = {(i, j) for i in range(len(s)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.97}
    got = {(int(r.id[1:]), int(r.other_id[1:])) for r in near.collect()}
    assert len(want & got) >= 0.97 * len(want) and got <= want


def test_dirt_copies_and_ties(spark):
    e = [0.0] * 4
    rows = [(f"c{i}", [1.0 * (i + 1), 0.0, 0.0, 0.0]) for i in range(9)] + [("n1", [1.0, 0.1, 0.0, 0.0]), ("n1", [1.0, 0.1, 0.0, 0.0]), ("z", e), ("nan", [float("nan"), 1, 1, 1]), ("inf", [float("inf"), 1, 1, 1]), ("short", [1.0]), ("null", None), (None, [1.0, 0, 0, 0]), ("tiny", [1e-30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v and [float(c) for c in v], "x", 0) for i, v in rows], SCHEMA)
    got = N.most_similar(df, dim=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.other_id)
    assert set(by) == {f"c{i}" for i in range(9)} | {"n1", "tiny"}
    assert sorted(by["c0"]) == ["c1", "c2", "c3", "c4", "c5"] and sorted(by["c8"]) == ["c0", "c1", "c2", "c3", "c4"] and sorted(by["n1"]) == ["c0", "c1", "c2", "c3", "c4"]
    assert all(len(v) == 5 for v in by.values())


def test_empty_and_single(spark):
    assert N.most_similar(spark.createDataFrame([], SCHEMA), dim=4).count() == 0
    assert N.most_similar(spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0], "x", 1)], SCHEMA), dim=4).count() == 0


def test_graph_search_against_brute_force(spark, clustered):
    df = make(spark, clustered)
    q = df.filter("id like 'v00%'")
    got = N.search(df, "id", "embeddings", q, dim=16, leaf=64, trees=2).collect()
    s = exact(clustered)
    hits = sum(s[int(r.query_id[1:]), int(r.id[1:])] >= np.sort(s[int(r.query_id[1:])])[-5] - 1e-6 for r in got)
    assert hits / (5 * 100) >= 0.9


def test_the_rounds_make_the_neighbours(spark, clustered):
    """The first graph alone is poor; the rounds of joins bring the recall."""
    x = np.random.default_rng(3).normal(size=(3000, 16))
    s = exact(x)
    truth = [set(np.argsort(-r)[:5]) for r in s]

    def recall(rounds):
        got = N.most_similar(make(spark, x), dim=16, leaf=64, trees=2, rounds=rounds).collect()
        return sum(int(r.other_id[1:]) in truth[int(r.id[1:])] for r in got) / (5 * len(x))

    assert recall(0) < 0.7 and recall(None) >= 0.9


def test_a_hub_that_all_point_at_has_its_list_spread(spark, monkeypatch):
    """All vectors are a common direction and noise, so the one without noise is near to all."""
    monkeypatch.setattr(N, "HEARD", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)) * 0.3 + np.eye(16)[0] * 3
    x[0] = np.eye(16)[0]
    s = exact(x)
    got = N.most_similar(make(spark, x), dim=16, leaf=32, trees=3).collect()
    truth = [set(np.argsort(-r)[:5]) for r in s]
    assert sum(int(r.other_id[1:]) in truth[int(r.id[1:])] for r in got) / (5 * len(x)) >= 0.85


def test_long_lists_are_windows_that_overlap():
    begin, size = N._windows(np.array([1] * 150 + [2] * 3), 64)
    assert size.tolist() == [64, 64, 64, 54, 3] and begin.tolist() == [0, 32, 64, 96, 150]


def test_lists_over_batches_meet_whole():
    keys = np.array([1] * 5 + [2] * 40 + [3] * 2)
    seen = set()
    for cut in (1, 3, 7, 20):
        parts = ([keys[a : a + cut], np.arange(a, min(a + cut, len(keys)))] for a in range(0, len(keys), cut))
        for cols, begin, size in N._open_lists(parts, 16):
            for a, m in zip(begin, size, strict=True):
                assert m <= 16 and len(set(cols[0][a : a + m])) == 1
                seen |= {(i, i + 1) for i in cols[1][a : a + m - 1]}
        assert seen == {(i, i + 1) for i in range(46) if keys[i] == keys[i + 1]}
        seen.clear()


def test_compression_keeps_products():
    x = np.random.default_rng(1).normal(size=(200, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = N._expand(N._pack_bytes(N._compress(x)), 64)
    assert np.abs(x @ x.T - y @ y.T).max() < 0.01
