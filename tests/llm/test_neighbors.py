import numpy as np
import pytest

from vellumdf.llm import neighbors

SCHEMA = "reference_index long, matrix array<float>, id long, v string, g string"


def brute(rows, k=5):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = set()
    for a in range(len(ids)):
        d = np.sqrt(((x - x[a]) ** 2).sum(1))
        d[a] = np.inf
        out |= {(int(ids[a]), int(ids[b])) for b in np.lexsort((ids, d))[:k] if np.isfinite(d[b])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("n", [3, 900])
def test_recall_against_brute_force(spark, n):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(max(1, n // 12), 64))
    x = (centres[rng.integers(0, len(centres), n)] + 0.05 * rng.normal(size=(n, 64))).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(n)]
    got = {(r.id, r.neighbor) for r in neighbors.nearest(frame(spark, rows), "reference_index", "matrix").collect()}
    want = brute(rows)
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)


def test_spread_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 64)).astype(np.float32))]
    got = {(r.id, r.neighbor) for r in neighbors.nearest(frame(spark, rows), "reference_index", "matrix").collect()}
    assert len(got & brute(rows)) >= 0.95 * 5 * 1500


def test_spread_vectors_in_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF", 4)
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1200, 64)).astype(np.float32))]
    got = {(r.id, r.neighbor) for r in neighbors.nearest(frame(spark, rows), "reference_index", "matrix").collect()}
    assert len(got & brute(rows)) >= 0.98 * 5 * 1200  # 300 leaves


def test_copies_ties_and_unusable_rows(spark):
    one, two = [1.0] * 64, [2.0] * 64
    rows = [(i, one) for i in range(1, 10)] + [(20, two), (21, two), (22, [3.0] * 64)]
    bad = [(30, None), (31, one[:10]), (32, [float("nan")] * 64), (33, [None] * 64), (1, one)]
    got = {(r.id, r.neighbor) for r in neighbors.nearest(frame(spark, rows + bad), "reference_index", "matrix").collect()}
    assert got == brute(rows)
    assert neighbors.nearest(frame(spark, bad[:4]), "reference_index", "matrix").count() == 0
    assert neighbors.nearest(frame(spark, []), "reference_index", "matrix").count() == 0


def test_hot_leaf_is_searched_in_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "SHARD", 50)
    monkeypatch.setattr(neighbors, "LEAF", 400)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate((0.01 * rng.normal(size=(600, 64))).astype(np.float32))]
    got = {(r.id, r.neighbor) for r in neighbors.nearest(frame(spark, rows), "reference_index", "matrix").collect()}
    assert len(got & brute(rows)) >= 0.95 * 5 * 600


def test_calibration_walks_as_the_search_does():
    rng = np.random.default_rng(8)
    tree = neighbors.Tree(rng.normal(size=(2000, 64)), 300)
    q = rng.normal(size=(40, 64))
    few, many = tree.order(q, 7)[0], tree.order(q, len(tree.leaf))[0]
    assert (few == many[:, :7]).all()
    assert all(sorted(r) == list(range(len(tree.leaf))) for r in many.tolist())  # every leaf is reached once


def test_visited_parts_stand_in_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "HOT", 40)
    monkeypatch.setattr(neighbors, "SHARD", 60)
    monkeypatch.setattr(neighbors, "SMALL", 10)
    monkeypatch.setattr(neighbors, "LEAF", 20)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 64)).astype(np.float32)
    x[300:] = x[299]  # two fifths of the rows are copies of one
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {(r.id, r.neighbor) for r in neighbors.nearest(frame(spark, rows), "reference_index", "matrix").collect()}
    want = brute(rows)
    assert len(got) == len(want) and len(got & want) >= 0.98 * len(want)
