"""Batches of queries in blocks against a plain ranking of every pair."""

import numpy as np
import pytest

from brindle.operators import rank


def _cosine(a, b):
    scale = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return 1.0 if scale == 0 else 1.0 - min(1.0, max(-1.0, float((a * b).sum() / scale)))


def _l2(a, b):
    return float(np.sqrt(((a - b) ** 2).sum()))


@pytest.fixture(scope="module")
def points():
    """Vectors with many repeats, a zero vector, and one missing."""
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 5)).astype(np.float32)
    rows = [(f"v{i:03}", base[i % 40 if i % 3 else 7].tolist(), i % 4) for i in range(180)]
    return [*rows, ("zero", [0.0] * 5, 1), ("none", None, 2)]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("probed", [False, True])
def test_blocks_rank_as_all_pairs_do(spark, monkeypatch, points, metric, probed):
    monkeypatch.setattr(rank, "ROWS", 16)
    monkeypatch.setattr(rank, "ASKED", 3)
    rows = spark.createDataFrame(points, "id string, vector array<float>, cluster int").repartition(3)
    asked = [(i, v, [c % 4, (c + 1) % 4]) for i, v, c in points[:7] + points[-2:-1]]
    queries = spark.createDataFrame(asked, "query string, q array<float>, clusters array<int>")
    got = {}
    for x in rank.batch_top_vectors(rows, queries, 9, metric, probed).collect():
        got.setdefault(x["query"], []).append((x["rank"], x["id"], round(x["dist"], 9)))
    far = {"cosine": _cosine, "l2": _l2}[metric]
    for name, q, clusters in asked:
        near = sorted((round(far(np.array(v, float), np.array(q, float)), 12), i) for i, v, c in points if v is not None and (not probed or c in clusters))[:9]
        assert sorted(got[name]) == [(n, i, round(d, 9)) for n, (d, i) in enumerate(near, 1)]


def test_batches_of_nothing_and_of_other_lengths(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0])], "id string, vector array<float>")
    empty = spark.createDataFrame([], "query string, q array<float>")
    assert rank.batch_top_vectors(rows, empty).count() == 0
    asked = spark.createDataFrame([("q", [1.0, 2.0])], "query string, q array<float>")
    assert rank.batch_top_vectors(rows.limit(0), asked).count() == 0
    with pytest.raises(Exception, match="components"):
        rank.batch_top_vectors(rows, spark.createDataFrame([("q", [1.0])], "query string, q array<float>")).collect()
    with pytest.raises(ValueError, match="unknown metric"):
        rank.batch_top_vectors(rows, asked, metric="dot")
