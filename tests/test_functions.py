import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import filters, text, vector
from brindle.operators import ivf, rank


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "d"), [([1, 0], [1, 0], 0), ([2, 0], [5, 0], 0), ([1, 0], [0, 1], 1), ([1, 0], [-1, 0], 2), ([0, 0], [1, 1], 1), ([1, 1], [0, 0], 1), ([0, 0], [0, 0], 1)])
def test_cosine(spark, a, b, d):
    assert one(spark, vector.cosine_distance(a, b)) == pytest.approx(d)


@pytest.mark.parametrize(("a", "b", "d"), [([1, 2], [1, 2], 0), ([0, 0], [3, 4], 5), ([0], [1], 1), ([0, 0], [2, 2], math.sqrt(8))])
def test_l2(spark, a, b, d):
    assert one(spark, vector.l2_distance(a, b)) == pytest.approx(d)


def test_unknown_metric():
    with pytest.raises(ValueError, match="manhattan"):
        vector.distance("manhattan", [1], [1])


@pytest.mark.parametrize(("n", "k"), [(0, 1), (-5, 1), (1, 1), (4, 2), (9, 3), (100, 10), (10, 3)])
def test_choose_k(n, k):
    assert vector.choose_k(n) == k


def test_packed_signs_pad_with_zeros(spark):
    signs = F.array(*[F.lit(0)] * 64, F.lit(1))
    assert one(spark, vector.packed_signs(signs, 65)) == [0, 1]


@pytest.mark.parametrize(("s", "words"), [("user42 v2 go1.26", ["user42", "v2", "go1", "26"]), ("", []), ("!!!", []), ("Straße, ÉTÉ", ["straße", "été"]), (None, [])])
def test_tokens(spark, s, words):
    assert one(spark, text.tokens(F.lit(s).cast("string"))) == words


def _eq(f, v):
    return {"op": "eq", "field": f, "value": v}


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        ({}, True), ({"op": "all"}, True), (_eq("lang", "en"), True), (_eq("lang", "de"), False), (_eq("rank", 5), True), (_eq("rank", 5.0), True), (_eq("rank", "5"), False),
        (_eq("score", 2.5), True), (_eq("active", True), True), (_eq("active", 1), False), (_eq("missing", None), True), (_eq("absent", None), False), (_eq("absent", 1), False),
        ({"op": "and"}, True), ({"op": "or"}, False), ({"op": "and", "sub": [_eq("lang", "en"), _eq("rank", 6)]}, False), ({"op": "or", "sub": [_eq("lang", "x"), _eq("rank", 5)]}, True),
        ({"op": "gte", "field": "rank", "value": 1}, False), (_eq("numeric_text", 7), False),
    ],
)
def test_filter_truth_table(spark, spec, expected):
    attributes = F.parse_json(F.lit('{"lang":"en","rank":5,"score":2.5,"active":true,"missing":null,"numeric_text":"7"}'))
    assert one(spark, filters.compile_filter(spec, filters.variant_field(attributes))) is expected


def test_fusion_example(spark):
    v = spark.createDataFrame([("A", 0.1), ("B", 0.2), ("D", 0.3)], "id string, dist double")
    t = spark.createDataFrame([("C", 9.0), ("B", 8.0), ("X", 7.0), ("A", 6.0)], "id string, score double")
    got = {r["id"]: r["rrf"] for r in rank.fuse(v, t).collect()}
    assert got["A"] == pytest.approx(1 / 61 + 1 / 64)
    assert got["B"] == pytest.approx(2 / 62)
    assert max(got, key=got.get) == "B"


def test_tree_reaches_every_cluster():
    centroids = {c: [float(c), float(c % 3)] for c in range(20)}
    found, compared = ivf.descend(ivf.tree(centroids, metric="l2"), [3.2, 0.1], 20, 10**6, "l2")
    assert sorted(found) == list(range(20))
    assert found[:3] == ivf.probe(centroids, [3.2, 0.1], 3, "l2")
    assert compared > 0
