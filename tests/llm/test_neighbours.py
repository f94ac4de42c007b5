"""The forest against brute force, and its edge cases."""

import numpy as np
import pytest
from gaugework.llm import neighbours
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    # names that the operator uses itself
    T.StructField("id", T.StringType()), T.StructField("v", T.LongType()), T.StructField("leaf", T.StringType()), T.StructField("rank", T.StringType()),
])


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1, "y", "z") for k, v in rows], VECTORS)


def brute(rows, query, k):
    ids = np.array([i for i, _ in rows])
    made = np.array([v for _, v in rows], np.float32).astype(float)
    scores = np.cumsum(made * made[list(ids).index(query)], axis=1)[:, -1]
    return sorted(((float(s), int(i)) for s, i in zip(scores, ids) if i != query), key=lambda x: (-x[0], x[1]))[:k]


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    return out


def test_recall_and_exact_scores(spark):
    random = np.random.default_rng(3)
    made = random.standard_normal((3000, 24)).astype(np.float32)
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    options = neighbours.ForestOptions(trees=4, leaf_rows=100, calibration=60)
    got = found(neighbours.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, k=10, options=options).collect())
    assert set(got) == set(range(0, 3000, 20)) and all(len(x) == 10 for x in got.values())
    hits = 0
    for q, near in got.items():
        want = brute(rows, q, 10)
        hits += len({i for _, i in near} & {i for _, i in want})
        scores = dict((i, s) for s, i in brute(rows, q, 3000))
        assert near == sorted(near, key=lambda x: (-x[0], x[1])) and all(abs(scores[i] - s) < 1e-12 for s, i in near)
    assert hits / 1500 >= 0.9


def test_separated_groups_need_few_candidates(spark):
    random = np.random.default_rng(5)
    centres = random.standard_normal((40, 16)) * 10
    made = (centres[np.arange(4000) % 40] + random.standard_normal((4000, 16))).astype(np.float32)
    sample = made[:2000].astype(float)
    options = neighbours.ForestOptions(trees=4)
    forest = neighbours.grown(sample, 64, options)
    sizes = np.bincount(forest.leaves(made.astype(float)).ravel(), minlength=4 << forest.depth)
    assert sizes.sum() == 4 * 4000
    first = next(forest.walk(made[0].astype(float)))
    assert first in forest.leaves(made[:1].astype(float))[0]
    order = list(forest.walk(made[0].astype(float)))
    assert sorted(order) == list(range(4 << forest.depth))


def test_equal_vectors_in_large_groups_are_taken_apart(spark, monkeypatch):
    """A third of all rows is one vector: cells stay bounded, ties go to the smaller id."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 8)
    random = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else random.standard_normal(3).tolist()) for i in range(900)]
    got = found(neighbours.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect())
    for q in range(0, 900, 60):  # multiples of three
        assert got[q] == brute(rows, q, 20)


def test_edges(spark):
    good = [(i, [float(i), 1.0]) for i in range(1, 8)]
    bad = [(None, [1.0, 1.0]), (20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [])]
    rows = good + bad + [(140, [2.0, 1.0]), (140, [2.0, 1.0]), (160, [5.0]), (7, [7.0, 1.0])]
    got = found(neighbours.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert set(got) == {140, 160}
    assert [i for _, i in got[140]] == [7, 6, 5, 160, 4, 3, 2, 1] and [i for _, i in got[160]] == [7, 6, 5, 4, 3, 2, 140, 1]
    for none in ([], bad, [(20, [1.0])]):
        assert neighbours.neighbours(frame(spark, none), F.col("vec_id") % 20 == 0).collect() == []
    assert neighbours.neighbours(frame(spark, good), F.col("vec_id") % 20 == 0).collect() == []


def test_two_vectors_under_one_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    got = neighbours.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]


@pytest.mark.parametrize("n", [1, 2, 25])
def test_fewer_candidates_than_asked(spark, n):
    rows = [(20 * i, [1.0 + i, 2.0]) for i in range(n)]
    got = found(neighbours.neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0).collect())
    assert all(len(x) == min(20, n - 1) for x in got.values()) and len(got) == (n if n > 1 else 0)
