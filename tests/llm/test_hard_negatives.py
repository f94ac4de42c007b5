"""Hard negatives against all pairs, ties, blocks and edge cases."""

import numpy as np
import pytest
from gaugework.llm import hard_negatives as hn
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    # names that the operator uses itself
    T.StructField("id", T.StringType()), T.StructField("anchor", T.StringType()), T.StructField("falling", T.LongType()), T.StructField("n", T.StringType()),
])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], ROWS)


def brute(rows, wanted, positives=5, negatives=5, low=80, high=100):
    out = []
    for a, label, v in rows:
        if not wanted(a):
            continue
        scored = sorted(((-sum(int(x) * int(y) for x, y in zip(v, u)), i, other) for i, other, u in rows if i != a), key=lambda t: t[:2])
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            p = -p
            inside = [(-s, i) for s, i, other in scored if other != label and low * p <= 100 * -s <= high * p]
            out += [(a, pid, n, i, p, s) for n, (s, i) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_equals_all_pairs(spark, block_bytes):
    random = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in random.integers(-20, 60, 6)]) for i in range(400)]
    got = result(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 25 == 0, block_bytes=block_bytes))
    want = brute(rows, lambda a: a % 25 == 0)
    assert want and got == want


def test_ties_and_a_label_of_most_rows(spark):
    """Few distinct vectors, so that most scores are tied; one label holds most rows."""
    rows = [(i, 0 if i % 5 else 1, [float(i % 4), 2.0]) for i in range(300)]
    got = result(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=3, negatives=4, low=50, high=90))
    assert got == brute(rows, lambda a: a % 10 == 0, 3, 4, 50, 90) and got


def test_scores_of_zero_below_zero_and_beyond_doubles(spark):
    large = float(1 << 40)
    rows = [(0, 1, [large, 1.0]), (1, 1, [large, 3.0]), (2, 2, [large, 2.0]), (3, 2, [large, 4.0])]
    assert result(hn.hard_negatives(frame(spark, rows), F.col("vec_id") == 0, low=0)) != []
    assert hn.scores(np.array([[large, 1.0]]), np.array([[4.0 * (1 << 20), 3.0]]))[0, 0] == (1 << 40) * (4 << 20) + 3
    assert hn.scores(np.array([[1e300]]), np.array([[1e300]]))[0, 0] == np.iinfo(np.int64).max
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [-2.0, 0.0]), (3, 2, [0.0, 5.0]), (4, 2, [-2.0, 1.0])]
    assert result(hn.hard_negatives(frame(spark, rows), F.col("vec_id") == 0)) == [(0, 1, 1, 3, 0, 0)]


def test_edges(spark):
    rows = [
        (0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (1, 1, [2.0, 1.0]), (1, 1, [2.0, 1.0]), (2, 2, [1.0, 1.5]), (2, 2, [1.0, 1.5]), (3, 2, [3.0]),
        (None, 1, [9.0, 9.0]), (4, None, [9.0, 9.0]), (5, 2, None), (6, 2, [None, 1.0]), (7, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 1.0]),
        (9, 2, []),
    ]
    got = result(hn.hard_negatives(frame(spark, [r if r[2] != [1.0, 1.5] else (2, 2, [1.0, 2.0]) for r in rows]), F.col("vec_id") == 0))
    assert got == [(0, 1, 1, 2, 3, 3), (0, 1, 2, 3, 3, 3)]
    for none in ([], rows[7:13], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 2, [1.0])]):
        assert hn.hard_negatives(frame(spark, none), F.col("vec_id") == 0).collect() == []
    assert result(hn.hard_negatives(frame(spark, rows), F.lit(False))) == []
    with pytest.raises(ValueError):
        hn.hard_negatives(frame(spark, rows), F.lit(True), high=120)
