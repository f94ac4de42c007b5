import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gaugework.operators import drift
from gaugework.operators.ordered import interpolated_quantiles, running_totals, value_counts
from gaugework.operators.profile import duplicate_rows, histogram, numeric_moments, top_values, column_counts


def _skewed(spark, partitions):
    # one value holds a third of all rows
    return spark.range(0, 3000, 1, partitions).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7.5 ELSE (id * 37 % 1000) / 10 END AS x")


def test_quantiles_equal_numpy_with_hot_value_and_any_partitioning(spark):
    for partitions in (1, 7):
        df = _skewed(spark, partitions)
        xs = np.array([r["x"] for r in df.select("x").collect()], float)
        counts = value_counts(df, ["x"])["float"]
        for buckets in (3, 200):
            ordered = running_totals(counts, ["column"], "value", ["n"], buckets)
            got = interpolated_quantiles(ordered, ["column"], "value", "n", {"a": 0.05, "b": 0.5, "c": 0.95}).first()
            assert np.allclose([got["a"], got["b"], got["c"]], np.percentile(xs, [5, 50, 95]))


def test_running_totals_are_complete_and_monotone(spark):
    counts = value_counts(_skewed(spark, 5), ["x"])["float"]
    rows = running_totals(counts, ["column"], "value", ["n"], 16).orderBy("value").collect()
    assert [r["cum_n"] for r in rows] == list(np.cumsum([r["n"] for r in rows]))
    assert {r["all_n"] for r in rows} == {3000}


def test_moments_match_pandas(spark):
    df = _skewed(spark, 3)
    xs = pd.Series([r["x"] for r in df.collect()], dtype=float)
    got = numeric_moments(df, ["x"]).first()
    for name, want in [("mean", xs.mean()), ("std", xs.std()), ("skewness", xs.skew()), ("kurtosis", xs.kurtosis())]:
        assert abs(got[name] - want) < 1e-9


def test_histogram_counts_every_value_once(spark):
    df = _skewed(spark, 3)
    bins = histogram(value_counts(df, ["x"]), numeric_moments(df, ["x"])).collect()
    assert len(bins) == 10 and sum(b["count"] for b in bins) == 3000


def test_long_values_keep_their_identity(spark):
    head = "a" * 150
    df = spark.createDataFrame([(head + "1",), (head + "2",), (head + "2",)], "t string")
    top = top_values(value_counts(df, ["t"]), column_counts(df)).orderBy("rank").collect()
    assert [r["count"] for r in top] == [2, 1] and all(r["value"] == "a" * 100 for r in top)


def test_null_equals_null_in_duplicate_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("x", 1)], "a string, b int")
    assert duplicate_rows(df).first()["duplicate_rows"] == 1


def test_positions_break_ties_by_key_and_put_nulls_last(spark):
    # all rows share one time but the nulls
    df = spark.range(100).selectExpr("id", "CASE WHEN id < 20 THEN NULL ELSE 5 END AS t")
    part = drift.partition_by_position(df, ["t", "id"], 0.7)
    base = sorted(r["id"] for r in df.where(part.base).collect())
    assert base == list(range(20, 90))
    assert df.where(part.base & part.current).count() == 0


def test_psi_of_equal_parts_is_zero_and_of_shifted_normals_is_large(spark):
    df = spark.range(600).selectExpr("id", "id % 2 AS side", "CAST(id div 2 AS double) AS x", "CASE WHEN id % 2 = 0 THEN 1.0 ELSE 5.0 END * (id % 97) AS y")
    part = drift.Partition(F.col("side") == 0, F.col("side") == 1, "")
    rows = {r["column"]: r for r in drift.drift_metrics(df, ["x", "y"], part).collect()}
    assert rows["x"]["psi"] == 0.0 and rows["x"]["ks_stat"] == 0.0 and rows["x"]["ks_p"] == 1.0
    assert rows["y"]["psi"] > 0.25 and rows["y"]["is_drift"]


def test_digit_strings_are_compared_as_numbers(spark):
    df = spark.range(200).selectExpr("id", "CAST(id % 20 AS string) AS digits", "concat('v', id % 3) AS words")
    part = drift.Partition(F.col("id") < 100, F.col("id") >= 100, "")
    assert drift.numeric_like(df, ["digits", "words"], part) == {"digits": True, "words": False}
