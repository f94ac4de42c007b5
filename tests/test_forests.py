"""Forests grown together on counted items, against their definition and Spark ML."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugework.operators import forests, modeling


def test_the_split_is_the_best_of_all():
    draw = np.random.default_rng(2)
    for classes in (3, 0):
        sums = draw.integers(0, 9, (2, 4, 6, classes or 2)).astype(float)
        sums[1] *= sums[0].sum(1, keepdims=True).sum(-1, keepdims=True) > 0
        sums[1, :, 0] += sums[0].sum(1) - sums[1].sum(1)  # both features hold the same rows
        sums = np.maximum(sums, 0)
        sums[1, :, 0] += sums[0].sum(1) - sums[1].sum(1)
        at, cut, total, left = forests.best_splits(sums, classes, 2)

        def spread(s):
            n = s.sum() if classes else s[0]
            return (n - (s * s).sum() / n if classes else -s[1] ** 2 / n) if n > 0 else 0.0

        for node in range(4):
            found = {}
            for f in range(2):
                for c in range(6):
                    low = sums[f, node, :c + 1].sum(0)
                    high = sums[f, node].sum(0) - low
                    if min((low.sum(), high.sum()) if classes else (low[0], high[0])) >= 2:
                        found[f, c] = spread(sums[f, node].sum(0)) - spread(low) - spread(high)
            assert found and found[at[node], cut[node]] == pytest.approx(max(found.values()))
            assert left[node] == pytest.approx(sums[at[node], node, :cut[node] + 1].sum(0))
    assert forests.best_splits(np.array([[[[4.0, 0.0], [3.0, 0.0]]]]), 2, 2)[0].tolist() == [-1]  # one class


def test_weights_are_those_of_the_rows_of_an_item():
    counts = np.repeat([1, 3, 8, 20], 20_000)
    drawn = forests._weights(7, 1, counts, len(counts)).reshape(4, -1)
    assert drawn.mean(1) == pytest.approx([1, 3, 8, 20], rel=0.02) and drawn.var(1) == pytest.approx([1, 3, 8, 20], rel=0.05)
    assert (forests._weights(7, 1, counts, len(counts)).reshape(4, -1) == drawn).all()


def _noisy(spark, n=6000):
    return spark.range(0, n, 1, 5).selectExpr(
        "id", "id * 37 % 101 AS x", "CASE WHEN id % 6 = 0 THEN NULL ELSE id * 53 % 997 / 10.0 END AS z", "concat('w', id * 17 % 5) AS word",
        "pmod(xxhash64(id), 1000) / 1000.0 AS noise").selectExpr(
        "*", "CAST((x > 50) <> (word = 'w1') AND noise < 0.8 OR noise > 0.95 AS int) AS y", "x + coalesce(z, 80.0) * 2 + noise * 30 AS amount")


def test_forests_score_like_those_of_spark_ml(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    monkeypatch.setattr(modeling, "TREES", 20)
    names = []
    write = forests.stored
    monkeypatch.setattr(forests, "stored", lambda df, name: names.append(name) or write(df, name))
    df = _noisy(spark).drop("noise")
    got = modeling.cross_validate(df.drop("amount"), [], "y", "binary_classification", "id", k=3)
    amount = modeling.cross_validate(df.drop("y"), [], "amount", "regression", "id", k=3)
    assert names == ["forest-items"] * 2  # the rows are put in bins once for all folds
    table = VectorAssembler(inputCols=["x", "f", "w"], outputCol="features").transform(
        df.withColumn("f", F.coalesce("z", F.lit(49.8))).withColumn("w", F.substring("word", 2, 1).cast("double")).withColumn("test", F.expr("pmod(xxhash64(id, 7), 3) = 0"))).cache()
    given = dict(numTrees=20, maxDepth=6, minInstancesPerNode=2, seed=42)
    model = RandomForestClassifier(labelCol="y", **given).fit(table.where("NOT test"))
    scored = model.transform(table.where("test")).select("y", vector_to_array("probability")[1].alias("probability"))
    assert got["score"] == pytest.approx(modeling.auc(scored).first()[0], abs=0.03) and got["score"] > 0.8
    model = RandomForestRegressor(labelCol="amount", **given).fit(table.where("NOT test"))
    r2 = modeling.regression_metrics(model.transform(table.where("test")).select(F.col("amount").alias("y"), "prediction")).first()["r2"]
    assert amount["score"] == pytest.approx(r2, abs=0.05)
    assert got["predictions"].count() == amount["predictions"].count() == 6000
    assert got["predictions"].select("key").distinct().count() == 6000


@pytest.mark.parametrize("target,kind", [("y", "binary_classification"), ("amount", "regression")])
def test_small_chunks_and_shards_leave_no_row_out(spark, monkeypatch, target, kind):
    """All rows have their weight at the root of every tree, in whatever pieces they come."""
    df = _noisy(spark, 3000).drop("noise", "amount" if target == "y" else "y").withColumn("x", F.col("x") % 4).drop("z")
    folds = modeling.Folds(df, target, kind, "id", ["x", "word"], k=3)
    classes = folds.fitted(True)[4]
    table = folds.rows.select("fold", F.col("_label").cast("double").alias("_label"), F.col("x").cast("double").alias("_x"), F.substring("word", 2, 1).cast("double").alias("_w"))
    cuts = [np.arange(4.0), np.arange(5.0)]
    grown = forests.grow(table, [["_x", "_w"]], [cuts], [[1, 2], [0, 2], [0]], classes, 30, 3, 2, 5)
    for forest, rows in zip(grown, (2000, 2000, 1000)):
        at_root = forest.stats[0][:, 0].sum(1) if classes else forest.stats[0][:, 0, 0]
        assert abs(at_root.mean() - rows) < 5 * np.sqrt(rows / 30) + 0.01 * rows and at_root.std() > 0
        for below in range(1, 4):
            assert (forest.stats[below].sum((1, 2)) <= forest.stats[0].sum((1, 2)) + 1e-6).all()
    assert forests.grow(table, [["_x", "_w"]], [cuts], [[9]], classes, 4, 2, 2, 5)[0].scores(np.zeros((2, 3), np.uint8), classes).shape == (3, classes or 1)


def test_cut_points_are_exact_ranks(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN 7 ELSE id END AS x", "id % 3 AS few", "CAST(id % 2 AS int) AS fold")
    counts = modeling.fold_counts(df, ["x", "few"], [[0, 1], [1]])
    both, odd = modeling.fold_cuts(counts, 2)
    assert both["few"].tolist() == odd["few"].tolist() == [0.5, 1.5]
    values = np.sort([7 if i % 4 == 0 else i for i in range(1000)])
    inside = np.diff([0, *np.searchsorted(values, both["x"], "right"), 1000])
    assert 6.5 in both["x"] and 8 in both["x"] and sorted(inside)[-2] <= 1000 / 32 + 1 and len(both["x"]) <= 34
    assert len(odd["x"]) >= 31


def test_comparisons_on_some_of_the_columns_share_folds(spark, monkeypatch):
    from gaugework.operators import experiments

    monkeypatch.setattr(modeling, "TREES", 5)
    names = []
    write = modeling.stored
    monkeypatch.setattr(modeling, "stored", lambda df, name: names.append(name) or write(df, name))
    df = _noisy(spark, 1500).drop("amount")
    given = ([], "y", "binary_classification", "id", "missingness_strategy", ["z"], ["MEDIAN_IMPUTATION", "DROP_FEATURE"])
    folds = experiments.shared_folds(df, *given[:4], k=3)
    for rows in (df, df.drop("noise")):
        alone, shared = (experiments.investigate(rows, *given, k=3, folds=f)[0].collect() for f in (None, folds))
        assert [r.asDict() | {"primary_score": 0, "secondary_metrics": 0, "delta_from_baseline": 0, "delta_pct": 0, "delta_label": 0, "practical_importance": 0} for r in alone] == [
            r.asDict() | {"primary_score": 0, "secondary_metrics": 0, "delta_from_baseline": 0, "delta_pct": 0, "delta_label": 0, "practical_importance": 0} for r in shared]
        assert [r["primary_score"] for r in alone] == pytest.approx([r["primary_score"] for r in shared], abs=0.03)
    assert names.count("model-matrix") == names.count("folded-rows") == 3  # one for all shared, one for each alone
