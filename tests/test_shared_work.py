"""Work that several steps share is done once, with the results of doing it for each."""

from pyspark.sql import functions as F

from gaugework.operators import experiments, modeling


def _rows(spark):
    return spark.range(400).select(
        F.col("id"), F.when(F.col("id") % 9 != 0, F.col("id") * 7 % 101).alias("x"), (F.col("id") * 13 % 50 / 3.0).alias("z"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("w"), F.col("id") % 4)).alias("word"), F.expr("CAST(id * 7 % 101 > 50 AS int)").alias("y"))


def test_strategies_share_folds_and_features(spark, monkeypatch):
    """Rows are dealt, counted and put in the model table once for all strategies; each has the scores that it has on its own."""
    monkeypatch.setattr(modeling, "TREES", 5)
    names = []
    write = modeling.stored
    monkeypatch.setattr(modeling, "stored", lambda df, name: names.append(name) or write(df, name))
    df = _rows(spark)
    given = ("y", "binary_classification", "id")
    strategies = ["DROP_FEATURE", "MEDIAN_IMPUTATION", "MISSING_INDICATOR", "WINSORIZE_OUTLIERS"]
    rows = experiments.investigate(df, [], *given, "missingness_strategy", ["x"], strategies, k=3)[0].collect()
    assert names.count("model-matrix") == names.count("category-codes") == names.count("folded-rows") == 1
    assert names.count("fold-predictions") == 3 * len(strategies)
    for row, strategy in zip(rows, strategies):
        alone = experiments.evaluate_strategy(df, [], *given, strategy, ["x"], k=3)
        assert row["strategy_id"] == strategy and abs(row["primary_score"] - alone["primary_score"]) < 0.02
        assert (row["rows_affected"], row["feature_count"], row["folds"]) == (alone["rows_affected"], alone["feature_count"], alone["folds"])


def test_experiments_share_folds(spark, monkeypatch):
    monkeypatch.setattr(modeling, "TREES", 3)
    names = []
    write = modeling.stored
    monkeypatch.setattr(modeling, "stored", lambda df, name: names.append(name) or write(df, name))
    found = [{"type": "target_leakage", "column": "x"}, {"type": "missingness", "column": "x"}, {"type": "outliers", "column": "z"}]
    rows = experiments.run_experiments(_rows(spark), [], "y", "binary_classification", "id", found, k=3).collect()
    assert [r["category"] for r in rows] == ["baseline", "target_leakage", "outliers", "missingness"]
    assert names.count("model-matrix") == names.count("fold-counts") / 2 == 1  # one table of counts each for whole and broken numbers


def test_profile_counts_values_once(spark, monkeypatch):
    """Each value table is stored, and its many readers read the stored one."""
    from gaugework.operators import profile

    names = []
    write = profile.stored
    monkeypatch.setattr(profile, "stored", lambda df, name: names.append(name) or write(df, name))
    made = profile.profile_columns(_rows(spark), "y", "id")
    assert names == ["profile-values"] * 3  # whole numbers, broken numbers, texts
    assert any("profile-values" in f for f in made.inputFiles())
    unique = {r["name"]: r["unique_count"] for r in made.collect()}
    assert unique == {"id": 400, "x": 101, "z": 50, "word": 4, "y": 2}


def test_tables_with_an_untyped_column_are_stored(spark):
    from gaugework.operators.lineage import stored

    assert stored(spark.range(2).select("id", F.lit(None).alias("nothing")), "untyped").where("nothing IS NULL").count() == 2


def test_phrases_are_sent_to_a_fixed_number_of_blocks(monkeypatch):
    """Ten times the phrases are sent ten times as often, until a block is as large as a task may hold."""
    from gaugework.operators import enrich

    sent = lambda n: n * -(-n // enrich._vector_block(n))
    assert sent(500_000) == 10 * sent(50_000) == 50 * sent(10_000)
    assert enrich._vector_block(10_000_000) == enrich.MOST_BLOCK and enrich._vector_block(10) == enrich.LEAST_BLOCK


def test_phrases_merge_as_one_by_one_in_blocks_and_parts(spark, monkeypatch):
    import numpy as np

    from gaugework.operators import enrich

    monkeypatch.setattr(enrich, "VECTOR_BLOCK", 7)  # rows compared at a time, fewer than a block has
    v = np.random.default_rng(3).normal(size=(90, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    near, chosen = v @ v.T >= enrich.MERGE_COSINE, []
    for i in range(len(v)):
        if not any(near[i, j] for j in chosen):
            chosen.append(i)
    want = {i: i if i in chosen else max(j for j in chosen if near[i, j]) for i in range(len(v))}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "position long, vector array<double>")
    for block in (None, 40):
        assert {r["position"]: r["representative"] for r in enrich.merge_phrases(df, block).collect()} == want


def test_detectors_read_the_counts_of_the_profile(spark, monkeypatch):
    """Given the profile's counts, the detectors count and order no values again and find the same."""
    from gaugework.operators import profile, quality

    df = _rows(spark).withColumn("z", F.when(F.col("id") % 20 == 0, F.col("id") * 1000.0).otherwise(F.col("z")))
    counted = profile.counted_values(df, "id")
    alone = sorted(quality.quality_findings(df, profile.profile_columns(df, "y", "id"), "y").drop("evidence").collect())
    names = []
    write = quality.stored
    monkeypatch.setattr(quality, "stored", lambda df, name: names.append(name) or write(df, name))
    made = quality.quality_findings(df, profile.profile_columns(df, "y", "id", counted=counted), "y", counted=counted)
    assert sorted(made.drop("evidence").collect()) == alone and any(r["type"] == "outliers" for r in alone)
    assert names == []
    stats = [sorted(quality.outlier_stats(df, ["x", "z"], counted=c).collect()) for c in (None, counted)]
    assert stats[0] == stats[1] and names == ["outlier-values"] * 2


def test_moments_of_a_table_without_rows(spark):
    from gaugework.operators.profile import numeric_moments

    rows = numeric_moments(_rows(spark).where("id < 0"), ["x", "z"]).collect()
    assert [(r["column"], r["n"], r["mean"]) for r in rows] == [("x", 0, None), ("z", 0, None)]


def test_faults_gather_no_rows_in_one_task(spark, tmp_path):
    """Repeated and extreme rows are found by their boundary, the base is spread whatever the number of files."""
    from gaugework.operators import faults
    from gaugework.plans import checks_model

    df = spark.range(1, 500, 1, 3).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
    again, extreme = faults.repeated_rows(df, "k", 71), faults.extreme_values(df, "x", "k", 33)
    assert sorted(r["k"] for r in again.collect()) == sorted([*range(1, 500), *range(1, 72)])
    lowest = df.orderBy(F.xxhash64(F.lit("extreme"), F.col("k")), "k").limit(33).collect()
    assert {r["k"] for r in extreme.where("x >= 90000").collect()} == {r["k"] for r in lowest} and extreme.count() == 499
    assert faults.repeated_rows(df, "k", 5000).count() == 998 and faults.repeated_rows(df, "k", 0).count() == 499
    for made in (again, extreme):
        assert "Limit" not in made._jdf.queryExecution().optimizedPlan().toString()
    spark.range(200).selectExpr("id AS c_custkey", "'a' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert len(checks_model.fault_base(spark, str(tmp_path)).inputFiles()) == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_regression_scores_count_the_values_once(spark, monkeypatch):
    """Trees and rank correlation against a number read one table of values, with the scores of each on its own."""
    from gaugework.operators import leakage

    df = _rows(spark).withColumn("y", F.when(F.col("id") % 11 != 0, F.col("id") * 7 % 90 / 4.0))
    features = ["x", "z", "word"]
    ranks = {r["column"]: r["spearman"] for r in leakage.spearman(df, features, "y", False).collect()}
    trees = {r["column"]: r["score"] for r in leakage.single_feature_scores(df, features, "y", False).collect()}
    monkeypatch.setattr(leakage, "single_feature_scores", None)  # unpivots and counts the rows once more
    got = leakage.feature_target_scores(df, features, "y", "regression").collect()
    assert {r["column"]: (r["metric"], r["score"], r["spearman"]) for r in got} == {
        c: ("R2", round(trees[c], 4), round(ranks[c], 4)) for c in features}
