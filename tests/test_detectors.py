import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugework.functions.columns import UnsupportedColumn
from gaugework.operators import association, decisions, drift, fairness, faults, leakage, modeling, quality
from gaugework.operators import findings as fd
from gaugework.operators.association import correlation_p_value
from gaugework.operators.profile import profile_columns
from gaugework.operators.semantic import find_target


def _collected(df, target=None, key=None):
    prof = profile_columns(df, target, key).cache()
    return prof, prof.collect()


def test_profile_types_roles_and_awkward_names(spark):
    df = spark.range(60).selectExpr(
        "id AS user_id", "concat('u', id, '@mail.org') AS `buyer's_address`",
        "CASE WHEN id % 6 = 0 THEN NULL ELSE id * 1.5D END AS `Annual Income (USD)`", "'A' AS const_col",
        "CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS flag", "id % 2 AS `class`")
    rows = {r["name"]: r for r in profile_columns(df, "class", "user_id").collect()}
    assert rows["user_id"]["role"] == "id_candidate" and rows["class"]["role"] == "target"
    assert rows["const_col"]["is_constant"] and rows["flag"]["semantic_type"] == "boolean"
    assert rows["buyer's_address"]["semantic_type"] == "email"
    assert rows["Annual Income (USD)"]["missing_count"] == 10 and len(rows["Annual Income (USD)"]["histogram"]) == 10


def test_target_names():
    assert find_target(["age", "CHURN"], "churn") == "CHURN"
    assert find_target(["age", "salary"]) is None
    assert find_target(["salary", "churn"], search=True) == "churn"


def test_nested_columns_are_refused(spark):
    with pytest.raises(UnsupportedColumn):
        profile_columns(spark.createDataFrame([([1],)], "a array<int>"))


def test_quality_findings(spark):
    df = spark.range(100).selectExpr(
        "id", "CASE WHEN id < 5 THEN 500 + id * 50 ELSE 30 + id % 7 END * 1.0D AS age",
        "CASE WHEN id < 25 THEN NULL ELSE 100 * id * 1.0D END AS salary", "id % 2 AS label")
    prof, roles = _collected(df, "label", "id")
    rows = {(r["type"], r["column"]): r for r in quality.quality_findings(df, prof, "label", roles=roles).collect()}
    assert ("missingness", "salary") in rows and ("outliers", "age") in rows
    assert all(r["severity"] != "CRITICAL" for r in rows.values())


def test_leak_is_suspected_never_confirmed(spark):
    df = spark.range(200).selectExpr("id", "pmod(xxhash64(id), 1000) / 1000 AS clean", "id % 2 AS refund_post_churn", "id % 2 AS churn")
    _, roles = _collected(df, "churn", "id")
    rows = leakage.leakage_findings(df, roles, "churn", "binary_classification").collect()
    assert [r["column"] for r in rows] == ["refund_post_churn"] and rows[0]["status"] == "SUSPECTED"


def test_rank_correlation_and_tree_agree_with_known_values(spark):
    df = spark.range(100).selectExpr("id", "id % 50 AS x", "CASE WHEN id % 50 >= 25 THEN 1 ELSE 0 END AS y")
    row = leakage.single_feature_scores(df, ["x"], "y", True).first()
    general = leakage.spearman(df, ["x"], "y", True).first()
    assert row["score"] == 1.0 and abs(row["spearman"] - general["spearman"]) < 1e-12


def test_p_value_against_known_quantile(spark):
    # t = 2.0484 is the 97.5 percent point with 28 degrees of freedom
    r = 2.048407 / (28 + 2.048407 ** 2) ** 0.5
    p = spark.createDataFrame([(r, 30.0)], "r double, n double").select(correlation_p_value("r", "n").alias("p")).first()["p"]
    assert abs(p - 0.05) < 1e-5


def test_slice_with_inverted_predictions_is_disparate(spark):
    df = spark.range(200).selectExpr("id", "CASE WHEN id < 100 THEN 'a' ELSE 'b' END AS grp", "id % 2 AS y", "CASE WHEN id < 100 THEN id % 2 ELSE 1 - id % 2 END AS p")
    rows = fairness.slice_metrics(df, F.col("y"), F.col("p"), {"grp": F.col("grp")}, True).collect()
    assert {r["slice_value"]: r["is_disparate"] for r in rows} == {"a": False, "b": True}


def _finding(spark, **values):
    base = dict(id="F-L201", type="target_leakage", status="SUSPECTED", severity="WARNING", column="post_refund", title="t",
                description="d", evidence={}, confidence=0.9, decision_question=None, recommendation=None) | values
    return spark.createDataFrame([tuple(base[c] for c in fd.COLUMNS)], fd.SCHEMA)


def test_candidates_need_a_target(spark):
    found = _finding(spark)
    one = decisions.decision_candidates(found, None, "target", "binary_classification").collect()
    assert len(one) == 1 and one[0]["category"] == "suspected_leakage" and one[0]["expected_impact"] == "HIGH"
    assert decisions.decision_candidates(found, None, None, None).count() == 0
    assert decisions.decision_candidates(found, None, "target", "regression", task_type="unsupervised").count() == 0


def test_missingness_window(spark):
    for pct, expected in (("0.008", 0), ("0.15", 1), ("0.9", 0)):
        found = _finding(spark, type="missingness", status="OBSERVED", evidence={"missing_pct": pct})
        assert decisions.decision_candidates(found, None, "target", "binary_classification").count() == expected


def test_health_without_findings(spark):
    row = decisions.health_score(fd.empty(spark.range(1))).first()
    assert row["overall_score"] == 100.0 and row["grade"] == "A+"


def test_folds_are_disjoint_and_stratified(spark):
    df = spark.range(0, 103, 1, 5).selectExpr("id", "CASE WHEN id % 4 = 0 THEN 'p' ELSE 'n' END AS y")
    folded = modeling.stratified_folds(df, "y", "id", 5)
    assert folded.select("id").distinct().count() == 103 == folded.count()
    sizes = [r["count"] for r in folded.groupBy("y", "fold").count().where("y = 'p'").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = modeling.stratified_folds(df.repartition(3), "y", "id", 5)
    assert folded.exceptAll(again).count() == 0


def test_preparation_sees_training_rows_only(spark):
    df = spark.createDataFrame([(i, float(i), 0) for i in range(10)] + [(99, 1e9, 1)], "id long, x double, fold int")
    made = modeling.fit_preparation(df.where("fold = 0"), ["x"], modeling.Recipe(clip=("x",)))
    assert made.bounds["x"][1] < 10


def test_injected_gaps_and_scoring(spark):
    df = faults.informative_gaps(spark.range(200).selectExpr("id", "id % 2 AS churn", "id * 1.0D AS annual_income"), "annual_income", "churn", "id")
    assert df.where("annual_income IS NULL AND churn = 0").count() == 0 < df.where("annual_income IS NULL").count()
    found = _finding(spark, type="missingness", column="annual_income").withColumn("case_id", F.lit("BENCH_4_INFORMATIVE_MISSING"))
    rows = {r["case_id"]: r for r in faults.score_detectors(found, [faults.FAULTS["missing"], faults.FAULTS["clean"], faults.FAULTS["drift"]]).collect()}
    assert rows["BENCH_4_INFORMATIVE_MISSING"]["detected"] and rows["BENCH_0_CLEAN"]["detected"]
    assert not rows["BENCH_3_DRIFT"]["detected"] and rows["BENCH_3_DRIFT"]["false_negatives"] == ["monthly_charges"]


def _ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def _rank_correlation(pairs):
    a, b = (np.array(_ranks(side)) for side in zip(*pairs))
    return float(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else 0.0


def test_rank_correlation_of_features_with_gaps_ties_and_texts(spark):
    """Each feature ranks the target over its own rows; a third of the target is one value."""
    draw = random.Random(2)
    rows = []
    for i in range(300):
        y = 5.0 if i % 3 == 0 else draw.choice([None, float(draw.randrange(40))])
        x = draw.choice([None, draw.randrange(8)])
        rows.append((i, x, None if y is None else y + draw.random() * 9, draw.choice(["é", "b", "a" * 150 + str(draw.randrange(3)), None]), 1, y))
    df = spark.createDataFrame(rows, "id int, few int, near double, word string, same int, y double")
    got = {r["column"]: (r["n"], r["spearman"]) for r in leakage.spearman(df, ["few", "near", "word", "same"], "y", False).collect()}
    for at, name in enumerate(["few", "near", "word", "same"], 1):
        pairs = [(r[at].encode() if name == "word" else r[at], r[5]) for r in rows if r[at] is not None and r[5] is not None]
        assert got[name] == (len(pairs), pytest.approx(_rank_correlation(pairs), abs=1e-9))


def test_wide_correlation_takes_one_scan(spark, tmp_path):
    random_ = np.random.default_rng(3)
    made = random_.normal(size=(500, 60)) + 1e6
    made[:, 1] = made[:, 0] * 2 + random_.normal(size=500) * 0.1
    made[:, 2] = 7.1
    made[random_.random(made.shape) < 0.1] = np.nan
    made[:200, 3] = np.nan
    table = pd.DataFrame(made, columns=[f"c{i}" for i in range(60)])
    table.to_parquet(tmp_path / "wide.parquet")
    df = spark.read.parquet(str(tmp_path / "wide.parquet"))
    pairs = association.pearson_pairs(df, df.columns)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    want, n = table.corr(), table.notna().astype(int).T @ table.notna().astype(int)
    rows = pairs.collect()
    assert len(rows) == 60 * 59 // 2
    for r in rows:
        assert r["n"] == n.loc[r["c1"], r["c2"]]
        if "c2" in (r["c1"], r["c2"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want.loc[r["c1"], r["c2"]], abs=1e-9)
    assert [(r["c1"], r["c2"]) for r in decisions.collinear_pairs(df, df.columns).collect()] == [("c0", "c1")]
    assert association.pearson_pairs(df, ["c0"]).collect() == []


def test_drift_reads_one_ordered_table(spark):
    df = spark.range(400).selectExpr("id", "CASE WHEN id < 280 THEN id % 50 ELSE id % 50 + 20 END * 1.0D AS x")
    part = drift.partition_by_position(df, ["id"])
    row = drift.drift_metrics(df, ["x"], part).first()
    base, now = ([i % 50 + (20 if i >= 280 else 0) for i in span] for span in (range(280), range(280, 400)))
    ks = max(abs(sum(b <= v for b in base) / 280 - sum(b <= v for b in now) / 120) for v in base + now)
    assert row["ks_stat"] == pytest.approx(ks, abs=1e-4) and row["severity"] == "CRITICAL"


def test_preparations_of_all_folds_equal_those_of_their_rows(spark):
    """One pass for all folds against a fit on each fold's training rows, with gaps, tails, flags and categories."""
    draw = random.Random(4)
    rows = [(i, draw.choice([None, draw.gauss(5, 3), 400.0]), i % 7, draw.choice(["a", "b", None, f"rare{i % 40}"]), i % 5 - 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, n int, word string, fold int")
    trains = [[-1, 0], [-1, 0, 1, 3], [2]]
    for recipe in (modeling.Recipe(), modeling.Recipe(impute="mean", clip=("x", "n")), modeling.Recipe(clip=("x",), flags=("x", "word"))):
        made, touched = modeling.fold_preparations(df, ["x", "n", "word"], recipe, trains)
        most = 0
        for train, got in zip(trains, made):
            own = df.where(F.col("fold").isin(train))
            want = modeling.fit_preparation(own, ["x", "n", "word"], recipe)
            assert got.bounds == want.bounds and list(got.columns) == list(want.columns)
            both = df.select(*[e.alias(f"a{i}") for i, e in enumerate(got.columns.values())], *[e.alias(f"b{i}") for i, e in enumerate(want.columns.values())]).collect()
            assert all(r[f"a{i}"] == pytest.approx(r[f"b{i}"], abs=1e-9) for r in both for i in range(len(got.columns)))
            inside = [r for r in rows if r[4] in train]
            most = max(most, sum((lo > r[at]) + (r[at] > hi) for r in inside for at, c in ((1, "x"), (2, "n")) if c in got.bounds and r[at] is not None for lo, hi in [got.bounds[c]])
                       + sum(r[at] is None for r in inside for at, c in ((1, "x"), (3, "word")) if c in recipe.flags))
        assert touched == most
    codes = {r["value"]: r["codes"] for r in modeling.fold_codes(df, ["word"], trains).collect()}
    for i, train in enumerate(trains):
        seen = sorted({r[3] or modeling.MISSING for r in rows if r[4] in train})
        assert all(codes[v][i] == (seen.index(v) if v in seen else -1) for v in codes)


@pytest.mark.parametrize("k", [2, 5])
def test_blocks_in_time_with_ties_and_unknown_times(spark, k):
    rows = [(i * 7919 % 211, None if i % 4 == 0 else float(i % 5)) for i in range(211)]
    df = spark.createDataFrame(rows, "id int, t double")
    got = {r["id"]: r["fold"] for r in modeling.chronological_folds(df, "t", "id", k).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    block = 211 // (k + 1)
    first = 211 - k * block
    assert got == {key: -1 if at < first else (at - first) // block for at, (key, _) in enumerate(order)}
    few = modeling.chronological_folds(df.limit(2), "t", "id", 5).collect()
    assert [r["fold"] for r in few] == [-1, -1]


def test_a_forest_on_stored_folds(spark):
    df = spark.range(300).selectExpr("id", "id % 2 AS y", "(id % 2) * 3 + rand(1) AS x", "CASE WHEN id % 9 = 0 THEN NULL ELSE concat('w', id % 3) END AS word")
    for isolated in (True, False):
        result = modeling.cross_validate(df, [], "y", "binary_classification", "id", isolated=isolated, k=3)
        assert result["predictions"].count() == 300 and result["score"] == 1.0
