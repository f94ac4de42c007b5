"""Decision candidates, recorded decisions, health score and summary over the findings table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.operators.association import pearson_pairs
from gaugework.options import Thresholds

# Strategies per decision category, penalties, weights and grades.
STRATEGIES = {
    "suspected_leakage": ["BASELINE_WITH_FEATURE", "REMOVE_SUSPECT_FEATURE"],
    "missingness_strategy": ["DROP_FEATURE", "MEDIAN_IMPUTATION", "MISSING_INDICATOR"],
    "feature_redundancy": ["KEEP_ALL_CORRELATED", "PRUNE_CORRELATED_GROUP"],
    "outlier_treatment": ["RAW_FEATURES", "WINSORIZE_OUTLIERS"],
}
PENALTIES = {"CRITICAL": 15.0, "WARNING": 5.0, "INFO": 1.0}
OTHER_PENALTY = 3.0
WEIGHTS = {"quality": 0.30, "leakage": 0.30, "drift": 0.20, "fairness": 0.20}
GRADES = [(90, "A+"), (80, "A"), (70, "B"), (55, "C"), (40, "D")]
MAX_CANDIDATES, MAX_LEAKAGE = 4, 2
MISSING_WINDOW = (0.02, 0.85)

CANDIDATE_COLUMNS = [
    "decision_id", "finding_ids", "category", "question", "affected_columns", "rationale",
    "expected_impact", "evidence", "evidence_block", "available_strategies", "confidence", "status",
]


def collinear_pairs(
    df: DataFrame, columns: list[str], limit: float = Thresholds.collinear, least_rows: int = 30
) -> DataFrame:
    """c1, c2, i, r, n: for each column its first partner with |r| at or above ``limit``."""
    strong = pearson_pairs(df, columns).where(
        (F.col("n") > least_rows) & ~F.isnan("r") & (F.abs("r") >= limit))
    first = F.row_number().over(Window.partitionBy("i").orderBy("j"))
    return strong.withColumn("_nth", first).where("_nth = 1").select("c1", "c2", "i", "n", "r")


def _block(observation: Column, known: list[Column], unknown: list[Column], metric: str) -> Column:
    held = {
        "model": "random forest, 50 trees, depth 6", "validation": "5 folds, seed 42",
        "preprocessing": "fitted inside each training fold", "metric": metric,
        "changed": "the treatment only",
    }
    return F.struct(
        observation.alias("observation"), F.array(*known).alias("what_we_know"),
        F.array(*unknown).alias("what_is_unknown"),
        F.create_map(*[F.lit(x) for kv in held.items() for x in kv]).alias("controlled_parameters"),
    )


def _candidates(
    rows: DataFrame, category: str, question: Column, columns: Column, ids: Column, rationale: Column,
    impact: Column | str, evidence: Column, block: Column, confidence: float, order: Column,
) -> DataFrame:
    return rows.select(
        ids.alias("finding_ids"), F.lit(category).alias("category"), question.alias("question"),
        columns.alias("affected_columns"), rationale.alias("rationale"),
        (impact if isinstance(impact, Column) else F.lit(impact)).alias("expected_impact"),
        evidence.alias("evidence"), block.alias("evidence_block"),
        F.array(*[F.lit(s) for s in STRATEGIES[category]]).alias("available_strategies"),
        F.lit(confidence).alias("confidence"), order.alias("_order"),
    )


def decision_candidates(
    findings: DataFrame, df: DataFrame | None, target: str | None, target_type: str | None,
    objective: str = "predictive_performance", task_type: str | None = None,
    numeric: list[str] | None = None, exclude: list[str] | None = None,
) -> DataFrame:
    """At most four numbered decisions: leakage, missingness, redundancy, outliers, in this order.

    Without a target, or for an unsupervised task, the result is empty. ``numeric`` are the columns
    looked at for redundancy (``exclude`` removes some, such as identifiers).
    """
    metric = "R2" if target_type == "regression" else "ROC-AUC"
    name, ev = F.col("column"), F.col("evidence")
    one_column, one_id = F.array("column"), F.array("id")
    unsupervised = target is None or task_type == "unsupervised"
    rows = findings.where(F.lit(not unsupervised))

    suspects = rows.where("type = 'target_leakage' AND status = 'SUSPECTED' AND column IS NOT NULL")
    top = suspects.withColumn("_nth", F.row_number().over(Window.partitionBy("type").orderBy("id"))).where(
        F.col("_nth") <= MAX_LEAKAGE)
    leak = _candidates(
        top, "suspected_leakage",
        F.concat(F.lit("How much of the score rests on suspicious feature "), name, F.lit("?")),
        one_column, one_id, F.concat(name, F.lit(" dominates the prediction; an ablation shows what remains.")),
        "HIGH", ev,
        _block(F.concat(name, F.lit(" alone predicts the target almost fully.")),
               [F.lit("association with the target is exceptional"), F.lit("association is no proof of cause")],
               [F.lit("whether the value exists at prediction time"), F.lit("the score without the feature")], metric),
        0.90, F.concat(F.lit("1"), F.lpad(F.col("_nth").cast("string"), 6, "0")),
    )

    pct = ev["missing_pct"].cast("double")
    informative = F.coalesce(ev["is_informative"] == "true", F.lit(False))
    gaps = rows.where("type = 'missingness' AND column IS NOT NULL").withColumn("_pct", pct).where(
        F.col("_pct").between(*MISSING_WINDOW))
    by_weight = Window.partitionBy("type").orderBy(
        F.desc((F.col("status") == "SUSPECTED").cast("int")), F.desc("_pct"), "id")
    gaps = gaps.withColumn("_nth", F.row_number().over(by_weight))
    impact = F.when(informative | (F.col("_pct") > 0.20) | F.lit(objective == "simplicity"), "HIGH").otherwise("MEDIUM")
    percent = F.format_string("%.1f%%", F.col("_pct") * 100)
    missing = _candidates(
        gaps, "missingness_strategy",
        F.concat(F.lit("Does retaining '"), name, F.lit("' and handling its gaps beat dropping it?")),
        one_column, one_id, F.concat(percent, F.lit(" of "), name, F.lit(" is missing; the variants are compared.")),
        impact, ev,
        _block(F.concat(percent, F.lit(" of the values of "), name, F.lit(" are missing.")),
               [F.when(informative, "gaps depend on other columns").otherwise("gaps need dropping or filling")],
               [F.lit("whether the column helps at all"), F.lit("whether a gap flag helps without overfitting")], metric),
        0.85, F.concat(F.lit("2"), F.lpad(F.col("_nth").cast("string"), 6, "0")),
    )
    parts = [leak, missing]

    skip = set(exclude or []) | {target}
    looked_at = [c for c in (numeric or []) if c not in skip]
    if df is not None and not unsupervised and len(looked_at) > 1:
        pairs = collinear_pairs(df, looked_at)
        r = F.format_string("%.3f", F.col("r"))
        parts.append(_candidates(
            pairs, "feature_redundancy",
            F.concat(F.lit("Does dropping collinear feature "), F.col("c2"), F.lit(" keep the score?")),
            F.array("c1", "c2"), F.array().cast("array<string>"),
            F.concat(F.col("c1"), F.lit(" and "), F.col("c2"), F.lit(" are collinear (r = "), r, F.lit(").")),
            "HIGH" if objective in ("simplicity", "interpretability") else "MEDIUM",
            F.create_map(F.lit("feature_1"), F.col("c1"), F.lit("feature_2"), F.col("c2"),
                         F.lit("correlation"), F.round("r", 3).cast("string")),
            _block(F.concat(F.lit("r = "), r, F.lit(" over "), F.col("n").cast("string"), F.lit(" rows.")),
                   [F.lit("both features carry mostly the same information")],
                   [F.lit("whether the score survives without the second one")], metric),
            0.85, F.concat(F.lit("3"), F.lpad(F.col("i").cast("string"), 6, "0")),
        ))

    tails = rows.where("type = 'outliers' AND column IS NOT NULL").withColumn(
        "_nth", F.row_number().over(Window.partitionBy("type").orderBy("id"))).where("_nth = 1")
    parts.append(_candidates(
        tails, "outlier_treatment",
        F.concat(F.lit("Does clipping extreme values of "), name, F.lit(" steady the score?")),
        one_column, one_id, F.concat(F.lit("Extreme values in "), name, F.lit("; clipping at p1/p99 is compared.")),
        "MEDIUM", ev,
        _block(F.concat(ev["extreme_outliers_count"], F.lit(" extreme values in "), name),
               [F.lit("extreme values can distort splits")], [F.lit("whether clipping generalises better")], metric),
        0.80, F.lit("4000001"),
    ))
    # small by construction: a few rows per finding
    ranked = reduce(DataFrame.unionByName, parts).withColumn("_set", F.lit("DEC"))
    place = F.row_number().over(Window.partitionBy("_set").orderBy("_order"))
    return ranked.withColumn("_place", place).where(F.col("_place") <= MAX_CANDIDATES).withColumn(
        "decision_id", F.format_string("DEC-%03d", "_place")
    ).withColumn("status", F.lit("EXPERIMENT_READY")).select(*CANDIDATE_COLUMNS)


def apply_decisions(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attach the latest recorded decision per id.

    ``decisions`` is append-only: decision_id, selected_strategy_id, decision_rationale, decided_at,
    custom_method_notes. The latest one is an aggregate, so a long history combines map-side.
    """
    chosen = decisions.groupBy("decision_id").agg(F.max_by(
        F.struct("selected_strategy_id", "decision_rationale", "decided_at", "custom_method_notes"),
        F.struct("decided_at", "selected_strategy_id"),
    ).alias("user_decision"))
    return candidates.join(chosen, "decision_id", "left").withColumn(
        "status", F.when(F.col("user_decision").isNotNull(), "USER_DECISION").otherwise(F.col("status")))


def _group(kind: Column) -> Column:
    return (
        F.when(kind.isin("target_leakage", "train_test_contamination"), "leakage")
        .when(kind == "distribution_drift", "drift").when(kind == "slice_bias", "fairness").otherwise("quality")
    )


def health_score(findings: DataFrame, has_target: bool = True) -> DataFrame:
    """One row: overall score, the four category scores and the grade."""
    points = F.lit(OTHER_PENALTY)
    for severity, value in PENALTIES.items():
        points = F.when(F.col("severity") == severity, F.lit(value)).otherwise(points)
    lost = findings.select(_group(F.col("type")).alias("g"), points.alias("points"))
    left = lambda g: F.greatest(
        F.lit(0.0), F.lit(100.0) - F.coalesce(F.sum(F.when(F.col("g") == g, F.col("points"))), F.lit(0.0)))
    scored = lost.agg(*[left(g).alias(f"{g}_score") for g in WEIGHTS])
    used = list(WEIGHTS) if has_target else ["quality", "drift"]
    if not has_target:
        scored = scored.withColumn("leakage_score", F.lit(0.0)).withColumn("fairness_score", F.lit(0.0))
    weight = sum(WEIGHTS[g] for g in used)
    overall = reduce(lambda a, b: a + b, [F.lit(WEIGHTS[g]) * F.col(f"{g}_score") for g in used])
    overall = F.round(F.least(F.lit(100.0), overall / F.lit(weight if not has_target else 1.0)), 1)
    grade = F.lit("F")
    for cut, letter in reversed(GRADES):
        grade = F.when(F.col("overall_score") >= cut, letter).otherwise(grade)
    return scored.withColumn("overall_score", overall).withColumn("grade", grade).select(
        "overall_score", *[F.round(f"{g}_score", 1).alias(f"{g}_score") for g in WEIGHTS], "grade")


def executive_summary(
    findings: DataFrame, health: DataFrame, dataset: DataFrame, experiments: DataFrame | None = None
) -> DataFrame:
    """One row: counts, flagged columns and one summary text built from them."""
    is_type = lambda t: F.col("type") == t
    counted = findings.agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_count"),
        # findings are bounded by the number of audited columns
        F.array_sort(F.collect_set(F.when(is_type("target_leakage"), F.col("column")))).alias("leaky_columns"),
        F.count_if(is_type("distribution_drift")).alias("drift_count"),
        F.count_if(is_type("slice_bias")).alias("slice_count"),
    ).withColumn("_one", F.lit(1))
    one = lambda d: F.broadcast(d.withColumn("_one", F.lit(1)))
    row = counted.join(one(health), "_one").join(one(dataset.select("row_count", "column_count")), "_one")
    ablation = F.lit(None).cast("string")
    if experiments is not None:
        shift = experiments.where("category = 'target_leakage'").limit(1).agg(F.max(F.format_string(
            "Without the suspicious features the score moves from %.3f to %.3f.", "baseline_score", "modified_score"
        )).alias("_shift"))
        row = row.join(one(shift), "_one")
        ablation = F.col("_shift")
    text = F.concat_ws(
        " ",
        F.format_string("%d rows and %d columns audited, health %.1f of 100 (grade %s).",
                        "row_count", "column_count", "overall_score", "grade"),
        F.when(F.col("critical_count") > 0, F.format_string("%d critical issue(s) need attention.", "critical_count"))
        .when(F.col("warning_count") > 0, F.format_string("%d warning(s) to address before use.", "warning_count"))
        .otherwise("No severe risks found."),
        F.when(F.size("leaky_columns") > 0, F.concat(F.lit("Possible leakage in "), F.array_join("leaky_columns", ", "), F.lit("."))),
        F.when(F.col("drift_count") > 0, F.format_string("%d feature(s) shifted.", "drift_count")),
        F.when(F.col("slice_count") > 0, F.format_string("%d slice(s) do worse than the whole.", "slice_count")),
        ablation,
    )
    return row.select(
        "critical_count", "warning_count", "leaky_columns", "drift_count", "slice_count", text.alias("summary"))
