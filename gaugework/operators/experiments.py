"""Controlled comparisons of data treatments on identical folds and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import families, present
from gaugework.operators.modeling import Folds, Recipe, cross_validate, model_features
from gaugework.operators.profile import NUMERIC

# The registered strategies and their complexity.
STRATEGY_COMPLEXITY = {
    "DROP_FEATURE": "Low", "MEDIAN_IMPUTATION": "Low", "MISSING_INDICATOR": "Low", "BASELINE_WITH_FEATURE": "Low",
    "REMOVE_SUSPECT_FEATURE": "Low", "KEEP_ALL_CORRELATED": "Medium", "PRUNE_CORRELATED_GROUP": "Low",
    "RAW_FEATURES": "Low", "WINSORIZE_OUTLIERS": "Low",
}
VARIANT_SCHEMA = (
    "strategy_id string, is_baseline boolean, primary_metric_name string, primary_score double, "
    "secondary_metrics map<string,double>, delta_from_baseline double, delta_pct double, rows_affected bigint, "
    "rows_retained_pct double, feature_count int, pipeline_complexity string, delta_label string, "
    "practical_importance string, split string, folds int"
)
EXPERIMENT_SCHEMA = (
    "id string, name string, category string, baseline_metric_name string, baseline_score double, "
    "modified_score double, delta double, delta_pct double, status string, metrics map<string,double>"
)


def _treatment(strategy: str, affected: list[str]) -> tuple[set[str], Recipe]:
    """(columns to leave out, preparation recipe) of a strategy."""
    out: set[str] = set()
    recipe = Recipe()
    if strategy in ("DROP_FEATURE", "REMOVE_SUSPECT_FEATURE"):
        out = set(affected)
    elif strategy == "PRUNE_CORRELATED_GROUP":
        out = set(affected[1:])
    elif strategy == "MISSING_INDICATOR":
        recipe = Recipe(flags=tuple(affected))
    elif strategy == "WINSORIZE_OUTLIERS":
        recipe = Recipe(clip=tuple(affected))
    return out, recipe


def evaluate_strategy(
    df: DataFrame, roles: list, target: str, target_type: str, key: str, strategy: str, affected: list[str],
    baseline: float | None = None, is_baseline: bool = False, time: str | None = None, k: int | None = None, folds: Folds | None = None,
) -> dict:
    """One variant row; all preparation is fitted inside the training folds."""
    time = time if time in df.columns else None
    exclude, recipe = _treatment(strategy, affected)
    result = cross_validate(df, roles, target, target_type, key, exclude, recipe, True, time, k, folds)
    if strategy == "DROP_FEATURE":
        kinds = families(df, [c for c in affected if c in df.columns])
        gaps = [F.sum(present(c, t).isNull().cast("bigint")) for c, t in kinds.items()]
        affected_rows = sum(v or 0 for v in df.where(F.col(f"`{target}`").isNotNull()).agg(*gaps).first()) if gaps else 0
    elif strategy == "REMOVE_SUSPECT_FEATURE" or (strategy == "PRUNE_CORRELATED_GROUP" and len(affected) > 1):
        affected_rows = result["rows"]
    else:
        affected_rows = result["rows_touched"]
    score = round(result["score"], 4)
    reference = score if baseline is None or is_baseline else baseline
    delta = 0.0 if is_baseline else round(score - reference, 4)
    size = abs(delta)
    importance = "Material" if size > 0.02 else "Moderate" if size > 0.005 else "Negligible"
    return {
        "strategy_id": strategy, "is_baseline": is_baseline, "primary_metric_name": result["metric_name"], "primary_score": score,
        "secondary_metrics": {m: v for m, v in result["metrics"].items() if v is not None},
        "delta_from_baseline": delta, "delta_pct": round(delta / reference * 100, 2) if reference else 0.0,
        "rows_affected": affected_rows, "rows_retained_pct": 100.0, "feature_count": result["feature_count"],
        "pipeline_complexity": STRATEGY_COMPLEXITY.get(strategy, "Low"),
        # a label for the size of the difference; no test is run
        "delta_label": "Distinct" if size >= 0.015 else "Indistinguishable", "practical_importance": importance,
        "split": "chronological" if time else ("stratified" if target_type != "regression" else "plain"), "folds": result["folds"],
    }


def interpretation(category: str, variants: list[dict], affected: list[str]) -> str:
    """One sentence on what the comparison shows."""
    best = max(variants, key=lambda v: v["primary_score"])
    by_id = {v["strategy_id"]: v for v in variants}
    name = ", ".join(affected)
    if category == "suspected_leakage":
        removed = by_id.get("REMOVE_SUSPECT_FEATURE")
        if removed and removed["delta_from_baseline"] < -0.03:
            return f"The score relies on {name}: it changes by {removed['delta_from_baseline']:+.3f} without it."
        return f"Leaving out {name} costs little."
    if category == "missingness_strategy":
        if best["strategy_id"] == "MISSING_INDICATOR" and best["delta_from_baseline"] > 0.005:
            return f"Flagging the gaps of {name} scores best ({best['primary_score']:.3f})."
        if best["strategy_id"] == "DROP_FEATURE":
            return f"Dropping {name} scores best ({best['primary_score']:.3f})."
        return f"Median imputation of {name} scores {best['primary_score']:.3f}; the variants are close."
    if category == "feature_redundancy":
        pruned = by_id.get("PRUNE_CORRELATED_GROUP")
        if pruned and abs(pruned["delta_from_baseline"]) <= 0.01:
            return f"Pruning {', '.join(affected[1:])} keeps the score."
        return f"Keeping all of {name} scores slightly better."
    return f"{len(variants)} variants compared."


def shared_folds(
    df: DataFrame, roles: list, target: str, target_type: str, key: str, time: str | None = None, k: int | None = None,
) -> Folds:
    """The folds of all variants of ``df``: every feature that one of them may use is in."""
    time = time if time in df.columns else None
    return Folds(df, target, target_type, key, model_features(df, roles, target, key, time), time, k)


def investigate(
    df: DataFrame, roles: list, target: str, target_type: str, key: str, category: str, affected: list[str],
    strategies: list[str], time: str | None = None, k: int | None = None, folds: Folds | None = None,
) -> tuple[DataFrame, str]:
    """(one row per strategy with its difference to the first one, interpretation). All strategies share the folds.

    Several comparisons on the same rows, or on some of their columns, may share ``folds`` too.
    """
    folds = folds or shared_folds(df, roles, target, target_type, key, time, k)
    rows: list[dict] = []
    for s in strategies:
        first = rows[0]["primary_score"] if rows else None
        rows.append(evaluate_strategy(df, roles, target, target_type, key, s, affected, first, not rows, time, k, folds))
    return df.sparkSession.createDataFrame(rows, VARIANT_SCHEMA), interpretation(category, rows, affected)


def run_experiments(
    df: DataFrame, roles: list, target: str, target_type: str, key: str, findings: list, baseline: dict | None = None,
    k: int | None = None,
) -> DataFrame:
    """Baseline, leakage removal, clipping and mean imputation, as far as findings call for them.

    ``findings`` are collected rows with type and column. Preparation is fitted on all rows here;
    :func:`evaluate_strategy` is the fold-isolated form.
    """
    folds = shared_folds(df, roles, target, target_type, key, k=k)
    base = baseline or cross_validate(df, roles, target, target_type, key, isolated=False, k=k, folds=folds)
    named = lambda kind: [f["column"] for f in findings if f["type"] == kind and f["column"]]
    leaks, gaps, tails = named("target_leakage"), named("missingness"), named("outliers")
    rows: list[dict] = []

    def add(name: str, category: str, result: dict, reference: float, status) -> float:
        score = round(result["score"], 4)
        delta = round(score - reference, 4)
        rows.append({
            "id": f"EXP-{len(rows) + 1:03d}", "name": name, "category": category, "baseline_metric_name": base["metric_name"],
            "baseline_score": reference, "modified_score": score, "delta": delta,
            "delta_pct": round(delta / reference * 100, 2) if reference else 0.0, "status": status(delta),
            "metrics": {m: v for m, v in result["metrics"].items() if v is not None},
        })
        return score

    start = add("baseline", "baseline", base, round(base["score"], 4), lambda d: "baseline")
    reference = start
    run = lambda recipe: cross_validate(df, roles, target, target_type, key, set(leaks), recipe, False, k=k, folds=folds)
    if leaks:
        reference = add(
            "without leaky features", "target_leakage", run(Recipe()), start,
            lambda d: "leakage_confirmed" if d < -0.03 else "neutral" if abs(d) <= 0.03 else "improved")
    if tails:
        numeric = tuple(c for c, t in families(df).items() if t in NUMERIC)
        add("clipped at p1 and p99", "outliers", run(Recipe(clip=numeric)), reference,
            lambda d: "improved" if d > 0.005 else "degraded" if d < -0.01 else "neutral")
    if gaps:
        add("mean instead of median imputation", "missingness", run(Recipe(impute="mean")), reference,
            lambda d: "improved" if d > 0.005 else "degraded" if d < -0.005 else "neutral")
    return df.sparkSession.createDataFrame(rows, EXPERIMENT_SCHEMA)
