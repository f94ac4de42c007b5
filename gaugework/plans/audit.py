"""The full audit: every stage in order, each stored once before the next builds on it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import families
from gaugework.operators import decisions, drift, fairness, leakage, quality
from gaugework.operators import findings as fd
from gaugework.operators.experiments import run_experiments
from gaugework.operators.lineage import settled, stored
from gaugework.operators.modeling import cross_validate
from gaugework.operators.profile import NUMERIC, dataset_profile, profile_columns
from gaugework.options import AuditOptions

LEAST_MODEL_ROWS = 30


@dataclass
class AuditResult:
    """Result tables by name and the readiness sentence."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    readiness: str = ""


def readiness_text(candidates: int, target: str | None) -> str:
    if candidates:
        return f"{candidates} decision(s) may change the evaluation."
    return "No decision with high impact found." if target else "Unsupervised data; supervised decisions are left out."


def audit(df: DataFrame, options: AuditOptions) -> AuditResult:
    """Run all stages. ``options.order_by`` is a unique row key.

    Only one row per column and the boundaries of a split come to the driver. A stage that fails stops
    the run instead of silently leaving its tables out.
    """
    if not df.columns or df.limit(1).count() == 0:
        raise ValueError("the table is empty")
    key, limits = options.order_by, options.thresholds
    if key is None:
        raise ValueError("order_by must name a unique row key")
    df = stored(df, "audited-rows")  # every stage reads them, most of them several times
    dataset = settled(dataset_profile(df, options.target))
    size = dataset.first()
    target, task = size["target"], size["target_type"]
    profile = settled(profile_columns(df, target, key, options.approx))
    roles = profile.select("name", "family", "unique_count", "missing_count", "is_constant", "is_id").collect()
    result = AuditResult({"dataset": dataset, "profile": profile})

    found = [quality.quality_findings(df, profile, target, limits, roles)]
    if target:
        found.append(leakage.leakage_findings(df, roles, target, task, limits))
    found.append(leakage.contamination_findings(df, roles, key, options.split_column))

    if size["row_count"] >= drift.LEAST_ROWS:
        part = drift.partition_for_drift(df, key, options.split_column, options.time_column)
        sides = df.agg(F.count_if(part.base).alias("b"), F.count_if(part.current).alias("c")).first()
        skip = {target, options.split_column, options.time_column}
        columns = [r["name"] for r in roles if r["name"] not in skip and not r["is_id"] and not r["is_constant"]]
        if min(sides["b"], sides["c"]) >= drift.LEAST_PART and columns:
            metrics, bins = drift.drift_tables(df, columns, part, limits)
            result.tables["drift"] = settled(metrics)
            result.tables["drift_bins"] = bins
            found.append(drift.drift_findings(df, result.tables["drift"], part))
    findings = settled(_union(found, df))

    experiments = None
    if target and options.with_models and size["row_count"] >= LEAST_MODEL_ROWS:
        base = cross_validate(df, roles, target, task, key, isolated=False)
        slices = fairness.candidate_slices(df, [r for r in roles if r["name"] != key], target)
        if slices:
            scored = base["predictions"].select(F.col("key").alias("_pk"), F.col("y").alias("_y"), F.col("prediction").alias("_p"))
            joined = df.join(scored, F.col(f"`{key}`") == F.col("_pk"))
            metrics = settled(fairness.slice_metrics(joined, F.col("_y"), F.col("_p"), slices, task != "regression", limits))
            result.tables["slices"] = metrics
            findings = settled(findings.unionByName(fairness.slice_findings(df, metrics, list(slices))))
        rows = [r.asDict() for r in findings.select("type", "column").collect()]
        experiments = run_experiments(df, roles, target, task, key, rows, base)
        result.tables["experiments"] = experiments

    numeric = [c for c, k in families(df).items() if k in NUMERIC]
    candidates = settled(decisions.decision_candidates(
        findings, df, target, task, options.objective, options.task_type, numeric))
    health = settled(decisions.health_score(findings, target is not None))
    result.tables |= {
        "findings": findings, "decision_candidates": candidates, "health": health,
        "summary": decisions.executive_summary(findings, health, dataset, experiments),
    }
    result.readiness = readiness_text(candidates.count(), target)
    return result


def _union(parts: list[DataFrame], df: DataFrame) -> DataFrame:
    out = fd.empty(df)
    for p in parts:
        out = out.unionByName(p)
    return out
