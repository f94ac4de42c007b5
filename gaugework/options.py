"""Thresholds, enumerations and run options."""

from __future__ import annotations

from dataclasses import dataclass

# The enumerations used in result columns.
SEVERITIES = ("CRITICAL", "WARNING", "INFO")
FINDING_STATUSES = ("OBSERVED", "SUSPECTED", "CONFIRMED", "NOT_ASSESSED")
DECISION_STATUSES = (
    "OBSERVED", "INVESTIGATING", "EXPERIMENT_READY", "EXPERIMENT_RUNNING", "EVIDENCE_AVAILABLE",
    "USER_DECISION", "INCONCLUSIVE", "NOT_APPLICABLE", "FAILED",
)
OBJECTIVES = (
    "predictive_performance", "generalization", "interpretability", "simplicity",
    "data_retention", "efficiency",
)
FINDING_CATEGORIES = (
    "target_leakage", "train_test_contamination", "missingness", "outliers", "format_error",
    "distribution_drift", "slice_bias", "constant_column", "high_cardinality", "multicollinearity",
)


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the detectors (fixed values)."""

    leak_auc_strong: float = 0.94
    leak_auc_weak: float = 0.88
    leak_corr_strong: float = 0.85
    leak_corr_weak: float = 0.70
    missing_p_value: float = 0.01
    missing_target_link: float = 0.15
    missing_feature_link: float = 0.20
    missing_warning_pct: float = 0.10
    outlier_extreme_pct: float = 0.03
    outlier_mild_pct: float = 0.08
    outlier_warning_pct: float = 0.05
    outlier_z: float = 3.0
    outlier_mild_iqr: float = 1.5
    outlier_extreme_iqr: float = 3.0
    duplicate_warning_pct: float = 0.05
    high_cardinality: int = 50
    high_cardinality_ratio: float = 0.85
    psi_critical: float = 0.25
    psi_warning: float = 0.10
    psi_with_ks: float = 0.08
    ks_p_value: float = 0.001
    psi_bins: int = 10
    slice_min_rows: int = 25
    slice_gap: float = 0.15
    slice_error_ratio: float = 1.30
    collinear: float = 0.85


@dataclass(frozen=True)
class AuditOptions:
    """What to audit and how. ``order_by`` is a unique row key: it fixes samples, splits and folds."""

    order_by: str | None = None
    target: str | None = None
    split_column: str | None = None
    time_column: str | None = None
    task_type: str | None = None
    objective: str = "predictive_performance"
    approx: bool = False
    with_models: bool = True
    thresholds: Thresholds = Thresholds()
