"""Quality detectors: duplicates, constants, missingness, outliers, cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import families
from gaugework.functions.numeric import rounded
from gaugework.operators import findings as fd
from gaugework.operators.association import indicator_links, target_links
from gaugework.operators.lineage import stored
from gaugework.operators.ordered import merged, value_counts
from gaugework.operators.profile import NUMERIC, Counted, duplicate_rows, numeric_moments, quantiles
from gaugework.options import Thresholds


def missingness_links(
    df: DataFrame, columns: list[str], target: str | None, limits: Thresholds = Thresholds()
) -> DataFrame:
    """column, other, n, stat_name, value, p_value, is_target, is_informative for all columns with gaps."""
    others = [c for c in df.columns if c != target]
    feature = indicator_links(df, columns, others).select(
        "column", "other", "n", F.lit("cramers_v").alias("stat_name"), F.col("cramers_v").alias("value"),
        F.lit(None).cast("double").alias("p_value"), F.lit(False).alias("is_target"),
        (F.col("cramers_v") > limits.missing_feature_link).alias("is_informative"),
    )
    gaps = [c for c in columns if c != target]
    if target is None or not gaps:
        return feature
    strong = F.abs("value") > limits.missing_target_link
    sure = F.coalesce(F.col("p_value") < limits.missing_p_value, F.col("stat_name") == "cramers_v")
    linked = target_links(df, gaps, target).select(
        "column", F.lit(target).alias("other"), "n", "stat_name", rounded("value").alias("value"), "p_value",
        F.lit(True).alias("is_target"),
        F.coalesce(strong & sure & (F.col("n") > 20), F.lit(False)).alias("is_informative"),
    )
    return feature.unionByName(linked)


def outlier_stats(
    df: DataFrame, columns: list[str] | None = None, limits: Thresholds = Thresholds(), counted: Counted | None = None
) -> DataFrame:
    """column, n, q25, q75, iqr, bounds and counts of IQR and z-score outliers.

    Quartiles come from the ordered value table; counting then reads one row per distinct value with
    the bounds of its column broadcast. Where the profile has counted the values, nothing is counted or ordered again.
    """
    kinds = families(df, columns)
    numeric = [c for c, k in kinds.items() if k in NUMERIC]
    if counted:
        chosen = F.col("column").isin(numeric)
        tables = {kind: t.where(chosen) for kind, t in counted.tables.items()}
        quartiles = counted.points.where(chosen).select("column", F.col("p25").alias("q25"), F.col("p75").alias("q75"))
        moments = counted.moments.where(chosen)
    else:
        tables = {kind: stored(t, "outlier-values") for kind, t in value_counts(df, numeric).items()}
        quartiles = quantiles(tables, {"q25": 0.25, "q75": 0.75})
        moments = numeric_moments(df, numeric)
    quartiles = quartiles.withColumn("iqr", F.col("q75") - F.col("q25"))
    moments = moments.select("column", F.col("n").alias("rows"), "mean", "std")
    mild, extreme = F.lit(limits.outlier_mild_iqr), F.lit(limits.outlier_extreme_iqr)
    bounds = (
        quartiles.join(F.broadcast(moments), "column").where((F.col("rows") >= 30) & (F.col("iqr") > 0))
        .withColumn("lower", F.col("q25") - extreme * F.col("iqr"))
        .withColumn("upper", F.col("q75") + extreme * F.col("iqr"))
        .withColumn("mild_lower", F.col("q25") - mild * F.col("iqr"))
        .withColumn("mild_upper", F.col("q75") + mild * F.col("iqr"))
    )
    v, n = F.col("value"), F.col("n")
    outside = lambda lo, hi: (v < F.col(lo)) | (v > F.col(hi))
    z = F.when(F.col("std") > 0, F.abs((v - F.col("mean")) / F.col("std")))
    per_column = ["rows", "q25", "q75", "iqr", "lower", "upper"]
    # broadcast: one row per numeric column
    summed = merged(tables, "double", NUMERIC).join(F.broadcast(bounds), "column").groupBy("column", *per_column).agg(
        F.sum(F.when(outside("mild_lower", "mild_upper"), n).otherwise(0)).alias("mild_count"),
        F.sum(F.when(outside("lower", "upper"), n).otherwise(0)).alias("extreme_count"),
        F.sum(F.when(z > limits.outlier_z, n).otherwise(0)).alias("z_count"),
    )
    return summed.select(
        "column", F.col("rows").alias("n"), "q25", "q75", "iqr", "lower", "upper", "mild_count",
        "extreme_count", "z_count", (F.col("extreme_count") / F.col("rows")).alias("extreme_pct"),
        (F.col("mild_count") / F.col("rows")).alias("mild_pct"),
    )


def flagged_outliers(stats: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Columns whose tails call for a finding, with the severity."""
    return stats.where(
        (F.col("extreme_pct") >= limits.outlier_extreme_pct) | (F.col("mild_pct") > limits.outlier_mild_pct)
    ).withColumn("severity", F.when(F.col("extreme_pct") > limits.outlier_warning_pct, "WARNING").otherwise("INFO"))


def quality_findings(
    df: DataFrame, profile: DataFrame, target: str | None = None, limits: Thresholds = Thresholds(),
    roles: list | None = None, counted: Counted | None = None,
) -> DataFrame:
    """Findings F-Q101... from the column profile and the detectors above.

    ``roles`` are the collected profile rows (name, missing_count, is_constant, is_id, family); they
    decide which columns the later plans touch. ``counted`` are the counts from which the profile was made.
    """
    roles = roles or profile.select("name", "family", "missing_count", "is_constant", "is_id").collect()
    prof = profile.select(
        F.col("name").alias("column"), "position", "n_rows", "missing_count", "missing_pct", "unique_count",
        "unique_ratio", "is_constant", "is_id", "family", F.col("sample_values")[0].alias("sample"),
    )
    name = F.col("column")
    percent = lambda c, d: F.format_string(f"%.{d}f%%", F.col(c) * 100)
    place = lambda step: [fd.padded(F.col("position") + 1), F.lit(step)]
    parts = []

    copies = duplicate_rows(df).where("duplicate_rows > 0")
    parts.append(fd.finding(
        copies, kind="format_error", status="OBSERVED",
        severity=F.when(F.col("duplicate_pct") > limits.duplicate_warning_pct, "WARNING").otherwise("INFO"),
        column=F.lit(None), title=F.lit("Exact duplicate rows"),
        description=F.concat(F.col("duplicate_rows").cast("string"), F.lit(" rows repeat an earlier row ("),
                             percent("duplicate_pct", 2), F.lit(").")),
        evidence=fd.evidence(duplicate_count=F.col("duplicate_rows"), duplicate_pct=F.col("duplicate_pct"),
                             total_rows=F.col("row_count")),
        confidence=1.0, recommendation="Check whether repeated rows are separate events before removing them.",
        question=F.lit("Should repeated rows be removed before evaluation?"), order=[fd.padded(F.lit(0)), F.lit("a")],
    ))
    parts.append(fd.finding(
        prof.where("is_constant"), kind="constant_column", status="OBSERVED", severity="INFO", column=name,
        title=F.concat(F.lit("Constant column: "), name),
        description=F.concat(name, F.lit(" holds "), F.col("unique_count").cast("string"), F.lit(" distinct value(s).")),
        evidence=fd.evidence(unique_count=F.col("unique_count"), sample_value=F.col("sample")),
        confidence=1.0, recommendation="Leave constant columns out of models.", order=place("a"),
    ))

    gaps = [r["name"] for r in roles if r["missing_count"] > 0 and not r["is_constant"]]
    if gaps:
        links = missingness_links(df, gaps, target, limits)
        order = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("value"), "other"))
        best = links.where("NOT is_target").withColumn("_r", order).where("_r = 1").select(
            "column", F.col("other").alias("feature"), F.col("value").alias("feature_v")
        )
        tied = links.where("is_target AND is_informative").select(
            "column", F.col("other").alias("target"), F.col("value").alias("target_v"),
            F.col("stat_name").alias("target_stat"), F.col("p_value").alias("target_p"),
        )
        rows = (
            prof.where(name.isin(gaps)).join(F.broadcast(best), "column", "left").join(F.broadcast(tied), "column", "left")
            .withColumn("informative", F.col("target").isNotNull() | F.coalesce(F.col("feature_v") > limits.missing_feature_link, F.lit(False)))
        )
        linked = F.col("feature_v") > limits.missing_feature_link
        parts.append(fd.finding(
            rows, kind="missingness", status=F.when(F.col("informative"), "SUSPECTED").otherwise("OBSERVED"),
            severity=F.when((F.col("missing_pct") >= limits.missing_warning_pct) | F.col("informative"), "WARNING").otherwise("INFO"),
            column=name, title=F.concat(F.lit("Missing values in "), name, F.lit(" ("), percent("missing_pct", 1), F.lit(")")),
            description=F.concat(
                F.col("missing_count").cast("string"), F.lit(" values are missing ("), percent("missing_pct", 1), F.lit(")."),
                F.when(F.col("informative"), " Whether a value is missing depends on other columns.").otherwise(""),
            ),
            evidence=fd.evidence(
                missing_count=F.col("missing_count"), missing_pct=F.col("missing_pct"), is_informative=F.col("informative"),
                target=F.col("target"), target_statistic=F.col("target_stat"), target_value=F.col("target_v"),
                target_p_value=rounded("target_p"), feature=F.when(linked, F.col("feature")),
                feature_cramers_v=F.when(linked, F.col("feature_v")),
            ),
            confidence=F.when(F.col("informative"), 0.90).otherwise(0.80),
            recommendation="Compare dropping, imputing and flagging the missing values in one experiment.",
            question=F.concat(F.lit("Does keeping "), name, F.lit(" with explicit handling of its gaps beat dropping it?")),
            order=place("b"),
        ))

    numeric = [r["name"] for r in roles if r["family"] in NUMERIC and not r["is_id"] and not r["is_constant"]]
    if numeric:
        stats = flagged_outliers(outlier_stats(df, numeric, limits, counted), limits)
        rows = stats.join(F.broadcast(prof.select("column", "position")), "column")
        parts.append(fd.finding(
            rows, kind="outliers", status="OBSERVED", severity=F.col("severity"), column=name,
            title=F.concat(F.lit("Long tails in "), name),
            description=F.concat(F.col("extreme_count").cast("string"), F.lit(" values lie beyond three interquartile ranges ("),
                                 percent("extreme_pct", 2), F.lit(").")),
            evidence=fd.evidence(
                extreme_outliers_count=F.col("extreme_count"), extreme_pct=rounded("extreme_pct"),
                mild_outliers_count=F.col("mild_count"), zscore_outliers_count=F.col("z_count"),
                q25=rounded("q25"), q75=rounded("q75"), iqr=rounded("iqr"),
                extreme_lower_bound=rounded("lower"), extreme_upper_bound=rounded("upper"),
            ),
            confidence=0.85, recommendation="Decide whether extreme values are rare events or errors.",
            question=F.concat(F.lit("Does clipping "), name, F.lit(" steady the validation score?")), order=place("c"),
        ))
    wide = prof.where(
        (F.col("family") == "string") & ~F.col("is_id") & ~F.col("is_constant")
        & (F.col("unique_count") > limits.high_cardinality) & (F.col("unique_ratio") < limits.high_cardinality_ratio)
    )
    parts.append(fd.finding(
        wide, kind="high_cardinality", status="OBSERVED", severity="INFO", column=name,
        title=F.concat(F.lit("Many categories in "), name),
        description=F.concat(name, F.lit(" has "), F.col("unique_count").cast("string"), F.lit(" categories.")),
        evidence=fd.evidence(unique_count=F.col("unique_count"), unique_ratio=F.col("unique_ratio")),
        confidence=0.85, recommendation="Consider grouping rare categories.",
        question=F.concat(F.lit("Does grouping the categories of "), name, F.lit(" keep the score with a simpler model?")),
        order=place("d"),
    ))
    return fd.numbered(parts, "F-Q", 101)
