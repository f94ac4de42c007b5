"""Per-slice model quality from given truth and prediction columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import families, present, ref
from gaugework.functions.numeric import rounded
from gaugework.operators import findings as fd
from gaugework.operators.ordered import _stacked, value_counts
from gaugework.operators.profile import NUMERIC, quantiles
from gaugework.options import Thresholds

# Name fragments of numeric columns that are cut into tertiles.
TERTILE_NAMES = ("age", "income", "tenure", "score")
MIN_GROUPS, MAX_GROUPS = 2, 8


def candidate_slices(df: DataFrame, roles: list, target: str | None) -> dict[str, Column]:
    """Slice name to slice expression: columns with 2-8 values, and tertiles of sensitively named numbers.

    ``roles`` are the collected profile rows (name, unique_count, is_id, is_constant).
    """
    kinds = families(df)
    usable = [r for r in roles if r["name"] != target and not r["is_id"] and not r["is_constant"]]
    out: dict[str, Column] = {}
    tertiles = []
    for r in usable:
        c = r["name"]
        if MIN_GROUPS <= r["unique_count"] <= MAX_GROUPS:
            # a missing category is a group of its own
            out[c] = F.coalesce(ref(c).cast("string"), F.lit("nan"))
        elif kinds[c] in NUMERIC and any(k in c.lower() for k in TERTILE_NAMES):
            tertiles.append(c)
    if tertiles:
        points = quantiles(value_counts(df, tertiles), {"q0": 0.0, "q1": 1 / 3, "q2": 2 / 3, "q3": 1.0})
        # four numbers per column
        for r in points.collect():
            edges = [r["q0"], r["q1"], r["q2"], r["q3"]]
            if len(set(edges)) < 4:
                continue
            x = present(r["column"], kinds[r["column"]]).cast("double")
            out[f"{r['column']}_quantile"] = (
                F.when(x <= edges[1], "Low").when(x <= edges[2], "Medium").when(x.isNotNull(), "High")
            )
    return out


def weighted_f1(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, n, score: weighted F1 from counts of (by, y, p).

    Per class, true positives, truths and predictions come from one regrouping of the counted cells.
    """
    truth = cells.select(*by, F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).alias("m"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    guess = cells.select(*by, F.col("p").alias("c"), F.lit(0).alias("t"), F.col("n").alias("m"), F.lit(0).alias("hit"))
    classes = truth.unionByName(guess).groupBy(*by, "c").agg(
        F.sum("t").alias("t"), F.sum("m").alias("m"), F.sum("hit").alias("hit"))
    f1 = 2.0 * F.col("hit") / (F.col("t") + F.col("m"))
    return classes.groupBy(*by).agg(
        F.sum("t").alias("n"), (F.sum(F.col("t") * f1) / F.sum("t")).alias("score"))


def slice_metrics(
    df: DataFrame, truth: Column, prediction: Column, slices: dict[str, Column], classification: bool,
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """feature, slice_value, counts, slice and overall score, ratio and disparity flag.

    Rows collapse to counts of (feature, slice, truth, prediction) before any shuffle; the overall
    score is read off one more slice that covers all rows.
    """
    everything = {"": F.lit("")}
    known = df.where(truth.isNotNull() & prediction.isNotNull())
    if classification:
        keep = [truth.cast("string"), prediction.cast("string")]
        long = _stacked(known, {**everything, **slices}, keep, "slice_value")
        cells = long.groupBy("column", "slice_value", F.col("_k0").alias("y"), F.col("_k1").alias("p")).agg(
            F.count(F.lit(1)).alias("n"))
        scores = weighted_f1(cells, ["column", "slice_value"])
        metric = "F1-Score"
    else:
        long = _stacked(known, {**everything, **slices}, [F.abs(truth - prediction)], "slice_value")
        scores = long.groupBy("column", "slice_value").agg(F.count(F.lit(1)).alias("n"), F.avg("_k0").alias("score"))
        metric = "MAE"
    overall = scores.where("column = ''").select(F.col("n").alias("_all"), F.col("score").alias("_overall"), F.lit(1).alias("_one"))
    # a single row
    parts = scores.where("column <> ''").withColumn("_one", F.lit(1)).join(F.broadcast(overall), "_one")
    # share is taken of the rows that the slicing covers (tertiles leave out missing values)
    covered = F.sum("n").over(Window.partitionBy("column"))
    parts = parts.withColumn("_covered", covered).where(F.col("n") >= limits.slice_min_rows)
    ratio = F.when(F.col("_overall") > 0, F.col("score") / F.col("_overall"))
    if classification:
        unfair = (F.col("_overall") - F.col("score")) >= limits.slice_gap
    else:
        unfair = F.coalesce(ratio > limits.slice_error_ratio, F.lit(False))
    return parts.select(
        F.col("column").alias("feature"), "slice_value", F.col("n").alias("sample_count"),
        F.round(F.col("n") / F.col("_covered"), 4).alias("sample_pct"), F.lit(metric).alias("metric_name"),
        rounded("score").alias("slice_score"), rounded("_overall").alias("overall_score"),
        F.coalesce(F.round(ratio, 3), F.lit(1.0)).alias("disparity_ratio"), unfair.alias("is_disparate"),
    )


def slice_findings(df: DataFrame, metrics: DataFrame, slices: list[str]) -> DataFrame:
    """Findings F-B401... for slices that do markedly worse than the whole."""
    positions = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(slices)], "feature string, position int")
    rows = metrics.where("is_disparate").join(F.broadcast(positions), "feature")
    name = F.concat("feature", F.lit(" = "), "slice_value")
    gap = F.abs(F.col("overall_score") - F.col("slice_score"))
    return fd.numbered([fd.finding(
        rows, kind="slice_bias", status="OBSERVED", severity="WARNING", column=F.col("feature"),
        title=F.concat(F.lit("Weaker results in slice "), name),
        description=F.concat(F.col("metric_name"), F.format_string(" is %.3f against %.3f overall.", "slice_score", "overall_score")),
        evidence=fd.evidence(
            subgroup=F.col("slice_value"), subgroup_sample_size=F.col("sample_count"),
            subgroup_metric=F.col("slice_score"), overall_metric=F.col("overall_score"),
            disparity_delta=rounded(gap), disparity_ratio=F.col("disparity_ratio")),
        confidence=0.88, recommendation="Look at how the group is represented and at its decision threshold.",
        question=F.concat(F.lit("Does treating "), name, F.lit(" apart help without hurting the rest?")),
        order=[fd.padded(F.col("position")), F.col("slice_value")],
    )], "F-B", 401)
