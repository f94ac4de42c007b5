"""Fault injection with known ground truth, and scoring of the detectors against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import ref
from gaugework.operators.drift import before_position, partition_by_position


@dataclass(frozen=True)
class Fault:
    """One case: what was injected and what a detector should report."""

    case_id: str
    detector: str | None
    status: str | None
    columns: tuple[str, ...] = ()


# Cases with the category and status that must be found.
FAULTS = {
    "clean": Fault("BENCH_0_CLEAN", None, None),
    "leakage": Fault("BENCH_1_LEAKAGE", "target_leakage", "SUSPECTED", ("account_cancellation_code",)),
    "duplicates": Fault("BENCH_2_DUPLICATES", "format_error", "OBSERVED"),
    "drift": Fault("BENCH_3_DRIFT", "distribution_drift", "OBSERVED", ("monthly_charges",)),
    "missing": Fault("BENCH_4_INFORMATIVE_MISSING", "missingness", "SUSPECTED", ("annual_income",)),
    "outliers": Fault("BENCH_5_OUTLIERS", "outliers", "OBSERVED", ("account_balance",)),
    "slice": Fault("BENCH_6_SLICE_DISPARITY", "slice_bias", "OBSERVED", ("service_region",)),
    "temporal": Fault("BENCH_7_TEMPORAL_LEAK", "target_leakage", "SUSPECTED", ("post_event_refund",)),
}


def uniform(key: str, salt: str) -> Column:
    """Reproducible draw in [0, 1) from the row key."""
    return F.expr(f"pmod(xxhash64('{salt}', `{key}`), 1000003) / 1000003D")


def normal(key: str, salt: str) -> Column:
    """Reproducible standard normal draw (Box-Muller)."""
    u, v = F.greatest(uniform(key, salt + "u"), F.lit(1e-9)), uniform(key, salt + "v")
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * 3.141592653589793 * v)


def leaky_feature(df: DataFrame, target: str, key: str, name: str = "account_cancellation_code", noise: float = 0.05) -> DataFrame:
    """Target plus small noise, clipped to [0, 1]."""
    value = ref(target).cast("double") + normal(key, name) * noise
    return df.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def repeated_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The first ``rows`` rows by their unique key once more; they are found by the boundary key, not gathered."""
    return df.unionByName(df.where(before_position(df, [key], rows=rows)))


def shifted_half(df: DataFrame, column: str, key: str, shift: float) -> DataFrame:
    """``column`` raised in the second half of the rows by key."""
    part = partition_by_position(df, [key], 0.5)
    return df.withColumn(column, F.when(part.current, ref(column) + shift).otherwise(ref(column)))


def informative_gaps(df: DataFrame, column: str, target: str, key: str, positive=1, share: float = 0.5) -> DataFrame:
    """``column`` missing for a share of the rows of one class, none elsewhere."""
    drop = (ref(target) == F.lit(positive)) & (uniform(key, "gap") < share)
    return df.withColumn(column, F.when(~F.coalesce(drop, F.lit(False)), ref(column)))


def extreme_values(df: DataFrame, column: str, key: str, rows: int, low: float = 90000.0, high: float = 250000.0) -> DataFrame:
    """``rows`` values (lowest in hash order of the unique key) replaced by huge ones."""
    marked = df.withColumn("_hash", F.xxhash64(F.lit("extreme"), ref(key)))
    chosen = before_position(marked, ["_hash", key], rows=rows)
    huge = F.lit(low) + uniform(key, "huge") * (high - low)
    return marked.withColumn(column, F.when(chosen, huge).otherwise(ref(column))).drop("_hash")


def inverted_slice(df: DataFrame, target: str, key: str, name: str = "service_region", share: float = 0.2) -> DataFrame:
    """A region column whose smallest region has the target turned round."""
    u = uniform(key, name)
    region = F.when(u < share, "North").when(u < share + (1 - share) / 2, "East").otherwise("West")
    flipped = F.when(region == "North", 1 - ref(target)).otherwise(ref(target))
    return df.withColumn(name, region).withColumn(target, flipped)


def late_feature(df: DataFrame, target: str, key: str, name: str = "post_event_refund", time: str = "event_timestamp") -> DataFrame:
    """A daily time column and an amount that exists only after a positive outcome."""
    day = F.expr(f"date_format(date_add(DATE'2024-01-01', CAST(pmod(`{key}`, 3650) AS int)), 'yyyy-MM-dd')")
    amount = F.when(ref(target) == 1, 50.0 + uniform(key, name) * 150.0).otherwise(0.0)
    return df.withColumn(time, day).withColumn(name, amount)


def score_detectors(findings: DataFrame, faults: list[Fault]) -> DataFrame:
    """case_id, detected, status match, expectations and false findings per case.

    ``findings`` has case_id besides the finding columns. The control case counts critical and leakage
    findings as false positives.
    """
    spark = findings.sparkSession
    truth = spark.createDataFrame(
        [(f.case_id, f.detector, f.status, list(f.columns)) for f in faults],
        "case_id string, expected_detector string, expected_status string, expected_columns array<string>")
    hit = (F.col("type") == F.col("expected_detector")) & (
        (F.size("expected_columns") == 0) | F.array_contains("expected_columns", F.col("column")))
    false_alarm = F.col("expected_detector").isNull() & ((F.col("severity") == "CRITICAL") | (F.col("type") == "target_leakage"))
    # the ground truth is a handful of rows
    joined = findings.join(F.broadcast(truth), "case_id", "right")
    summed = joined.groupBy("case_id", "expected_detector", "expected_status", "expected_columns").agg(
        F.min(F.when(hit, F.struct("id", "status", "type"))).alias("_hit"),
        F.sort_array(F.collect_set(F.when(false_alarm, F.concat_ws(":", "type", "column")))).alias("false_positives"))
    control = F.col("expected_detector").isNull()
    return summed.select(
        "case_id", "expected_detector", F.col("_hit.type").alias("actual_detector"), "expected_status",
        F.col("_hit.status").alias("actual_status"),
        F.when(control, F.size("false_positives") == 0).otherwise(F.col("_hit").isNotNull()).alias("detected"),
        F.coalesce(F.col("_hit.status") == F.col("expected_status"), F.lit(False)).alias("status_match"), "false_positives",
        F.when(~control & F.col("_hit").isNull(), F.col("expected_columns")).otherwise(F.array().cast("array<string>")).alias("false_negatives"))
