"""Distribution drift between a baseline and a current part of the data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import families, present, ref, text_key
from gaugework.functions.numeric import ks_p_value, rounded
from gaugework.operators import findings as fd
from gaugework.operators.leakage import first_two_values
from gaugework.operators.lineage import stored
from gaugework.operators.ordered import (
    _stacked, interpolated_quantiles, running_totals,
)
from gaugework.options import Thresholds

BASE_SHARE = 0.70
FLOOR = 1e-4
EDGE = "0.00001D"
PSI_TERM = "(actual - expected) * ln(actual / expected)"
LEAST_ROWS, LEAST_PART, LEAST_VALUES = 50, 20, 10


@dataclass(frozen=True)
class Partition:
    """Row conditions of the two parts; rows in neither part are ignored."""

    base: Column
    current: Column
    description: str


def _value_at(df: DataFrame, order: Column, position: int):
    """Value at a zero-based position of the sorted non-null column, rows below it and rows with it."""
    counts = df.select(order.alias("value")).where("value IS NOT NULL").groupBy("value").agg(
        F.expr("count(1) AS n")).selectExpr("'all' AS g", "value", "n")
    ordered = running_totals(counts, ["g"], "value", ["n"])
    return ordered.where(f"cum_n - n <= {position} AND {position} < cum_n").selectExpr(
        "value", "cum_n - n AS below", "n").first()


def before_position(df: DataFrame, order: list[str], share: float = BASE_SHARE, rows: int | None = None) -> Column:
    """Whether a row is among the first ``rows`` (else that ``share`` of all) in ``order``, nulls last.

    Only the boundary row is looked for, by exact selection on the value counts of each order column
    in turn; the result is then plain comparisons that push down to the scan. Later columns matter
    only among ties at the boundary; the last one must be a unique row key.
    """
    below, boundary, found = F.lit(False), F.lit(True), df
    left = rows
    for name in order:
        column = ref(name)
        size = found.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("known")).first()
        if left is None:
            left = int(size["n"] * share)
        if left >= size["n"]:
            below = below | boundary
            break
        if left < size["known"]:
            hit = _value_at(found, column, left)
            edge = F.lit(hit["value"])
            below = below | (boundary & column.isNotNull() & (column < edge))
            boundary, found = boundary & (column == edge), found.where(column == edge)
            left -= hit["below"]
            ties = hit["n"]
        else:
            below = below | (boundary & column.isNotNull())
            boundary, found = boundary & column.isNull(), found.where(column.isNull())
            left -= size["known"]
            ties = size["n"] - size["known"]
        if left == 0 or ties <= 1:
            break
    return F.coalesce(below, F.lit(False))


def partition_by_position(df: DataFrame, order: list[str], share: float = BASE_SHARE) -> Partition:
    """First ``share`` of the rows in ``order`` (nulls last) against the rest; see :func:`before_position`."""
    # the current part begins at the boundary row itself
    base = before_position(df, order, share)
    percent = round(share * 100)
    return Partition(base, ~base, f"ordered by {', '.join(order)} ({percent}/{100 - percent})")


def partition_by_values(df: DataFrame, split: str, order_by: str, values: tuple[str, str] | None = None) -> Partition | None:
    """The first two values of a split column, or the two given ones."""
    found = list(values) if values else first_two_values(df, split, order_by)
    if len(found) < 2:
        return None
    text = ref(split).cast("string")
    return Partition(
        F.coalesce(text == found[0], F.lit(False)), F.coalesce(text == found[1], F.lit(False)),
        f"{split}: {found[0]} against {found[1]}",
    )


def detected_time_column(df: DataFrame) -> str | None:
    """First column that is a timestamp or whose name mentions date or time."""
    kinds = families(df)
    return next(
        (c for c, k in kinds.items() if k == "temporal" or "date" in c.lower() or "time" in c.lower()), None)


def partition_for_drift(
    df: DataFrame, order_by: str, split: str | None = None, time: str | None = None,
    values: tuple[str, str] | None = None,
) -> Partition:
    """Split column, else time column, else a detected time column, else row order."""
    if split in df.columns:
        part = partition_by_values(df, split, order_by, values)
        if part:
            return part
    column = time if time in df.columns else detected_time_column(df)
    return partition_by_position(df, [column, order_by] if column else [order_by])


def numeric_like(df: DataFrame, columns: list[str], part: Partition) -> dict[str, bool]:
    """Which columns are compared as numbers: numbers, timestamps and texts that all parse as numbers."""
    kinds = families(df, columns)
    texts = [c for c in columns if kinds[c] == "string"]
    parsed = {}
    if texts:
        aggs = [
            F.min(F.when(ref(c).isNotNull(), ref(c).try_cast("double").isNotNull())).alias(f"p{i}")
            for i, c in enumerate(texts)
        ]
        row = df.where(part.base | part.current).agg(*aggs).first()
        parsed = {c: bool(row[f"p{i}"]) for i, c in enumerate(texts)}
    return {c: parsed.get(c, True) for c in columns}


def _number(name: str, kind: str) -> Column:
    if kind == "temporal":
        # epoch seconds; the index is free of the unit
        return F.unix_micros(ref(name).cast("timestamp")) / 1e6
    if kind == "string":
        return ref(name).try_cast("double")
    return present(name, kind).cast("double")


def paired_counts(df: DataFrame, columns: dict[str, Column], part: Partition) -> DataFrame:
    """column, value, nb, nc: how often each value occurs in the baseline and in the current part."""
    keep = [part.base.cast("bigint"), part.current.cast("bigint")]
    long = _stacked(df.where(part.base | part.current), columns, keep, "value")
    return long.groupBy("column", "value").agg(F.sum("_k0").alias("nb"), F.sum("_k1").alias("nc"))


def ordered_counts(counts: DataFrame) -> DataFrame:
    """The output of :func:`paired_counts` with running sums over the values, stored: bins, PSI and KS all read it."""
    return stored(running_totals(counts, ["column"], "value", ["nb", "nc"]), "ordered-counts")


def numeric_bins(ordered: DataFrame, bins: int = 10) -> DataFrame:
    """column, bin, low, high, expected, actual, contribution over baseline-decile bins.

    ``ordered`` is the output of :func:`ordered_counts`. Edges are baseline quantiles without repeats,
    the outer ones moved just past the overall extremes; shares are floored and rescaled.
    """
    counts = ordered.select("column", "value", "nb", "nc")
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = interpolated_quantiles(ordered, ["column"], "value", "nb", probs).selectExpr(
        "column", f"array_distinct(array({', '.join(probs)})) AS edges")
    totals = counts.groupBy("column").agg(
        *[F.expr(e) for e in ("min(value) AS lo", "max(value) AS hi", "sum(nb) AS total_b", "sum(nc) AS total_c")])
    # broadcast: one row per column with at most bins + 1 edges
    spec = totals.join(F.broadcast(edges), "column").where(
        "size(edges) >= 2 AND total_b > 0 AND total_c > 0").withColumn("inner", F.expr("slice(edges, 2, size(edges) - 2)"))
    found = counts.join(F.broadcast(spec.select("column", "inner")), "column").selectExpr(
        "column", "size(filter(inner, e -> e <= value)) AS bin", "nb", "nc"
    ).groupBy("column", "bin").agg(F.expr("sum(nb) AS nb"), F.expr("sum(nc) AS nc"))
    grid = spec.selectExpr("*", "explode(sequence(0, size(edges) - 2)) AS bin")
    shares = grid.join(found, ["column", "bin"], "left").selectExpr(
        "column", "bin", f"CASE WHEN bin = 0 THEN lo - {EDGE} ELSE edges[bin] END AS low",
        f"CASE WHEN bin = size(edges) - 2 THEN hi + {EDGE} ELSE edges[bin + 1] END AS high",
        f"least(greatest(coalesce(nb, 0) / total_b, {FLOOR!r}D), 1.0D) AS e",
        f"least(greatest(coalesce(nc, 0) / total_c, {FLOOR!r}D), 1.0D) AS a")
    # at most ``bins`` rows per column
    return shares.selectExpr(
        "column", "bin", "low", "high", "e / sum(e) OVER (PARTITION BY column) AS expected",
        "a / sum(a) OVER (PARTITION BY column) AS actual",
    ).withColumn("contribution", F.expr(PSI_TERM))


def categorical_bins(counts: DataFrame) -> DataFrame:
    """column, value, expected, actual, contribution per category; rare shares are floored only."""
    totals = counts.groupBy("column").agg(F.expr("sum(nb) AS total_b"), F.expr("sum(nc) AS total_c"))
    # broadcast: one row per column
    return counts.join(F.broadcast(totals), "column").where("total_b > 0 AND total_c > 0").selectExpr(
        "column", "value", f"greatest(nb / total_b, {FLOOR!r}D) AS expected", f"greatest(nc / total_c, {FLOOR!r}D) AS actual",
    ).withColumn("contribution", F.expr(PSI_TERM))


def ks_statistics(ordered: DataFrame) -> DataFrame:
    """column, nb, nc, ks_stat, ks_p from running counts of both parts over the ordered values."""
    found = ordered.groupBy("column").agg(
        F.expr("max(all_nb) AS nb"), F.expr("max(all_nc) AS nc"),
        F.expr("max(abs(cum_nb / all_nb - cum_nc / all_nc)) AS ks_stat"))
    return found.withColumn("ks_p", ks_p_value("ks_stat", "nb", "nc"))


def drift_tables(
    df: DataFrame, columns: list[str], part: Partition, limits: Thresholds = Thresholds()
) -> tuple[DataFrame, DataFrame]:
    """(metrics per column, rows per bin) for columns with enough values on both sides."""
    kinds = families(df, columns)
    as_number = numeric_like(df, columns, part)
    numeric = {c: _number(c, kinds[c]) for c in columns if as_number[c]}
    text = {c: text_key(c, kinds[c]) for c in columns if not as_number[c]}
    metrics, details = [], []
    if numeric:
        ordered = ordered_counts(paired_counts(df, numeric, part))
        bins = numeric_bins(ordered, limits.psi_bins)
        psi = bins.groupBy("column").agg(F.sum("contribution").alias("psi"))
        real = [c for c in numeric if kinds[c] in ("integer", "float")]
        ks = ks_statistics(ordered)
        shown = F.col("column").isin(real) if real else F.lit(False)
        metrics.append(
            ks.join(F.broadcast(psi), "column", "left").select(
                "column", "nb", "nc", F.coalesce("psi", F.lit(0.0)).alias("psi"),
                F.when(shown, F.col("ks_stat")).alias("ks_stat"), F.when(shown, F.col("ks_p")).alias("ks_p"))
        )
        label = F.format_string("[%s, %s)", F.round("low", 2).cast("string"), F.round("high", 2).cast("string"))
        details.append(bins.select("column", label.alias("bin_label"), "expected", "actual", "contribution"))
    if text:
        counts = paired_counts(df, text, part)
        bins = categorical_bins(counts)
        totals = counts.groupBy("column").agg(F.sum("nb").alias("nb"), F.sum("nc").alias("nc"))
        psi = bins.groupBy("column").agg(F.sum("contribution").alias("psi"))
        metrics.append(totals.join(F.broadcast(psi), "column", "left").select(
            "column", "nb", "nc", F.coalesce("psi", F.lit(0.0)).alias("psi"),
            F.lit(None).cast("double").alias("ks_stat"), F.lit(None).cast("double").alias("ks_p")))
        details.append(bins.select("column", F.substring("value", 1, 100).alias("bin_label"), "expected", "actual", "contribution"))
    raw = reduce(DataFrame.unionByName, metrics).where((F.col("nb") >= LEAST_VALUES) & (F.col("nc") >= LEAST_VALUES))
    shaped = raw.select(
        "column", rounded("psi").alias("psi"), rounded("ks_stat").alias("ks_stat"),
        rounded("ks_p").alias("ks_p"))
    critical = F.col("psi") >= limits.psi_critical
    warning = (F.col("psi") >= limits.psi_warning) | F.coalesce(
        (F.col("ks_p") < limits.ks_p_value) & (F.col("psi") >= limits.psi_with_ks), F.lit(False))
    ruled = shaped.withColumn(
        "severity", F.when(critical, "CRITICAL").when(warning, "WARNING").otherwise("INFO")
    ).withColumn("is_drift", critical | warning)
    listed = reduce(DataFrame.unionByName, details).select(
        "column", "bin_label", rounded("expected").alias("expected_pct"),
        rounded("actual").alias("actual_pct"), rounded("contribution").alias("contribution"))
    return ruled, listed


def drift_metrics(df: DataFrame, columns: list[str], part: Partition, limits: Thresholds = Thresholds()) -> DataFrame:
    return drift_tables(df, columns, part, limits)[0]


def drift_bins(df: DataFrame, columns: list[str], part: Partition, limits: Thresholds = Thresholds()) -> DataFrame:
    return drift_tables(df, columns, part, limits)[1]


def drift_findings(df: DataFrame, metrics: DataFrame, part: Partition) -> DataFrame:
    """Findings F-D1... for drifted columns."""
    positions = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "column string, position int")
    sizes = df.agg(
        F.sum(part.base.cast("bigint")).alias("base_rows"), F.sum(part.current.cast("bigint")).alias("current_rows")
    ).withColumn("_one", F.lit(1))
    rows = metrics.where("is_drift").join(F.broadcast(positions), "column").withColumn("_one", F.lit(1)).join(
        F.broadcast(sizes), "_one")
    critical, name = F.col("severity") == "CRITICAL", F.col("column")
    return fd.numbered([fd.finding(
        rows, kind="distribution_drift", status=F.when(critical, "SUSPECTED").otherwise("OBSERVED"),
        severity=F.when(critical, "WARNING").otherwise("INFO"), column=name,
        title=F.concat(F.lit("Distribution shift in "), name, F.format_string(" (PSI %.3f)", "psi")),
        description=F.concat(name, F.format_string(" differs between the parts (PSI %.3f).", "psi")),
        evidence=fd.evidence(
            psi=F.col("psi"), ks_statistic=F.col("ks_stat"), ks_p_value=F.col("ks_p"),
            baseline_rows=F.col("base_rows"), evaluation_rows=F.col("current_rows")),
        confidence=0.90, recommendation="Find out whether the shift is seasonal, external or a pipeline fault.",
        question=F.concat(F.lit("Does weighting by time or group offset the shift in "), name, F.lit("?")),
        order=[fd.padded(F.col("position"))],
    )], "F-D", 1)
