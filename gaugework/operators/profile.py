"""Column and dataset profiles: one wide aggregate plus one long-form value table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import families, present, ref, text_literal
from gaugework.functions.numeric import rounded, share
from gaugework.operators.lineage import settled, stored
from gaugework.operators.ordered import (
    interpolated_quantiles, merged, running_totals, value_counts,
)

QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
HISTOGRAM_BINS = 10
NUMERIC = ("integer", "float")


def row_and_column_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows (null equals null)."""
    families(df)
    groups = df.groupBy(*[ref(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("duplicate_pct", share("duplicate_rows", "row_count"))


def column_counts(df: DataFrame) -> DataFrame:
    """column, position, dtype, n_rows, missing_count: one pass, one output row per column."""
    kinds = families(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wide = df.select(*[present(c, k).alias(f"x{i}") for i, (c, k) in enumerate(kinds.items())]).agg(
        F.expr("count(1) AS _rows"), *[F.expr(f"count(x{i}) AS c{i}") for i in range(len(kinds))])
    rows = ", ".join(
        f"struct({text_literal(c)} AS column, {i} AS position, {text_literal(types[c])} AS dtype, "
        f"{text_literal(k)} AS family, _rows AS n_rows, _rows - c{i} AS missing_count)"
        for i, (c, k) in enumerate(kinds.items()))
    return wide.selectExpr(f"inline(array({rows}))")


def numeric_moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, min, max, mean, std, skewness, kurtosis in a single map-side combined aggregate.

    Rows are put in long form, so that the same few aggregates serve every column; aggregates of their own for each
    column make a method too long to be compiled, and then every row is interpreted.
    """
    kinds = families(df, columns)
    numeric = [c for c, k in kinds.items() if k in NUMERIC]
    slim = df.select(*[present(c, kinds[c]).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)])
    found = slim.unpivot([], slim.columns, "place", "x").groupBy("place").agg(*[
        F.expr(f"{f}(x) AS {a}")
        for f, a in (("count", "n"), ("min", "lo"), ("max", "hi"), ("avg", "m"), ("stddev_samp", "s"), ("skewness", "g"), ("kurtosis", "k"))])
    names = ", ".join(f"struct('x{i}' AS place, {text_literal(c)} AS column)" for i, c in enumerate(numeric))
    # one row per column, also for a table without rows
    listed = df.sparkSession.range(0, 1, 1, 1).selectExpr(f"inline(array({names}))")
    # population moments become bias-corrected ones
    return listed.join(F.broadcast(found), "place", "left").selectExpr(
        "column", "coalesce(n, 0L) AS n", "lo AS min", "hi AS max", "m AS mean", "s AS std",
        "CASE WHEN n > 2 THEN g * sqrt(n * (n - 1)) / (n - 2) END AS skewness",
        "CASE WHEN n > 3 THEN (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6) END AS kurtosis")


def approximate_summary(df: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Distinct counts and quantiles from bounded sketches: one scan and no value shuffle."""
    kinds = families(df)
    probs = list(QUANTILES.values())
    aggs, rows = [], []
    for i, (c, k) in enumerate(kinds.items()):
        x = present(c, k)
        aggs.append(F.approx_count_distinct(x).alias(f"u{i}"))
        numeric = k in NUMERIC
        if numeric:
            aggs.append(F.percentile_approx(x.cast("double"), probs, accuracy).alias(f"q{i}"))
        rows.append(F.struct(
            F.lit(c).alias("column"), F.col(f"u{i}").alias("unique_count"),
            *[
                (F.col(f"q{i}")[j] if numeric else F.lit(None).cast("double")).alias(name)
                for j, name in enumerate(QUANTILES)
            ],
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def distinct_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """column, unique_count from value tables (exact)."""
    return merged(tables, "string", ("integer", "float", "text")).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count")
    )


def _rank_first(df: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """First ``keep`` rows per column; the rank filter is pushed below the shuffle by Catalyst."""
    window = Window.partitionBy("column").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= keep)


def top_values(tables: dict[str, DataFrame], n_rows: DataFrame, k: int = 10) -> DataFrame:
    """column, rank, value, count, pct: the ``k`` most frequent values, ties by value."""
    values = merged(tables, "string", ("integer", "float", "text"))
    ranked = _rank_first(values, [F.desc("n"), F.asc("value")], k)
    # broadcast: one row per audited column
    return ranked.join(F.broadcast(n_rows.select("column", "n_rows")), "column").select(
        "column", "rank", F.substring("value", 1, 100).alias("value"), F.col("n").alias("count"),
        share("n", "n_rows").alias("pct"),
    )


def sample_values(tables: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """column, rank, value: the first ``k`` distinct values by row key (by value without a key)."""
    values = merged(tables, "string", ("integer", "float", "text"))
    order = "first" if "first" in values.columns else "value"
    return _rank_first(values, [F.asc(order), F.asc("value")], k).select(
        "column", "rank", F.substring("value", 1, 100).alias("value")
    )


def quantiles(tables: dict[str, DataFrame], probs: dict[str, float] = QUANTILES) -> DataFrame:
    """column and one exact interpolated quantile per entry of ``probs``."""
    numeric = merged(tables, "double", NUMERIC).select("column", "value", "n")
    return interpolated_quantiles(
        running_totals(numeric, ["column"], "value", ["n"]), ["column"], "value", "n", probs
    )


def histogram(tables: dict[str, DataFrame], moments: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """column, bin, bin_start, bin_end, count, pct: equal-width bins of non-constant numeric columns."""
    spread = moments.where(F.col("max") > F.col("min")).select("column", "min", "max", F.col("n").alias("_n"))
    width = (F.col("max") - F.col("min")) / F.lit(bins)
    numeric = merged(tables, "double", NUMERIC).select("column", "value", "n")
    # broadcast: one row per numeric column
    counted = (
        numeric.join(F.broadcast(spread), "column")
        .withColumn("bin", F.least(F.floor((F.col("value") - F.col("min")) / width), F.lit(bins - 1)))
        .groupBy("column", "bin").agg(F.sum("n").alias("count"))
    )
    grid = spread.withColumn("bin", F.explode(F.expr(f"sequence(0L, {bins - 1}L)")))
    return grid.join(counted, ["column", "bin"], "left").select(
        "column", "bin",
        rounded(F.col("min") + F.col("bin") * width, 3).alias("bin_start"),
        rounded(F.col("min") + (F.col("bin") + 1) * width, 3).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
        share("coalesce(`count`, 0)", "_n").alias("pct"),
    )


def dataset_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: size, duplicates and the resolved target with its task type."""
    from gaugework.operators.semantic import target_task

    base = duplicate_rows(df).withColumn("column_count", F.lit(len(df.columns)))
    # one row joined to one row on a shared literal
    task = target_task(df, target).withColumn("_one", F.lit(1))
    return base.withColumn("_one", F.lit(1)).join(F.broadcast(task), "_one", "left").drop("_one")


@dataclass(frozen=True)
class Counted:
    """Counts of the values of every column, with moments and quantiles: what the profile and the detectors both read."""

    tables: dict[str, DataFrame]
    moments: DataFrame | None
    points: DataFrame | None


def counted_values(df: DataFrame, order_by: str | None = None) -> Counted:
    """Value tables, moments and quantiles, each worked out and stored once for ``profile_columns`` and ``quality_findings``."""
    tables = {kind: stored(t, "profile-values") for kind, t in value_counts(df, df.columns, order_by=order_by).items()}
    if not any(k in NUMERIC for k in families(df).values()):
        return Counted(tables, None, None)
    return Counted(tables, settled(numeric_moments(df)), settled(quantiles(tables)))


def profile_columns(
    df: DataFrame, target: str | None = None, order_by: str | None = None, approx: bool = False,
    sample: int | None = 100, counted: Counted | None = None,
) -> DataFrame:
    """Full profile, one row per column.

    Exact mode shuffles one row per distinct value of each column and derives distinct counts, top
    values, samples, quantiles and histograms from it. ``approx`` replaces distinct counts and
    quantiles by sketches. ``counted`` are the counts of ``df`` where other steps read them too.
    """
    from gaugework.operators.semantic import column_roles, semantic_types

    counts = column_counts(df)
    # stored: each consumer needs other columns of it, so none of them would share the scan and the shuffle of another
    tables = counted.tables if counted else {
        kind: stored(t, "profile-values") for kind, t in value_counts(df, df.columns, order_by=order_by).items()}
    has_numeric = any(k in NUMERIC for k in families(df).values())
    moments = (counted.moments if counted else numeric_moments(df)) if has_numeric else None
    if approx:
        sketch = approximate_summary(df)
        distinct = sketch.select("column", "unique_count")
        points = sketch.drop("unique_count")
    else:
        distinct = distinct_counts(tables)
        points = (counted.points if counted else quantiles(tables)) if has_numeric else None
    semantic = semantic_types(df, order_by, sample, distinct)
    base = counts.join(F.broadcast(distinct), "column", "left").withColumn(
        "unique_count", F.coalesce("unique_count", F.lit(0))
    )
    base = base.join(F.broadcast(semantic.select("column", "semantic_type")), "column", "left")
    base = column_roles(base, target)
    listed = top_values(tables, counts).groupBy("column").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "value", "count", "pct"))),
            lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"), v["pct"].alias("pct")),
        ).alias("top_values")
    )
    samples = sample_values(tables).groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda v: v["value"]).alias("sample_values")
    )
    # every table below has one row per column
    out = base.join(F.broadcast(listed), "column", "left").join(F.broadcast(samples), "column", "left")
    if has_numeric:
        bins = histogram(tables, moments).groupBy("column").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("bin", "bin_start", "bin_end", "count", "pct"))),
                lambda b: F.struct(
                    b["bin_start"].alias("bin_start"), b["bin_end"].alias("bin_end"),
                    b["count"].alias("count"), b["pct"].alias("pct"),
                ),
            ).alias("histogram")
        )
        out = (
            out.join(F.broadcast(moments), "column", "left")
            .join(F.broadcast(points), "column", "left")
            .join(F.broadcast(bins), "column", "left")
        )
        varied = ~F.col("is_constant")
        for c in ("min", "max", "mean", "median", "std", "p5", "p25", "p75", "p95", "skewness", "kurtosis"):
            out = out.withColumn(c, F.when(varied, rounded(c)))
    else:
        for c in ("min", "max", "mean", "median", "std", "p5", "p25", "p75", "p95", "skewness", "kurtosis"):
            out = out.withColumn(c, F.lit(None).cast("double"))
        out = out.withColumn(
            "histogram",
            F.lit(None).cast("array<struct<bin_start:double,bin_end:double,count:bigint,pct:double>>"),
        )
    return out.select(
        F.col("column").alias("name"), "position", "dtype", "family", "semantic_type", "role", "n_rows",
        "missing_count", "missing_pct", "unique_count", "unique_ratio", "is_constant", "is_id",
        "min", "max", "mean", "median", "std", "p5", "p25", "p75", "p95", "skewness", "kurtosis",
        "top_values", "histogram", "sample_values",
    )
