"""Association between columns from aggregated contingency counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import families, present, text_key
from gaugework.functions.numeric import correlation_p_value, cramers_v, rounded, yates_chi2
from gaugework.operators.ordered import value_counts


def cramers_v_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rows, cols, chi2 (Yates-corrected on 2x2) and the bias-corrected V of two columns.

    Cells are counted once; marginals are aggregated from the cells and joined back, so neither a hot
    value nor a wide row is gathered in one task.
    """
    kinds = families(df, [x, y])
    cells = (
        df.select(text_key(x, kinds[x]).alias("x"), text_key(y, kinds[y]).alias("y"))
        .where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("o"))
    )
    by_x = cells.groupBy("x").agg(F.sum("o").alias("rx"))
    by_y = cells.groupBy("y").agg(F.sum("o").alias("cy"))
    fit = cells.join(by_x, "x").join(by_y, "y").agg(
        F.sum("o").alias("n"),
        F.sum(F.col("o") * F.col("o") / (F.col("rx").cast("double") * F.col("cy"))).alias("fit"),
    )
    # squared marginals give the product of the two totals when there are exactly two
    shape_x = by_x.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("rx").cast("double") * F.col("rx")).alias("qx"))
    shape_y = by_y.agg(F.count(F.lit(1)).alias("cols"), F.sum(F.col("cy").cast("double") * F.col("cy")).alias("qy"))
    one = F.lit(1)
    # three single-row tables
    joined = (
        fit.withColumn("_one", one).join(F.broadcast(shape_x.withColumn("_one", one)), "_one")
        .join(F.broadcast(shape_y.withColumn("_one", one)), "_one")
    )
    n = F.col("n").cast("double")
    plain = n * F.col("fit") - n
    corrected = yates_chi2(plain, n, (n * n - F.col("qx")) / 2, (n * n - F.col("qy")) / 2)
    chi2 = F.when((F.col("rows") == 2) & (F.col("cols") == 2), corrected).otherwise(F.greatest(plain, F.lit(0.0)))
    return joined.withColumn("chi2", chi2).select(
        F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "rows", "cols", rounded("chi2").alias("chi2"),
        cramers_v(F.col("chi2"), n, F.col("rows"), F.col("cols")).alias("cramers_v"),
    )


def indicator_links(df: DataFrame, indicators: list[str], others: list[str], least_rows: int = 20) -> DataFrame:
    """column, other, n, cramers_v: link between "value is missing" and the values of other columns.

    One long-form count of (other, value) with one summed indicator per column with gaps serves all
    pairs. With p the share of missing rows, the 2xr statistic reduces to
    ``(sum(o^2/n_j) - M^2/N) / (p (1-p))``, so only sums per pair are needed afterwards.
    """
    kinds = families(df)
    gaps = {
        f"m{i}": present(c, kinds[c]).isNull().cast("bigint") for i, c in enumerate(indicators)
    }
    tables = value_counts(df, others, measures=gaps, as_text=True)
    cells = reduce(DataFrame.unionByName, tables.values())
    aggs = [
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("values"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("Q"),
    ]
    for m in gaps:
        aggs += [
            F.sum(m).alias(f"M_{m}"),
            F.sum(F.col(m) * F.col(m) / F.col("n").cast("double")).alias(f"S_{m}"),
        ]
    sums = cells.groupBy("column").agg(*aggs)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("gap"), F.col(f"M_{m}").alias("M"), F.col(f"S_{m}").alias("S"))
        for m, c in zip(gaps, indicators)
    ])
    rows = sums.select(F.col("column").alias("other"), "N", "values", "Q", F.inline(pairs)).where(
        (F.col("gap") != F.col("other")) & (F.col("N") >= least_rows)
    )
    n, missing = F.col("N").cast("double"), F.col("M").cast("double")
    p = missing / n
    plain = F.greatest(F.lit(0.0), (F.col("S") - missing * missing / n) / (p * (1 - p)))
    corrected = yates_chi2(plain, n, missing * (n - missing), (n * n - F.col("Q")) / 2)
    chi2 = F.when(F.col("values") == 2, corrected).otherwise(plain)
    both = (missing > 0) & (missing < n)
    return rows.select(
        F.col("gap").alias("column"), "other", F.col("N").alias("n"),
        F.when(both, cramers_v(chi2, n, F.lit(2), F.col("values"))).otherwise(F.lit(0.0)).alias("cramers_v"),
    )


def target_links(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """column, n, stat_name, value, p_value: link between missingness and the target.

    Numeric targets use the point-biserial correlation, others the association of the indicator.
    """
    kinds = families(df)
    if kinds[target] in ("integer", "float"):
        y = present(target, kinds[target]).cast("double")
        aggs, rows = [], []
        for i, c in enumerate(columns):
            gap = F.when(y.isNotNull(), present(c, kinds[c]).isNull().cast("double"))
            aggs += [F.corr(gap, y).alias(f"r{i}"), F.count(y).alias(f"n{i}")]
            rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r")))
        wide = df.agg(*aggs).select(F.inline(F.array(*rows)))
        r = F.when(~F.isnan("r"), F.col("r"))
        return wide.withColumn("r", r).withColumn("p_value", correlation_p_value("r", F.col("n").cast("double"))).select(
            "column", "n", F.lit("point_biserial").alias("stat_name"), F.col("r").alias("value"), "p_value"
        )
    return indicator_links(df, columns, [target], 0).select(
        "column", "n", F.lit("cramers_v").alias("stat_name"), F.col("cramers_v").alias("value"),
        F.lit(None).cast("double").alias("p_value"),
    )


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_ROWS = 4096
_CONSTANT = 1e-12  # share of the squares below which a variance is rounding


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """c1, c2, i, j, n, r: pairwise-complete Pearson correlation of all numeric column pairs, in one scan.

    A task adds up the masked Gram matrices of its rows: counts, sums, squares and products of each pair over the rows
    that have both values. They merge by addition, one row for each task and pair. Values are taken relative to a
    value of their column, so a large common offset costs no digits. r is null where a column is constant on the pair's rows.
    """
    result = "c1 string, c2 string, i int, j int, n bigint, r double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], result)
    kinds = families(df, columns)
    values = df.select(*[present(c, kinds[c]).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    some = values.limit(1000).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values.columns]).first()
    pivots = np.array([v if v is not None and np.isfinite(v) else 0.0 for v in some])
    left, right = np.triu_indices(len(columns), 1)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(pivots)
        sums = np.zeros((4, k, k))
        for batch in batches:
            # nulls read as NaN; NaN itself counts as missing before this point
            made = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)], axis=1) - pivots
            for at in range(0, len(made), _ROWS):
                x = made[at:at + _ROWS]
                there = ~np.isnan(x)
                x, mask = np.where(there, x, 0.0), there.astype(float)
                sums += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        n, s, q, p = sums
        found = (n[left, right].astype(np.int64), s[left, right], s[right, left], q[left, right], q[right, left], p[left, right])
        if n.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *map(pa.array, found)], names=["i", "j", *_SUMS])

    parts = values.mapInArrow(gram, "i int, j int, n bigint, sx double, sy double, sxx double, syy double, sxy double")
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n").cast("double")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    varied = (vx > _CONSTANT * F.col("sxx")) & (vy > _CONSTANT * F.col("syy"))
    r = F.when((n > 0) & varied, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    names = F.array(*map(F.lit, columns))
    return total.select(F.element_at(names, F.col("i") + 1).alias("c1"), F.element_at(names, F.col("j") + 1).alias("c2"), "i", "j", "n", r.alias("r"))
