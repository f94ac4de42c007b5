"""Distributed order statistics over pre-aggregated value tables.

Everything that needs a global order (quantiles, ranks, empirical distribution functions, positions)
goes through :func:`running_totals`. It never sorts a whole group in one task: values are first
reduced to one row per distinct value, then cut into buckets by splitters, and a bounded table of
bucket totals carries the running sum across buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import families, once, present, quoted, ref, text_key

_OVERSAMPLE = 8
# A cut point only separates, so the head of a text does: buckets stay in order whatever the cut points are.
_CUT_HEAD = 100


def bucket_count(df: DataFrame) -> int:
    """One bucket per shuffle partition, so that buckets grow with the cluster setting."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _splitters(df: DataFrame, by: list[str], order: str, buckets: int) -> DataFrame:
    """Sorted cut points per group.

    One member of each hash class is picked by a second hash, so the sample is a pure function of
    the data: recomputing it after a lost executor or in another branch gives the same buckets.
    """
    member = f"substring({order}, 1, {_CUT_HEAD})" if df.schema[order].dataType.typeName() == "string" else order
    picked = df.groupBy(*by, F.expr(f"pmod(xxhash64('class', {order}), {buckets * _OVERSAMPLE}) AS _class")).agg(
        F.expr(f"min_by({member}, xxhash64('pick', {order})) AS _member"))
    # at most buckets * _OVERSAMPLE members per group: bounded by the partition setting
    return picked.groupBy(*by).agg(F.expr(
        f"filter(sort_array(collect_list(_member)), (x, i) -> i % {_OVERSAMPLE} = {_OVERSAMPLE - 1}) AS _cuts"))


def _with_bucket(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """Add ``_bucket``, the number of cut points not above the value, found by halving.

    The halving takes one step for each bit of the number of buckets; every step is evaluated once per row.
    """
    place, step = "0", 1 << max(0, buckets.bit_length() - 1)
    while step:
        # places beyond the last cut point are never reached, and element_at sees only those that exist
        further = f"IF({place} + {step} <= size(_cuts), element_at(_cuts, greatest(1, least({place} + {step}, size(_cuts)))) <= {order}, false)"
        name = f"_place{step}"
        df = once(df, **{name: F.expr(f"{place} + IF({further}, {step}, 0)")})
        place, step = name, step // 2
    return df.withColumnRenamed(place, "_bucket")


def running_totals(
    df: DataFrame, by: list[str], order: str, sums: list[str], buckets: int | None = None
) -> DataFrame:
    """Add ``cum_<s>`` (inclusive running sum) and ``all_<s>`` (group total) for every ``s`` in ``sums``.

    ``df`` holds few groups ``by`` (audited columns, classes) and at most a handful of rows per
    (by, order); ``order`` is not null. Column names are plain identifiers.
    """
    buckets = buckets or bucket_count(df)
    keys = ", ".join(by)
    # keeping the sums in the sampled branch lets Catalyst reuse the exchange that feeds all branches
    counted = df.where(f"greatest({', '.join(sums)}, 0) >= 0")
    cuts = _splitters(counted, by, order, buckets)
    # broadcast: groups x buckets cut points
    placed = _with_bucket(counted.join(F.broadcast(cuts), by), order, buckets).select(*counted.columns, "_bucket")
    before = f"OVER (PARTITION BY {keys} ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    totals = placed.groupBy(*by, "_bucket").agg(*[F.expr(f"sum({s}) AS _t_{s}") for s in sums])
    # broadcast: one row per (group, bucket)
    bounds = totals.selectExpr(
        *by, "_bucket", *[f"coalesce(sum(_t_{s}) {before}, 0) AS _before_{s}" for s in sums],
        *[f"sum(_t_{s}) OVER (PARTITION BY {keys}) AS all_{s}" for s in sums])
    inside = f"OVER (PARTITION BY {keys}, _bucket ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return placed.join(F.broadcast(bounds), by + ["_bucket"]).selectExpr(
        *df.columns, *[f"all_{s}" for s in sums],
        *[f"sum({s}) {inside} + _before_{s} AS cum_{s}" for s in sums])


def interpolated_quantiles(
    ordered: DataFrame, by: list[str], value: str, weight: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated quantiles from the output of :func:`running_totals`.

    A value sits at position k of the sorted rows when its running count first exceeds k.
    """
    cum, total = f"cum_{weight}", f"all_{weight}"
    aggs = [F.expr(f"max({total}) AS _n")]
    for name, p in probs.items():
        for side, f in (("lo", "floor"), ("hi", "ceil")):
            spot = f"{f}(({total} - 1) * {float(p)!r}D)"
            aggs.append(F.expr(
                f"max(CASE WHEN {cum} - {weight} <= {spot} AND {spot} < {cum} THEN CAST({value} AS double) END) AS _{side}_{name}"))
    wide = ordered.where(f"{weight} > 0").groupBy(*by).agg(*aggs)
    part = lambda p: f"((_n - 1) * {float(p)!r}D - floor((_n - 1) * {float(p)!r}D))"
    return wide.selectExpr(
        *by, *[f"_lo_{name} + (_hi_{name} - _lo_{name}) * {part(p)} AS {name}" for name, p in probs.items()])


def _stacked(df: DataFrame, columns: dict[str, Column], keep: list[Column], value: str) -> DataFrame:
    """Unpivot expressions of one type into (kept columns ``_k0``.., value, column), nulls removed."""
    kept = [c.alias(f"_k{i}") for i, c in enumerate(keep)]
    slots = [e.alias(name) for name, e in columns.items()]
    return df.select(*kept, *slots).unpivot(
        [f"_k{i}" for i in range(len(keep))], [quoted(name) for name in columns], "column", value
    ).where(f"{value} IS NOT NULL")


def value_counts(
    df: DataFrame,
    columns: list[str],
    measures: dict[str, Column] | None = None,
    order_by: str | None = None,
    as_text: bool = False,
) -> dict[str, DataFrame]:
    """One row per (column, distinct value) with ``n`` and optional summed measures.

    Returns up to three tables by storage type (``integer``, ``float``, ``text``), so that values
    keep their exact type. Counting combines on the map side first, so a hot value costs one row
    per task. ``measures`` are numeric row expressions summed per value; ``order_by`` adds ``first``
    (the smallest row key at which the value occurs).
    """
    kinds = families(df, columns)
    groups: dict[str, dict[str, Column]] = {"integer": {}, "float": {}, "text": {}}
    for name in columns:
        kind = kinds[name]
        if kind == "integer" and not as_text:
            groups["integer"][name] = ref(name).cast("bigint")
        elif kind == "float" and not as_text:
            groups["float"][name] = present(name, kind).cast("double")
        else:
            groups["text"][name] = text_key(name, kind)
    measures = measures or {}
    out: dict[str, DataFrame] = {}
    for kind, exprs in groups.items():
        if not exprs:
            continue
        keep = list(measures.values()) + ([ref(order_by)] if order_by else [])
        long = _stacked(df, exprs, keep, "value")
        aggs = [F.count(F.lit(1)).alias("n")]
        aggs += [F.sum(f"_k{i}").alias(m) for i, m in enumerate(measures)]
        if order_by:
            aggs.append(F.min(f"_k{len(measures)}").alias("first"))
        out[kind] = long.groupBy("column", "value").agg(*aggs)
    return out


def merged(tables: dict[str, DataFrame], cast: str, kinds: tuple[str, ...]) -> DataFrame | None:
    """Union of value tables with ``value`` cast to one type."""
    parts = [
        tables[k].withColumn("value", F.col("value").cast(cast)) for k in kinds if k in tables
    ]
    return reduce(DataFrame.unionByName, parts) if parts else None
