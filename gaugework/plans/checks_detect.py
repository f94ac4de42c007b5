"""Check queries of the quality, leakage, drift and slice operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.functions.columns import ref
from gaugework.operators import association, decisions, drift, fairness, leakage, quality, semantic
from gaugework.operators import findings as fd
from gaugework.operators.lineage import settled, stored
from gaugework.operators.profile import column_counts, distinct_counts, profile_columns
from gaugework.operators.ordered import value_counts
from gaugework.plans.checks_profile import rounded_sql, union_sql
from gaugework.plans.registry import register
from gaugework.plans.views import cte, view

GAPS = ["segment", "total_price", "income_score"]
LINKED = ["customer_id", "segment", "balance", "total_price", "income_score", "tail_amount", "order_status",
          "order_date", "split", "refund_flag"]


def v_sql(chi2: str, n: str, r: str, k: str) -> str:
    """Bias-corrected association from a statistic, for the check SQL."""
    phi = f"greatest(0, {chi2} / {n} - ({k} - 1) * ({r} - 1) / ({n} - 1))"
    room = f"least({r} - power({r} - 1, 2) / ({n} - 1) - 1, {k} - power({k} - 1, 2) / ({n} - 1) - 1)"
    return f"(CASE WHEN least({r}, {k}) > 1 AND {room} > 0 THEN round(sqrt({phi} / {room}), 4) ELSE 0.0 END)"


def chi2_sql(source: str) -> str:
    """n, r, k, chi2 of a table of cells (x, y, o), empty cells included, Yates-corrected on 2x2."""
    return (
        f"(SELECT max(n) AS n, max(r) AS r, max(k) AS k, sum(CASE WHEN r = 2 AND k = 2 THEN "
        "power(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE power(o - e, 2) / e END) AS chi2 FROM ("
        "SELECT coalesce(c.o, 0) AS o, CAST(a.t AS DOUBLE) * b.t / n AS e, CAST(n AS DOUBLE) AS n, "
        "CAST(r AS DOUBLE) AS r, CAST(k AS DOUBLE) AS k FROM "
        f"(SELECT x, sum(o) AS t FROM {source} GROUP BY x) a CROSS JOIN (SELECT y, sum(o) AS t FROM {source} GROUP BY y) b "
        f"CROSS JOIN (SELECT sum(o) AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS k FROM {source}) s "
        f"LEFT JOIN {source} c ON c.x = a.x AND c.y = b.y))"
    )


def _link_sql(gap: str, other: str) -> str:
    cells = f"(SELECT ({gap} IS NULL) AS x, CAST({other} AS VARCHAR) AS y, count(*) AS o FROM orders_audit WHERE {other} IS NOT NULL GROUP BY 1, 2)"
    return (
        f"SELECT '{gap}' AS \"column\", '{other}' AS other, CAST(n AS BIGINT) AS n, "
        f"{v_sql('chi2', 'n', 'r', 'k')} AS cramers_v FROM {chi2_sql(cells)}"
    )


@register(
    "missingness_feature_links_orders",
    cte("orders_audit") + " " + " UNION ALL ".join(_link_sql(g, o) for g in GAPS for o in LINKED if g != o),
)
def missingness_feature_links_orders(spark, sf_dir):
    return association.indicator_links(view(spark, sf_dir, "orders_audit"), GAPS, LINKED)


_TARGET_LINK = (
    "SELECT \'{c}\' AS \"column\", count(*) AS n, 'point_biserial' AS stat_name, "
    + rounded_sql("corr(CAST({c} IS NULL AS DOUBLE), urgent)") + ' AS "value" FROM orders_audit'
)


@register("missingness_target_links_orders", cte("orders_audit") + " " + union_sql(GAPS, _TARGET_LINK))
def missingness_target_links_orders(spark, sf_dir):
    links = association.target_links(view(spark, sf_dir, "orders_audit"), GAPS, "urgent")
    return links.select("column", "n", "stat_name", association.rounded("value").alias("value"))


@register("missingness_target_p_values_orders")
def missingness_target_p_values_orders(spark, sf_dir):
    return association.target_links(view(spark, sf_dir, "orders_audit"), GAPS, "urgent")


@register(
    "missingness_category_target_links_orders",
    cte("orders_audit") + " " + " UNION ALL ".join(_link_sql(g, "order_status") for g in GAPS),
)
def missingness_category_target_links_orders(spark, sf_dir):
    links = association.target_links(view(spark, sf_dir, "orders_audit"), GAPS, "order_status")
    return links.select("column", F.lit("order_status").alias("other"), "n", F.col("value").alias("cramers_v"))


def _pair_sql(view_name: str, x: str, y: str) -> str:
    cells = (
        f"(SELECT CAST({x} AS VARCHAR) AS x, CAST({y} AS VARCHAR) AS y, count(*) AS o FROM {view_name} "
        f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2)"
    )
    return (
        f"{cte(view_name)} SELECT '{x}' AS x, '{y}' AS y, CAST(n AS BIGINT) AS n, CAST(r AS BIGINT) AS rows, "
        f"CAST(k AS BIGINT) AS cols, round(chi2, 4) AS chi2, {v_sql('chi2', 'n', 'r', 'k')} AS cramers_v FROM {chi2_sql(cells)}"
    )


@register("cramers_v_segment_status", _pair_sql("orders_audit", "segment", "order_status"))
def cramers_v_segment_status(spark, sf_dir):
    return association.cramers_v_pair(view(spark, sf_dir, "orders_audit"), "segment", "order_status")


@register("cramers_v_flag_target", _pair_sql("orders_audit", "refund_flag", "urgent"))
def cramers_v_flag_target(spark, sf_dir):
    return association.cramers_v_pair(view(spark, sf_dir, "orders_audit"), "refund_flag", "urgent")


OUTLIER_COLUMNS = ["balance", "total_price", "income_score", "tail_amount"]
_OUTLIERS = (
    "SELECT \'{c}\' AS \"column\", count({c}) AS n, round(max(q25), 4) AS q25, round(max(q75), 4) AS q75, "
    "round(max(q75 - q25), 4) AS iqr, round(max(q25 - 3 * (q75 - q25)), 4) AS lower, round(max(q75 + 3 * (q75 - q25)), 4) AS upper, "
    "count(CASE WHEN {c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25) THEN 1 END) AS mild_count, "
    "count(CASE WHEN {c} < q25 - 3 * (q75 - q25) OR {c} > q75 + 3 * (q75 - q25) THEN 1 END) AS extreme_count, "
    "count(CASE WHEN abs(({c} - mu) / sd) > 3 THEN 1 END) AS z_count, "
    "round(count(CASE WHEN {c} < q25 - 3 * (q75 - q25) OR {c} > q75 + 3 * (q75 - q25) THEN 1 END) / CAST(count({c}) AS DOUBLE), 4) AS extreme_pct "
    "FROM orders_audit CROSS JOIN (SELECT quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75, "
    "avg({c}) AS mu, stddev_samp({c}) AS sd FROM orders_audit)"
)


def _rounded_outliers(stats):
    return stats.select(
        "column", "n", *[F.round(c, 4).alias(c) for c in ("q25", "q75", "iqr", "lower", "upper")],
        "mild_count", "extreme_count", "z_count", F.round("extreme_pct", 4).alias("extreme_pct"))


@register("outlier_stats_orders", cte("orders_audit") + " " + union_sql(OUTLIER_COLUMNS, _OUTLIERS))
def outlier_stats_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit").select(*OUTLIER_COLUMNS)
    return _rounded_outliers(quality.outlier_stats(df))


@register(
    "outlier_rule_orders",
    cte("orders_audit") + " SELECT \"column\", CASE WHEN extreme_count / CAST(n AS DOUBLE) > 0.05 THEN 'WARNING' ELSE 'INFO' END AS severity "
    f"FROM ({union_sql(OUTLIER_COLUMNS, _OUTLIERS)}) WHERE extreme_count / CAST(n AS DOUBLE) >= 0.03 OR mild_count / CAST(n AS DOUBLE) > 0.08",
)
def outlier_rule_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit").select(*OUTLIER_COLUMNS)
    return quality.flagged_outliers(quality.outlier_stats(df)).select("column", "severity")


def _orders_findings(spark, sf_dir):
    # the detectors read the view some ten times; its join is done once
    df = stored(view(spark, sf_dir, "orders_audit"), "orders-audit")
    prof = settled(profile_columns(df, "urgent", "order_id"))
    roles = prof.select("name", "family", "missing_count", "is_constant", "is_id", "unique_count").collect()
    return df, prof, roles


@register(
    "quality_findings_orders",
    cte("orders_audit") + " " + union_sql(GAPS, (
        "SELECT concat('F-Q', CAST(101 + {i} AS VARCHAR)) AS id, 'missingness' AS type, "
        "CASE WHEN '{c}' = 'income_score' AND abs(corr(CAST({c} IS NULL AS DOUBLE), urgent)) > 0.15 THEN 'SUSPECTED' ELSE 'OBSERVED' END AS status, "
        "CASE WHEN avg(CAST({c} IS NULL AS DOUBLE)) >= 0.1 THEN 'WARNING' ELSE 'INFO' END AS severity, "
        "'{c}' AS \"column\", CAST(count(*) - count({c}) AS VARCHAR) AS amount FROM orders_audit"))
    + " UNION ALL SELECT 'F-Q104', 'outliers', 'OBSERVED', 'INFO', 'tail_amount', CAST(extreme_count AS VARCHAR) FROM ("
    + _OUTLIERS.format(c="tail_amount") + ")"
    + " UNION ALL SELECT 'F-Q105', 'constant_column', 'OBSERVED', 'INFO', 'region_tag', CAST(count(DISTINCT region_tag) AS VARCHAR) FROM orders_audit",
)
def quality_findings_orders(spark, sf_dir):
    df, prof, roles = _orders_findings(spark, sf_dir)
    ev = F.col("evidence")
    return quality.quality_findings(df, prof, "urgent", roles=roles).select(
        "id", "type", "status", "severity", "column",
        F.coalesce(ev["missing_count"], ev["extreme_outliers_count"], ev["unique_count"]).alias("amount"))


@register(
    "duplicate_and_cardinality_findings_events",
    "SELECT 'F-Q101' AS id, 'format_error' AS type, CASE WHEN sum(c - 1) / CAST(sum(c) AS DOUBLE) > 0.05 THEN 'WARNING' ELSE 'INFO' END AS severity, "
    "NULL AS \"column\", CAST(sum(c - 1) AS VARCHAR) AS amount FROM (SELECT count(*) AS c FROM events GROUP BY event_type, user_id) "
    "UNION ALL SELECT 'F-Q102', 'high_cardinality', 'INFO', 'user_text', CAST(count(DISTINCT user_id) AS VARCHAR) FROM events",
)
def duplicate_and_cardinality_findings_events(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type", "concat('u', user_id) AS user_text")
    prof = settled(profile_columns(df))
    ev = F.col("evidence")
    return quality.quality_findings(df, prof).select(
        "id", "type", "severity", "column", F.coalesce(ev["duplicate_count"], ev["unique_count"]).alias("amount"))


FEATURES = ["customer_id", "segment", "balance", "total_price", "income_score", "tail_amount", "order_status",
            "order_date", "split", "refund_flag"]


def _spearman_sql(view_name: str, c: str, target: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", count(*) AS n, {rounded_sql('corr(rx, ry)')} AS spearman FROM ("
        f"SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, "
        f"rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM ("
        f"SELECT {c} AS x, {target} AS y FROM {view_name} WHERE {c} IS NOT NULL AND {target} IS NOT NULL))"
    )


@register(
    "spearman_with_binary_target_orders",
    cte("orders_audit") + " " + " UNION ALL ".join(_spearman_sql("orders_audit", c, "urgent") for c in FEATURES),
)
def spearman_with_binary_target_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit")
    return leakage.spearman(df, FEATURES, "urgent", True).select(
        "column", "n", leakage.rounded("spearman").alias("spearman"))


LINE_FEATURES = ["quantity", "discount", "tax", "return_flag", "net_price"]


@register(
    "spearman_with_numeric_target_lineitem",
    cte("lineitem_audit") + " " + " UNION ALL ".join(_spearman_sql("lineitem_audit", c, "extended_price") for c in LINE_FEATURES),
)
def spearman_with_numeric_target_lineitem(spark, sf_dir):
    df = view(spark, sf_dir, "lineitem_audit")
    return leakage.spearman(df, LINE_FEATURES, "extended_price", False).select(
        "column", "n", leakage.rounded("spearman").alias("spearman"))


@register(
    "single_feature_auc_flag_orders",
    cte("orders_audit") + " SELECT 'refund_flag' AS \"column\", 'AUC' AS metric, "
    "round((tp / p + tn / q) / 2, 4) AS score FROM (SELECT "
    "CAST(count(CASE WHEN urgent = 1 AND refund_flag = 1 THEN 1 END) AS DOUBLE) AS tp, "
    "CAST(count(CASE WHEN urgent = 0 AND refund_flag = 0 THEN 1 END) AS DOUBLE) AS tn, "
    "count(CASE WHEN urgent = 1 THEN 1 END) AS p, count(CASE WHEN urgent = 0 THEN 1 END) AS q FROM orders_audit)",
)
def single_feature_auc_flag_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit")
    return leakage.single_feature_scores(df, ["refund_flag"], "urgent", True).select(
        "column", "metric", leakage.rounded("score").alias("score"))


@register("single_feature_scores_orders")
def single_feature_scores_orders(spark, sf_dir):
    return leakage.feature_target_scores(view(spark, sf_dir, "orders_audit"), FEATURES, "urgent", "binary_classification")


@register("single_feature_r2_lineitem")
def single_feature_r2_lineitem(spark, sf_dir):
    df = view(spark, sf_dir, "lineitem_audit")
    return leakage.feature_target_scores(df, LINE_FEATURES, "extended_price", "regression")


@register(
    "leakage_findings_orders",
    cte("orders_audit") + " SELECT 'F-L201' AS id, 'target_leakage' AS type, 'SUSPECTED' AS status, 'WARNING' AS severity, "
    "'refund_flag' AS \"column\", 'single_feature_score_very_high;rank_correlation_extreme;post_event_name' AS reasons "
    "FROM orders_audit HAVING abs(corr(refund_flag, urgent)) >= 0.85",
)
def leakage_findings_orders(spark, sf_dir):
    df, _, roles = _orders_findings(spark, sf_dir)
    return leakage.leakage_findings(df, roles, "urgent", "binary_classification").select(
        "id", "type", "status", "severity", "column", F.col("evidence")["reasons"].alias("reasons"))


@register(
    "post_event_names_orders",
    cte("orders_audit") + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {str(c == 'refund_flag').lower()} AS post_event_name, count(\"{c}\") AS n_present FROM orders_audit" for c in FEATURES),
)
def post_event_names_orders(spark, sf_dir):
    """Suspicious names beside the number of rows that have a value."""
    df = view(spark, sf_dir, "orders_audit")
    names = [c for c in df.columns if c in FEATURES]
    present_rows = df.select([F.count(ref(c)).alias(c) for c in names]).unpivot([], names, "column", "n_present")
    return leakage.post_event_names(df, names).join(present_rows, "column")


_IDS = "SELECT customer_id AS id, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS b FROM orders_audit GROUP BY customer_id"


@register(
    "train_test_contamination_orders",
    cte("orders_audit") + " SELECT 'split' AS split_column, 'customer_id' AS id_column, sum(a) AS first_ids, sum(b) AS second_ids, "
    "sum(a * b) AS shared_ids, round(sum(a * b) / CAST(sum(b) AS DOUBLE), 4) AS shared_pct, "
    f"(SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (SELECT id FROM ({_IDS}) WHERE a * b = 1 ORDER BY id LIMIT 5)) AS sample_ids FROM ({_IDS})",
)
def train_test_contamination_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit")
    first, second = leakage.first_two_values(df, "split", "order_id")
    return leakage.contamination(df, "split", "customer_id", (first, second))


@register("contamination_findings_orders")
def contamination_findings_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit")
    return leakage.contamination_findings(df, [], "order_id", id_column="customer_id")


# --- drift -----------------------------------------------------------------------------------------

_TIMED = "(SELECT *, row_number() OVER (ORDER BY ts NULLS LAST, event_id) <= floor(0.7 * count(*) OVER ()) AS base FROM events_audit)"
DRIFT_NUMERIC = ["user_id", "value", "shifted"]
DRIFT_TEXT = ["event_type", "channel"]


def _psi_numeric_sql(source: str, c: str) -> str:
    """Rows (column, bin, expected, actual) over baseline deciles; edges are distinct quantiles."""
    return (
        f"(SELECT '{c}' AS \"column\", b AS bin, e / sum(e) OVER () AS expected, a / sum(a) OVER () AS actual FROM ("
        "SELECT b, least(greatest(count(CASE WHEN base THEN x END) / max(nb), 0.0001), 1) AS e, "
        "least(greatest(count(CASE WHEN NOT base THEN x END) / max(nc), 0.0001), 1) AS a FROM "
        f"(SELECT unnest(range(len(edges) - 1)) AS b, edges, nb, nc FROM (SELECT list_sort(list_distinct(quantile_cont({c}, "
        "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (WHERE base))) AS edges, "
        f"CAST(count({c}) FILTER (WHERE base) AS DOUBLE) AS nb, CAST(count({c}) FILTER (WHERE NOT base) AS DOUBLE) AS nc FROM {source})) g "
        f"LEFT JOIN (SELECT CAST({c} AS DOUBLE) AS x, base FROM {source} WHERE {c} IS NOT NULL) d "
        "ON (b = 0 OR x >= edges[b + 1]) AND (b = len(edges) - 2 OR x < edges[b + 2]) GROUP BY b))"
    )


def _psi_text_sql(source: str, c: str) -> str:
    return (
        f"(SELECT '{c}' AS \"column\", x AS bin, greatest(nb / sum(nb) OVER (), 0.0001) AS expected, "
        f"greatest(nc / sum(nc) OVER (), 0.0001) AS actual FROM (SELECT CAST({c} AS VARCHAR) AS x, "
        f"CAST(count(*) FILTER (WHERE base) AS DOUBLE) AS nb, CAST(count(*) FILTER (WHERE NOT base) AS DOUBLE) AS nc "
        f"FROM {source} WHERE {c} IS NOT NULL GROUP BY 1))"
    )


def _ks_sql(source: str, c: str) -> str:
    return (
        f"(SELECT '{c}' AS \"column\", max(abs(fb / nb - fc / nc)) AS ks FROM (SELECT "
        "sum(b) OVER (ORDER BY x) AS fb, sum(k) OVER (ORDER BY x) AS fc, CAST(sum(b) OVER () AS DOUBLE) AS nb, CAST(sum(k) OVER () AS DOUBLE) AS nc "
        f"FROM (SELECT {c} AS x, count(*) FILTER (WHERE base) AS b, count(*) FILTER (WHERE NOT base) AS k FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)))"
    )


def drift_sql(view_name: str, source: str, numeric: list[str], text: list[str]) -> str:
    bins = " UNION ALL ".join(
        [f'SELECT "column", expected, actual FROM {_psi_numeric_sql(source, c)}' for c in numeric]
        + [f'SELECT "column", expected, actual FROM {_psi_text_sql(source, c)}' for c in text])
    ks = " UNION ALL ".join(f"SELECT * FROM {_ks_sql(source, c)}" for c in numeric)
    psi = f'SELECT "column", round(sum((actual - expected) * ln(actual / expected)), 4) AS psi FROM ({bins}) GROUP BY 1'
    return (
        f'{cte(view_name)} SELECT p."column", {rounded_sql("psi")} AS psi, {rounded_sql("ks")} AS ks_stat, '
        "CASE WHEN psi >= 0.25 THEN 'CRITICAL' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'INFO' END AS severity "
        f'FROM ({psi}) p LEFT JOIN ({ks}) k ON p."column" = k."column"'
    )


def _events_parts(spark, sf_dir):
    df = view(spark, sf_dir, "events_audit")
    return df, drift.partition_for_drift(df, "event_id", time="ts")


@register("drift_by_time_events", drift_sql("events_audit", _TIMED, DRIFT_NUMERIC, DRIFT_TEXT))
def drift_by_time_events(spark, sf_dir):
    df, part = _events_parts(spark, sf_dir)
    return drift.drift_metrics(df, DRIFT_NUMERIC + DRIFT_TEXT, part).select("column", "psi", "ks_stat", "severity")


@register(
    "drift_by_split_orders",
    drift_sql("orders_audit", "(SELECT *, split = 'train' AS base FROM orders_audit)",
              ["balance", "total_price", "income_score", "refund_flag"], ["segment", "order_status"]),
)
def drift_by_split_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit")
    part = drift.partition_for_drift(df, "order_id", split="split")
    columns = ["balance", "total_price", "income_score", "refund_flag", "segment", "order_status"]
    return drift.drift_metrics(df, columns, part).select("column", "psi", "ks_stat", "severity")


@register(
    "drift_by_position_lineitem",
    drift_sql("lineitem_audit", "(SELECT *, row_number() OVER (ORDER BY line_key, extended_price) <= floor(0.7 * count(*) OVER ()) AS base FROM lineitem_audit)",
              ["quantity", "extended_price", "discount"], ["return_flag"]),
)
def drift_by_position_lineitem(spark, sf_dir):
    df = view(spark, sf_dir, "lineitem_audit")
    part = drift.partition_by_position(df, ["line_key", "extended_price"])
    return drift.drift_metrics(df, ["quantity", "extended_price", "discount", "return_flag"], part).select(
        "column", "psi", "ks_stat", "severity")


@register(
    "drift_partition_sizes_events",
    cte("events_audit") + f" SELECT base AS is_base, count(*) AS n, min(event_id) AS first_id FROM {_TIMED} GROUP BY base",
)
def drift_partition_sizes_events(spark, sf_dir):
    df, part = _events_parts(spark, sf_dir)
    return df.groupBy(part.base.alias("is_base")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@register(
    "drift_detected_time_orders",
    cte("orders_audit") + " SELECT base AS is_base, count(*) AS n, sum(order_id) AS ids FROM (SELECT *, "
    "row_number() OVER (ORDER BY order_date NULLS LAST, order_id) <= floor(0.7 * count(*) OVER ()) AS base FROM orders_audit) GROUP BY base",
)
def drift_detected_time_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit")
    part = drift.partition_for_drift(df, "order_id")
    return df.groupBy(part.base.alias("is_base")).agg(F.count(F.lit(1)).alias("n"), F.sum("order_id").alias("ids"))


@register(
    "drift_numeric_bins_events",
    cte("events_audit") + f" SELECT \"column\", bin, {rounded_sql('expected')} AS expected, {rounded_sql('actual')} AS actual, "
    f"{rounded_sql('(actual - expected) * ln(actual / expected)')} AS contribution FROM ("
    + " UNION ALL ".join(f"SELECT * FROM {_psi_numeric_sql(_TIMED, c)}" for c in DRIFT_NUMERIC) + ")",
)
def drift_numeric_bins_events(spark, sf_dir):
    df, part = _events_parts(spark, sf_dir)
    counts = drift.paired_counts(df, {c: F.col(c).cast("double") for c in DRIFT_NUMERIC}, part)
    bins = drift.numeric_bins(drift.ordered_counts(counts))
    return bins.select("column", F.col("bin").cast("bigint").alias("bin"),
                       *[drift.rounded(c).alias(c) for c in ("expected", "actual", "contribution")])


@register(
    "drift_category_bins_events",
    cte("events_audit") + f" SELECT \"column\", bin, {rounded_sql('expected')} AS expected, {rounded_sql('actual')} AS actual, "
    f"{rounded_sql('(actual - expected) * ln(actual / expected)')} AS contribution FROM ("
    + " UNION ALL ".join(f"SELECT * FROM {_psi_text_sql(_TIMED, c)}" for c in DRIFT_TEXT) + ")",
)
def drift_category_bins_events(spark, sf_dir):
    df, part = _events_parts(spark, sf_dir)
    bins = drift.categorical_bins(drift.paired_counts(df, {c: F.col(c) for c in DRIFT_TEXT}, part))
    return bins.select("column", F.col("value").alias("bin"),
                       *[drift.rounded(c).alias(c) for c in ("expected", "actual", "contribution")])


@register("drift_ks_p_values_events")
def drift_ks_p_values_events(spark, sf_dir):
    df, part = _events_parts(spark, sf_dir)
    counts = drift.paired_counts(df, {c: F.col(c).cast("double") for c in DRIFT_NUMERIC}, part)
    return drift.ks_statistics(drift.ordered_counts(counts))


@register(
    "drift_findings_events",
    f"{cte('events_audit')} SELECT concat('F-D', CAST(row_number() OVER (ORDER BY CASE \"column\" WHEN 'shifted' THEN 1 ELSE 2 END) AS VARCHAR)) AS id, "
    "\"column\", 'SUSPECTED' AS status, 'WARNING' AS severity, CAST(psi AS DOUBLE) AS psi FROM ("
    "SELECT \"column\", round(sum((actual - expected) * ln(actual / expected)), 4) AS psi FROM ("
    + " UNION ALL ".join(
        [f'SELECT "column", expected, actual FROM {_psi_numeric_sql(_TIMED, c)}' for c in DRIFT_NUMERIC]
        + [f'SELECT "column", expected, actual FROM {_psi_text_sql(_TIMED, c)}' for c in DRIFT_TEXT])
    + ") GROUP BY 1) WHERE psi >= 0.25",
)
def drift_findings_events(spark, sf_dir):
    df, part = _events_parts(spark, sf_dir)
    metrics = drift.drift_metrics(df, DRIFT_NUMERIC + DRIFT_TEXT, part)
    return drift.drift_findings(df, metrics, part).select(
        "id", "column", "status", "severity", F.col("evidence")["psi"].cast("double").alias("psi"))


# --- slices ----------------------------------------------------------------------------------------

_TERTILE = (
    "CASE WHEN length_score <= (SELECT quantile_cont(length_score, 1.0 / 3) FROM labelled_audit) THEN 'Low' "
    "WHEN length_score <= (SELECT quantile_cont(length_score, 2.0 / 3) FROM labelled_audit) THEN 'Medium' ELSE 'High' END"
)
_SLICED = (
    "(SELECT 'lang' AS feature, coalesce(lang, 'nan') AS s, truth AS y, prediction AS p, abs(amount - estimate) AS err FROM labelled_audit "
    f"UNION ALL SELECT 'length_score_quantile', {_TERTILE}, truth, prediction, abs(amount - estimate) FROM labelled_audit)"
)


def _f1_sql(source: str, by: str) -> str:
    """Weighted F1 per group of ``by``."""
    return (
        f"(SELECT {by}, sum(t) AS n, sum(t * f1) / sum(t) AS score FROM (SELECT {by}, c, sum(t) AS t, "
        f"2.0 * sum(hit) / (sum(t) + sum(m)) AS f1 FROM (SELECT {by}, y AS c, 1 AS t, 0 AS m, CAST(y = p AS INT) AS hit FROM {source} "
        f"UNION ALL SELECT {by}, p, 0, 1, 0 FROM {source}) GROUP BY {by}, c) GROUP BY {by})"
    )


def _slices_of(spark, sf_dir):
    df = view(spark, sf_dir, "labelled_audit")
    base = df.select("doc_id", "lang", "source", "length_score", "truth")
    distinct = distinct_counts(value_counts(base, base.columns))
    counts = column_counts(base).join(F.broadcast(distinct), "column").withColumn("semantic_type", F.lit("generic_categorical"))
    roles = semantic.column_roles(counts, "truth").select(F.col("column").alias("name"), "unique_count", "is_id", "is_constant")
    return df, fairness.candidate_slices(df, roles.collect(), "truth")


@register(
    "slice_f1_documents",
    f"{cte('labelled_audit')} SELECT feature, s AS slice_value, CAST(n AS BIGINT) AS sample_count, round(n / CAST(total AS DOUBLE), 4) AS sample_pct, "
    f"'F1-Score' AS metric_name, {rounded_sql('score')} AS slice_score, {rounded_sql('overall')} AS overall_score, "
    "round(score / overall, 3) AS disparity_ratio, overall - score >= 0.15 AS is_disparate "
    f"FROM {_f1_sql(_SLICED, 'feature, s')} CROSS JOIN (SELECT score AS overall, n AS total FROM {_f1_sql('(SELECT 1 AS g, truth AS y, prediction AS p FROM labelled_audit)', 'g')}) WHERE n >= 25",
)
def slice_f1_documents(spark, sf_dir):
    df, slices = _slices_of(spark, sf_dir)
    return fairness.slice_metrics(df, F.col("truth"), F.col("prediction"), slices, True)


@register(
    "slice_mae_documents",
    f"{cte('labelled_audit')} SELECT feature, s AS slice_value, count(*) AS sample_count, round(count(*) / CAST(total AS DOUBLE), 4) AS sample_pct, "
    f"'MAE' AS metric_name, {rounded_sql('avg(err)')} AS slice_score, {rounded_sql('overall')} AS overall_score, "
    "round(avg(err) / overall, 3) AS disparity_ratio, avg(err) / overall > 1.3 AS is_disparate "
    f"FROM {_SLICED} CROSS JOIN (SELECT avg(abs(amount - estimate)) AS overall, count(*) AS total FROM labelled_audit) "
    "GROUP BY feature, s, overall, total HAVING count(*) >= 25",
)
def slice_mae_documents(spark, sf_dir):
    df, slices = _slices_of(spark, sf_dir)
    return fairness.slice_metrics(df, F.col("amount"), F.col("estimate"), slices, False)


@register(
    "slice_findings_documents",
    f"{cte('labelled_audit')} SELECT 'F-B401' AS id, 'slice_bias' AS type, feature AS \"column\", s AS subgroup, CAST(n AS VARCHAR) AS size "
    f"FROM {_f1_sql(_SLICED, 'feature, s')} CROSS JOIN (SELECT score AS overall FROM {_f1_sql('(SELECT 1 AS g, truth AS y, prediction AS p FROM labelled_audit)', 'g')}) "
    "WHERE n >= 25 AND overall - score >= 0.15",
)
def slice_findings_documents(spark, sf_dir):
    df, slices = _slices_of(spark, sf_dir)
    metrics = fairness.slice_metrics(df, F.col("truth"), F.col("prediction"), slices, True)
    return fairness.slice_findings(df, metrics, list(slices)).select(
        "id", "type", "column", F.col("evidence")["subgroup"].alias("subgroup"),
        F.col("evidence")["subgroup_sample_size"].alias("size"))


# --- decisions -------------------------------------------------------------------------------------

NUMERIC_ORDERS = ["customer_id", "balance", "total_price", "income_score", "tail_amount", "refund_flag"]


@register(
    "collinear_pairs_orders",
    cte("orders_audit") + " SELECT c1, c2, n, r FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS c1, '{b}' AS c2, {i} AS i, {j} AS j, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, "
        f"round(corr({a}, {b}), 4) AS r FROM orders_audit"
        for i, a in enumerate(NUMERIC_ORDERS) for j, b in enumerate(NUMERIC_ORDERS) if i < j)
    + ") WHERE n > 30 AND abs(r) >= 0.85 QUALIFY row_number() OVER (PARTITION BY i ORDER BY j) = 1",
)
def collinear_pairs_orders(spark, sf_dir):
    pairs = decisions.collinear_pairs(view(spark, sf_dir, "orders_audit"), NUMERIC_ORDERS)
    return pairs.select("c1", "c2", "n", F.round("r", 4).alias("r"))


def _all_findings(spark, sf_dir):
    df, prof, roles = _orders_findings(spark, sf_dir)
    found = quality.quality_findings(df, prof, "urgent", roles=roles).unionByName(
        leakage.leakage_findings(df, roles, "urgent", "binary_classification"))
    return df, settled(found)


@register(
    "decision_candidates_orders",
    "SELECT * FROM (VALUES ('DEC-001', 'suspected_leakage', 'refund_flag', 'HIGH', 2), "
    "('DEC-002', 'missingness_strategy', 'income_score', 'HIGH', 3), ('DEC-003', 'missingness_strategy', 'total_price', 'MEDIUM', 3), "
    "('DEC-004', 'missingness_strategy', 'segment', 'MEDIUM', 3)) t(decision_id, category, columns, expected_impact, strategies) "
    "WHERE (SELECT count(*) FROM orders) > 0",
)
def decision_candidates_orders(spark, sf_dir):
    df, found = _all_findings(spark, sf_dir)
    return decisions.decision_candidates(found, df, "urgent", "binary_classification", numeric=NUMERIC_ORDERS).select(
        "decision_id", "category", F.array_join("affected_columns", ",").alias("columns"), "expected_impact",
        F.size("available_strategies").alias("strategies"))


@register(
    "redundancy_and_outlier_candidates_orders",
    "SELECT * FROM (VALUES ('DEC-001', 'feature_redundancy', 'total_price,income_score'), "
    "('DEC-002', 'outlier_treatment', 'tail_amount')) t(decision_id, category, columns) WHERE (SELECT count(*) FROM orders) > 0",
)
def redundancy_and_outlier_candidates_orders(spark, sf_dir):
    df, found = _all_findings(spark, sf_dir)
    rest = found.where("type NOT IN ('target_leakage', 'missingness')")
    return decisions.decision_candidates(rest, df, "urgent", "binary_classification", numeric=NUMERIC_ORDERS).select(
        "decision_id", "category", F.array_join("affected_columns", ",").alias("columns"))


def _event_findings(spark, sf_dir):
    """A findings table derived from the events: one row per event with varied severity and type."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "concat('F-', event_id) AS id",
        "CASE user_id % 4 WHEN 0 THEN 'missingness' WHEN 1 THEN 'target_leakage' WHEN 2 THEN 'distribution_drift' ELSE 'slice_bias' END AS type",
        "CASE user_id % 5 WHEN 0 THEN 'OBSERVED' ELSE 'SUSPECTED' END AS status",
        "CASE WHEN value > 300 THEN 'CRITICAL' WHEN value > 250 THEN 'WARNING' ELSE 'INFO' END AS severity",
        "concat('feature_', user_id % 7) AS column", "concat('Seen: ', event_type) AS title",
        "concat('value ', event_type, ' of user ', user_id) AS description")


_EVENT_FINDINGS = (
    "WITH f AS (SELECT concat('F-', CAST(event_id AS VARCHAR)) AS id, CASE user_id % 4 WHEN 0 THEN 'missingness' WHEN 1 THEN 'target_leakage' "
    "WHEN 2 THEN 'distribution_drift' ELSE 'slice_bias' END AS type, CASE user_id % 5 WHEN 0 THEN 'OBSERVED' ELSE 'SUSPECTED' END AS status, "
    "CASE WHEN value > 300 THEN 'CRITICAL' WHEN value > 250 THEN 'WARNING' ELSE 'INFO' END AS severity, "
    "concat('feature_', CAST(user_id % 7 AS VARCHAR)) AS \"column\", concat('Seen: ', event_type) AS title, "
    "concat('value ', event_type, ' of user ', CAST(user_id AS VARCHAR)) AS description FROM events) "
)
# nine findings from all events: the severity follows the number of large values in each group of users
_GROUP_FINDINGS = (
    "WITH g AS (SELECT user_id % 9 AS g, sum(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS n FROM events GROUP BY user_id % 9), "
    "f AS (SELECT concat('F-', CAST(g AS VARCHAR)) AS id, CASE g % 4 WHEN 0 THEN 'missingness' WHEN 1 THEN 'target_leakage' "
    "WHEN 2 THEN 'distribution_drift' ELSE 'slice_bias' END AS type, "
    "CASE n % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity FROM g) "
)


def _group_findings(spark, sf_dir):
    groups = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.expr("user_id % 9 AS g")).agg(F.count_if(F.col("value") > 200).alias("n"))
    return groups.selectExpr(
        "concat('F-', g) AS id",
        "CASE g % 4 WHEN 0 THEN 'missingness' WHEN 1 THEN 'target_leakage' WHEN 2 THEN 'distribution_drift' ELSE 'slice_bias' END AS type",
        "'SUSPECTED' AS status", "CASE n % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity",
        "concat('feature_', g) AS column", "'' AS title", "'' AS description")


_POINTS = "sum(CASE severity WHEN 'CRITICAL' THEN 15.0 WHEN 'WARNING' THEN 5.0 ELSE 1.0 END)"


def _health_sql(supervised: bool) -> str:
    group = lambda t: f"greatest(0, 100 - coalesce({_POINTS} FILTER (WHERE type = '{t}'), 0))"
    parts = {"quality": group("missingness"), "drift": group("distribution_drift"),
             "leakage": group("target_leakage") if supervised else "0.0", "fairness": group("slice_bias") if supervised else "0.0"}
    overall = ("0.3 * q + 0.3 * l + 0.2 * d + 0.2 * s" if supervised else "(0.3 * q + 0.2 * d) / 0.5")
    return (
        _GROUP_FINDINGS + f"SELECT overall_score, q AS quality_score, l AS leakage_score, d AS drift_score, s AS fairness_score, "
        "CASE WHEN overall_score >= 90 THEN 'A+' WHEN overall_score >= 80 THEN 'A' WHEN overall_score >= 70 THEN 'B' "
        "WHEN overall_score >= 55 THEN 'C' WHEN overall_score >= 40 THEN 'D' ELSE 'F' END AS grade FROM ("
        f"SELECT q, l, d, s, round({overall}, 1) AS overall_score FROM (SELECT CAST({parts['quality']} AS DOUBLE) AS q, CAST({parts['leakage']} AS DOUBLE) AS l, "
        f"CAST({parts['drift']} AS DOUBLE) AS d, CAST({parts['fairness']} AS DOUBLE) AS s FROM f))"
    )


@register("health_score_events", _health_sql(True))
def health_score_events(spark, sf_dir):
    return decisions.health_score(_group_findings(spark, sf_dir))


@register("health_score_without_target_events", _health_sql(False))
def health_score_without_target_events(spark, sf_dir):
    return decisions.health_score(_group_findings(spark, sf_dir), has_target=False)


@register(
    "findings_search_events",
    _EVENT_FINDINGS + "SELECT id, type, status, \"column\" FROM f WHERE (contains(lower(title), 'click') OR contains(lower(description), 'click') "
    "OR contains(lower(\"column\"), 'click') OR contains(lower(id), 'click')) AND status = 'SUSPECTED' AND type = 'target_leakage'",
)
def findings_search_events(spark, sf_dir):
    found = fd.search(_event_findings(spark, sf_dir), "CLICK", "SUSPECTED", "target_leakage")
    return found.select("id", "type", "status", "column")


@register("findings_counts_events", _EVENT_FINDINGS + "SELECT status, type, count(*) AS count FROM f GROUP BY status, type")
def findings_counts_events(spark, sf_dir):
    return fd.counts_by_status_and_category(_event_findings(spark, sf_dir))


@register(
    "executive_summary_events",
    _EVENT_FINDINGS + "SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE severity = 'WARNING') AS warning_count, "
    "string_agg(DISTINCT \"column\", ',' ORDER BY \"column\") FILTER (WHERE type = 'target_leakage') AS leaky_columns, "
    "count(*) FILTER (WHERE type = 'distribution_drift') AS drift_count, count(*) FILTER (WHERE type = 'slice_bias') AS slice_count FROM f",
)
def executive_summary_events(spark, sf_dir):
    found = _event_findings(spark, sf_dir)
    size = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(6))
    return decisions.executive_summary(found, decisions.health_score(found), size).select(
        "critical_count", "warning_count", F.array_join("leaky_columns", ",").alias("leaky_columns"), "drift_count", "slice_count")


@register(
    "recorded_decisions_events",
    "WITH c AS (SELECT concat('DEC-', CAST(c_custkey AS VARCHAR)) AS decision_id FROM customer), "
    "d AS (SELECT concat('DEC-', CAST(user_id AS VARCHAR)) AS decision_id, event_type AS strategy, CAST(ts AS VARCHAR) AS at, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS r FROM events) "
    "SELECT c.decision_id, CASE WHEN d.strategy IS NULL THEN 'EXPERIMENT_READY' ELSE 'USER_DECISION' END AS status, d.strategy "
    "FROM c LEFT JOIN d ON c.decision_id = d.decision_id AND d.r = 1",
)
def recorded_decisions_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    candidates = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('DEC-', c_custkey) AS decision_id", "'EXPERIMENT_READY' AS status")
    log = events.selectExpr(
        "concat('DEC-', user_id) AS decision_id", "event_type AS selected_strategy_id", "props AS decision_rationale",
        "ts AS decided_at", "CAST(NULL AS string) AS custom_method_notes")
    return decisions.apply_decisions(candidates, log).select(
        "decision_id", "status", F.col("user_decision.selected_strategy_id").alias("strategy"))
