"""Check queries of the profile, semantic type and role operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.operators import profile, semantic
from gaugework.operators.ordered import value_counts
from gaugework.plans.registry import register
from gaugework.plans.views import ORDERS, cte, view

LINE_NUMERIC = ["quantity", "extended_price", "discount", "tax", "net_price"]
ORDER_COLUMNS = [n for n, _ in ORDERS]
EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "channel"]


def union_sql(columns: list[str], template: str) -> str:
    """One SELECT per column; ``{c}`` is the column and ``{i}`` its position."""
    return " UNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(columns))


def rounded_sql(expr: str, digits: int = 4) -> str:
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0 ELSE round({expr}, {digits}) END)"


_NUMERIC = (
    'SELECT \'{c}\' AS "column", count({c}) AS n, '
    + ", ".join(
        f"{rounded_sql(e)} AS {a}"
        for e, a in [
            ("min({c})", '"min"'), ("max({c})", '"max"'), ("avg({c})", "mean"), ("stddev_samp({c})", "std"),
            ("skewness({c})", "skewness"), ("kurtosis({c})", "kurtosis"),
            ("quantile_cont({c}, 0.05)", "p5"), ("quantile_cont({c}, 0.25)", "p25"),
            ("quantile_cont({c}, 0.5)", "median"), ("quantile_cont({c}, 0.75)", "p75"),
            ("quantile_cont({c}, 0.95)", "p95"),
        ]
    )
    + " FROM lineitem_audit"
)


@register("numeric_profile_lineitem", cte("lineitem_audit") + " " + union_sql(LINE_NUMERIC, _NUMERIC))
def numeric_profile_lineitem(spark, sf_dir):
    df = view(spark, sf_dir, "lineitem_audit").select(*LINE_NUMERIC)
    moments = profile.numeric_moments(df)
    points = profile.quantiles(value_counts(df, LINE_NUMERIC))
    joined = moments.join(F.broadcast(points), "column")
    return joined.select(
        "column", "n",
        *[profile.rounded(c).alias(c) for c in (
            "min", "max", "mean", "std", "skewness", "kurtosis", "p5", "p25", "median", "p75", "p95")],
    )


_COUNTS = (
    'SELECT \'{c}\' AS "column", count(*) AS n_rows, count(*) - count({c}) AS missing_count, '
    "round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 4) AS missing_pct, "
    "count(DISTINCT {c}) AS unique_count, "
    "round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 4) AS unique_ratio, "
    "count(DISTINCT {c}) <= 1 AS is_constant FROM orders_audit"
)


@register("column_counts_orders", cte("orders_audit") + " " + union_sql(ORDER_COLUMNS, _COUNTS))
def column_counts_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit")
    distinct = profile.distinct_counts(value_counts(df, df.columns))
    base = profile.column_counts(df).join(F.broadcast(distinct), "column", "left")
    base = base.withColumn("unique_count", F.coalesce("unique_count", F.lit(0))).withColumn("semantic_type", F.lit(""))
    return semantic.column_roles(base).select(
        "column", "n_rows", "missing_count", "missing_pct", "unique_count", "unique_ratio", "is_constant"
    )


@register(
    "dataset_size_and_duplicates_events",
    "SELECT sum(c) AS row_count, sum(c - 1) AS duplicate_rows, "
    "round(sum(c - 1) / CAST(sum(c) AS DOUBLE), 4) AS duplicate_pct, 3 AS column_count "
    "FROM (SELECT count(*) AS c FROM (SELECT event_type, user_id, date_trunc('day', ts) AS d FROM events) "
    "GROUP BY event_type, user_id, d)",
)
def dataset_size_and_duplicates_events(spark, sf_dir):
    df = view(spark, sf_dir, "events_audit").select("event_type", "user_id", F.date_trunc("day", "ts").alias("d"))
    return profile.duplicate_rows(df).withColumn("column_count", F.lit(len(df.columns)))


@register("row_and_column_count_orders", "SELECT count(*) AS row_count, 6 AS column_count FROM orders")
def row_and_column_count_orders(spark, sf_dir):
    return profile.row_and_column_count(spark.read.parquet(f"{sf_dir}/orders.parquet"))


_TOP = (
    "(SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rank, "
    "CAST({c} AS VARCHAR) AS value, count(*) AS count, "
    "round(count(*) / CAST((SELECT count(*) FROM orders_audit) AS DOUBLE), 4) AS pct "
    "FROM orders_audit WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= 10)"
)
TOP_COLUMNS = ["order_id", "customer_id", "segment", "order_status", "split", "refund_flag", "urgent"]


@register("top_values_orders", cte("orders_audit") + " " + union_sql(TOP_COLUMNS, _TOP))
def top_values_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit").select(*TOP_COLUMNS)
    return profile.top_values(value_counts(df, TOP_COLUMNS), profile.column_counts(df))


_SAMPLE = (
    "(SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY min(event_id)) AS rank, "
    "CAST({c} AS VARCHAR) AS value FROM events_audit WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= 5)"
)
SAMPLE_COLUMNS = ["event_id", "user_id", "event_type", "channel"]


@register("sample_values_events", cte("events_audit") + " " + union_sql(SAMPLE_COLUMNS, _SAMPLE))
def sample_values_events(spark, sf_dir):
    df = view(spark, sf_dir, "events_audit")
    return profile.sample_values(value_counts(df, SAMPLE_COLUMNS, order_by="event_id"))


_HISTOGRAM = (
    "(SELECT '{c}' AS \"column\", b AS bin, "
    "round(lo + b * ((hi - lo) / 10), 3) AS bin_start, round(lo + (b + 1) * ((hi - lo) / 10), 3) AS bin_end, "
    "count(x) AS count, round(count(x) / CAST(n AS DOUBLE), 4) AS pct "
    "FROM (SELECT min({c}) AS lo, max({c}) AS hi, count({c}) AS n FROM lineitem_audit) "
    "CROSS JOIN (SELECT unnest(range(10)) AS b) "
    "LEFT JOIN (SELECT {c} AS x FROM lineitem_audit) ON least(floor((x - lo) / ((hi - lo) / 10)), 9) = b "
    "GROUP BY b, lo, hi, n)"
)


@register("histogram_lineitem", cte("lineitem_audit") + " " + union_sql(LINE_NUMERIC, _HISTOGRAM))
def histogram_lineitem(spark, sf_dir):
    df = view(spark, sf_dir, "lineitem_audit").select(*LINE_NUMERIC)
    return profile.histogram(value_counts(df, LINE_NUMERIC), profile.numeric_moments(df))


def _semantic_sql(view_name: str, key: str, columns: list[tuple[str, str]]) -> str:
    """Semantic type of each (column, family) from the first 100 values by key."""
    parts = []
    for c, kind in columns:
        if kind in ("string", "integer"):
            inner = (
                f"SELECT trim(CAST({c} AS VARCHAR)) AS t, row_number() OVER (ORDER BY {key}) AS r "
                f"FROM {view_name} WHERE {c} IS NOT NULL QUALIFY r <= 100"
            )
        else:
            parts.append(f"SELECT DISTINCT '{c}', '{'generic_numeric' if kind == 'float' else 'datetime_string'}' FROM {view_name}")
            continue
        date = (
            "(try_cast(t AS TIMESTAMP) IS NOT NULL AND regexp_matches(t, '^\\d{4}-')"
            " OR try_strptime(t, '%d/%m/%Y') IS NOT NULL OR try_strptime(t, '%m/%d/%Y') IS NOT NULL)"
        )
        cases = " ".join(
            f"WHEN avg(CASE WHEN t <> '' THEN CAST(regexp_matches(t, '{p}') AS INT) END) >= 0.7 THEN '{name}'"
            for name, p in semantic.SEMANTIC_PATTERNS.items()
        )
        literals = ", ".join(f"'{x}'" for x in semantic.BOOLEAN_LITERALS)
        fixed = {
            "integer": f"CASE WHEN min(CASE WHEN r <= 50 THEN CAST(lower(t) IN ({literals}) AS INT) END) = 1 "
                       "THEN 'boolean' ELSE 'generic_numeric' END",
        }.get(kind)
        text = (
            f"CASE WHEN min(CASE WHEN r <= 50 THEN CAST(lower(t) IN ({literals}) AS INT) END) = 1 THEN 'boolean' "
            f"{cases} WHEN avg(CASE WHEN t <> '' AND nth <= 20 THEN CAST({date} AS INT) END) >= 0.8 THEN 'datetime_string' "
            "WHEN avg(CASE WHEN t <> '' AND nth <= 20 THEN CAST(try_cast(t AS DOUBLE) IS NOT NULL AS INT) END) >= 0.8 "
            f"THEN 'numeric_string' WHEN (SELECT count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) < 0.05 "
            f"FROM {view_name}) THEN 'generic_categorical' ELSE 'generic_text' END"
        )
        parts.append(
            f"SELECT '{c}' AS \"column\", {fixed or text} AS semantic_type FROM "
            f"(SELECT *, sum(CAST(t <> '' AS INT)) OVER (ORDER BY r) AS nth FROM ({inner}))"
        )
    return " UNION ALL ".join(parts)


ORDER_KINDS = [
    ("order_id", "integer"), ("segment", "string"), ("balance", "float"), ("order_status", "string"),
    ("order_date", "temporal"), ("split", "string"), ("refund_flag", "integer"), ("urgent", "integer"),
]


@register("semantic_types_orders", cte("orders_audit") + " " + _semantic_sql("orders_audit", "order_id", ORDER_KINDS))
def semantic_types_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit").select(*[c for c, _ in ORDER_KINDS])
    return semantic.semantic_types(df, "order_id").select("column", "semantic_type")


PATTERNED = [
    ("doc_id", "doc_id"),
    ("mail", "concat('user', CAST(doc_id AS VARCHAR(20)), '@mail.example.org')"),
    ("phone", "concat('+1 555-', CAST(100 + doc_id % 800 AS VARCHAR(20)), '-', CAST(1000 + doc_id % 9000 AS VARCHAR(20)))"),
    ("address", "concat('10.', CAST(doc_id % 200 AS VARCHAR(20)), '.0.', CAST(doc_id % 99 AS VARCHAR(20)))"),
    ("zip", "CAST(10000 + doc_id % 80000 AS VARCHAR(20))"),
    ("card", "concat('4000-1234-', CAST(1000 + doc_id % 9000 AS VARCHAR(20)), '-', CAST(1000 + doc_id % 8999 AS VARCHAR(20)))"),
    ("price_text", "concat('$', CAST(doc_id % 500 AS VARCHAR(20)), '.50')"),
    ("day_text", "CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('2026-03-', CAST(10 + doc_id % 19 AS VARCHAR(20))) END"),
    ("number_text", "CAST(doc_id * 7 + 1.5 AS VARCHAR(20))"),
    ("answer", "CASE WHEN doc_id % 2 = 0 THEN 'Yes' ELSE 'no' END"),
    ("lang", "lang"),
    ("body", "text"),
]
_PATTERNED_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in PATTERNED) + " FROM documents"


@register(
    "semantic_types_patterns",
    f"WITH patterned AS ({_PATTERNED_SQL}) "
    + _semantic_sql("patterned", "doc_id", [(n, "string") for n, _ in PATTERNED if n != "doc_id"]),
)
def semantic_types_patterns(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*[f"{e} AS {n}" for n, e in PATTERNED])
    return semantic.semantic_types(df, "doc_id").where("column <> 'doc_id'").select("column", "semantic_type")


@register(
    "target_task_orders",
    cte("orders_audit") + " SELECT 'urgent' AS target, CASE WHEN n = 2 THEN 'binary_classification' "
    "WHEN n BETWEEN 3 AND 20 THEN 'multiclass_classification' ELSE 'regression' END AS target_type, "
    "n AS target_distinct FROM (SELECT count(DISTINCT urgent) AS n FROM orders_audit)",
)
def target_task_orders(spark, sf_dir):
    return semantic.target_task(view(spark, sf_dir, "orders_audit"), "URGENT")


_ROLE_ROWS = (
    "SELECT '{c}' AS \"column\", CASE WHEN '{c}' = 'urgent' THEN 'target' WHEN u <= 1 THEN 'constant' "
    "WHEN regexp_matches('{c}', '_id$') AND u / n >= 0.8 THEN 'id_candidate' "
    "WHEN '{c}' = 'order_date' THEN 'datetime_feature' "
    "WHEN '{c}' IN ('segment', 'order_status', 'split', 'refund_flag') THEN 'categorical_feature' "
    "ELSE 'numeric_feature' END AS role "
    "FROM (SELECT count(DISTINCT {c}) AS u, CAST(count(*) AS DOUBLE) AS n FROM orders_audit)"
)


@register("column_roles_orders", cte("orders_audit") + " " + union_sql(ORDER_COLUMNS, _ROLE_ROWS))
def column_roles_orders(spark, sf_dir):
    df = view(spark, sf_dir, "orders_audit")
    distinct = profile.distinct_counts(value_counts(df, df.columns))
    kinds = semantic.semantic_types(df, "order_id", distinct=distinct)
    base = profile.column_counts(df).join(F.broadcast(distinct), "column").join(
        F.broadcast(kinds.select("column", "semantic_type")), "column")
    return semantic.column_roles(base, "urgent").select("column", "role")


@register(
    "full_profile_events",
    cte("events_audit") + " " + union_sql(EVENT_COLUMNS, (
        "SELECT '{c}' AS name, count(*) AS n_rows, count(*) - count({c}) AS missing_count, "
        "count(DISTINCT {c}) AS unique_count, "
        + " , ".join(
            "CASE WHEN '{c}' IN ('event_id', 'user_id', 'value') THEN "
            + rounded_sql(f"{f}(try_cast({{c}} AS DOUBLE){a})") + f" END AS {n}"
            for f, a, n in [("avg", "", "mean"), ("quantile_cont", ", 0.5", "median"), ("stddev_samp", "", "std")]
        )
        + ", least(count(DISTINCT {c}), 10) AS n_top, least(count(DISTINCT {c}), 5) AS n_samples, "
        "CASE WHEN '{c}' IN ('event_id', 'user_id', 'value') THEN 10 END AS n_bins FROM events_audit"
    )),
)
def full_profile_events(spark, sf_dir):
    df = view(spark, sf_dir, "events_audit").select(*EVENT_COLUMNS)
    full = profile.profile_columns(df, None, "event_id")
    return full.select(
        "name", "n_rows", "missing_count", "unique_count", "mean", "median", "std",
        F.size("top_values").cast("bigint").alias("n_top"), F.size("sample_values").cast("bigint").alias("n_samples"),
        F.when(F.col("histogram").isNotNull(), F.size("histogram")).alias("n_bins"),
    )


@register("approximate_profile_lineitem")
def approximate_profile_lineitem(spark, sf_dir):
    return profile.approximate_summary(view(spark, sf_dir, "lineitem_audit"))
