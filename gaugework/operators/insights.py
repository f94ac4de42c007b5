"""Dataset-level insights and dashboard aggregates over triaged feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.functions.columns import ref

# Field names tried in order, value orders, scores and limits of the reports.
DATE_FIELDS = ("date", "created_at", "submitted_at", "timestamp")
CATEGORY_FIELDS = ("category", "department", "support_team", "product_category", "business_unit")
NO_DIMENSION = ("feedback", "cleaned_text", "topics", "keywords", "aspect_sentiments")
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
PRIORITIES = ("P1", "P2", "P3", "P4")
PRIORITY_POINTS = {"P1": 4, "P2": 3, "P3": 2, "P4": 1}
ACTIONS_NEEDED = ("CREATE_TASK", "ESCALATE", "IMMEDIATE_ESCALATION")
CASE_FIELDS = ("feedback_id", "feedback", "severity", "priority", "department", "action")
TOP, TOP_ASPECTS, TOP_HOTSPOTS, MAX_DIMENSION = 20, 30, 10, 50


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: rows, valid rows and the date range."""
    valid = F.count_if(F.col("validation_status") == "VALID") if "validation_status" in df.columns else F.count(F.lit(1))
    # the first date field that has any readable date gives the range
    dates = [ref(f).try_cast("timestamp") for f in DATE_FIELDS if f in df.columns] or [F.lit(None).cast("timestamp")]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), valid.alias("valid_rows"),
        F.coalesce(*[F.min(d) for d in dates]).alias("start"), F.coalesce(*[F.max(d) for d in dates]).alias("end"))


def dimensions(df: DataFrame) -> DataFrame:
    """column, distinct_count of columns with at most min(50, rows) distinct values.

    A sketch with 5 % error sets columns of clearly more values aside; only the rest is counted exactly.
    """
    from gaugework.operators.ordered import value_counts
    from gaugework.operators.profile import column_counts, distinct_counts

    plain = [
        f.name for f in df.schema.fields
        if f.name not in NO_DIMENSION and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    ]
    slim = df.select(*[ref(c) for c in plain])
    counts = column_counts(slim).select("column", "n_rows")
    sketch = slim.agg(*[F.approx_count_distinct(ref(c), 0.05).alias(f"s{i}") for i, c in enumerate(plain)]).first()
    low = [c for i, c in enumerate(plain) if sketch[f"s{i}"] <= 2 * MAX_DIMENSION]
    if not low:
        return _empty(df, "column string, distinct_count long")
    distinct = distinct_counts(value_counts(slim.select(*[ref(c) for c in low]), low))
    counts = counts.where(F.col("column").isin(low))
    # one row per column
    return counts.join(F.broadcast(distinct), "column", "left").select(
        "column", F.coalesce("unique_count", F.lit(0)).alias("distinct_count"), "n_rows"
    ).where(F.col("distinct_count") <= F.least(F.lit(MAX_DIMENSION), F.greatest(F.lit(1), F.col("n_rows")))).drop("n_rows")


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """sentiment, count, average_score (the mean over all rows)."""
    if "sentiment" not in df.columns:
        return _empty(df, "sentiment string, count bigint, average_score double")
    score = ref("sentiment_score").try_cast("double") if "sentiment_score" in df.columns else F.lit(None).cast("double")
    grouped = df.groupBy("sentiment").agg(F.count(F.lit(1)).alias("count"), F.sum(score).alias("_s"), F.count(score).alias("_n"))
    total = grouped.agg((F.sum("_s") / F.sum("_n")).alias("m")).select(F.round("m", 4).alias("average_score"), F.lit(1).alias("_one"))
    return grouped.where("sentiment IS NOT NULL").withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(
        "sentiment", "count", "average_score")


def decision_distributions(df: DataFrame) -> DataFrame:
    """field, value, count, pct (0-100 of all rows) for severity, priority, impact_level and action."""
    fields = [f for f in ("severity", "priority", "impact_level", "action") if f in df.columns]
    if not fields:
        return _empty(df, "field string, value string, count bigint, pct double")
    long = df.select(*[ref(f).cast("string").alias(f) for f in fields]).unpivot([], fields, "field", "value")
    grouped = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))
    # a handful of values per field
    total = F.sum("count").over(Window.partitionBy("field"))
    return grouped.withColumn("_total", total).where("value IS NOT NULL").select(
        "field", "value", "count", F.round(F.col("count") * 100 / F.col("_total"), 2).alias("pct"))


def _top(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The most frequent keys of a counted table; a top-k report by definition."""
    return df.orderBy(F.desc("count"), *keys).limit(limit)


def category_counts(df: DataFrame) -> DataFrame:
    """field, value, count of the first available category column."""
    field = next((f for f in CATEGORY_FIELDS if f in df.columns), None)
    if field is None:
        return _empty(df, "field string, value string, count bigint")
    grouped = df.where(ref(field).isNotNull()).groupBy(ref(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return _top(grouped, ["value"], TOP).select(F.lit(field).alias("field"), "value", "count")


def listed_values(df: DataFrame, field: str) -> Column:
    """The values of a list-like column as array<string>: array, JSON list text or a single value."""
    kind = df.schema[field].dataType
    if isinstance(kind, T.ArrayType):
        return F.transform(ref(field), lambda v: v.cast("string"))
    text = ref(field).cast("string")
    parsed = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, F.array(text)))


def top_listed(df: DataFrame, field: str, limit: int = TOP) -> DataFrame:
    """field, value, count of the most frequent values of a list-like column."""
    if field not in df.columns:
        return _empty(df, "field string, value string, count bigint")
    values = df.select(F.explode(listed_values(df, field)).alias("value")).where("trim(value) <> ''")
    return _top(values.groupBy("value").agg(F.count(F.lit(1)).alias("count")), ["value"], limit).select(
        F.lit(field).alias("field"), "value", "count")


def aspect_summary(df: DataFrame) -> DataFrame:
    """aspect, sentiment, count."""
    if "aspect_sentiments" not in df.columns:
        return _empty(df, "aspect string, sentiment string, count bigint")
    column = ref("aspect_sentiments")
    if not isinstance(df.schema["aspect_sentiments"].dataType, T.ArrayType):
        column = F.from_json(column.cast("string"), "array<struct<aspect:string,sentiment:string>>")
    items = df.select(F.inline(column)).select(
        F.coalesce("aspect", F.lit("")).alias("aspect"), F.coalesce("sentiment", F.lit("")).alias("sentiment"))
    return _top(items.groupBy("aspect", "sentiment").agg(F.count(F.lit(1)).alias("count")), ["aspect", "sentiment"], TOP_ASPECTS)


def cross_metrics(df: DataFrame) -> DataFrame:
    if not {"severity", "action"} <= set(df.columns):
        return _empty(df, "severity string, action string, count bigint")
    return df.where("severity IS NOT NULL AND action IS NOT NULL").groupBy("severity", "action").agg(F.count(F.lit(1)).alias("count"))


def hotspots(df: DataFrame) -> DataFrame:
    """department, count of HIGH and CRITICAL rows, the ten largest."""
    if not {"department", "severity"} <= set(df.columns):
        return _empty(df, "department string, count bigint")
    grouped = df.where("severity IN ('HIGH', 'CRITICAL') AND department IS NOT NULL").groupBy("department").agg(F.count(F.lit(1)).alias("count"))
    return _top(grouped, ["department"], TOP_HOTSPOTS)


def representative_cases(df: DataFrame, order_by: str, k: int = 5) -> DataFrame:
    """The first five records by row key, blanks for missing values."""
    fields = [f for f in CASE_FIELDS if f in df.columns]
    return df.orderBy(ref(order_by)).limit(k).select(
        *[F.coalesce(ref(f).cast("string"), F.lit("")).alias(f) for f in fields])


def insight_rows(df: DataFrame) -> DataFrame:
    """kind, title, value, count: summary, workload and theme rows derived from the other aggregates."""
    size = dataset_summary(df).select(F.lit("summary").alias("kind"), F.lit("records").alias("title"),
                                      F.lit("processed").alias("value"), F.col("row_count").alias("count"))
    shares = decision_distributions(df)
    severity = shares.where("field = 'severity'").select(F.lit("summary"), F.lit("severity"), "value", "count")
    workload = shares.where("field = 'action'").select(F.lit("insight"), F.lit("decision workload"), "value", "count")
    themes = top_listed(df, "topics", 5).select(F.lit("theme"), F.lit("recurring topic"), "value", "count")
    return reduce(DataFrame.union, [size, severity, workload, themes])


def insights(df: DataFrame, order_by: str) -> dict[str, DataFrame]:
    """All insight tables of a triaged feedback table, by name."""
    return {
        "dataset": dataset_summary(df), "dimensions": dimensions(df), "sentiment": sentiment_distribution(df),
        "decisions": decision_distributions(df), "categories": category_counts(df),
        "top_topics": top_listed(df, "topics"), "top_keywords": top_listed(df, "keywords"), "emotions": top_listed(df, "emotion"),
        "aspect_sentiments": aspect_summary(df), "cross_metrics": cross_metrics(df), "hotspots": hotspots(df),
        "representative_cases": representative_cases(df, order_by), "insights": insight_rows(df),
        "kpis": kpi_row(df), "severity_priority": severity_priority_matrix(df),
        "category_performance": category_performance(df), "leaders": category_leaders(df),
    }


# --- dashboard aggregates --------------------------------------------------------------------------

def _points() -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY_POINTS.items() for x in kv]), F.col("priority")), F.lit(0))


def _category(df: DataFrame) -> Column:
    names = [F.nullif(ref(c).cast("string"), F.lit("")) for c in ("category", "department") if c in df.columns]
    return F.coalesce(*names, F.lit("Unknown"))


def _measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"), F.round(F.avg(_points()), 2).alias("mean_priority"),
        F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("high_critical"),
        F.count_if(F.col("action").isin(*ACTIONS_NEEDED)).alias("actions_needed"),
    ]


def kpi_row(df: DataFrame) -> DataFrame:
    return df.agg(*_measures())


def severity_priority_matrix(df: DataFrame) -> DataFrame:
    """severity, P1..P4 with zero cells; the grid is fixed."""
    grid = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, place int")
    counted = df.where(F.col("severity").isin(*SEVERITIES)).groupBy("severity").agg(
        *[F.count_if(F.col("priority") == p).alias(p) for p in PRIORITIES])
    return grid.join(counted, "severity", "left").select("severity", *[F.coalesce(p, F.lit(0)).alias(p) for p in PRIORITIES])


def category_performance(df: DataFrame) -> DataFrame:
    return df.groupBy(_category(df).alias("category")).agg(*_measures())


def category_leaders(df: DataFrame) -> DataFrame:
    """measure, category: the leading category of each measure (larger volume, then name, on ties)."""
    table = category_performance(df)
    measures = ("count", "mean_priority", "high_critical", "actions_needed")
    first = lambda m: F.min_by("category", F.struct(-F.col(m), -F.col("count"), F.col("category")))
    row = table.agg(*[first(m).alias(m) for m in measures])
    return row.unpivot([], list(measures), "measure", "category")


def search_records(df: DataFrame, text: str = "", value: str | None = None) -> DataFrame:
    """Records with ``value`` in one of six fields and ``text`` anywhere (case-insensitive)."""
    out = df
    if value:
        fields = [F.coalesce(ref(f), F.lit("")) for f in ("sentiment", "severity", "priority", "action", "impact_level") if f in df.columns]
        out = out.where(F.array_contains(F.array(*fields, _category(df)), value))
    if text:
        shown = []
        for f in df.schema.fields:
            column = ref(f.name)
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.StructType, T.MapType)):
                column = F.to_json(column)
            elif isinstance(f.dataType, T.ArrayType):
                column = F.array_join(column, ", ")
            shown.append(F.lower(column.cast("string")))
        needle = F.lit(text.lower())
        out = out.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(s, needle), F.lit(False)) for s in shown]))
    return out
