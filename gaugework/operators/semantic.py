"""Semantic types, column roles and target detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.columns import families, present, ref
from gaugework.functions.numeric import share
from gaugework.operators.ordered import _stacked

# Recognition patterns in the order in which they are tried.
SEMANTIC_PATTERNS = {
    "email": r"^[\w\.-]+@[\w\.-]+\.\w{2,}$",
    "phone": r"^(\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "credit_card": r"^\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}$",
    "ip_address": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
    "url": r"^https?://[^\s]+",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "postal_code": r"^\d{5}(-\d{4})?$",
    "currency": r"^[$€£¥]\s?\d+([,\.]\d{2})?",
}
# Literals read as booleans, and the shares and sample sizes of the recognisers.
BOOLEAN_LITERALS = ("true", "false", "0", "1", "yes", "no", "t", "f")
PATTERN_SHARE, PARSE_SHARE = 0.70, 0.80
BOOLEAN_SAMPLE, PARSE_SAMPLE = 50, 20
CATEGORY_LIMIT, CATEGORY_RATIO = 50, 0.05
# Identifier names and target names in order of preference.
ID_NAME = (
    r"(?i)(^id$|_id$|^uuid$|^guid$|^key$|^index$|^pk$|customer_id|user_id|order_id|client_id|account_id)"
)
TARGET_NAMES = (
    "target", "label", "churn", "is_churn", "default", "is_default", "fraud", "is_fraud", "survived",
    "outcome", "class", "status", "y", "converted", "attrition", "risk", "click",
)
SECOND_TARGET_NAMES = ("price", "salary", "revenue", "sales")
# Date notations accepted besides ISO.
DATE_FORMATS = (
    "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy",
    "d MMM yyyy", "d MMMM yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss",
)


def parsed_datetime(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Timestamp of a text in ISO or one of the usual notations, else null."""
    iso = F.when(
        text.rlike(r"^\d{4}(-\d{1,2}(-\d{1,2})?)?([T ].*)?$"), F.try_to_timestamp(text)
    )
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
    other = [F.when(text.rlike(r"[/\-A-Za-z]"), F.try_to_timestamp(text, F.lit(f))) for f in formats]
    return F.coalesce(iso, compact, *other)


def semantic_types(
    df: DataFrame, order_by: str | None, sample: int | None = 100, distinct: DataFrame | None = None
) -> DataFrame:
    """column, semantic_type.

    Decides on the first ``sample`` values by ``order_by``; ``sample=None`` (or no key) judges every
    value with plain aggregates, which needs no ordering at all.
    """
    from gaugework.operators.profile import column_counts, distinct_counts
    from gaugework.operators.ordered import value_counts

    kinds = families(df)
    counts = column_counts(df)
    if distinct is None:
        distinct = distinct_counts(value_counts(df, df.columns))
    texts = {
        c: present(c, k).cast("string") for c, k in kinds.items() if k in ("string", "integer")
    }
    ordered = sample is not None and order_by is not None
    if texts:
        keep = [ref(order_by)] if ordered else []
        long = _stacked(df, texts, keep, "value")
        text = F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
        if ordered:
            by_key = Window.partitionBy("column").orderBy("_k0")
            # at most ``sample`` rows per column survive the pushed-down rank filter
            long = long.withColumn("_rank", F.row_number().over(by_key)).where(F.col("_rank") <= sample).withColumn("_text", text)
            filled = F.when(F.col("_text") != "", 1)
            nth = F.sum(filled).over(by_key.rowsBetween(Window.unboundedPreceding, 0))
            long = long.withColumn("_nth", F.when(F.col("_text") != "", nth))
            early, head = F.col("_nth") <= PARSE_SAMPLE, F.col("_rank") <= BOOLEAN_SAMPLE
        else:
            long = long.withColumn("_text", text)
            early, head = F.col("_text") != "", F.lit(True)
        shown = F.col("_text") != ""
        aggs = [
            F.min(F.when(head, F.lower("_text").isin(*BOOLEAN_LITERALS).cast("int"))).alias("_bool"),
            F.count(F.when(shown, 1)).alias("_shown"),
            F.avg(F.when(early, parsed_datetime(F.col("_text")).isNotNull().cast("int"))).alias("_date"),
            F.avg(F.when(early, F.expr("try_cast(_text AS double)").isNotNull().cast("int"))).alias("_number"),
        ]
        aggs += [
            F.avg(F.when(shown, F.col("_text").rlike("(?U)" + p).cast("int"))).alias(f"_p_{name}")
            for name, p in SEMANTIC_PATTERNS.items()
        ]
        judged = long.groupBy("column").agg(*aggs)
        # broadcast: one row per column
        base = counts.join(F.broadcast(judged), "column", "left")
    else:
        base = counts.withColumn("_bool", F.lit(None).cast("int")).withColumn("_shown", F.lit(0))
        for name in ["_date", "_number"] + [f"_p_{n}" for n in SEMANTIC_PATTERNS]:
            base = base.withColumn(name, F.lit(None).cast("double"))
    base = base.join(F.broadcast(distinct), "column", "left").withColumn(
        "unique_count", F.coalesce("unique_count", F.lit(0))
    )
    fam = F.col("family")
    kind = (
        F.when(F.col("n_rows") == F.col("missing_count"), "generic_text")
        .when(fam == "boolean", "boolean")
        .when(F.col("_bool") == 1, "boolean")
        .when(fam.isin("integer", "float"), "generic_numeric")
        .when(fam == "temporal", "datetime_string")
        .when(F.col("_shown") == 0, "generic_text")
    )
    for name in SEMANTIC_PATTERNS:
        kind = kind.when(F.col(f"_p_{name}") >= PATTERN_SHARE, name)
    kind = (
        kind.when(F.col("_date") >= PARSE_SHARE, "datetime_string")
        .when(F.col("_number") >= PARSE_SHARE, "numeric_string")
        .when(
            (F.col("unique_count") <= CATEGORY_LIMIT)
            | (F.col("unique_count") / F.col("n_rows") < CATEGORY_RATIO), "generic_categorical",
        )
        .otherwise("generic_text")
    )
    return base.select("column", "position", kind.alias("semantic_type"))


def column_roles(profile: DataFrame, target: str | None = None) -> DataFrame:
    """Add missing_pct, unique_ratio, is_constant, role and is_id.

    ``profile`` has column, family, dtype, n_rows, missing_count, unique_count and semantic_type.
    """
    name, ratio = F.col("column"), F.col("_ratio")
    named_id = name.rlike(ID_NAME)
    kind, fam = F.col("semantic_type"), F.col("family")
    id_like_type = fam.isin("string", "integer") & ~F.col("dtype").isin("tinyint", "smallint")
    is_target = F.lower(name) == F.lit((target or "").lower()) if target else F.lit(False)
    role = (
        F.when(is_target, "target")
        .when(F.col("unique_count") <= 1, "constant")
        .when(named_id & (ratio >= 0.80), "id_candidate")
        .when((ratio >= 0.98) & id_like_type & (named_id | (fam == "string")), "id_candidate")
        .when(kind.isin("uuid", "ssn", "credit_card"), "id_candidate")
        .when((kind == "datetime_string") | (fam == "temporal"), "datetime_feature")
        .when(kind.isin("generic_numeric", "numeric_string", "currency"), "numeric_feature")
        .when(kind.isin("generic_categorical", "boolean"), "categorical_feature")
        .when(
            kind.isin("email", "url", "ip_address", "generic_text")
            & ~((F.col("unique_count") < 50) | (ratio < 0.10)), "text_feature",
        )
        .otherwise("categorical_feature")
    )
    return (
        profile.withColumn("_ratio", F.when(F.col("n_rows") > 0, F.col("unique_count") / F.col("n_rows")).otherwise(0.0))
        .withColumn("missing_pct", share("missing_count", "n_rows"))
        .withColumn("unique_ratio", share("unique_count", "n_rows"))
        .withColumn("is_constant", F.col("unique_count") <= 1)
        .withColumn("role", role)
        .withColumn("is_id", F.col("role") == "id_candidate")
        .drop("_ratio")
    )


def find_target(columns: list[str], wanted: str | None = None, search: bool = False) -> str | None:
    """Resolve a target column by name (case-insensitive); ``search`` tries the usual names."""
    lowered: dict[str, str] = {}
    for c in columns:
        lowered.setdefault(c.lower(), c)
    names = ([wanted.lower()] if wanted else []) + (list(TARGET_NAMES + SECOND_TARGET_NAMES) if search else [])
    return next((lowered[n] for n in names if n in lowered), None)


def target_task(df: DataFrame, wanted: str | None = None, search: bool = False) -> DataFrame:
    """One row: target, target_type, distinct (empty strings and nulls included in neither)."""
    target = find_target(df.columns, wanted, search)
    if target is None:
        return df.sparkSession.createDataFrame(
            [(None, None, None)], "target string, target_type string, target_distinct bigint"
        )
    kind = families(df, [target])[target]
    # grouping first keeps the distinct count combinable on the map side
    distinct = df.select(present(target, kind).alias("y")).where("y IS NOT NULL").groupBy("y").count()
    n = F.col("target_distinct")
    otherwise = "regression" if kind in ("integer", "float", "boolean") else "multiclass_classification"
    return distinct.agg(F.count(F.lit(1)).alias("target_distinct")).select(
        F.lit(target).alias("target"),
        F.when(n == 2, "binary_classification").when(n.between(3, 20), "multiclass_classification")
        .otherwise(otherwise).alias("target_type"),
        "target_distinct",
    )
