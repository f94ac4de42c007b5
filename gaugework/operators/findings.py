"""The findings table: one row per observation, the same columns for every detector."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = (
    "id string, type string, status string, severity string, column string, title string, "
    "description string, evidence map<string,string>, confidence double, decision_question string, "
    "recommendation string"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def evidence(**values: Column) -> Column:
    """Evidence as text values; absent (null) entries are left out."""
    entries = F.map_from_arrays(
        F.array(*[F.lit(k) for k in values]),
        F.array(*[v.cast("string") for v in values.values()]),
    )
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def finding(
    rows: DataFrame, *, kind: str, status: Column | str, severity: Column | str, column: Column,
    title: Column, description: Column, evidence: Column, confidence: Column | float,
    recommendation: str, question: Column | None = None, order: list[Column] | None = None,
) -> DataFrame:
    """Shape detector rows as findings; ``_order`` fixes the numbering within a detector."""
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    return rows.select(
        F.lit(kind).alias("type"), lit(status).alias("status"), lit(severity).alias("severity"),
        column.cast("string").alias("column"), title.alias("title"), description.alias("description"),
        evidence.alias("evidence"), lit(confidence).cast("double").alias("confidence"),
        (question if question is not None else F.lit(None).cast("string")).alias("decision_question"),
        F.lit(recommendation).alias("recommendation"),
        F.array(*[o.cast("string") for o in (order or [F.lit("")])]).alias("_order"),
    )


def numbered(parts: list[DataFrame], prefix: str, start: int) -> DataFrame:
    """Union of finding rows with ids ``<prefix><start>...``; at most a few rows per audited column."""
    rows = reduce(DataFrame.unionByName, parts).withColumn("_family", F.lit(prefix))
    place = F.row_number().over(Window.partitionBy("_family").orderBy("_order"))
    return rows.withColumn("id", F.concat(F.lit(prefix), (place + F.lit(start - 1)).cast("string"))).select(*COLUMNS)


def padded(position: Column) -> Column:
    """Position as sortable text."""
    return F.lpad(position.cast("string"), 8, "0")


def empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], SCHEMA)


def search(
    findings: DataFrame, text: str = "", status: str | None = None, category: str | None = None
) -> DataFrame:
    """Findings whose title, description, column or id contains ``text``, by status and category."""
    needle = F.lower(F.lit(text))
    fields = ["title", "description", "column", "id"]
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in fields])
    out = findings.where(hit)
    if status:
        out = out.where(F.coalesce("status", F.lit("OBSERVED")) == status)
    if category:
        out = out.where(F.col("type") == category)
    return out


def counts_by_status_and_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("status", F.lit("OBSERVED")).alias("status"), "type").agg(
        F.count(F.lit(1)).alias("count")
    )
