"""Result sinks: one directory per table, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_report(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """One JSON directory per result table."""
    for name, df in tables.items():
        df.write.mode(mode).json(f"{folder}/{name}")


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, nested columns as JSON; an empty table still writes its header."""
    flat_columns(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_feedback_outputs(clean: DataFrame, rejected: DataFrame, report: DataFrame, folder: str) -> None:
    write_csv(clean, f"{folder}/clean")
    write_csv(rejected, f"{folder}/rejected")
    report.write.mode("overwrite").json(f"{folder}/report")
