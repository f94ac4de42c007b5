"""What several corpus operators share: stored stages, names that clash with nothing, and word patterns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.columns import ref
from gaugework.operators.lineage import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Store a stage as Parquet in the cluster's shared folder and read it from there.

    A lost executor then re-reads files instead of repeating the stages before, and the planner knows the
    size of the stage. The files stay until the owner of the shared folder removes them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish`` or, where a column of ``df`` has it (in any case), the next numbered form of it."""
    taken = {c.lower() for c in df.columns}
    name, n = wish, 1
    while name.lower() in taken:
        name, n = f"{wish}{n}", n + 1
    return name


def text_mark(text: str) -> Column:
    """64-bit mark of a text. With the key it tells rows apart that share a key; equal rows are one document."""
    return F.xxhash64(F.coalesce(ref(text).cast("string"), F.lit("\x00")))


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only what the operators read: ``k`` (the key), ``m`` (the mark of the text) and ``text`` (null: empty)."""
    return df.select(
        ref(key).alias("k"), text_mark(text).alias("m"), F.coalesce(ref(text).cast("string"), F.lit("")).alias("text"),
    )


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on ``k`` and ``m``; null keys meet null keys."""
    return left["k"].eqNullSafe(right["k"]) & (left["m"] == right["m"])


def attached(df: DataFrame, key: str, text: str, facts: DataFrame, how: str = "left") -> DataFrame:
    """``df`` with one struct column of facts per document.

    ``facts`` has ``k``, ``m`` and one struct column ``f``, at most one row for each (k, m). The struct gets a name
    that no column of ``df`` has, so extra columns never clash; ``fact_column`` tells it.
    """
    name = fact_column(df)
    mark = free_name(df, "_gw_mark")
    right = facts.select(F.col("k").alias("_gw_right_k"), F.col("m").alias("_gw_right_m"), F.col("f").alias(name))
    left = df.withColumn(mark, text_mark(text))
    on = left[f"`{key}`"].eqNullSafe(right["_gw_right_k"]) & (left[mark] == right["_gw_right_m"])
    joined = left.join(right, on, how)
    return joined.drop("_gw_right_k", "_gw_right_m", mark)


def fact_column(df: DataFrame) -> str:
    return free_name(df, "_gw_fact")


def column_lists(batch: pa.RecordBatch) -> dict[str, list]:
    return {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}


def in_pieces(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows, so that what a task has made never piles up."""
    piece: list[tuple] = []
    for row in rows:
        piece.append(row)
        if len(piece) >= size:
            yield _batch(piece, schema)
            piece = []
    if piece:
        yield _batch(piece, schema)


def _batch(piece: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(column), field.type) for column, field in zip(zip(*piece), schema)], schema=schema
    )
