"""Schema-level helpers: column families and the expressions that put columns into long form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)

# Values longer than this are keyed by their head and a digest of the whole value.
KEY_HEAD = 100


class UnsupportedColumn(ValueError):
    """A nested column was given to a tabular operator."""


def ref(name: str) -> Column:
    """Column by exact name; back-ticks make dots, spaces and symbols safe."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    The one-element generator keeps the optimizer from copying a large expression into each of its
    consumers; it neither shuffles nor buffers, so it also works on streams.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def text_literal(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def family(field: T.StructField) -> str:
    """integer, float, boolean, temporal or string."""
    kind = field.dataType
    if isinstance(kind, _NESTED):
        raise UnsupportedColumn(f"column {field.name!r} has nested type {kind.simpleString()}")
    if isinstance(kind, _INTEGERS):
        return "integer"
    if isinstance(kind, _FLOATS):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, _TEMPORAL):
        return "temporal"
    return "string"


def families(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str]:
    wanted = set(columns) if columns is not None else None
    return {
        f.name: family(f) for f in df.schema.fields if wanted is None or f.name in wanted
    }


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        c for c, f in families(df, [x for x in df.columns if x not in skip]).items()
        if f in ("integer", "float")
    ]


def present(name: str, kind: str) -> Column:
    """The column with NaN turned into null (missing is null or NaN)."""
    if kind == "float":
        as_double = ref(name).cast("double")
        return F.when(~F.isnan(as_double), as_double)
    return ref(name)


def text_key(name: str, kind: str) -> Column:
    """Grouping key of a value as text; for an order by whole texts see ``whole_text``.

    Short values are their own key. Long values keep their first characters for display and add a
    SHA-256 of the whole value, so that shuffles carry short keys and still tell whole texts apart.
    """
    text = present(name, kind).cast("string")
    if kind != "string":
        return text
    return F.when(F.length(text) <= KEY_HEAD, text).otherwise(
        F.concat(F.substring(text, 1, KEY_HEAD), F.sha2(text, 256))
    )


def whole_text(name: str, kind: str) -> Column:
    """A value as text in full: what orders and ranks compare."""
    return present(name, kind).cast("string")
