"""Table and feedback sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugework.sources import quoted_csv

# Separators besides the comma in the order in which they are tried, and the look-ahead.
SEPARATORS = ("\t", ";", "|")
SNIFF_CHARS = 4096
_BAD = "_corrupt_record"


class UnsupportedFormat(ValueError):
    """No distributed source exists for this file type."""


def clean_names(names: list[str]) -> list[str]:
    """Trimmed names; repeated ones get a running suffix."""
    out, seen = [], {}
    for name in (n.strip() for n in names):
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(name if count == 0 else f"{name}_{count}")
    return out


def _first_file(spark: SparkSession, path: str) -> str:
    files = sorted(spark.read.text(path).inputFiles())
    return files[0] if files else path


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Separator that outnumbers the comma in the first ``SNIFF_CHARS`` characters of the (first) file."""
    # every line has one character at least, its end, so this many lines always reach far enough
    lines = spark.read.text(_first_file(spark, path)).limit(SNIFF_CHARS).select(F.substring("value", 1, SNIFF_CHARS)).collect()
    head = "\n".join(r[0] for r in lines)[:SNIFF_CHARS]
    return next((s for s in SEPARATORS if head.count(s) > head.count(",")), ",")


def read_csv(spark: SparkSession, path: str, separator: str | None = None, schema=None) -> DataFrame:
    """Delimited text with a header: short lines are filled with nulls, lines with too many fields and blank ones are skipped.

    Quoted fields may hold separators, doubled quotes and line breaks, and files are split all the same. A ``schema``
    gives the names and types of the columns in their order; without one types are inferred in one more pass over all rows.
    """
    sep = separator or sniff_separator(spark, path)
    names = quoted_csv.header(spark, _first_file(spark, path), sep)
    if not names:
        raise UnsupportedFormat(f"{path} has no header line")
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    # rows are judged by the header's width, or the schema's where it is wider
    width = max(len(names), len(schema.fields) if schema else 0)
    rows = quoted_csv.read_quoted(spark, path, sep, [f"c{i}" for i in range(width)], blank_lines=False)
    if schema is None:
        kinds = quoted_csv.inferred(rows)
        schema = T.StructType([
            T.StructField(f"c{i}", T.StructType.fromDDL(f"x {kind}").fields[0].dataType) for i, kind in enumerate(kinds)])
        return quoted_csv.typed(rows, schema).toDF(*names)
    return quoted_csv.typed(rows, schema)


def _json_document(spark: SparkSession, path: str) -> bool:
    """True if the (first) file is one document, judged by its first line with text; a bad record never decides."""
    first = spark.read.text(_first_file(spark, path)).where(F.trim("value") != "").select(F.trim("value")).head()
    line = first[0].lstrip("\ufeff") if first else ""
    return line.startswith("[") or (line.startswith("{") and not line.rstrip().endswith("}"))


def read_json(spark: SparkSession, path: str, lines: bool, schema=None) -> DataFrame:
    """A JSON document (an array of records or one record) or one record per line; bad lines are left out.

    ``bad_json_lines`` lists what was left out.
    """
    reader = spark.read.option("columnNameOfCorruptRecord", _BAD)
    if not lines:
        return (reader.schema(schema) if schema else reader).option("multiLine", True).json(path)
    if schema is None:
        # inferring adds the column of bad records only where there are any
        schema = T.StructType([f for f in reader.json(path).schema.fields if f.name != _BAD])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = reader.schema(T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])).json(path)
    return rows.where(F.col(_BAD).isNull()).drop(_BAD)


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the lines with text of a JSON lines source that hold no record."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    parsed = F.from_json("line", f"`{_BAD}` string, ok int", {"columnNameOfCorruptRecord": _BAD})
    return lines.where((F.trim("line") != "") & parsed[_BAD].isNotNull())


def read_table(
    spark: SparkSession, path: str, format: str | None = None, schema=None, max_rows: int | None = None
) -> DataFrame:
    """Parquet, JSON document, JSON lines or delimited text, by extension or ``format``; names cleaned."""
    lower = path.lower().rstrip("/")
    kind = format or next(
        (k for k, ends in {
            "parquet": (".parquet", ".pq"), "jsonl": (".jsonl",), "json": (".json",), "excel": (".xlsx", ".xls", ".xlsm"),
        }.items() if lower.endswith(ends)), "csv")
    if kind == "excel":
        raise UnsupportedFormat("spreadsheets have no distributed source; export them as CSV or parquet")
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind in ("json", "jsonl"):
        df = read_json(spark, path, kind == "jsonl" or not _json_document(spark, path), schema)
    else:
        df = read_csv(spark, path, schema=schema)
    df = df.toDF(*clean_names(df.columns))
    return df.limit(max_rows) if max_rows else df


def read_feedback_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feedback CSV as text columns: each file UTF-8 with or without byte order mark, else cp1252.

    Empty fields are empty strings, a blank line is a row of empty fields, short lines are filled up, and lines with
    too many fields are skipped. Records may span lines; files may be of any size and are split.
    """
    names = quoted_csv.header(spark, _first_file(spark, path), ",", "cp1252")
    if not names:
        raise UnsupportedFormat(f"{path} has no header line")
    numbered = [f"c{i}" for i in range(len(names))]
    rows = quoted_csv.read_quoted(spark, path, ",", numbered, blank_lines=True, legacy="cp1252")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in numbered]).toDF(*names)
