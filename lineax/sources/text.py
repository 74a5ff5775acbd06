"""Delimited text sources and sinks with explicit schemas (no inference)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _snake(name: str) -> str:
    s = re.sub(r"[^0-9A-Za-z]+", "_", name.strip())
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", s)
    return s.strip("_").lower()


def snake_case_columns(df: DataFrame) -> DataFrame:
    """``Virus.name`` → ``virus_name``, ``date.first`` → ``date_first``."""
    return df.withColumnsRenamed({c: _snake(c) for c in df.columns if _snake(c) != c})


def read_tsv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    null_value: str = "NA",
) -> DataFrame:
    """Tab-separated file with a header line; quotes are data (no quoting).

    With ``schema`` its columns are found by header name, whatever their order or
    other columns; without it every column is a string named from the header, in snake case.
    """
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", null_value)
    reader = reader.option("mode", "FAILFAST")
    return snake_case_columns(reader.csv(path)) if schema is None else _by_header(reader, path, schema)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    """Comma-separated file with a header and normal double-quote quoting."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    return snake_case_columns(reader.csv(path)) if schema is None else _by_header(reader, path, schema)


def _by_header(reader: DataFrameReader, path: str | list[str], schema: StructType | str) -> DataFrame:
    """The columns of ``schema`` by header name (as written or in snake case).

    All files of one read need the same header (``enforceSchema`` off: Spark
    compares each); columns that the schema does not name are never parsed.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = reader.csv(path).columns  # reads one line
    at = {_snake(c): c for c in header} | {c: c for c in header}
    missing = [f.name for f in wanted if f.name not in at]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the header of {path}")
    types = {at[f.name]: f.dataType for f in wanted}
    whole = StructType([StructField(c, types.get(c, StringType())) for c in header])
    rows = reader.option("enforceSchema", False).schema(whole).csv(path)
    return rows.select(*[F.col(f"`{at[f.name]}`").alias(f.name) for f in wanted])


def write_tsv(df: DataFrame, path: str, null_value: str = "NA", mode: str = "overwrite") -> None:
    """Header, no row index, no quoting; a folder of part files (one per task)."""
    (
        df.write.mode(mode)
        .option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("nullValue", null_value)
        .option("emptyValue", "")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no index, standard quoting."""
    df.write.mode(mode).option("header", True).csv(path)
