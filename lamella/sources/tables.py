"""Reading and describing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.predicates import filter_where
from lamella.operators.select import as_column


def read_table(spark: SparkSession, location: str, format: str | None = None, **options) -> DataFrame:
    """A table by catalog name, or files by path (``format`` defaults to parquet for paths)."""
    if format is None and "/" not in location:
        return spark.table(location)
    return spark.read.format(format or "parquet").options(**options).load(location)


def read_seed(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file with a header row; every column is text and a dimension unless typed by ``schema``."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def describe_table(df: DataFrame) -> DataFrame:
    """Name, type, nullability and comment of every column."""
    rows = [
        (f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("comment")) for f in df.schema
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, data_type string, nullable boolean, comment string"
    )


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows of a model; a smaller limit already on it stays in force."""
    return df.limit(rows)


def refresh_from_parent(
    parent: DataFrame, select: Sequence[tuple[str, str | None, str | None]], where: str | None = None
) -> DataFrame:
    """Rows a source takes from its parent table: (name, expression, type) per column."""
    columns = []
    for name, expr, data_type in select:
        column = F.col(name) if expr is None else as_column(expr)
        columns.append((column.cast(data_type) if data_type else column).alias(name))
    return filter_where(parent, where).select(*columns)
