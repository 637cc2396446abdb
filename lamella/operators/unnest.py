"""Unnest joins: one row per element of an array or map column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.dates import column_type


def unnest(
    df: DataFrame, column: str, fields: Sequence[str], json_schema: str | T.DataType | None = None
) -> DataFrame:
    """Cross join each row with the elements of ``column``; rows without elements are dropped.

    One field takes the whole element; several fields take the members of an array of structs,
    or key and value of a map. ``json_schema`` parses JSON text first. No shuffle is needed.
    """
    value = F.expr(column)
    if json_schema is not None:
        value = F.from_json(value, json_schema)
        kind: T.DataType = df.select(value).schema[0].dataType
    else:
        kind = column_type(df, column)
    fields = list(fields)
    clash = [f for f in fields if f in df.columns]
    if clash:
        raise ValueError(f"unnested fields hide columns of the model: {clash}")
    if isinstance(kind, T.MapType):
        if len(fields) != 2:
            raise ValueError("unnesting a map gives two fields, key and value")
        return df.select("*", F.explode(value).alias(*fields))
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"{column} is a {kind.simpleString()}, not an array or map")
    if len(fields) == 1:
        return df.select("*", F.explode(value).alias(fields[0]))
    if not isinstance(kind.elementType, T.StructType) or len(kind.elementType) != len(fields):
        raise ValueError(f"{column} does not hold structs of {len(fields)} members")
    return df.select("*", F.inline(value).alias(*fields))
