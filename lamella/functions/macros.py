"""Named, reusable expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession


def register_macro(
    spark: SparkSession, name: str, arguments: Mapping[str, str], expr: str, returns: str
) -> None:
    """Make SQL text callable by name in later expressions, for this session.

    The body is inlined by Spark's optimizer; it may itself call aggregates only when written as
    a Python function that returns a Column, which needs no registration.
    """
    parameters = ", ".join(f"{arg} {kind}" for arg, kind in arguments.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {expr}")
