"""Column roles: every column is a dimension or a fact, kept in column metadata."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.names import DIM, FCT, NAMES


def ident(*parts: str) -> str:
    """Quote a possibly qualified name."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def field_metadata(df: DataFrame, name: str) -> dict:
    return dict(df.schema[name].metadata or {})


def role_of(df: DataFrame, name: str) -> str:
    """Role of a column; a column without one is a dimension."""
    return field_metadata(df, name).get("role", DIM)


#: Metadata of time columns that are cut from one event time: its source and expression.
TIME = "cut from"


def tied(df: DataFrame, first: str, second: str) -> bool:
    """Whether two columns are known to be cut from the same event time of the same row."""
    if first not in df.columns or second not in df.columns:
        return False
    own = field_metadata(df, first).get(TIME)
    return own is not None and own == field_metadata(df, second).get(TIME)


def united(branches: Sequence[DataFrame], result: DataFrame, names: Sequence[str]) -> DataFrame:
    """The union of ``branches``, whose columns say what the first says: times are tied where they are in all."""
    known = [c for c in names if c in result.columns and TIME in field_metadata(result, c)]
    if all(tied(b, known[0], c) for b in branches for c in known):
        return result
    plain = {c: {k: v for k, v in field_metadata(result, c).items() if k != TIME} for c in known}
    return result.select(
        *[F.col(ident(c)).alias(c, metadata=plain[c]) if c in plain else F.col(ident(c)) for c in result.columns]
    )


def with_roles(df: DataFrame, facts: Iterable[str] = (), dims: Iterable[str] = ()) -> DataFrame:
    """Mark the given columns; all others keep the role they have."""
    roles = {**{c: DIM for c in dims}, **{c: FCT for c in facts}}
    unknown = [c for c in roles if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    return df.select(
        *[
            F.col(ident(c)).alias(c, metadata={**field_metadata(df, c), "role": roles[c]})
            if c in roles
            else F.col(ident(c))
            for c in df.columns
        ]
    )


def tag(column: Column, name: str, role: str, **extra) -> Column:
    """Name a computed column and set its role."""
    return column.alias(name, metadata={"role": role, **extra})


def dims(df: DataFrame) -> list[str]:
    return [c for c in df.columns if role_of(df, c) != FCT]


def facts(df: DataFrame) -> list[str]:
    return [c for c in df.columns if role_of(df, c) == FCT]


def bulk_select(
    df: DataFrame,
    which: str = "all",
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> list[str]:
    """Names of all columns, only dimensions or only facts, narrowed by include / exclude."""
    try:
        pool = {"all": lambda d: list(d.columns), "dims": dims, "facts": facts}[which](df)
    except KeyError:
        raise ValueError(f"which must be all, dims or facts, not {which!r}") from None
    return [c for c in pool if (not include or c in include) and c not in exclude]


def canonical_order(columns: Iterable[str], partitions: Sequence[str] = NAMES.partitions) -> list[str]:
    """Alphabetical, partition columns last in their own order."""
    columns = list(columns)
    tail = [p for p in partitions if p in columns]
    return sorted(c for c in columns if c not in tail) + tail
