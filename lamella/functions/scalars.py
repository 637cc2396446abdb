"""Scalar functions whose meaning in model expressions differs from Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date format tokens and what they are called in Spark.
DATE_TOKENS = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%c": "M",
    "%M": "MMMM",
    "%b": "MMM",
    "%d": "dd",
    "%e": "d",
    "%H": "HH",
    "%k": "H",
    "%h": "hh",
    "%i": "mm",
    "%s": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%W": "EEEE",
    "%a": "EEE",
    "%j": "DDD",
}


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def split_text(column, delimiter: str) -> Column:
    """Split at a literal delimiter (Spark's own ``split`` takes a pattern)."""
    literal = "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in delimiter)
    return F.split(_col(column), literal)


def element(array, position) -> Column:
    """Array element counted from 1; null when out of range."""
    index = position if isinstance(position, Column) else F.lit(position)
    return F.try_element_at(_col(array), index)


def cardinality(array) -> Column:
    """Number of elements; null for a null array."""
    return F.when(_col(array).isNotNull(), F.size(_col(array)))


def greatest(*columns) -> Column:
    """Largest argument, null when any argument is null."""
    return _strict(F.greatest, columns)


def least(*columns) -> Column:
    """Smallest argument, null when any argument is null."""
    return _strict(F.least, columns)


def _strict(function, columns) -> Column:
    columns = [_col(c) for c in columns]
    none_null = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return F.when(none_null, function(*columns))


def to_integer(column, data_type: str = "integer") -> Column:
    """Cast to a whole number, rounding half away from zero instead of cutting off."""
    return F.round(_col(column), 0).cast(data_type)


def int_div(a, b) -> Column:
    """Whole-number division cutting towards zero."""
    return F.call_function("div", _col(a), _col(b))


def trunc_to(unit: str, column) -> Column:
    """Cut a zone-less timestamp to a unit; the result is a zone-less timestamp.

    Built from date arithmetic, so it never passes through the session's time zone.
    """
    column = _col(column).cast("timestamp_ntz")
    day = column.cast("date")
    if unit == "hour":
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(column))
    if unit == "day":
        return day.cast("timestamp_ntz")
    return F.trunc(day, unit).cast("timestamp_ntz")


def trunc_date(unit: str, column) -> Column:
    """Cut a date or timestamp to a unit of a day or more; the result is a date."""
    day = _col(column).cast("date")
    return day if unit == "day" else F.trunc(day, unit)


def date_plus(unit: str, amount, column) -> Column:
    """Add whole units to a date (day, week, month, year)."""
    amount = amount if isinstance(amount, Column) else F.lit(amount)
    if unit == "day":
        return F.date_add(_col(column), amount)
    if unit == "week":
        return F.date_add(_col(column), amount * 7)
    if unit == "month":
        return F.add_months(_col(column), amount)
    if unit == "year":
        return F.add_months(_col(column), amount * 12)
    raise ValueError(f"unknown unit {unit!r}")


def date_diff(unit: str, start, end) -> Column:
    """Whole units from ``start`` to ``end``."""
    return F.timestamp_diff(unit.upper(), _col(start), _col(end))


def day_of_week(column) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(_col(column)) + 1


def format_date(column, pattern: str) -> Column:
    """Format with ``%Y-%m-%d`` style tokens."""
    translated, rest = [], pattern
    while rest:
        token = rest[:2]
        if token in DATE_TOKENS:
            translated.append(DATE_TOKENS[token])
            rest = rest[2:]
        elif rest[0] == "%":
            raise ValueError(f"unknown date token {token!r}")
        else:
            translated.append("'" + rest[0] + "'" if rest[0].isalpha() else rest[0])
            rest = rest[1:]
    return F.date_format(_col(column), "".join(translated))


def json_scalar(column, path: str) -> Column:
    """Scalar at a JSON path as text."""
    return F.get_json_object(_col(column), path)


def json_size(column, path: str) -> Column:
    """Number of elements of the JSON array at a path."""
    return F.json_array_length(F.get_json_object(_col(column), path))


def distinct_values(column) -> Column:
    """Aggregate: the distinct values of a group as a sorted array (for keys of a known, small range)."""
    return F.sort_array(F.collect_set(_col(column)))


def join_sorted(column, separator: str = ", ") -> Column:
    """Aggregate: the values of a group in order, as one text (for small groups)."""
    return F.array_join(F.sort_array(F.collect_list(_col(column))), separator)
