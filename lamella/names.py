"""Fixed vocabulary: roles, grains and the names of the columns every model may carry."""

from __future__ import annotations

from dataclasses import dataclass

DIM = "dim"
FCT = "fct"

# The time grains, finest first.
GRAINS = ("hour", "day", "month", "year")

# The aggregations a fact may carry as its name suffix.
AGGS = ("count", "hll", "max", "min", "sum", "tdigest")


@dataclass(frozen=True)
class Names:
    """Column names shared by all models; replace them to match existing tables."""

    datetime: str = "datetime"
    monthly: str = "partition_monthly"
    daily: str = "partition_daily"
    hourly: str = "partition_hourly"
    row_count: str = "source_row_count"
    event_date: str = "event_date"

    @property
    def partitions(self) -> tuple[str, str, str]:
        """Default partition columns in canonical order."""
        return (self.monthly, self.daily, self.hourly)

    def finer_than(self, grain: str | None) -> tuple[str, ...]:
        """Partition columns that stop being meaningful once time is cut to ``grain``."""
        if grain is None:
            return ()
        if grain not in GRAINS:
            raise ValueError(f"unknown grain {grain!r}, expected one of {GRAINS}")
        by_grain = dict(zip(("hour", "day", "month"), reversed(self.partitions)))
        coarse_enough = GRAINS[GRAINS.index(grain) :]
        return tuple(column for g, column in by_grain.items() if g not in coarse_enough)


NAMES = Names()


def partition_columns(model=None, parent=None, names: Names = NAMES) -> tuple[str, ...]:
    """Partition columns of a model: its own list, else its parent's, else the defaults."""
    return tuple(model or parent or names.partitions)
