"""What is known about a source: where its times live and how it is filtered and tracked."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields, is_dataclass, replace

# Comparison kinds of a static partition predicate.
PREDICATE_KINDS = ("eq", "neq", "gt", "gte", "lt", "lte", "event_dates")


@dataclass(frozen=True)
class EventTime:
    """The time an event happened."""

    expr: str
    grain: str | None = None
    use_range: bool | None = None


@dataclass(frozen=True)
class PartitionDate:
    """The column the source is partitioned by, which may lag behind the event time."""

    expr: str
    data_type: str | None = None
    grain: str | None = None
    use_event_dates: bool | None = None
    use_range: bool | None = None
    compile_dates: bool | None = None


@dataclass(frozen=True)
class PartitionPredicate:
    """A fixed condition on a partition column, or (``event_dates``) the run's dates on it."""

    expr: str
    kind: str = "eq"
    value: str | None = None
    data_type: str | None = None
    grain: str | None = None
    use_range: bool | None = None

    def __post_init__(self):
        if self.kind not in PREDICATE_KINDS:
            raise ValueError(f"unknown predicate kind {self.kind!r}, expected one of {PREDICATE_KINDS}")


@dataclass(frozen=True)
class Tracking:
    """How new and changed dates of the source are found."""

    active: bool | None = None
    kind: str | None = None  # "run_schedule": always the base date; otherwise by event counts
    backfill_start: dt.date | None = None
    lookback_days: int | None = None
    date_delay: int | None = None


@dataclass(frozen=True)
class SourceSpec:
    source_id: str | None = None
    event_time: EventTime | None = None
    partition_date: PartitionDate | None = None
    partitions: tuple[PartitionPredicate, ...] | None = None
    where: str | None = None
    row_count: bool | None = None
    tracking: Tracking | None = None

    def override(self, table: SourceSpec) -> SourceSpec:
        """These schema-wide settings with a table's own on top, field by field, at any depth."""
        return _merge(self, table)


def _merge(base, top):
    if top is None:
        return base
    if not (is_dataclass(base) and is_dataclass(top)):
        return top
    changed = {f.name: _merge(getattr(base, f.name), getattr(top, f.name)) for f in fields(top)}
    return replace(base, **changed)
