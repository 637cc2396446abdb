"""Select lists: what a model puts out, by name, expression, aggregate or in bulk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.scalars import trunc_to
from lamella.names import DIM, FCT, NAMES, Names
from lamella.operators.aggregate import agg_name
from lamella.operators.roles import TIME, bulk_select, field_metadata, ident, role_of


@dataclass(frozen=True)
class Item:
    """One selected column; build it with ``dim``, ``fct`` or ``grain``."""

    name: str
    expr: Column | str | None = None
    role: str = DIM
    aggs: tuple[str, ...] = ()
    override_suffix: bool = False
    exclude_from_group_by: bool = False
    side: str | None = None
    interval: str | None = None


@dataclass(frozen=True)
class Bulk:
    """Many columns of one side; build it with ``all_from``, ``dims_from`` or ``facts_from``."""

    which: str
    side: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass
class Output:
    """A resolved column of the result."""

    name: str
    source: str
    column: Column
    role: str
    agg: str | None = None
    computed: bool = False
    exclude_from_group_by: bool = False
    metadata: dict = field(default_factory=dict)

    @property
    def wanted_metadata(self) -> dict:
        return {**self.metadata, "role": self.role}


def put(df: DataFrame, outputs: Sequence[Output], order: Sequence[str]) -> DataFrame:
    """Order the columns of a result and set the roles its columns do not carry by themselves."""
    named = {o.name: o for o in outputs}
    columns: list[Column | str] = []
    for name in order:
        wanted = named[name].wanted_metadata
        has = field_metadata(df, name)
        if {"role": DIM, **has} == wanted:
            columns.append(ident(name))
        else:
            columns.append(F.col(ident(name)).alias(name, metadata=wanted))
    return df.select(*columns)


def dim(name, expr=None, *, side=None, exclude_from_group_by=False) -> Item:
    return Item(name, expr, DIM, side=side, exclude_from_group_by=exclude_from_group_by)


def fct(name, expr=None, *, agg=None, aggs=(), override_suffix=False, side=None) -> Item:
    """A fact; ``agg`` or several ``aggs`` aggregate it, one output column for each."""
    chosen = tuple(aggs) or ((agg,) if agg else ())
    return Item(name, expr, FCT, chosen, override_suffix, side=side)


def grain(interval: str, name: str = NAMES.datetime, expr=None, *, side=None) -> Item:
    """The event time cut to hour, day, month or year."""
    return Item(name, expr, DIM, side=side, interval=interval)


def all_from(side=None, *, include=(), exclude=()) -> Bulk:
    return Bulk("all", side, tuple(include), tuple(exclude))


def dims_from(side=None, *, include=(), exclude=()) -> Bulk:
    return Bulk("dims", side, tuple(include), tuple(exclude))


def facts_from(side=None, *, include=(), exclude=()) -> Bulk:
    return Bulk("facts", side, tuple(include), tuple(exclude))


def as_column(expr: Column | str) -> Column:
    return F.expr(expr) if isinstance(expr, str) else expr


class Scope:
    """The tables a select list may read: one, or several joined under aliases."""

    def __init__(self, sides: Mapping[str, DataFrame], base: str, qualify: bool):
        self.sides, self.base, self.qualify = dict(sides), base, qualify

    @classmethod
    def single(cls, df: DataFrame) -> Scope:
        return cls({"": df}, "", False)

    def frame(self, side: str | None) -> DataFrame:
        side = self.base if side is None or not self.qualify else side
        if side not in self.sides:
            raise ValueError(f"unknown side {side!r}, expected one of {list(self.sides)}")
        return self.sides[side]

    def metadata(self, name: str, side: str | None = None) -> dict:
        """What is known of a column; another side's times are not those of the base's rows."""
        found = field_metadata(self.frame(side), name)
        other = self.qualify and side not in (None, self.base)
        return {k: v for k, v in found.items() if not (other and k == TIME)}

    def column(self, name: str, side: str | None = None) -> Column:
        if not self.qualify:
            return F.col(ident(name))
        return F.col(ident(self.base if side is None else side, name))


def selected_grain(select: Sequence | None, names: Names = NAMES) -> str | None:
    """The grain at which a select list puts out the event time, if it does."""
    for item in select or ():
        if isinstance(item, Item) and item.interval and item.name == names.datetime:
            return item.interval
    return None


def resolve(select: Sequence, scope: Scope) -> list[Output]:
    """Expand a select list; the first column of a given output name wins."""
    outputs: dict[str, Output] = {}

    def add(output: Output) -> None:
        outputs.setdefault(output.name, output)

    for item in select:
        if isinstance(item, Bulk):
            frame = scope.frame(item.side)
            for name in bulk_select(frame, item.which, item.include, item.exclude):
                add(inherited(name, scope, item.side))
            continue
        if isinstance(item, str):
            item = Item(item)
        frame = scope.frame(item.side)
        column = as_column(item.expr) if item.expr is not None else scope.column(item.name, item.side)
        metadata: dict = {}
        computed = item.expr is not None
        if item.interval:
            metadata["interval"] = item.interval
            parent = field_metadata(frame, item.name) if item.name in frame.columns else {}
            if computed or parent.get("interval") != item.interval:
                column = trunc_to(item.interval, column)
                computed = True
        elif not computed and item.name in frame.columns:
            metadata = scope.metadata(item.name, item.side)
        for agg in item.aggs or (None,):
            name = agg_name(item.name, agg, item.override_suffix) if agg else item.name
            add(
                Output(
                    name,
                    item.name,
                    column,
                    item.role,
                    agg,
                    computed,
                    item.exclude_from_group_by,
                    metadata,
                )
            )
    return list(outputs.values())


def inherited(name: str, scope: Scope, side: str | None = None) -> Output:
    """A column taken over as it is, with its role but never with an aggregation."""
    frame = scope.frame(side)
    return Output(
        name, name, scope.column(name, side), role_of(frame, name), metadata=scope.metadata(name, side)
    )
