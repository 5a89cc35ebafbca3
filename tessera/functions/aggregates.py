"""Aggregates of groups: built-in ones, and folds given as (start, step, finish)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.expressions import column


@dataclass(frozen=True)
class Aggregate:
    """A built-in aggregate of an expression: partial sums form before the shuffle."""

    name: str
    of: str | Column | None = None

    def column(self) -> Column:
        if self.name == "count":
            return F.count(F.lit(1) if self.of is None else column(self.of))
        return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[self.name](column(self.of))


@dataclass(frozen=True)
class Fold:
    """A fold without a merge: values of a group are gathered and reduced in the order of their values.

    A fold can't be split, so a group's values meet in one task; where the step is one of the known shapes, use an
    Aggregate, which has partial results.
    """

    of: str | Column
    start: Any
    step: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] | None = None

    def column(self) -> Column:
        values = F.array_sort(F.collect_list(column(self.of)))
        return F.reduce(values, self.start if isinstance(self.start, Column) else F.lit(self.start), self.step, *([self.finish] if self.finish else []))


def count() -> Aggregate:
    return Aggregate("count")


def total(of) -> Aggregate:
    return Aggregate("sum", of)


def least(of) -> Aggregate:
    return Aggregate("min", of)


def greatest(of) -> Aggregate:
    return Aggregate("max", of)


def mean(of) -> Aggregate:
    return Aggregate("avg", of)
