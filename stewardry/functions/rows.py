"""Helpers that keep a row expression from being evaluated more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside array lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def once(df: DataFrame, **values: Column) -> DataFrame:
    """The ``values`` of every row, each computed once.

    A filter behind a plain projection is moved down to the source, or into a join below, and
    computes its value and all that the value is made of there a second time. It stays behind
    this one.
    """
    return df.select(F.inline_outer(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))))


def unfold(df: DataFrame, array: str, keep: list[str], position: str = "position") -> DataFrame:
    """``keep``, the position and the ``item`` for every element of an array column.

    The outer form with a filter behind it: the inner form makes the optimizer test the
    array's size first, which computes a derived array twice.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, "item")).filter(
        F.col(position).isNotNull()
    )
