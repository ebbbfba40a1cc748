"""Rows packed into one column while an operator works, so that its own names can't meet theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def packed(docs: DataFrame, **needed: Column) -> DataFrame:
    """``_row``: all columns; besides, what the operator reads."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in needed.items()])


def unpacked(out: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of ``docs`` and the operator's ``own``, which replace columns of the same name."""
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in own], *own)


def settled(condition: Column) -> Column:
    """The condition as a column that a filter can't be pushed through: what it is computed from is evaluated once, not once
    in the filter for every place where it occurs."""
    return F.when(F.monotonically_increasing_id() >= 0, condition)


def rest(docs: DataFrame, text: str, *own: str) -> list[str]:
    """Columns that go along with an operator that takes the text and adds its own columns."""
    return [c for c in docs.columns if c != text and c not in own]
