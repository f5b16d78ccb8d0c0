"""Turning one wide aggregate row into a readable table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_from(aggregate: DataFrame, rows: list[dict]) -> DataFrame:
    """One output row per dict, computed from the columns of a one-row aggregate.

    Cells are SQL text, all or none; otherwise Columns.
    """
    if all(isinstance(cell, str) for row in rows for cell in row.values()):
        structs = ", ".join(
            "named_struct(" + ", ".join(f"'{name}', {cell}" for name, cell in row.items()) + ")"
            for row in rows)
        return aggregate.select(F.expr(f"inline(array({structs}))"))

    def cell(value) -> Column:
        return F.expr(value) if isinstance(value, str) else value

    return aggregate.select(F.inline(F.array(*[
        F.struct(*[cell(value).alias(name) for name, value in row.items()]) for row in rows])))
