"""Pure Column builders. None of them starts a job, so all work on streams too.

Values may be given as Columns or as SQL text. Text is preferred for wide projections:
one parsed expression costs the driver far less than hundreds of Column calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value) -> str:
    """A double literal in SQL text."""
    return f"{float(value)!r}D"


def quote(value: str) -> str:
    """A string literal in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _col(c) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def cut(value: str, edges, labels, include_lowest: bool = False) -> Column:
    """Label of the right-closed bin ``(low, high]`` holding ``value``, else null.

    A ``None`` edge is unbounded. ``include_lowest`` also admits the lowest edge itself.
    """
    arms = []
    for position, (low, high, label) in enumerate(zip(edges, edges[1:], labels)):
        above = ">=" if include_lowest and position == 0 else ">"
        inside = f"({value}) {above} {number(low)}"
        if high is not None:
            inside += f" AND ({value}) <= {number(high)}"
        arms.append(f"WHEN {inside} THEN {quote(label)}")
    return F.expr(f"CASE {' '.join(arms)} END")


def clip(value, low, high) -> Column:
    """``value`` held within [low, high]; null stays null."""
    if isinstance(value, str):
        return F.expr(f"CASE WHEN ({value}) IS NOT NULL THEN "
                      f"greatest(least(({value}), {number(high)}), {number(low)}) END")
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def flag(condition) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    if isinstance(condition, str):
        return F.expr(f"CAST(coalesce({condition}, false) AS INT)")
    return F.coalesce(condition, F.lit(False)).cast("int")


def round_even(value, digits: int) -> Column:
    """Round to ``digits`` decimals, ties to even, by scaling the double."""
    scale = float(10 ** digits)
    if isinstance(value, str):
        return F.expr(f"rint(({value}) * {number(scale)}) / {number(scale)}")
    return F.rint(value * scale) / scale


def percent(part, whole) -> Column:
    """part / whole in percent; 0 when the whole is empty."""
    if isinstance(part, str) and isinstance(whole, str):
        return F.expr(f"CASE WHEN ({whole}) > 0 THEN ({part}) / ({whole}) * 100.0D ELSE 0.0D END")
    whole = _col(whole)
    return F.when(whole > 0, _col(part) / whole * 100.0).otherwise(0.0)


def exact_mean(value, decimals: int) -> Column:
    """Mean of values with a fixed number of decimals, summed as whole numbers.

    Adding doubles depends on the order of the rows; adding integers does not, so the
    result is the same whatever the partitioning.
    """
    scale = float(10 ** decimals)
    units = F.rint(_col(value) * scale).cast("bigint")
    return F.try_divide(F.sum(units).cast("double"), F.count(units)) / scale


def lookup(key: str, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a small fixed dictionary; a constant in the plan, not a join."""
    pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in table.items())
    other = "" if default is None else f", {quote(default)}"
    return F.expr(f"coalesce(try_element_at(map({pairs}), {key}){other})")


def strip(value) -> Column:
    """Remove every kind of white space at both ends, not spaces alone."""
    return F.regexp_replace(_col(value), r"(?U)^\s+|\s+$", "")


def is_missing(name: str, spark_type: str) -> Column:
    """Null, or not-a-number in a floating point column."""
    if spark_type in ("double", "float"):
        return F.expr(f"`{name}` IS NULL OR isnan(`{name}`)")
    return F.expr(f"`{name}` IS NULL")


def similarity(left, right) -> Column:
    """1 minus the edit distance over the longer length, ignoring case."""
    a, b = F.lower(_col(left)), F.lower(_col(right))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)
