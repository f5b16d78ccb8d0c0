"""Exact order statistics and quantiles without sorting the table.

``percentile`` keeps every distinct value of a group in one buffer and a global window
moves every row to one task. Here a mergeable sketch first brackets each wanted position;
a second aggregate then counts the rows below the bracket and tallies only the values
inside it. Both passes combine on the map side, so what is shuffled depends on the number
of wanted positions and not on the number of rows. A bracket that is still crowded is
narrowed again, and one that turns out to miss its position is sought in a wider one: the
answer is exact in every case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnloom.plans.stages import small

# Up to this many rows per key or bracket are tallied without narrowing. It is small, so
# that tables of all sizes but tiny ones take the same way.
EXACT_ROWS = 256
GRID = 2_000
# Cells of the grid that a bracket reaches to both sides; the last one leaves it open.
MARGINS = (2, 50, 2 * GRID)
ACCURACY = 10_000


def unpivot_numeric(df: DataFrame, columns, keep=()) -> DataFrame:
    """Rows (keep..., series, value) for every non-null numeric cell."""
    doubles = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    cells = doubles.unpivot(list(keep), list(columns), "series", "value")
    return cells.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _sketch(value: Column, size: Column, exact_rows: int) -> Column:
    # One constant text instead of thousands of literals keeps the plan small.
    grid = F.split(F.lit(",".join(str(i / GRID) for i in range(GRID + 1))), ",")
    return F.when(
        size > exact_rows, F.percentile_approx(value, grid.cast("array<double>"), ACCURACY))


def _bracket(grid: Column, position: Column, size: Column, margin: int = MARGINS[0]):
    cell = F.floor(position / size * GRID).cast("int")
    return F.get(grid, cell - margin), F.get(grid, cell + margin + 1)


def order_statistics(long: DataFrame, keys, value: str, picks, exact_rows: int = EXACT_ROWS,
                     rows: int | None = None) -> DataFrame:
    """Values at 0-based positions of the ascending order within each key.

    ``picks`` is a function from the row count column to an array of positions, or a
    DataFrame (keys..., slot, pos). ``rows`` is an upper bound on the rows of one key if
    the caller knows one: a table known to be short is tallied in one pass. Returns keys,
    n, slot, pos, value, ``before`` (rows with a smaller value) and ``ties`` (rows with
    this value).
    """
    keys = list(keys)
    if rows is not None and rows <= exact_rows:
        return _tally_short(long, keys, value, picks)
    if not isinstance(long.schema[value].dataType, T.NumericType):
        return small(_tally_all(long, keys, value, _targets(long, keys, value, picks, None)), "order-found")
    for margin in MARGINS:
        wanted = _targets(long, keys, value, picks, exact_rows, margin)
        wanted = _narrow_further(long, keys, F.col(value), wanted, exact_rows)
        found = small(_tally_brackets(long, keys, value, wanted), "order-found")
        if margin == MARGINS[-1] or found.count() == wanted.count():
            break
    return found


def _targets(long, keys, value, picks, exact_rows: int | None, margin: int = MARGINS[0]):
    """Wanted positions with their brackets. The grid of a key is used where it is made and not passed on."""
    v, size = F.col(value), F.count(value)
    nothing = F.lit(None).cast(T.ArrayType(long.schema[value].dataType))
    grid = nothing if exact_rows is None else _sketch(v, size, exact_rows)
    sizes = long.groupBy(*keys).agg(size.alias("n"), grid.alias("grid"))
    if isinstance(picks, DataFrame):
        wanted = sizes.join(picks.select(*keys, "slot", "pos"), keys)
    else:
        wanted = sizes.select(*keys, "n", "grid", F.posexplode(picks(F.col("n"))).alias("slot", "pos"))
    lo, hi = _bracket(F.col("grid"), F.col("pos"), F.col("n"), margin)
    return small(
        wanted.where((F.col("pos") >= 0) & (F.col("pos") < F.col("n")))
        .select(*keys, "n", "slot", "pos", lo.alias("lo"), hi.alias("hi")), "order-targets")


def _within(long: DataFrame, keys, v: Column, wanted: DataFrame):
    rows = long.join(wanted, keys).where(F.col("hi").isNull() | (v <= F.col("hi")))
    return rows, F.col("lo").isNull() | (v >= F.col("lo"))


def _narrow_further(long, keys, v, wanted, exact_rows):
    """Repeat sketching inside brackets expected to hold more than ``exact_rows`` rows."""
    share = 6 / GRID
    # Keys without a bracket hold few rows.
    expected = (wanted.where("lo IS NOT NULL OR hi IS NOT NULL").agg(F.max("n")).first()[0] or 0) * share
    while expected > exact_rows:
        rows, inside = _within(long, keys, v, wanted)
        held = F.count_if(inside)
        counted = rows.groupBy(*keys, "n", "slot", "pos", "lo", "hi").agg(
            F.count_if(~inside).alias("below"), held.alias("held"),
            _sketch(F.when(inside, v), held, exact_rows).alias("grid"))
        lo, hi = _bracket(F.col("grid"), F.col("pos") - F.col("below"), F.col("held"))
        wanted = small(
            counted.select(
                *keys, "n", "slot", "pos",
                F.coalesce(lo, "lo").alias("lo"), F.coalesce(hi, "hi").alias("hi")),
            "order-targets")
        expected *= share
    return wanted


def _tally_brackets(long, keys, value, wanted):
    rows, inside = _within(long, keys, F.col(value), wanted)
    tally = rows.groupBy(*keys, "n", "slot", "pos", F.when(inside, F.col(value)).alias(value)).agg(
        F.count("*").alias("ties"))
    upto = F.sum("ties").over(
        W.partitionBy(*keys, "slot").orderBy(F.col(value).asc_nulls_first()))
    return (
        tally.withColumn("before", upto - F.col("ties"))
        .where(F.col(value).isNotNull() & (F.col("before") <= F.col("pos"))
               & (F.col("pos") < F.col("before") + F.col("ties")))
        .select(*keys, "n", "slot", "pos", value, "before", "ties"))


def _tally_all(long, keys, value, wanted):
    tally = long.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    upto = F.sum("ties").over(W.partitionBy(*keys).orderBy(value))
    return (
        tally.withColumn("before", upto - F.col("ties"))
        .join(wanted.select(*keys, "n", "slot", "pos"), keys)
        .where((F.col("before") <= F.col("pos")) & (F.col("pos") < F.col("before") + F.col("ties")))
        .select(*keys, "n", "slot", "pos", value, "before", "ties"))


def _tally_short(long, keys, value, picks):
    tally = long.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    key = W.partitionBy(*keys)
    placed = tally.select(
        *keys, value, "ties", F.sum("ties").over(key).alias("n"),
        (F.sum("ties").over(key.orderBy(value)) - F.col("ties")).alias("before"))
    if isinstance(picks, DataFrame):
        placed = placed.join(picks.select(*keys, "slot", "pos"), keys)
    else:
        placed = placed.select("*", F.posexplode(picks(F.col("n"))).alias("slot", "pos"))
    return (
        placed.where((F.col("before") <= F.col("pos")) & (F.col("pos") < F.col("before") + F.col("ties")))
        .select(*keys, "n", "slot", "pos", value, "before", "ties"))


def quantiles(long: DataFrame, keys, value: str, probabilities: dict[str, float],
              exact_rows: int = EXACT_ROWS, rows: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles per key, one named column for each probability."""
    names = list(probabilities)

    def picks(n: Column) -> Column:
        spots = []
        for name in names:
            h = (n - 1) * F.lit(float(probabilities[name]))
            spots += [F.floor(h), F.ceil(h)]
        return F.array(*[s.cast("bigint") for s in spots])

    found = order_statistics(long, keys, value, picks, exact_rows, rows)
    columns = []
    for i, name in enumerate(names):
        low = F.max(F.when(F.col("slot") == 2 * i, F.col(value)))
        high = F.max(F.when(F.col("slot") == 2 * i + 1, F.col(value)))
        h = (F.max("n") - 1) * F.lit(float(probabilities[name]))
        columns.append((low + (high - low) * (h - F.floor(h))).alias(name))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *columns)
