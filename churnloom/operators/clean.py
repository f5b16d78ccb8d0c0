"""Cleaning: white space, duplicates, synonyms, imputation, outlier clipping, types.

Imputation and clipping are split into ``fit`` (a few aggregate passes) and ``apply``
(a projection), so the parameters of one table can clean another table or a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnloom import contract as c
from churnloom.errors import ImputationError, SchemaValidationError
from churnloom.functions import clip, is_missing, number, quote, strip
from churnloom.operators.order_stats import quantiles, unpivot_numeric
from churnloom.operators.tidy import rows_from
from churnloom.plans.stages import literal_table, small

KEEP = ("first", "last", "drop")


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def trim_text(df: DataFrame) -> DataFrame:
    """Strip white space around column names and inside every string column."""
    return df.select(*[
        (strip(F.col(f"`{name}`")) if kind == "string" else F.col(f"`{name}`")).alias(name.strip())
        for name, kind in df.dtypes])


def business_columns(df: DataFrame, sequence: str = c.SEQUENCE) -> list[str]:
    """All columns that describe the customer; arrival order is not one of them."""
    return [name for name in df.columns if name != sequence]


def drop_duplicates(df: DataFrame, primary_key: str | None = c.PRIMARY_KEY, keep: str = "first",
                    sequence: str = c.SEQUENCE) -> DataFrame:
    """Remove exact copies, then repeated keys.

    ``first`` and ``last`` keep the row that arrived first or last; ``drop`` removes every
    member of a repeated group. With a key, first/last need one ranking only: exact copies
    share the key, so the winner of the key is the winner among its copies as well. The
    rank filter is cut on the map side, so a key holding a third of all rows reaches its
    task as one row per input partition.
    """
    if keep not in KEEP:
        raise ValueError(f"keep must be one of {KEEP}")
    business = business_columns(df, sequence)
    ordered = sequence in df.columns
    keyed = primary_key is not None and primary_key in df.columns
    if keep == "drop":
        grouped = df.groupBy(*business).agg(
            F.count("*").alias("_copies"), *([F.min(sequence).alias(sequence)] if ordered else []))
        once = grouped.where("_copies = 1").drop("_copies")
        if not keyed:
            return once.select(*df.columns)
        others = [name for name in df.columns if name != primary_key]
        return (
            once.groupBy(primary_key)
            .agg(F.count("*").alias("_rows"), F.any_value(F.struct(*others)).alias("_row"))
            .where("_rows = 1")
            .select(primary_key, "_row.*").select(*df.columns))
    if not keyed:
        if not ordered:
            return df.dropDuplicates(business)
        chosen = F.min(sequence) if keep == "first" else F.max(sequence)
        return df.groupBy(*business).agg(chosen.alias(sequence)).select(*df.columns)
    arrival = [F.col(sequence)] if ordered else [F.col(name) for name in business]
    order = [a.asc() if keep == "first" else a.desc() for a in arrival]
    return (
        df.withColumn("_rank", F.row_number().over(W.partitionBy(primary_key).orderBy(*order)))
        .where("_rank = 1").drop("_rank"))


def duplicate_audit(df: DataFrame, primary_key: str | None = c.PRIMARY_KEY, keep: str = "first",
                    sequence: str = c.SEQUENCE) -> DataFrame:
    """One row: rows before and after, exact copies removed, key repeats removed."""
    business = business_columns(df, sequence)
    keyed = primary_key is not None and primary_key in df.columns
    distinct = df.groupBy(*business).agg(F.count("*").alias("copies"))
    if keep == "drop":
        distinct = distinct.withColumn("kept", (F.col("copies") == 1).cast("bigint"))
    else:
        distinct = distinct.withColumn("kept", F.lit(1).cast("bigint"))
    exact = (F.col("copies") - 1).alias("extra")
    if keyed:
        # Reduced per key before the final sum: the key is spread by the grouping above.
        per_key = distinct.groupBy(primary_key).agg(
            F.sum("copies").alias("rows"), F.sum(exact).alias("extra"), F.sum("kept").alias("kept"))
        survivors = (F.when(F.col("kept") == 1, 1).otherwise(0) if keep == "drop"
                     else F.when(F.col("kept") > 0, 1).otherwise(0))
        per_key = per_key.withColumn("final", survivors.cast("bigint"))
    else:
        per_key = distinct.select(
            F.col("copies").alias("rows"), exact, "kept", F.col("kept").alias("final"))
    none = F.lit(0).cast("bigint")
    totals = per_key.agg(*[
        F.coalesce(F.sum(name), none).alias(name) for name in ("rows", "extra", "kept", "final")])
    # Repeats counted the way they are found: every row after the first of its key.
    repeats = (F.col("rows") - F.col("extra") - F.col("final")) if keep != "drop" else (
        F.col("kept") - F.col("final"))
    return totals.select(
        F.col("rows").alias("initial_rows"), F.col("final").alias("final_rows"),
        F.col("extra").alias("exact_duplicates_removed"),
        repeats.alias("pk_duplicates_removed"),
        (F.col("rows") - F.col("final")).alias("total_removed"))


def merge_synonyms(df: DataFrame, maps: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Replace alternative spellings of a category by one spelling."""
    for column, mapping in (c.SYNONYMS if maps is None else maps).items():
        if column in df.columns:
            df = df.replace(mapping, subset=[column])
    return df


# --- imputation ---------------------------------------------------------------------------

@dataclass
class Imputation:
    """Fitted fill values. ``grouped`` has a column per imputed column, keyed by ``_group``."""

    numeric_strategy: str
    categorical_strategy: str
    group_by: str | None
    missing: dict[str, int]
    rows: int | None = None
    numeric: dict[str, float | None] = field(default_factory=dict)
    categorical: dict[str, str | None] = field(default_factory=dict)
    grouped: DataFrame | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill the gaps; a projection, plus one lookup join for group medians."""
        names = df.columns
        if self.grouped is not None:
            df = df.join(self.grouped, df[self.group_by] == F.col("_group"), "left")
        filled = {}
        for name, fallback in self.numeric.items():
            choices = [f"nanvl(CAST({name} AS DOUBLE), NULL)"]
            if self.grouped is not None:
                choices.append(f"_median_{name}")
            if fallback is not None:
                choices.append(number(fallback))
            filled[name] = F.expr(f"coalesce({', '.join(choices)})")
        for name, fallback in self.categorical.items():
            filled[name] = F.coalesce(F.col(name), F.lit(fallback))
        return df.select(*[filled.get(name, F.col(name)).alias(name) for name in names])

    def audit(self, spark) -> DataFrame:
        """Imputed columns with the number of gaps and how they were filled."""
        columns, counts, strategies, texts = [], [], [], []
        for name, value in {**self.numeric, **self.categorical}.items():
            if not self.missing[name]:
                continue
            columns.append(name)
            counts.append(self.missing[name])
            if name in self.categorical:
                strategies.append(self.categorical_strategy)
                # The wording of the descriptions.
                texts.append(f"mode ({value})" if self.categorical_strategy == "mode"
                             else f"constant value '{value}'")
            else:
                strategies.append(self.numeric_strategy)
                texts.append(
                    f"grouped median by {self.group_by} (fallback global {value})"
                    if self.grouped is not None else f"global {self.numeric_strategy} ({value})")
        types = {"column": "string", "imputed_count": "bigint", "strategy": "string",
                 "description": "string"}
        return literal_table(spark, {
            "column": columns, "imputed_count": counts, "strategy": strategies,
            "description": texts}, types)


def fit_imputation(df: DataFrame, numeric_strategy: str = "median", categorical_strategy: str = "mode",
                   group_by: str | None = c.IMPUTE_GROUP, numeric_columns=c.IMPUTE_NUMERIC,
                   categorical_columns=c.IMPUTE_CATEGORICAL) -> Imputation:
    """Learn fill values: grouped or global median, global mean, mode or a constant.

    A group whose values are all missing, and rows without a group, fall back to the
    global median of the values present before filling.
    """
    if numeric_strategy not in ("median", "mean"):
        raise ImputationError(f"unknown numeric strategy {numeric_strategy!r}")
    kinds = _types(df)
    numeric = [n for n in numeric_columns if n in kinds]
    categorical = [n for n in categorical_columns if n in kinds]
    grouping = group_by if numeric_strategy == "median" and group_by in kinds else None
    model = Imputation(numeric_strategy, categorical_strategy, grouping, {})
    if not numeric and not categorical:
        return model
    model.missing = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(is_missing(n, kinds[n])).alias(n) for n in numeric + categorical]).first().asDict()
    rows = model.rows = model.missing.pop("_rows")
    gappy = [n for n in numeric if model.missing[n]]

    if gappy and numeric_strategy == "mean":
        means = df.agg(*[
            F.avg(F.when(~is_missing(n, kinds[n]), F.col(n))).alias(n) for n in gappy]).first()
        model.numeric = {n: means[n] for n in gappy}
    elif gappy:
        model.numeric, model.grouped = _fit_medians(df, gappy, grouping, rows)
    for name in categorical:
        if model.missing[name]:
            model.categorical[name] = (
                _most_frequent(df, name) if categorical_strategy == "mode" else categorical_strategy)
    return model


def _fit_medians(df, columns, group_by, rows):
    long = unpivot_numeric(
        df.withColumn("_group", F.col(group_by).cast("string") if group_by else F.lit("")),
        columns, keep=["_group"])
    # Every cell counts once for its group and once for the whole table.
    scopes = [F.struct(F.lit(True).alias("whole"), F.lit("").alias("grp"))]
    if group_by:
        scopes.append(F.struct(F.lit(False).alias("whole"), F.col("_group").alias("grp")))
    long = (
        long.select("series", "value", F.explode(F.array(*scopes)).alias("scope"))
        .select("series", "value", "scope.*").where("grp IS NOT NULL"))
    medians = small(
        quantiles(long, ["series", "whole", "grp"], "value", {"median": 0.5}, rows=rows), "medians")
    fallback = dict.fromkeys(columns)
    fallback.update({r["series"]: r["median"] for r in medians.where("whole").collect()})
    if not group_by:
        return fallback, None
    wide = medians.where("NOT whole").groupBy(F.col("grp").alias("_group")).agg(*[
        F.max(F.when(F.col("series") == n, F.col("median"))).alias(f"_median_{n}") for n in columns])
    return fallback, small(wide, "group-medians")


def _most_frequent(df, name):
    """Most frequent non-null value, ties to the smallest."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).count()
    top = counts.orderBy(F.desc("count"), F.asc(name)).limit(1).collect()
    return top[0][0] if top else None


# --- outliers -----------------------------------------------------------------------------

@dataclass
class Clipping:
    """Fitted interquartile bounds per column."""

    bounds: dict[str, tuple[float, float]]

    def apply(self, df: DataFrame) -> DataFrame:
        """Hold each column within its bounds. Clipped columns are always double."""
        clipped = {n: clip(f"CAST({n} AS DOUBLE)", *b) for n, b in self.bounds.items()}
        return df.select(*[clipped.get(n, F.col(n)).alias(n) for n in df.columns])

    def audit(self, df: DataFrame) -> DataFrame:
        """Bounds and number of capped values per column, counted on unclipped data."""
        counts, rows = [], []
        for name, (low, high) in self.bounds.items():
            below, above = f"below_{name}", f"above_{name}"
            counts += [F.expr(f"count_if({name} < {number(low)}) AS {below}"),
                       F.expr(f"count_if({name} > {number(high)}) AS {above}")]
            rows.append({
                "column": quote(name), "lower_bound": number(low), "upper_bound": number(high),
                "below_capped": below, "above_capped": above, "total_capped": f"{below} + {above}"})
        return rows_from(df.agg(*counts), rows)


def fit_clipping(df: DataFrame, multiplier: float | None = None, columns=c.CLIP_COLUMNS,
                 rows: int | None = None) -> Clipping:
    """Bounds q1 - m * iqr and q3 + m * iqr from exact, linearly interpolated quartiles."""
    factor = c.IQR_MULTIPLIER if multiplier is None else float(multiplier)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    wanted = [n for n in columns if n in numeric]
    if not wanted:
        return Clipping({})
    quartiles = quantiles(
        unpivot_numeric(df, wanted), ["series"], "value", {"q1": 0.25, "q3": 0.75}, rows=rows)
    found = {r["series"]: (r["q1"], r["q3"]) for r in quartiles.collect()}
    bounds = {}
    for name in wanted:
        if name in found:
            q1, q3 = found[name]
            bounds[name] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return Clipping(bounds)


# --- types and the whole pipeline ------------------------------------------------------------

def enforce_types(df: DataFrame) -> DataFrame:
    """Store doubles as float and longs as int. Opt in: float loses digits."""
    narrower = {"double": "float", "bigint": "int"}
    return df.select(*[
        F.col(n).cast(narrower[kind]).alias(n) if kind in narrower and n != c.SEQUENCE else F.col(n)
        for n, kind in df.dtypes])


def prepare(df: DataFrame, primary_key: str | None = c.PRIMARY_KEY, keep: str = "first") -> DataFrame:
    """The steps without fitted parameters: trim, drop duplicates, merge synonyms."""
    return merge_synonyms(drop_duplicates(trim_text(df), primary_key, keep))


@dataclass
class Cleaned:
    """A cleaned table with its fitted parameters; audits are DataFrames."""

    df: DataFrame
    prepared: DataFrame
    imputation: Imputation
    clipping: Clipping
    raw: DataFrame
    primary_key: str | None

    def duplicates(self) -> DataFrame:
        return duplicate_audit(trim_text(self.raw), self.primary_key)

    def imputed(self) -> DataFrame:
        return self.imputation.audit(self.raw.sparkSession)

    def capped(self) -> DataFrame:
        return self.clipping.audit(self.imputation.apply(self.prepared))


def clean(df: DataFrame, primary_key: str | None = c.PRIMARY_KEY, numeric_strategy: str = "median",
          categorical_strategy: str = "mode", group_by: str | None = c.IMPUTE_GROUP,
          iqr_multiplier: float | None = None, enforce: bool = False, prepared: DataFrame | None = None):
    """Run all cleaning steps. Pass ``prepared`` to reuse a stage of ``prepare(df)``."""
    base = prepare(df, primary_key) if prepared is None else prepared
    if not base.columns:
        raise SchemaValidationError("the table has no columns")
    imputation = fit_imputation(base, numeric_strategy, categorical_strategy, group_by)
    filled = imputation.apply(base)
    clipping = fit_clipping(filled, iqr_multiplier, rows=imputation.rows)
    result = clipping.apply(filled)
    return Cleaned(enforce_types(result) if enforce else result, base, imputation, clipping, df,
                   primary_key)
