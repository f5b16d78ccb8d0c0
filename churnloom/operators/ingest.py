"""Ingestion checks: columns, types, duplicate keys, gaps, the quality gate, downcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom.errors import SchemaValidationError
from churnloom.functions import is_missing, percent, round_even, similarity
from churnloom.operators.clean import business_columns
from churnloom.operators.tidy import rows_from
from churnloom.plans.stages import literal_table

TYPO_SIMILARITY = 0.75
_INTEGERS = ("bigint", "int", "smallint", "tinyint")
_RANGES = (("tinyint", 127), ("smallint", 32767), ("int", 2147483647))


def _known(df: DataFrame, columns):
    return df.agg(*[F.count(F.col(n)).alias(n) for n in columns])


def required_columns(df: DataFrame, expected=c.SOURCE_COLUMNS) -> DataFrame:
    """Every expected or present column: matched, missing or extra, with its known values."""
    present = business_columns(df)
    rows = []
    for name in sorted(set(expected) | set(present)):
        state = ("matched" if name in expected and name in present
                 else "missing" if name in expected else "extra")
        known = F.col(name) if name in present else F.lit(0).cast("bigint")
        rows.append({"column": F.lit(name), "status": F.lit(state), "known_values": known})
    return rows_from(_known(df, present), rows)


def suggest_spellings(values: DataFrame, domain: DataFrame, threshold: float = TYPO_SIMILARITY) -> DataFrame:
    """Allowed values that an unknown value of the same column resembles.

    ``values`` has (column, value, row_count), ``domain`` has (column, expected).
    """
    likeness = similarity("expected", "value")
    return (
        values.join(domain, "column")
        .select("column", "value", "row_count", "expected", likeness.alias("likeness"))
        .where(F.col("likeness") >= threshold)
        .select("column", F.col("value").alias("found"), "expected",
                round_even("likeness", 4).alias("similarity"), "row_count"))


def column_typos(df: DataFrame, expected=c.SOURCE_COLUMNS) -> DataFrame:
    """Extra column names that resemble missing ones."""
    spark = df.sparkSession
    missing = [n for n in expected if n not in df.columns]
    extra = [n for n in business_columns(df) if n not in expected]
    types = {"column": "string", "value": "string", "row_count": "bigint"}
    found = literal_table(spark, {
        "column": ["column name"] * len(extra), "value": extra, "row_count": [1] * len(extra)}, types)
    domain = literal_table(spark, {
        "column": ["column name"] * len(missing), "expected": missing},
        {"column": "string", "expected": "string"})
    return suggest_spellings(found, F.broadcast(domain))


def type_conformity(df: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """Declared and actual type of every present contract column."""
    wanted = c.SOURCE_TYPES if expected is None else expected
    kinds = dict(df.dtypes)
    present = [n for n in wanted if n in kinds]
    return rows_from(_known(df, present), [
        {"column": F.lit(n), "expected": F.lit(wanted[n]), "actual": F.lit(kinds[n]),
         "matches": F.lit(kinds[n] == wanted[n]), "known_values": F.col(n)} for n in present])


def duplicate_keys(df: DataFrame, key: str = c.PRIMARY_KEY) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("row_count")).where("row_count > 1")


def duplicate_total(df: DataFrame, key: str = c.PRIMARY_KEY) -> DataFrame:
    """One row: rows in repeated groups, repeated keys, whether the key is clean."""
    none = F.lit(0).cast("bigint")
    return duplicate_keys(df, key).agg(
        F.coalesce(F.sum("row_count"), none).alias("total_duplicates"),
        F.count("*").alias("duplicate_keys")).withColumn("is_clean", F.col("total_duplicates") == 0)


def _null_counts(df: DataFrame, columns):
    kinds = dict(df.dtypes)
    return [F.count_if(is_missing(n, kinds[n])).alias(n) for n in columns]


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, most affected first; one scan for all columns."""
    columns = business_columns(df)
    counts = df.agg(F.count("*").alias("_rows"), *_null_counts(df, columns))
    return rows_from(counts, [
        {"column": F.lit(n), "null_count": F.col(n),
         "null_percentage": round_even(percent(n, "_rows"), 2),
         "has_nulls": F.col(n) > 0} for n in columns]).orderBy(F.desc("null_percentage"), "column")


def null_total(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table."""
    columns = business_columns(df)
    counts = df.agg(F.count("*").alias("_rows"), *_null_counts(df, columns))
    total = sum((F.col(n) for n in columns[1:]), F.col(columns[0]))
    return counts.select(
        total.alias("total_nulls"),
        round_even(percent(total, F.col("_rows") * len(columns)), 2).alias("null_percentage_overall"))


def quality_gate(df: DataFrame, expected=c.SOURCE_COLUMNS, types: dict[str, str] | None = None,
                 key: str = c.PRIMARY_KEY) -> DataFrame:
    """One row: shape, the three verdicts and the overall one, which ignores types."""
    wanted = c.SOURCE_TYPES if types is None else types
    kinds = dict(df.dtypes)
    columns = business_columns(df)
    columns_valid = all(n in kinds for n in expected)
    types_valid = all(kinds[n] == t for n, t in wanted.items() if n in kinds)
    grouped = df.groupBy(*([key] if key in kinds else [])).agg(F.count("*").alias("n"))
    clean = F.count_if(F.col("n") > 1) == 0 if key in kinds else F.lit(True)
    none = F.lit(0).cast("bigint")
    return grouped.agg(
        F.coalesce(F.sum("n"), none).alias("total_rows"), clean.alias("duplicates_clean")).select(
        "total_rows", F.lit(len(columns)).cast("bigint").alias("total_columns"),
        F.lit(columns_valid).alias("columns_valid"), F.lit(types_valid).alias("dtypes_valid"),
        "duplicates_clean",
        (F.lit(columns_valid) & F.col("duplicates_clean")).alias("overall_pass"))


def downcast_plan(df: DataFrame) -> DataFrame:
    """The narrowest type that holds every value of each numeric column.

    Whole numbers go by their range; doubles become float only if no value changes.
    """
    kinds = dict(df.dtypes)
    aggregates, rows = [], []
    for name in business_columns(df):
        kind = kinds[name]
        if kind in _INTEGERS:
            top = F.greatest(F.abs(F.min(name).cast("bigint")), F.abs(F.max(name).cast("bigint")))
            aggregates.append(top.alias(name))
            choice = F.lit(kind)
            for narrow, limit in reversed(_RANGES[:_INTEGERS[::-1].index(kind)]):
                choice = F.when(F.col(name) <= limit, F.lit(narrow)).otherwise(choice)
        elif kind == "double":
            changed = F.col(name).cast("float").cast("double") != F.col(name)
            aggregates.append(F.count_if(changed).alias(name))
            choice = F.when(F.col(name) == 0, F.lit("float")).otherwise(F.lit("double"))
        else:
            continue
        rows.append({"column": F.lit(name), "from_type": F.lit(kind), "to_type": choice})
    return rows_from(df.agg(*aggregates), rows)


def downcast(df: DataFrame) -> DataFrame:
    """Cast each numeric column to its planned type."""
    plan = {r["column"]: r["to_type"] for r in downcast_plan(df).collect()}
    return df.select(*[F.col(n).cast(plan[n]).alias(n) if n in plan else F.col(n) for n in df.columns])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: total rows and rows beyond the first of identical ones.

    Grouping by the whole row combines copies before the shuffle.
    """
    none = F.lit(0).cast("bigint")
    return df.groupBy(*business_columns(df)).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), none).alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - 1), none).alias("duplicate_rows"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: shape, numeric and text columns, missing cells, fully duplicated rows.

    Missing cells are added up in the same grouping that finds the duplicates.
    """
    columns = business_columns(df)
    kinds = dict(df.dtypes)
    text = [n for n in columns if kinds[n] == "string"]
    numeric = [n for n in columns if n not in text]
    holes = sum((is_missing(n, kinds[n]).cast("bigint") for n in columns[1:]),
                is_missing(columns[0], kinds[columns[0]]).cast("bigint"))
    none = F.lit(0).cast("bigint")
    grouped = df.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_holes", holes)
    return grouped.agg(
        F.coalesce(F.sum("_n"), none).alias("total_rows"),
        F.coalesce(F.sum(F.col("_n") * F.col("_holes")), none).alias("null_total"),
        F.coalesce(F.sum(F.col("_n") - 1), none).alias("duplicate_rows")).select(
        "total_rows", F.lit(len(columns)).cast("bigint").alias("total_columns"),
        F.lit(",".join(numeric)).alias("numeric_columns"),
        F.lit(",".join(text)).alias("categorical_columns"), "null_total", "duplicate_rows")


def ingest(df: DataFrame, expected=c.SOURCE_COLUMNS, types=None, key: str = c.PRIMARY_KEY,
           optimize: bool = True):
    """Check a table read from a source; return it with its reports as DataFrames."""
    missing = sorted(n for n in expected if n not in df.columns)
    if missing:
        hints = [f"{r['found']} for {r['expected']}" for r in column_typos(df, expected).collect()]
        raise SchemaValidationError(f"missing columns {missing}; possible typos: {hints or 'none'}")
    reports = {
        "columns": required_columns(df, expected),
        "types": type_conformity(df, types),
        "duplicates": duplicate_total(df, key),
        "nulls": null_profile(df),
        "gate": quality_gate(df, expected, types, key),
    }
    return (downcast(df) if optimize else df), reports
