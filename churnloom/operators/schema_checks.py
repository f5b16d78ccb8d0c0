"""Contract validation. Every check returns findings: rule, column, severity, message, details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnloom import contract as c
from churnloom.errors import SchemaValidationError
from churnloom.functions import is_missing, number, quote
from churnloom.operators.clean import business_columns
from churnloom.operators.tidy import rows_from
from churnloom.plans.stages import literal_table

BASELINE_ROWS = 5000
ROW_DRIFT = 0.50
SAMPLE_KEYS = 10

# Message formats of the findings.
MESSAGES = {
    "missing": "Mandatory column '%s' is missing from the dataset.",
    "extra": "Column '%s' found in dataset but not defined in schema.",
    "type": "Column '%s' has dtype '%s', expected one of %s.",
    "not_null": "NOT_NULL column '%s' contains %s null value(s) (%s%%).",
    "nullable": "NULLABLE column '%s' contains %s null value(s) (%s%%). "
                "Imputation required in cleaning phase.",
    "unique": "Unique column '%s' contains %s duplicate row(s) across %s key(s).",
    "domain": "Column '%s' contains %s value(s) outside the allowed domain.",
    "below": "Column '%s' has %s value(s) below minimum boundary (%s). Actual min: %s.",
    "above": "Column '%s' has %s value(s) above maximum boundary (%s). Actual max: %s.",
    "column_drift": "Column count drift detected: expected %s, found %s.",
    "row_drift": "Row count magnitude drift: expected ~%s, found %s (%s%% deviation).",
    "order_drift": "Column ordering differs from schema registry baseline.",
}

FINDING = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("details", T.MapType(T.StringType(), T.StringType())),
])


def _finding(rule, column, severity, message, *values: str, found: str = "true", **details: str):
    """One row of SQL cells. ``values`` and ``details`` are SQL text themselves."""
    texts = [f"CAST({v} AS STRING)" for v in values]
    template = quote(MESSAGES[message])
    pairs = ", ".join(f"{quote(k)}, CAST({v} AS STRING)" for k, v in details.items())
    return {
        "rule": quote(rule), "column": "CAST(NULL AS STRING)" if column is None else quote(column),
        "severity": quote(severity),
        "message": f"format_string({', '.join([template, *texts])})" if texts else template,
        "details": f"CAST(map({pairs}) AS MAP<STRING, STRING>)",
        "found": f"coalesce({found}, false)",
    }


def _findings(aggregate: DataFrame, rows) -> DataFrame:
    if not rows:
        return aggregate.sparkSession.createDataFrame([], FINDING)
    return rows_from(aggregate, rows).where("found").drop("found")


def _counted(df: DataFrame, extra=()):
    return df.agg(F.count("*").alias("_rows"), *extra)


def _share(part: str, whole: str, digits: int) -> str:
    scale = number(10 ** digits)
    return f"(rint({part} / {whole} * 100.0D * {scale}) / {scale})"


def _presence_rows(df):
    present = business_columns(df)
    rows = [_finding("column_presence", r.name, "critical", "missing", quote(r.name))
            for r in c.RULES if r.mandatory and r.name not in present]
    extras = sorted(n for n in present if n not in c.BY_NAME)
    return rows + [_finding("column_presence", n, "info", "extra", quote(n)) for n in extras]


def _type_rows(df):
    kinds = dict(df.dtypes)
    return [
        _finding("data_type", r.name, "warning", "type", quote(r.name), quote(kinds[r.name]),
                 quote(str(list(r.types))), actual_dtype=quote(kinds[r.name]))
        for r in c.RULES if r.name in kinds and kinds[r.name] not in r.types]


def _null_facts(df):
    kinds = dict(df.dtypes)
    return [F.count_if(is_missing(r.name, kinds[r.name])).alias(f"nulls_{r.name}")
            for r in c.RULES if r.name in kinds]


def _null_rows(df):
    rows = []
    for r in c.RULES:
        if r.name not in df.columns:
            continue
        count = f"nulls_{r.name}"
        share = _share(count, "_rows", 2)
        kind = "nullable" if r.nullable else "not_null"
        rows.append(_finding(
            "nullability", r.name, "info" if r.nullable else "critical", kind,
            quote(r.name), f"format_number({count}, 0)", share, found=f"{count} > 0",
            null_count=count, null_percentage=share))
    return rows


def _bounded(df):
    return [r for r in c.RULES if r.name in df.columns and (r.low is not None or r.high is not None)]


def _range_facts(df):
    facts = []
    for r in _bounded(df):
        value = f"CAST({r.name} AS DOUBLE)"
        facts += [F.expr(f"min({value}) AS min_{r.name}"), F.expr(f"max({value}) AS max_{r.name}")]
        if r.low is not None:
            facts.append(F.expr(f"count_if({value} < {r.low}) AS below_{r.name}"))
        if r.high is not None:
            facts.append(F.expr(f"count_if({value} > {r.high}) AS above_{r.name}"))
    return facts


def _range_rows(df):
    rows = []
    for r in _bounded(df):
        for side, limit, extreme in (("below", r.low, "min"), ("above", r.high, "max")):
            if limit is None:
                continue
            count, actual = f"{side}_{r.name}", f"{extreme}_{r.name}"
            rows.append(_finding(
                "numeric_range", r.name, "warning", side, quote(r.name), count, str(limit), actual,
                found=f"{count} > 0", boundary=quote(extreme), threshold=str(limit),
                actual_extreme=actual, violation_count=count))
    return rows


def _drift_rows(df, baseline_rows, baseline_columns):
    columns = business_columns(df)
    expected = len(c.RULES) if baseline_columns is None else baseline_columns
    base = BASELINE_ROWS if baseline_rows is None else baseline_rows
    rows = []
    if len(columns) != expected:
        rows.append(_finding(
            "schema_drift", None, "warning", "column_drift", str(expected),
            str(len(columns)), expected_columns=str(expected), actual_columns=str(len(columns)),
            delta=str(len(columns) - expected)))
    if base > 0:
        deviation = f"(abs(_rows - {base}) / {number(base)})"
        rows.append(_finding(
            "schema_drift", None, "warning", "row_drift", quote(f"{base:,}"),
            "format_number(_rows, 0)", f"CAST(rint({deviation} * 100.0D) AS BIGINT)",
            found=f"{deviation} > {ROW_DRIFT}", expected_rows=str(base), actual_rows="_rows",
            deviation_pct=f"rint({deviation} * 100.0D * 10.0D) / 10.0D"))
    ordered = [r.name for r in c.RULES if r.name in columns]
    actual = [n for n in columns if n in c.BY_NAME]
    if ordered != actual:
        rows.append(_finding(
            "schema_drift", None, "info", "order_drift",
            expected_order=quote(",".join(ordered)), actual_order=quote(",".join(actual))))
    return rows


def check_presence(df: DataFrame) -> DataFrame:
    """Missing mandatory columns (critical) and unknown columns (info)."""
    return _findings(_counted(df), _presence_rows(df))


def check_types(df: DataFrame) -> DataFrame:
    """Columns whose type the contract does not accept (warning)."""
    return _findings(_counted(df), _type_rows(df))


def check_nulls(df: DataFrame) -> DataFrame:
    """Nulls where none are allowed (critical) and nulls to be imputed (info)."""
    return _findings(_counted(df, _null_facts(df)), _null_rows(df))


def check_ranges(df: DataFrame) -> DataFrame:
    """Values below or above the bounds (warning), one finding per side."""
    return _findings(_counted(df, _range_facts(df)), _range_rows(df))


def check_drift(df: DataFrame, baseline_rows: int | None = None, baseline_columns: int | None = None):
    """Column count, row count and column order against the baseline."""
    return _findings(_counted(df), _drift_rows(df, baseline_rows, baseline_columns))


def check_unique(df: DataFrame) -> DataFrame:
    """Repeated values of unique columns (critical) with the first few keys as a sample."""
    found = None
    for r in c.RULES:
        if not r.unique or r.name not in df.columns:
            continue
        repeated = df.groupBy(F.col(r.name).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
        totals = repeated.agg(F.sum("n").alias("rows"), F.count("*").alias("keys")).withColumn(
            "column", F.lit(r.name))
        # At most SAMPLE_KEYS rows reach the list.
        sample = repeated.orderBy("key").limit(SAMPLE_KEYS).agg(
            F.sort_array(F.collect_list("key")).alias("sample")).withColumn("column", F.lit(r.name))
        rows = _findings(totals.join(sample, "column"), [_finding(
            "uniqueness", r.name, "critical", "unique", quote(r.name), "rows", "keys",
            found="keys > 0", duplicate_row_count="rows", unique_duplicated_keys="keys",
            sample_keys="array_join(CAST(sample AS ARRAY<STRING>), ',')")])
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else df.sparkSession.createDataFrame([], FINDING)


def domain_table(spark) -> DataFrame:
    """The allowed values of every closed column: (column, expected)."""
    pairs = [(r.name, str(v)) for r in c.RULES if r.allowed is not None for v in r.allowed]
    return literal_table(spark, {"column": [p[0] for p in pairs], "expected": [p[1] for p in pairs]})


def domain_violations(df: DataFrame) -> DataFrame:
    """Every value outside its domain with its number of rows; nulls are not judged.

    Counted before it is compared, so the comparison sees distinct values only. The domain
    is a fixed table of the contract.
    """
    closed = [r.name for r in c.RULES if r.allowed is not None and r.name in df.columns]
    cells = df.select(*[F.col(n).cast("string").alias(n) for n in closed]).unpivot(
        [], closed, "column", "value")
    counted = cells.where("value IS NOT NULL").groupBy("column", "value").agg(
        F.count("*").alias("row_count"))
    domain = F.broadcast(domain_table(df.sparkSession)).withColumnRenamed("expected", "value")
    return counted.join(domain, ["column", "value"], "left_anti")


def check_domains(df: DataFrame) -> DataFrame:
    """One finding per column with unknown values; ``domain_violations`` lists them all."""
    per_column = domain_violations(df).groupBy("column").agg(
        F.count("*").alias("n_values"), F.sum("row_count").alias("n_rows"))
    return per_column.select(
        F.lit("categorical_domain").alias("rule"), "column", F.lit("warning").alias("severity"),
        F.format_string(MESSAGES["domain"], "column", F.col("n_values").cast("string")).alias("message"),
        F.expr("map('invalid_value_count', CAST(n_values AS STRING), 'row_count', CAST(n_rows AS STRING))")
        .alias("details"))


def all_findings(df: DataFrame, baseline_rows: int | None = None) -> DataFrame:
    """The findings of all seven checks; the aggregate ones share a single scan."""
    facts = _counted(df, _null_facts(df) + _range_facts(df))
    rows = (_presence_rows(df) + _type_rows(df) + _null_rows(df) + _range_rows(df)
            + _drift_rows(df, baseline_rows, None))
    return (
        _findings(facts, rows).unionByName(check_unique(df)).unionByName(check_domains(df)))


SEVERITIES = ("critical", "warning", "info")


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Number of findings of each severity, zeros included."""
    rows = [{"severity": F.lit(s), "findings": F.col(s)} for s in SEVERITIES]
    return rows_from(
        findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]), rows)


def findings_by_rule(findings: DataFrame) -> DataFrame:
    """Findings of each rule as a list; there is at most one per column and side."""
    return findings.groupBy("rule").agg(
        F.count("*").alias("findings"),
        F.sort_array(F.collect_list(F.struct("column", "severity", "message"))).alias("items"))


def validate(df: DataFrame, baseline_rows: int | None = None, raise_on_critical: bool = False) -> DataFrame:
    """One row: counts by severity and FAILED, WARNINGS or PASSED."""
    findings = all_findings(df, baseline_rows)
    report = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]).select(
        F.when(F.col("critical") > 0, "FAILED").when(F.col("warning") > 0, "WARNINGS")
        .otherwise("PASSED").alias("overall_status"), *SEVERITIES)
    if raise_on_critical:
        critical = [r["message"] for r in findings.where("severity = 'critical'").collect()]
        if critical:
            raise SchemaValidationError(f"{len(critical)} critical finding(s): {critical}")
    return report


def registry_table(df: DataFrame) -> DataFrame:
    """The contract as a table, with the type and known values each column has in ``df``."""
    kinds = dict(df.dtypes)
    known = df.agg(F.count("*").alias("_rows"), *[
        F.count(r.name).alias(r.name) for r in c.RULES if r.name in kinds])
    def text(values):
        return "CAST(NULL AS STRING)" if values is None else quote(",".join(str(v) for v in values))

    def bound(value):
        return "CAST(NULL AS DOUBLE)" if value is None else number(value)

    return rows_from(known, [{
        "name": quote(r.name), "category": quote(r.category), "types": text(r.types),
        "nullability": quote(r.nullability), "is_mandatory": str(r.mandatory).lower(),
        "unique": str(r.unique).lower(), "allowed_values": text(r.allowed),
        "min_value": bound(r.low), "max_value": bound(r.high), "description": quote(r.description),
        "actual_type": text([kinds[r.name]] if r.name in kinds else None),
        "known_values": r.name if r.name in kinds else "0L",
    } for r in c.RULES])
