"""Audit of the engineered features: gaps, infinities, constants, correlation, leakage."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnloom import contract as c
from churnloom.errors import FeatureEngineeringError
from churnloom.functions import is_missing, number, quote, round_even
from churnloom.operators.tidy import rows_from
from churnloom.plans.stages import literal_table

CORRELATION_LIMIT = 0.90


def _numeric(df: DataFrame, features):
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [n for n in features if n in kinds and isinstance(kinds[n], T.NumericType)]


def _present(df: DataFrame, features):
    return [n for n in features if n in df.columns]


def missing_features(df: DataFrame, features=tuple(c.FEATURE_TYPES)) -> DataFrame:
    """Every expected feature with whether it is there and how many values are known."""
    known = df.agg(F.count("*").alias("_rows"), *[F.count(n).alias(n) for n in _present(df, features)])
    return rows_from(known, [
        {"feature": F.lit(n), "present": F.lit(n in df.columns),
         "known_values": F.col(n) if n in df.columns else F.lit(0).cast("bigint")} for n in features])


# Each check names its aggregates and the rows made from them, so that several checks can
# share one scan. Cells are SQL text.

def _nulls(df, features):
    kinds = dict(df.dtypes)
    facts = {f"null_{n}": F.count_if(is_missing(n, kinds[n])) for n in _present(df, features)}
    return facts, [{"kind": "'missing_values'", "feature": quote(n), "amount": f"null_{n}",
                    "found": f"null_{n} > 0"} for n in _present(df, features)]


def _infinities(df, features):
    present = _numeric(df, features)
    facts = {f"inf_{n}": F.expr(f"count_if(abs(CAST({n} AS DOUBLE)) = double('Infinity'))") for n in present}
    return facts, [{"kind": "'infinite_values'", "feature": quote(n), "amount": f"inf_{n}",
                    "found": f"inf_{n} > 0"} for n in present]


def _constants(df, features):
    """Exactly one distinct known value: the extremes agree."""
    present = _present(df, features)
    facts = {f"{f}_{n}": F.expr(f"{f}({n})") for n in present for f in ("min", "max")}
    return facts, [{"kind": "'constant'", "feature": quote(n), "amount": "CAST(NULL AS BIGINT)",
                    "found": f"coalesce(min_{n} = max_{n}, false)"} for n in present]


def _flat(df, features):
    """Sample deviation zero or undefined."""
    present = _numeric(df, features)
    facts = {f"std_{n}": F.expr(f"stddev_samp({n})") for n in present}
    return facts, [{"kind": "'zero_variance'", "feature": quote(n), "amount": "CAST(NULL AS BIGINT)",
                    "found": f"coalesce(std_{n} = 0, true)"} for n in present]


def _twins(df, features):
    """Pairs of one type that agree in every row, gaps included."""
    kinds = dict(df.dtypes)
    pairs = [(a, b) for a, b in combinations(_present(df, features), 2) if kinds[a] == kinds[b]]
    facts = {f"same_{a}__{b}": F.expr(f"bool_and({a} <=> {b})") for a, b in pairs}
    return facts, [{"kind": "'duplicate'", "feature": quote(f"{a}~{b}"), "amount": "CAST(NULL AS BIGINT)",
                    "found": f"coalesce(same_{a}__{b}, false)"} for a, b in pairs]


def _run(df, *checks) -> DataFrame:
    """Findings (kind, feature, amount) of checks that share one aggregate."""
    facts = {name: column for check in checks for name, column in check[0].items()}
    rows = [row for check in checks for row in check[1]]
    if not rows:
        return df.select(F.lit("").alias("kind"), F.lit("").alias("feature"),
                         F.lit(None).cast("bigint").alias("amount")).limit(0)
    aggregate = df.agg(*[column.alias(name) for name, column in facts.items()])
    return rows_from(aggregate, rows).where("found").drop("found")


def null_features(df: DataFrame, features=tuple(c.FEATURE_TYPES)) -> DataFrame:
    """Features with missing values."""
    return _run(df, _nulls(df, features)).select("feature", F.col("amount").alias("null_count"))


def infinite_features(df: DataFrame, features=tuple(c.FEATURE_TYPES)) -> DataFrame:
    """Numeric features with infinite values."""
    return _run(df, _infinities(df, features)).select("feature", F.col("amount").alias("infinite_count"))


def constant_features(df: DataFrame, features=tuple(c.FEATURE_TYPES)) -> DataFrame:
    """Features with exactly one distinct known value."""
    return _run(df, _constants(df, features)).select("feature")


def zero_variance(df: DataFrame, features=tuple(c.FEATURE_TYPES)) -> DataFrame:
    """Numeric features whose sample deviation is zero or undefined."""
    return _run(df, _flat(df, features)).select("feature")


def duplicate_features(df: DataFrame, features=tuple(c.FEATURE_TYPES)) -> DataFrame:
    """Pairs of features that agree in every row."""
    sides = F.split("feature", "~")
    return _run(df, _twins(df, features)).select(
        sides[0].alias("feature_a"), sides[1].alias("feature_b"))


def _numeric_pairs(df, features, target=None):
    """Pairs of numeric features, and each of them with the target."""
    numeric = _numeric(df, features)
    return list(combinations(numeric, 2)), ([(n, target) for n in numeric] if target else [])


def _coefficients(df: DataFrame, pairs) -> DataFrame:
    """Pearson coefficient per pair over the rows where both are known: (pair, coefficient).

    Every row lists its pairs, which combine per partition into one group per pair. The
    moments are the same as in one wide aggregate, but the loop stays small enough to be
    compiled. The coefficient is null when one side does not vary; the built-in ``corr``
    fails on such a column in ANSI mode.
    """
    cells = ", ".join(
        f"named_struct('pair', {i}, 'x', CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END, "
        f"'y', CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END)"
        for i, (a, b) in enumerate(pairs))
    return df.select(F.expr(f"inline(array({cells}))")).groupBy("pair").agg(F.expr(
        "nanvl(try_divide(covar_pop(x, y), stddev_pop(x) * stddev_pop(y)), NULL) AS coefficient"))


def _named(names) -> Column:
    return F.expr(f"element_at(array({', '.join(map(quote, names))}), pair + 1)")


def correlations(df: DataFrame, features=tuple(c.FEATURE_TYPES)) -> DataFrame:
    """Pearson coefficient of every pair of numeric features, in one grouping."""
    pairs, _ = _numeric_pairs(df, features)
    return _coefficients(df, pairs).select(
        _named([a for a, _ in pairs]).alias("feature_a"), _named([b for _, b in pairs]).alias("feature_b"),
        "coefficient")


def high_correlation(df: DataFrame, features=tuple(c.FEATURE_TYPES), threshold=CORRELATION_LIMIT):
    """Pairs of features whose coefficient exceeds the threshold in size."""
    return correlations(df, features).where(F.abs("coefficient") > threshold).select(
        "feature_a", "feature_b", round_even("abs(coefficient)", 4).alias("correlation_coef"))


def type_mismatches(df: DataFrame, expected: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Present features with their type and whether it is an accepted one."""
    wanted = c.FEATURE_TYPES if expected is None else expected
    kinds = dict(df.dtypes)
    known = df.agg(F.count("*").alias("_rows"), *[F.count(n).alias(n) for n in wanted if n in kinds])
    return rows_from(known, [
        {"feature": F.lit(n), "actual": F.lit(kinds[n]), "expected": F.lit(",".join(wanted[n])),
         "conforms": F.lit(kinds[n] in wanted[n]), "known_values": F.col(n)}
        for n in wanted if n in kinds])


def target_leakage(df: DataFrame, features=tuple(c.FEATURE_TYPES), target: str = c.TARGET,
                   threshold: float = CORRELATION_LIMIT) -> DataFrame:
    """Correlation of every numeric feature with the target and whether it gives it away."""
    _, pairs = _numeric_pairs(df, features, target)
    return _coefficients(df, pairs).select(
        _named([a for a, _ in pairs]).alias("feature"),
        round_even("coefficient", 4).alias("correlation_with_target"),
        F.expr(f"coalesce(abs(coefficient) > {number(threshold)}, false)").alias("leaks"))


def all_findings(df: DataFrame, features=tuple(c.FEATURE_TYPES), types=None, target: str = c.TARGET):
    """Every finding as (kind, feature); pairs are written a~b.

    Two scans: one for the plain aggregates, one for all correlations.
    """
    kinds = dict(df.dtypes)
    wanted = types or c.FEATURE_TYPES
    plain = _run(df, *[check(df, features) for check in (_nulls, _infinities, _constants, _flat, _twins)])
    found = plain.select("kind", "feature")
    among, leaks = _numeric_pairs(df, features, target if target in kinds else None)
    if among or leaks:
        kind = _named(["high_correlation"] * len(among) + ["target_leakage"] * len(leaks))
        name = _named([f"{a}~{b}" for a, b in among] + [a for a, _ in leaks])
        found = found.unionByName(
            _coefficients(df, among + leaks).where(F.abs("coefficient") > CORRELATION_LIMIT)
            .select(kind.alias("kind"), name.alias("feature")))
    known = [("missing_feature", n) for n in features if n not in kinds]
    known += [("type_mismatch", n) for n in features if n in kinds and kinds[n] not in wanted.get(n, ())]
    if known:
        found = found.unionByName(literal_table(df.sparkSession, {
            "kind": [k for k, _ in known], "feature": [n for _, n in known]}))
    return found


def quality_score(df: DataFrame, features=tuple(c.FEATURE_TYPES), types=None, target: str = c.TARGET):
    """One row: findings by kind, the score out of 100 and its grade."""
    if df.isEmpty():
        raise FeatureEngineeringError("an empty table cannot be audited")
    counts = all_findings(df, features, types, target).agg(*[
        F.count_if(F.col("kind") == k).alias(k) for k in c.QUALITY_PENALTIES])
    penalty = sum((F.col(k) * p for k, p in list(c.QUALITY_PENALTIES.items())), F.lit(0))
    score = F.greatest(F.lit(0), F.lit(100) - penalty).cast("int")
    grade = (F.when(F.col("score") >= 90, "EXCELLENT").when(F.col("score") >= 75, "GOOD")
             .when(F.col("score") >= 50, "DEGRADED").otherwise("CRITICAL"))
    return counts.withColumn("score", score).withColumn("grade", grade)
