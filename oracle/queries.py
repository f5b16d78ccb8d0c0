"""Expected result of every query as SQL over the same parquet tables."""

from __future__ import annotations

from itertools import combinations

from churnloom import contract as c
from churnloom import playbooks
from churnloom.operators import kpi, reports, schema_checks
from oracle.base import RULES, case_map, cut, exact_mean, flag, rnd, text, trimmed, upto

COLUMNS = list(c.SOURCE_COLUMNS)
BUSINESS = ", ".join(COLUMNS)
NUMERIC = [n for n, t in c.SOURCE_TYPES.items() if t != "string"]
TEXT = [n for n, t in c.SOURCE_TYPES.items() if t == "string"]


def union(parts) -> str:
    return "\nUNION ALL ".join(parts)


def values(columns, rows) -> str:
    """A literal table of texts (strings), numbers (others) or nulls."""
    def lit(v):
        return "NULL" if v is None else text(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + (
        f") AS t({', '.join(columns)})")


def pct(part, whole, digits=2) -> str:
    return rnd(f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / {whole} * 100.0::DOUBLE ELSE 0.0::DOUBLE END", digits)


def long(source, columns, cast="DOUBLE", keep="") -> str:
    return union(f"SELECT {keep}{text(n)} AS series, CAST({n} AS {cast}) AS value FROM {source}" for n in columns)


def select(stage, columns, extra="") -> str:
    return upto(stage, f"SELECT {columns} FROM {stage}", extra)


def nulls(n, source="raw") -> str:
    return f"(SELECT count(*) FILTER (WHERE {n} IS NULL) FROM {source})"


def printf(template, *args) -> str:
    return f"printf({text(template)}, {', '.join(f'CAST({a} AS VARCHAR)' for a in args)})"


# --- ingestion and contract ------------------------------------------------------------------

def ingestion() -> dict[str, str]:
    domain = [(r.name, str(v)) for r in c.RULES if r.allowed is not None for v in r.allowed]
    closed = [r.name for r in c.RULES if r.allowed is not None]
    cells = f"cells AS ({long('raw', closed, 'VARCHAR')}), dom AS (SELECT * FROM {values(['col', 'expected'], domain)})"
    odd = (cells + ", odd AS (SELECT series, value, count(*) AS row_count FROM cells WHERE value IS NOT NULL "
           "AND NOT EXISTS (SELECT 1 FROM dom WHERE col = series AND expected = value) GROUP BY 1, 2)")
    like = "1.0::DOUBLE - levenshtein(lower(expected), lower(value)) / CAST(greatest(length(expected), length(value)) AS DOUBLE)"
    gate = ("SELECT count(*) AS total_rows, CAST(20 AS BIGINT) AS total_columns, TRUE AS columns_valid, "
            "TRUE AS dtypes_valid, count(*) = count(DISTINCT CustomerID) AS duplicates_clean, "
            "count(*) = count(DISTINCT CustomerID) AS overall_pass FROM raw")
    keys = "dup AS (SELECT CustomerID, count(*) AS row_count FROM raw GROUP BY 1 HAVING count(*) > 1)"
    known = lambda n: f"(SELECT count({n}) FROM raw)"
    total_nulls = "(" + " + ".join(nulls(n) for n in COLUMNS) + ")"
    plan = []
    for n, t in c.SOURCE_TYPES.items():
        if t == "double":
            choice = (f"CASE WHEN count(*) FILTER (WHERE CAST(CAST({n} AS FLOAT) AS DOUBLE) <> {n}) = 0 "
                      "THEN 'float' ELSE 'double' END")
        elif t in ("int", "bigint"):
            top = f"greatest(abs(min({n})), abs(max({n})))"
            last = f"WHEN {top} <= 2147483647 THEN 'int' " if t == "bigint" else ""
            choice = (f"CASE WHEN {top} <= 127 THEN 'tinyint' WHEN {top} <= 32767 THEN 'smallint' "
                      f"{last}ELSE '{t}' END")
        else:
            continue
        plan.append(f"SELECT {text(n)} AS \"column\", {text(t)} AS from_type, {choice} AS to_type FROM raw")
    q = {
        "s1_read_dataset": select("raw", "*"),
        "s5_ingest_gate": upto("raw", gate),
        "s6_csv_round_trip": select("mart", "*"),
        "s6_parquet_round_trip": select("mart", "*"),
        "v1_required_columns": upto("raw", union(
            f"SELECT {text(n)} AS \"column\", 'matched' AS status, {known(n)} AS known_values" for n in COLUMNS)),
        "v2_spelling_suggestions": upto("raw", (
            f"SELECT series AS \"column\", value AS found, expected, {rnd(like, 4)} AS similarity, row_count "
            f"FROM odd JOIN dom ON col = series WHERE {like} >= 0.75::DOUBLE"), odd),
        "v3_type_conformity": upto("raw", union(
            f"SELECT {text(n)} AS \"column\", {text(t)} AS expected, {text(t)} AS actual, TRUE AS matches, "
            f"{known(n)} AS known_values" for n, t in c.SOURCE_TYPES.items())),
        "v4_duplicate_keys": upto("raw", "SELECT * FROM dup", keys),
        "v4_duplicate_total": upto("raw", (
            "SELECT CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_duplicates, count(*) AS duplicate_keys, "
            "coalesce(sum(row_count), 0) = 0 AS is_clean FROM dup"), keys),
        "v5_null_profile": upto("raw", union(
            f"SELECT {text(n)} AS \"column\", {nulls(n)} AS null_count, "
            f"{pct(nulls(n), '(SELECT count(*) FROM raw)')} AS null_percentage, {nulls(n)} > 0 AS has_nulls"
            for n in COLUMNS)),
        "v5_null_total": upto("raw", (
            f"SELECT CAST({total_nulls} AS BIGINT) AS total_nulls, "
            f"{pct(total_nulls, '((SELECT count(*) FROM raw) * 20)')} AS null_percentage_overall")),
        "v6_quality_gate": upto("raw", gate),
        "v7_downcast_plan": upto("raw", union(plan)),
        "v8_dataset_summary": upto("raw", (
            "SELECT count(*) AS total_rows, CAST(20 AS BIGINT) AS total_columns, "
            f"{text(','.join(NUMERIC))} AS numeric_columns, {text(','.join(TEXT))} AS categorical_columns, "
            f"CAST({total_nulls} AS BIGINT) AS null_total, "
            f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {BUSINESS} FROM raw)) AS duplicate_rows FROM raw")),
    }
    PLANTED = (
        "planted AS (SELECT * REPLACE (CASE WHEN CustomerID % 13 = 0 THEN -3.0::DOUBLE WHEN CustomerID % 17 = 0 "
        "THEN 130.5::DOUBLE ELSE Tenure END AS Tenure, CASE WHEN CustomerID % 19 = 0 THEN 9 ELSE SatisfactionScore END "
        "AS SatisfactionScore) FROM raw)")
    M = schema_checks.MESSAGES
    null_rows, range_rows = [], []
    for r in c.RULES:
        n, share = nulls(r.name), pct(nulls(r.name), "(SELECT count(*) FROM raw)")
        null_rows.append(
            f"SELECT 'nullability' AS rule, {text(r.name)} AS \"column\", '{'info' if r.nullable else 'critical'}' AS severity, "
            f"{printf(M['nullable' if r.nullable else 'not_null'], text(r.name), f'format({text(chr(123) + chr(58) + chr(44) + chr(125))}, {n})', share)} AS message, "
            f"CAST({n} AS VARCHAR) AS null_count, CAST({share} AS VARCHAR) AS null_percentage WHERE {n} > 0")
        for side, limit, op, ext in (("below", r.low, "<", "min"), ("above", r.high, ">", "max")):
            if limit is None:
                continue
            count = f"(SELECT count(*) FILTER (WHERE {r.name} {op} {limit}) FROM raw)"
            actual = f"(SELECT CAST({ext}({r.name}) AS DOUBLE) FROM raw)"
            range_rows.append(
                f"SELECT 'numeric_range' AS rule, {text(r.name)} AS \"column\", 'warning' AS severity, "
                f"{printf(M[side], text(r.name), count, limit, actual)} AS message, '{ext}' AS boundary, "
                f"CAST({actual} AS VARCHAR) AS actual_extreme, CAST({count} AS VARCHAR) AS violation_count WHERE {count} > 0")
    n_rows = "(SELECT count(*) FROM raw)"
    dev = f"(abs({n_rows} - 5000) / 5000.0::DOUBLE)"
    drift = union([
        f"SELECT 'schema_drift' AS rule, CAST(NULL AS VARCHAR) AS \"column\", 'warning' AS severity, "
        f"{printf(M['row_drift'], text('5,000'), f'format({text(chr(123) + chr(58) + chr(44) + chr(125))}, {n_rows})', f'CAST(round_even({dev} * 100.0::DOUBLE, 0) AS BIGINT)')} AS message, "
        f"CAST({n_rows} AS VARCHAR) AS actual_rows, CAST({rnd(dev + ' * 100.0::DOUBLE', 1)} AS VARCHAR) AS deviation_pct "
        f"WHERE {dev} > 0.5",
        f"SELECT 'schema_drift', CAST(NULL AS VARCHAR), 'info', {text(M['order_drift'])}, NULL, NULL"])
    unique = (
        f"SELECT 'uniqueness' AS rule, 'CustomerID' AS \"column\", 'critical' AS severity, "
        f"{printf(M['unique'], text('CustomerID'), 'sum(row_count)', 'count(*)')} AS message, "
        "CAST(CAST(sum(row_count) AS BIGINT) AS VARCHAR) AS duplicate_row_count, CAST(count(*) AS VARCHAR) AS unique_duplicated_keys, "
        "(SELECT string_agg(CAST(CustomerID AS VARCHAR), ',' ORDER BY CustomerID) FROM (SELECT CustomerID FROM dup ORDER BY 1 LIMIT 10)) AS sample_keys "
        "FROM dup HAVING count(*) > 0")
    domains = (
        "SELECT 'categorical_domain' AS rule, series AS \"column\", 'warning' AS severity, "
        f"{printf(M['domain'], 'series', 'count(*)')} AS message, CAST(count(*) AS VARCHAR) AS invalid_values, "
        "CAST(CAST(sum(row_count) AS BIGINT) AS VARCHAR) AS row_count FROM odd GROUP BY series")
    every = (f"{keys}, {odd}, found AS (SELECT rule, \"column\", severity, message FROM ({union(null_rows)}) "
             f"UNION ALL SELECT rule, \"column\", severity, message FROM ({union(range_rows)}) "
             f"UNION ALL SELECT rule, \"column\", severity, message FROM ({drift}) "
             f"UNION ALL SELECT rule, \"column\", severity, message FROM ({unique}) "
             f"UNION ALL SELECT rule, \"column\", severity, message FROM ({domains}))")
    sev = lambda s: f"count(*) FILTER (WHERE severity = '{s}')"
    registry = []
    joined = lambda v: None if v is None else ",".join(str(x) for x in v)
    for r in c.RULES:
        allowed = "CAST(NULL AS VARCHAR)" if r.allowed is None else text(joined(r.allowed))
        number = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"{v}::DOUBLE"
        registry.append(
            f"SELECT {text(r.name)} AS name, {text(r.category)} AS category, {text(joined(r.types))} AS types, "
            f"{text(r.nullability)} AS nullability, TRUE AS is_mandatory, {str(r.unique).upper()} AS \"unique\", "
            f"{allowed} AS allowed_values, {number(r.low)} AS min_value, {number(r.high)} AS max_value, "
            f"{text(r.description)} AS description, {text(c.SOURCE_TYPES[r.name])} AS actual_type, {known(r.name)} AS known_values")
    one = "FROM (SELECT count(*) AS n FROM raw) WHERE n >= 0"
    q |= {
        "a1_presence": upto("raw", (
            f"SELECT 'column_presence' AS rule, 'MaritalStatus' AS \"column\", 'critical' AS severity, "
            f"{text(M['missing'] % 'MaritalStatus')} AS message {one} UNION ALL "
            f"SELECT 'column_presence', 'Region', 'info', {text(M['extra'] % 'Region')} {one}")),
        "a2_types": upto("raw", (
            f"SELECT 'data_type' AS rule, 'CityTier' AS \"column\", 'warning' AS severity, "
            f"{text(M['type'] % ('CityTier', 'string', str(list(c.BY_NAME['CityTier'].types))))} AS message, "
            f"'string' AS actual {one}")),
        "a3_nullability": upto("raw", union(null_rows)),
        "a4_uniqueness": upto("raw", unique, keys),
        "a5_domain_values": upto("raw", 'SELECT series AS "column", value, row_count FROM odd', odd),
        "a5_domain_findings": upto("raw", domains, odd),
        "a6_ranges": upto("raw", union(range_rows).replace("FROM raw)", "FROM planted)"), PLANTED),
        "a7_drift": upto("raw", drift),
        "a8_by_severity": upto("raw", union(
            f"SELECT '{s}' AS severity, {sev(s)} AS findings FROM found" for s in schema_checks.SEVERITIES), every),
        "a9_by_rule": upto("raw", (
            "SELECT rule, count(*) AS findings, coalesce(string_agg(\"column\", ',' ORDER BY \"column\"), '') AS columns "
            "FROM found GROUP BY rule"), every),
        "a10_validate": upto("raw", (
            f"SELECT CASE WHEN {sev('critical')} > 0 THEN 'FAILED' WHEN {sev('warning')} > 0 THEN 'WARNINGS' "
            f"ELSE 'PASSED' END AS overall_status, {sev('critical')} AS critical, {sev('warning')} AS warning, "
            f"{sev('info')} AS info FROM found"), every),
        "a11_registry": upto("raw", union(registry)),
    }
    return q


# --- profile -----------------------------------------------------------------------------------

def _numeric_facts(source, columns, extra_select="") -> str:
    return (
        f"cells AS ({long(source, columns)}),\n"
        "f AS (SELECT series, count(*) AS total, count(value) AS n, avg(value) AS mean, "
        "coalesce(stddev_samp(value), 0) AS sd, coalesce(var_samp(value), 0) AS var, min(value) AS lo, max(value) AS hi, "
        "quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3, "
        "CASE WHEN count(value) > 2 THEN coalesce(skewness(value), 0) ELSE 0 END AS skew FROM cells GROUP BY 1),\n"
        "g AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5::DOUBLE * (q3 - q1) AS low, q3 + 1.5::DOUBLE * (q3 - q1) AS high, "
        "CASE WHEN mean <> 0 THEN sd / mean ELSE 0 END AS cv FROM f)")


def _text_facts(source, columns) -> str:
    return (
        f"tcells AS ({long(source, columns, 'VARCHAR')}),\n"
        "vc AS (SELECT series, value, count(*) AS cnt FROM tcells WHERE value IS NOT NULL GROUP BY 1, 2),\n"
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY cnt DESC, value) AS rn FROM vc),\n"
        "tf AS (SELECT series, count(*) AS total, count(*) FILTER (WHERE value IS NULL) AS gaps, "
        "count(DISTINCT value) AS uniq FROM tcells GROUP BY 1),\n"
        "tg AS (SELECT tf.*, r.value AS top, coalesce(r.cnt, 0) AS top_n FROM tf LEFT JOIN ranked r ON r.series = tf.series AND rn = 1)")


def profiles() -> dict[str, str]:
    facts = _numeric_facts("raw", NUMERIC)
    texts = _text_facts("raw", TEXT)
    low_var = "(lo = hi OR sd < 0.001 OR abs(cv) < 0.01)"
    low_text = "(uniq = 1 OR CAST(top_n AS DOUBLE) / (total - gaps) > 0.95)"
    high_card = "(CAST(uniq AS DOUBLE) / total > 0.2 AND uniq > 10)"
    distinct = f"(SELECT count(*) FROM (SELECT DISTINCT {BUSINESS} FROM raw))"
    total_nulls = "(" + " + ".join(nulls(n) for n in COLUMNS) + ")"
    small = ("small AS (SELECT CustomerID, 1 AS OneValue, TenureGroup, RFM_Score, CashbackAmount, "
             "CASE WHEN Complain = 1 THEN OrderCount END AS MostlyNull FROM mart),\n")
    anomalies = small + _numeric_facts("small", ["CustomerID", "OneValue", "CashbackAmount", "MostlyNull"]) + ",\n" + (
        _text_facts("small", ["TenureGroup", "RFM_Score"])) + (
        f",\nu AS (SELECT series, lo = hi AS k, {low_var} AS v, FALSE AS h, (total - n) * 100.0 / total > 30 AS g FROM g "
        f"UNION ALL SELECT series, uniq = 1, {low_text}, {high_card}, gaps * 100.0 / total > 30 FROM tg)")
    return {
        "p1_numeric_profile": upto("raw", (
            "SELECT series AS \"column\", total AS total_count, total - n AS null_count, "
            f"{pct('(total - n)', 'total', 4)} AS null_percentage, {rnd('mean', 4)} AS mean, {rnd('sd', 4)} AS std, "
            f"{rnd('var', 4)} AS variance, {rnd('cv', 4)} AS cv, lo AS min, q1, med AS median, q3, hi AS max, "
            f"{rnd('iqr', 4)} AS iqr, {rnd('skew', 4)} AS skewness FROM g"), facts),
        "p2_outliers": upto("raw", (
            f"SELECT series AS \"column\", {rnd('low', 4)} AS outlier_lower, {rnd('high', 4)} AS outlier_upper, "
            "(SELECT count(*) FROM cells x WHERE x.series = g.series AND (value < low OR value > high)) AS outlier_count, "
            f"{pct('(SELECT count(*) FROM cells x WHERE x.series = g.series AND (value < low OR value > high))', 'total', 4)} "
            "AS outlier_percentage FROM g"), facts),
        "p2_outlier_samples": upto("raw", (
            f"SELECT w.series AS \"column\", CAST(row_number() OVER (PARTITION BY w.series ORDER BY CustomerID, src_seq) AS INTEGER) AS position, "
            f"CustomerID, value FROM ({long('raw', NUMERIC, keep='CustomerID, src_seq, ')}) w JOIN g ON g.series = w.series "
            "WHERE value < low OR value > high QUALIFY position <= 5"), facts),
        "p3_variance_flags": upto("raw", (
            f"SELECT series AS \"column\", lo = hi AS is_constant, {low_var} AS is_low_variance FROM g"), facts),
        "p4_categorical_profile": upto("raw", (
            f"SELECT series AS \"column\", total AS total_count, gaps AS null_count, {pct('gaps', 'total', 4)} AS null_percentage, "
            f"uniq AS unique_values_count, {rnd('CAST(uniq AS DOUBLE) / total', 4)} AS cardinality_ratio, top AS top_value, "
            f"{pct('top_n', 'total', 4)} AS top_value_percentage FROM tg"), texts),
        "p5_top_values": upto("raw", (
            "SELECT series AS \"column\", CAST(rn AS INTEGER) AS position, value, cnt AS count, "
            f"{pct('cnt', '(SELECT count(*) FROM raw)', 4)} AS percentage FROM ranked WHERE rn <= 10"), texts),
        "p6_cardinality_flags": upto("raw", (
            f"SELECT series AS \"column\", uniq = 1 AS is_constant, {high_card} AS is_high_cardinality, "
            f"{low_text} AS is_low_variance FROM tg"), texts),
        "p7_dataset_profile": upto("raw", (
            "SELECT count(*) AS total_rows, CAST(20 AS BIGINT) AS total_columns, count(*) * 20 AS total_cells, "
            f"CAST({total_nulls} AS BIGINT) AS total_nulls, "
            f"{rnd(f'CAST(count(*) * 20 - {total_nulls} AS DOUBLE) / (count(*) * 20) * 100.0::DOUBLE', 4)} AS completeness_score_pct, "
            f"count(*) - {distinct} AS duplicate_rows_count, {pct(f'(count(*) - {distinct})', 'count(*)', 4)} AS duplicate_rows_pct, "
            "count(*) - count(DISTINCT CustomerID) AS pk_duplicate_count, "
            f"{pct('(count(*) - count(DISTINCT CustomerID))', 'count(*)', 4)} AS pk_duplicate_pct FROM raw")),
        "p8_anomalies": upto("mart", union(
            f"SELECT '{kind}' AS anomaly, series AS \"column\" FROM u WHERE {col}"
            for kind, col in (("constant", "k"), ("low_variance", "v"), ("high_cardinality", "h"), ("high_null", "g"))),
            anomalies),
    }


# --- cleaning ------------------------------------------------------------------------------------

def cleaning() -> dict[str, str]:
    exact = f"SELECT {BUSINESS}, min(src_seq) AS src_seq FROM trimmed GROUP BY ALL"
    drop = (f"once AS (SELECT {BUSINESS}, min(src_seq) AS src_seq FROM trimmed GROUP BY ALL HAVING count(*) = 1)")
    last = ("SELECT * FROM trimmed QUALIFY row_number() OVER (PARTITION BY CustomerID ORDER BY src_seq DESC) = 1")
    filled = lambda choice: "SELECT CustomerID, " + ", ".join(
        f"coalesce({n}, {choice(n)}) AS {n}" for n in c.IMPUTE_NUMERIC) + " FROM prepared"
    synonyms = "SELECT * REPLACE (" + ", ".join(
        f"CASE {n} " + " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in m.items()) + f" ELSE {n} END AS {n}"
        for n, m in c.SYNONYMS.items()) + ") FROM trimmed"
    mode = ("gap AS (SELECT CustomerID, nullif(PreferredPaymentMode, 'UPI') AS m FROM prepared), "
            "top AS (SELECT m AS t FROM gap WHERE m IS NOT NULL GROUP BY m ORDER BY count(*) DESC, m LIMIT 1)")
    audit = union(
        f"SELECT {text(n)} AS \"column\", {nulls(n, 'prepared')} AS imputed_count, 'median' AS strategy, "
        f"'grouped median by PreferedOrderCat (fallback global ' || CAST((SELECT median({n}) FROM prepared) AS VARCHAR) || ')' AS description "
        f"WHERE {nulls(n, 'prepared')} > 0" for n in c.IMPUTE_NUMERIC)
    clip_audit = union(
        f"SELECT {text(n)} AS \"column\", lo_{n} AS lower_bound, hi_{n} AS upper_bound, "
        f"(SELECT count(*) FROM imputed WHERE {n} < lo_{n}) AS below_capped, (SELECT count(*) FROM imputed WHERE {n} > hi_{n}) AS above_capped, "
        f"(SELECT count(*) FROM imputed WHERE {n} < lo_{n} OR {n} > hi_{n}) AS total_capped FROM bounds" for n in c.CLIP_COLUMNS)
    clean_types = {**c.SOURCE_TYPES, "NumberOfAddress": "double"}
    narrow = "SELECT * REPLACE (" + ", ".join(
        f"CAST({n} AS {'FLOAT' if t == 'double' else 'INTEGER'}) AS {n}"
        for n, t in clean_types.items() if t in ("double", "bigint")) + ") FROM clean"
    distinct = f"(SELECT count(*) FROM (SELECT DISTINCT {BUSINESS} FROM trimmed))"
    return {
        "c1_trim_text": select("trimmed", "*"),
        "c2a_exact_duplicates": upto("trimmed", exact),
        "c2b_keep_first": upto("trimmed", last.replace(" DESC", "")),
        "c2b_keep_last": upto("trimmed", last),
        "c2b_drop_all": upto("trimmed", "SELECT * FROM once QUALIFY count(*) OVER (PARTITION BY CustomerID) = 1", drop),
        "c2_duplicate_audit": upto("trimmed", (
            "SELECT count(*) AS initial_rows, count(DISTINCT CustomerID) AS final_rows, "
            f"count(*) - {distinct} AS exact_duplicates_removed, {distinct} - count(DISTINCT CustomerID) AS pk_duplicates_removed, "
            "count(*) - count(DISTINCT CustomerID) AS total_removed FROM trimmed")),
        "c3_merge_synonyms": upto("trimmed", synonyms),
        "c4a_grouped_median": select("imputed", "CustomerID, " + ", ".join(c.IMPUTE_NUMERIC)),
        "c4b_global_median": upto("prepared", filled(lambda n: f"(SELECT median({n}) FROM prepared)")),
        "c4c_global_mean": upto("prepared", filled(lambda n: f"(SELECT avg({n}) FROM prepared)")),
        "c4d_mode": upto("prepared", "SELECT CustomerID, coalesce(m, (SELECT t FROM top)) AS PreferredPaymentMode FROM gap", mode),
        "c4e_constant": upto("prepared", "SELECT CustomerID, coalesce(m, 'Missing') AS PreferredPaymentMode FROM gap", mode),
        "c4f_imputation_audit": upto("prepared", audit),
        "c5a_clip": select("clean", "CustomerID, " + ", ".join(c.CLIP_COLUMNS)),
        "c5b_clip_audit": upto("clean", clip_audit),
        "c6_enforce_types": upto("clean", narrow),
        "c7_clean": select("clean", "*"),
    }


# --- features and their audit ----------------------------------------------------------------------

NUMERIC_FEATURES = [n for n, t in c.FEATURE_TYPES.items() if "string" not in t]


def feature_queries() -> dict[str, str]:
    q = {f"f{i}_{n}": select("feat", f"CustomerID, {n}") for i, n in enumerate(c.FEATURE_TYPES, 1)}
    kind = lambda n: ("string" if "string" in c.FEATURE_TYPES[n] else "int" if n == "RuleBasedChurnIndicator"
                      else "double")
    known = lambda n: f"(SELECT count({n}) FROM mart)"
    pairs = list(combinations(NUMERIC_FEATURES, 2))
    score = lambda found: f"""SELECT {', '.join(f"CAST({found.get(k, '0')} AS BIGINT) AS {k}" for k in c.QUALITY_PENALTIES)}"""
    penalty = "+".join(f"{k} * {p}" for k, p in c.QUALITY_PENALTIES.items())

    def graded(found, source):
        return upto("mart", (
            f"SELECT *, CAST(greatest(0, 100 - ({penalty})) AS INTEGER) AS score, CASE WHEN 100 - ({penalty}) >= 90 THEN 'EXCELLENT' "
            f"WHEN 100 - ({penalty}) >= 75 THEN 'GOOD' WHEN 100 - ({penalty}) >= 50 THEN 'DEGRADED' ELSE 'CRITICAL' END AS grade FROM s"),
            source + f"s AS ({score(found)})")

    def audited(source, features, kinds):
        numeric = [n for n in features if kinds(n) != "string"]
        count = lambda parts: "(" + " + ".join(parts) + ")"
        same = [(a, b) for a, b in combinations(features, 2) if kinds(a) == kinds(b)]
        return {
            "missing_feature": str(len(c.FEATURE_TYPES) - len(features)),
            "missing_values": count(f"(SELECT CAST(count(*) > count({n}) AS INTEGER) FROM {source})" for n in features),
            "constant": count(f"(SELECT CAST(coalesce(min({n}) = max({n}), FALSE) AS INTEGER) FROM {source})" for n in features),
            "zero_variance": count(f"(SELECT CAST(coalesce(stddev_samp({n}), 0) = 0 AS INTEGER) FROM {source})" for n in numeric),
            "high_correlation": count(
                f"(SELECT CAST(coalesce(abs(corr({a}, {b})) > 0.9, FALSE) AS INTEGER) FROM {source})" for a, b in combinations(numeric, 2)),
            "duplicate": count(
                f"(SELECT CAST(bool_and({a} IS NOT DISTINCT FROM {b}) AS INTEGER) FROM {source})" for a, b in same),
            "target_leakage": count(f"(SELECT CAST(coalesce(abs(corr({n}, Churn)) > 0.9, FALSE) AS INTEGER) FROM {source})" for n in numeric),
        }

    everything = list(c.FEATURE_TYPES)
    damaged = [n for n in everything if n != "TenureGroup"]
    leaky = "w AS (SELECT * REPLACE (Churn * 2.0::DOUBLE AS AppExposure) FROM mart), "
    q |= {
        "f13_build_features": select("feat", "*"),
        "f13_registry": upto("mart", union(
            f"SELECT {text(n)} AS feature, '{kind(n)}' AS dtype, {text(c.FEATURE_TEXT[n])} AS description, {known(n)} AS known_values"
            for n in everything)),
        "q1_presence": upto("mart", union(
            f"SELECT {text(n)} AS feature, {str(n != 'AppExposure').upper()} AS present, "
            f"{known(n) if n != 'AppExposure' else '0::BIGINT'} AS known_values" for n in everything)),
        "q2_nulls": upto("mart", "SELECT * FROM (" + union(
            f"SELECT {text(n)} AS feature, (SELECT count(*) - count({n}) FROM w) AS null_count" for n in everything) + ") WHERE null_count > 0",
            "w AS (SELECT * REPLACE (CASE WHEN Complain = 0 THEN OrderVelocity END AS OrderVelocity) FROM mart)"),
        "q3_infinities": upto("mart", (
            "SELECT 'OrderVelocity' AS feature, count(*) AS infinite_count FROM mart WHERE Complain = 1 HAVING count(*) > 0")),
        "q4_constants": upto("mart", "SELECT 'AppExposure' AS feature FROM mart HAVING count(*) > 0"),
        "q5_zero_variance": upto("mart", "SELECT 'AppExposure' AS feature FROM mart HAVING count(*) > 0"),
        "q6_correlations": upto("mart", union(
            f"SELECT {text(a)} AS feature_a, {text(b)} AS feature_b, (SELECT {rnd(f'corr({a}, {b})', 4)} FROM mart) AS coefficient"
            for a, b in pairs)),
        "q6_high_correlation": upto("mart", "SELECT * FROM (" + union(
            f"SELECT {text(a)} AS feature_a, {text(b)} AS feature_b, (SELECT {rnd(f'abs(corr({a}, {b}))', 4)} FROM w) AS correlation_coef"
            for a, b in pairs) + ") WHERE correlation_coef > 0.9",
            "w AS (SELECT * REPLACE (AppExposure * 2.0::DOUBLE + 1.0::DOUBLE AS OrderVelocity) FROM mart)"),
        "q7_duplicates": upto("mart", (
            "SELECT 'OrderVelocity' AS feature_a, 'CashbackEfficiency' AS feature_b FROM mart HAVING count(*) > 0")),
        "q8_types": upto("mart", union(
            f"SELECT {text(n)} AS feature, '{'string' if n == 'AppExposure' else kind(n)}' AS actual, "
            f"{text(','.join(c.FEATURE_TYPES[n]))} AS expected, {str(n != 'AppExposure').upper()} AS conforms, {known(n)} AS known_values"
            for n in everything)),
        "q9_target_leakage": upto("mart", union(
            f"SELECT {text(n)} AS feature, (SELECT {rnd(f'corr({n}, Churn)', 4)} FROM w) AS correlation_with_target, "
            f"(SELECT coalesce(abs(corr({n}, Churn)) > 0.9, FALSE) FROM w) AS leaks" for n in NUMERIC_FEATURES),
            "w AS (SELECT * REPLACE (Churn * 2.0::DOUBLE AS AppExposure) FROM mart)"),
        "q10_quality_score": graded(audited("mart", everything, kind), ""),
        "q11_degraded_score": graded(audited("w", damaged, kind), leaky),
    }
    return q


# --- segments, health, indicators --------------------------------------------------------------------

def segment_queries() -> dict[str, str]:
    n_all = "(SELECT count(*) FROM mart)"
    cohorts = union(
        f"SELECT {text(label)} AS cohort, '{f}' AS flag, CAST(coalesce(sum({f}), 0) AS BIGINT) AS customer_count, "
        f"{pct(f'sum({f})', 'count(*)')} AS percentage, {rnd(f'coalesce(avg(CASE WHEN {f} = 1 THEN Churn END), 0) * 100.0::DOUBLE', 2)} AS segment_churn_rate_pct, "
        + ", ".join(f"{text(t)} AS {k}" for k, t in zip(playbooks.COHORT_FIELDS, playbooks.COHORT_TEXTS[label])) + " FROM mart"
        for f, label in c.FLAG_LABELS.items())
    risks = dict(zip(c.HEALTH_CATEGORIES, c.HEALTH_RISKS))
    cats = values(["cat", "risk", "descr", "act"], [
        (n, risks[n], *playbooks.HEALTH_TEXTS[n]) for n in c.HEALTH_CATEGORIES])
    avg0 = lambda x: f"coalesce(avg({x}), 0)"
    q = {
        "r1_quintile": select("rfm", "CustomerID, Recency_Score"),
        "r2_scores": select("rfm", "CustomerID, Recency_Score, Frequency_Score, Monetary_Score"),
        "r3_composite": select("rfm", "CustomerID, RFM_Score, RFM_Sum"),
        "r4_segments": select("rfm", "CustomerID, RFM_Score, RFM_Segment"),
        "r5_recommendations": select("rfm", "CustomerID, RFM_Segment, RFM_Recommendation"),
        "r6_segment_statistics": upto("mart", (
            f"SELECT RFM_Segment, count(*) AS customer_count, {pct('count(*)', n_all)} AS percentage, "
            f"{rnd('avg(DaySinceLastOrder)', 1)} AS average_recency_days, {rnd('avg(OrderCount)', 1)} AS average_frequency_orders, "
            f"{rnd(exact_mean('CashbackAmount', 4), 2)} AS average_monetary_cashback, {rnd('avg(Churn) * 100.0::DOUBLE', 2)} AS churn_rate_percentage, "
            f"{case_map('RFM_Segment', playbooks.RFM_ACTIONS, playbooks.RFM_DEFAULT_ACTION)} AS recommendation FROM mart GROUP BY RFM_Segment")),
        "r7_analyze": select("rfm", "*"),
        "g13_cohort_summary": upto("mart", cohorts),
        "h1_service_quality": select("mart", "CustomerID, Service_Quality_Score"),
        "h2_purchase_momentum": select("mart", "CustomerID, Purchase_Momentum_Score"),
        "h3_app_engagement": select("mart", "CustomerID, App_Engagement_Score"),
        "h4_tenure_loyalty": select("mart", "CustomerID, Tenure_Loyalty_Score"),
        "h5_health_score": select("mart", "CustomerID, CustomerHealthScore"),
        "h6_bands": select("mart", "CustomerID, Health_Category, Health_Grade, Risk_Level"),
        "h7_category_summary": upto("mart", (
            f"SELECT cat AS Health_Category, count(CustomerID) AS customer_count, {pct('count(CustomerID)', n_all)} AS percentage, "
            f"{rnd(avg0('Churn') + ' * 100.0::DOUBLE', 2)} AS churn_rate_pct, {rnd(avg0('SatisfactionScore'), 2)} AS csat, "
            f"{rnd(avg0('Complain') + ' * 100.0::DOUBLE', 2)} AS complaint_rate_pct, {rnd(avg0('DaySinceLastOrder'), 1)} AS recency_days, "
            f"{rnd(avg0('Tenure'), 1)} AS tenure_months, risk AS risk_level, descr AS description, act AS playbook_action "
            f"FROM {cats} LEFT JOIN mart ON Health_Category = cat GROUP BY cat, risk, descr, act")),
        "h8_overall": upto("mart", (
            f"SELECT count(*) AS total_customers_evaluated, {rnd(exact_mean('CustomerHealthScore', 2), 2)} AS average_health_score, "
            f"{pct('count(*) FILTER (WHERE CustomerHealthScore >= 75)', 'count(*)')} AS healthy_percentage, "
            f"{pct('count(*) FILTER (WHERE CustomerHealthScore < 40)', 'count(*)')} AS critical_percentage, "
            + ", ".join(f"{v}::DOUBLE AS weight_{k}" for k, v in c.HEALTH_WEIGHTS.items()) + " FROM mart")),
    }
    q |= {f"g{i}_{f}": select("mart", f"CustomerID, {f}") for i, f in enumerate(RULES, 1)}
    return q


def _kpi_sql() -> str:
    share = lambda f: pct(f"sum({f})", "count(*)")
    n = lambda k: f"count(*) FILTER (WHERE Churn = {k})"
    sized = "(SELECT RFM_Segment FROM (SELECT RFM_Segment, count(*) AS n FROM mart GROUP BY 1) ORDER BY n {}, RFM_Segment LIMIT 1)"
    cells = {
        "total_customers": "count(*)", "active_customers": n(0), "churned_customers": n(1),
        "churn_rate_pct": pct(n(1), "count(*)"), "retention_rate_pct": pct(n(0), "count(*)"),
        "avg_satisfaction_score": rnd("avg(SatisfactionScore)", 2),
        "complaint_rate_pct": pct("count(*) FILTER (WHERE Complain = 1)", "count(*)"),
        "avg_app_usage_hours": rnd("avg(HourSpendOnApp)", 2),
        "avg_cashback_amount": rnd(exact_mean("CashbackAmount", 4), 2), "avg_order_count": rnd("avg(OrderCount)", 2),
        "high_engagement_pct": share("is_high_engagement"), "high_loyalty_pct": share("is_loyal"),
        "mobile_first_pct": share("is_mobile_first"), "discount_seeker_pct": share("is_discount_seeker"),
        "frequent_buyer_pct": share("is_frequent_buyer"), "champions_pct": share("is_champion"),
        "loyal_customers_pct": share("is_loyal"), "at_risk_pct": share("is_at_risk"),
        "high_value_pct": share("is_high_value"), "complaint_prone_pct": share("is_complaint_prone"),
        "avg_rfm_sum": rnd("avg(RFM_Sum)", 2), "top_rfm_segment": sized.format("DESC"),
        "weakest_rfm_segment": sized.format("ASC"), "customer_health_index": rnd("avg(RawHealthIndex)", 2),
        "engagement_index": rnd("avg(AppExposure)", 2),
        "satisfaction_index_pct": rnd("avg(SatisfactionScore) / 5.0::DOUBLE * 100.0::DOUBLE", 2),
        "loyalty_index": rnd("avg(CustomerLoyaltyScore)", 2),
    }
    return "kpi AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in cells.items()) + " FROM mart)"


def kpi_queries() -> dict[str, str]:
    base = _kpi_sql()
    group_of = {n: g for g, names in kpi.GROUPS.items() for n in names}
    s = lambda n: f"CAST({n} AS VARCHAR)"
    advice = [
        (1, "churn_rate_pct > 15", f"'CRITICAL: Churn rate is elevated at ' || {s('churn_rate_pct')} || '%. Immediately activate the At-Risk cohort retention campaigns and check for coupon usage anomalies.'"),
        (1, "churn_rate_pct <= 15", f"'STABLE: Churn rate is within threshold at ' || {s('churn_rate_pct')} || '%. Focus on expanding LTV across high-value segments.'"),
        (2, "(avg_satisfaction_score < 3.5 OR complaint_rate_pct > 20)", f"'CX WARNING: CSAT rating is ' || {s('avg_satisfaction_score')} || '/5.0 and complaint rate is high at ' || {s('complaint_rate_pct')} || '%. Audit warehouse operations, shipping intervals, and delivery distance bottlenecks.'"),
        (2, "NOT (avg_satisfaction_score < 3.5 OR complaint_rate_pct > 20)", f"'HEALTHY: Customer sentiment is strong (CSAT = ' || {s('avg_satisfaction_score')} || '/5.0). Maintain operational SLA targets.'"),
        (3, "discount_seeker_pct > 50", f"'MARGIN RISK: ' || {s('discount_seeker_pct')} || '% of the customer base are Discount Seekers. Transition from straight discount coupons to purchase bundles and loyalty points to protect gross margins.'"),
        (4, "mobile_first_pct > 60", f"'CHANNEL STRATEGY: Mobile-first users dominate the base (' || {s('mobile_first_pct')} || '%). Prioritize mobile app feature updates and deploy cart recovery push notifications.'"),
        (5, "customer_health_index < 2", f"'HEALTH ALERT: Overall customer health index is low (' || {s('customer_health_index')} || '). Execute service recovery campaigns for dissatisfied customers.'"),
    ]
    q = {
        "k0_all": upto("mart", "SELECT * FROM kpi", base),
        "k8_recommendations": upto("mart", (
            "SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS position, recommendation FROM (" + union(
                f"SELECT {o} AS o, {t} AS recommendation FROM kpi WHERE {w}" for o, w, t in advice) + ")"), base),
        "k9_dictionary": upto("mart", union(
            f"SELECT '{group_of[n]}' AS kpi_group, '{n}' AS kpi, {text(t)} AS title, {text(d)} AS description, {s(n)} AS value FROM kpi"
            for n, (t, d) in playbooks.KPI_TEXTS.items()), base),
    }
    for i, (group, names) in enumerate(kpi.GROUPS.items(), 1):
        q[f"k{i}_{group}"] = upto("mart", f"SELECT {', '.join(names)} FROM kpi", base)
    return q


# --- risk, explanations, reports -----------------------------------------------------------------------

def _contributions() -> str:
    """Of every encoded input: the numbers, then each value of each text column in order."""
    amount = lambda k: f"CAST((CustomerID * (7 + {k})) % 2001 - 1000 AS DOUBLE) / 1000.0::DOUBLE AS contribution"
    hot = union(f"SELECT DISTINCT {i} AS col, {n} AS v FROM scored WHERE {n} IS NOT NULL" for i, n in enumerate(c.MODEL_CATEGORICAL))
    numbers = [f"SELECT CustomerID, Churn_Probability, '{n}' AS feature, CAST({n} AS DOUBLE) AS value, {amount(i)} FROM scored"
               for i, n in enumerate(c.MODEL_NUMERIC)]
    texts = [f"SELECT CustomerID, Churn_Probability, '{n}_' || v AS feature, CASE WHEN {n} = v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, "
             f"{amount('place')} FROM scored CROSS JOIN hot WHERE col = {i}" for i, n in enumerate(c.MODEL_CATEGORICAL)]
    return (f"hot AS (SELECT col, v, {len(c.MODEL_NUMERIC)} + row_number() OVER (ORDER BY col, v) - 1 AS place FROM ({hot})),\n"
            "contrib AS (" + union(numbers + texts) + ")")


def _drivers() -> str:
    part = lambda name, op, sign: (
        f"SELECT CustomerID, Churn_Probability, '{name}' AS direction, CAST(row_number() OVER (PARTITION BY CustomerID "
        f"ORDER BY contribution {sign}, feature) AS INTEGER) AS position, feature, value, contribution FROM contrib WHERE contribution {op}")
    return _contributions() + ",\ndrv AS (SELECT * FROM (" + union([
        part("positive", "> 0.001::DOUBLE", "DESC"), part("negative", "< -0.001::DOUBLE", "ASC")]) + ") WHERE position <= 5)"


def _histogram(source, column, edges, labels) -> str:
    rows = values(["bin", "position"], [(label, i) for i, label in enumerate(labels)])
    return upto(source, (
        f"SELECT bin, CAST(position AS INTEGER) AS position, count(b) AS count FROM {rows} LEFT JOIN "
        f"(SELECT {cut(column, edges, labels)} AS b FROM {source}) ON b = bin GROUP BY 1, 2"))


def _ordered(source, column, order) -> str:
    rows = values(["v", "position"], [(v, i) for i, v in enumerate(order)])
    return upto(source, (
        f"SELECT v AS {column}, CAST(position AS INTEGER) AS position, count({column}) AS count FROM {rows} "
        f"LEFT JOIN {source} ON {column} = v GROUP BY 1, 2"))


def report_queries() -> dict[str, str]:
    counts = lambda source, col: upto(source, f"SELECT {col}, count(*) AS count FROM {source} GROUP BY 1")
    tiers = union(
        f"SELECT '{t}' AS risk_tier, count(*) FILTER (WHERE Prediction_Risk_Level = '{t}') AS count, "
        f"{pct(f'count(*) FILTER (WHERE Prediction_Risk_Level = {text(t)})', 'count(*)')} AS percentage FROM scored" for t, _ in c.RISK_TIERS)
    risk_cols = "CustomerID, Churn_Prediction, Churn_Probability, Prediction_Confidence, Prediction_Risk_Level, Prediction_CRM_Action"
    importance = ("imp AS (SELECT feature, " + rnd("avg(abs(contribution))", 6) + " AS importance FROM contrib GROUP BY 1)")
    share = f"printf('%.1f%%', {rnd('Churn_Probability * 100.0::DOUBLE', 1)})"
    tier = ("CASE WHEN Churn_Probability >= 0.9 THEN 'Critical' WHEN Churn_Probability >= 0.75 THEN 'High' "
            "WHEN Churn_Probability >= 0.5 THEN 'Medium' ELSE 'Low' END")
    lines = lambda d, t: (
        f"coalesce((SELECT chr(10) || string_agg(printf('{t}', replace(feature, '_', ' '), {rnd('contribution', 2)}), chr(10) ORDER BY position) "
        f"FROM drv WHERE drv.CustomerID = s.CustomerID AND direction = '{d}' AND position <= 3), '')")
    narrative = (
        f"SELECT CustomerID, {rnd('Churn_Probability', 4)} AS churn_probability, {tier} AS risk_level, CASE WHEN Churn_Probability >= 0.5 THEN "
        f"'Customer ' || CAST(CustomerID AS VARCHAR) || ' is flagged at Churn Risk (' || {share} || ') driven primarily by:' || {lines('positive', '  - High %s (Impact: +%.2f)')} ELSE "
        f"'Customer ' || CAST(CustomerID AS VARCHAR) || ' is classified as Low Churn Risk (' || {share} || '). Active indicators include:' || {lines('negative', '  - Positive %s (Impact: %.2f)')} END "
        "AS executive_summary FROM scored s")
    grid = lambda extra: upto("scored", (
        'SELECT CustomerID AS "Customer ID", Churn_Probability AS "Churn Prob", Prediction_Confidence AS "Certainty", '
        'Prediction_Risk_Level AS "Risk Level", CustomerHealthScore AS "Health Score", Prediction_CRM_Action AS "CS Playbook Campaign Play" '
        f"FROM scored WHERE Churn_Probability >= 0.5::DOUBLE{extra}"))
    member = lambda f, x: f"CASE WHEN {f} = 1 THEN {x} END"
    averages = union(
        f"SELECT '{f.removeprefix('is_')}' AS segment, {rnd(f'coalesce(avg({member(f, 'Churn_Prediction')}), 0) * 100.0::DOUBLE', 2)} AS predicted_churn_pct, "
        f"{rnd(f'coalesce({exact_mean(member(f, 'CustomerHealthScore'), 2)}, 0)', 2)} AS avg_health_score, "
        f"{rnd(f'coalesce(avg({member(f, 'SatisfactionScore')}), 0)', 2)} AS avg_satisfaction, "
        f"{rnd(f'coalesce({exact_mean(member(f, 'CashbackAmount'), 4)}, 0)', 2)} AS avg_cashback FROM scored" for f in reports.AVERAGED_FLAGS)
    penetration = union(
        f"SELECT '{f}' AS flag, CAST(coalesce(sum({f}), 0) AS BIGINT) AS count, {pct(f'sum({f})', 'count(*)')} AS percentage FROM mart" for f in c.FLAG_LABELS)
    at = lambda t: f"(SELECT count(*) FROM scored WHERE Prediction_Risk_Level = '{t}')"
    fields = {
        "d6_profile": ("customer_id=CustomerID gender=Gender marital_status=MaritalStatus city_tier=CityTier preferred_login_device=PreferredLoginDevice "
                       "preferred_payment_mode=PreferredPaymentMode preferred_order_category=PreferedOrderCat"),
        "d6_activity": ("tenure_months=Tenure days_since_last_order=DaySinceLastOrder order_count=OrderCount hour_spend_on_app=HourSpendOnApp "
                        "number_of_device_registered=NumberOfDeviceRegistered number_of_address=NumberOfAddress complain_logged=Complain "
                        "satisfaction_score=SatisfactionScore cashback_amount=CashbackAmount coupon_used=CouponUsed"),
        "d6_rfm": ("recency_score=Recency_Score frequency_score=Frequency_Score monetary_score=Monetary_Score composite_rfm_score=RFM_Score "
                   "rfm_sum=RFM_Sum rfm_segment=RFM_Segment crm_recommendation=RFM_Recommendation"),
        "d6_health": ("health_score=CustomerHealthScore health_category=Health_Category health_grade=Health_Grade risk_level=Risk_Level "
                      "service_quality_score=Service_Quality_Score purchase_momentum_score=Purchase_Momentum_Score "
                      "app_engagement_score=App_Engagement_Score tenure_loyalty_score=Tenure_Loyalty_Score"),
        "d6_predictions": ("predicted_churn=Churn_Prediction churn_probability=Churn_Probability confidence_score=Prediction_Confidence "
                           "prediction_risk_tier=Prediction_Risk_Level crm_retention_action=Prediction_CRM_Action"),
    }
    q = {
        name: upto("scored", "SELECT CustomerID, " + ", ".join(
            f"{p.split('=')[1]} AS {p.split('=')[0]}" for p in spec.split()) + " FROM scored")
        for name, spec in fields.items()}
    q |= {
        "m17_risk_tiers": select("scored", risk_cols),
        "m18_crm_actions": counts("scored", "Prediction_CRM_Action"),
        "m19_batch_statistics": upto("scored", (
            f"SELECT count(*) AS total_predictions, {rnd('avg(Churn_Probability)', 4)} AS average_churn_probability, 'Unknown' AS algorithm_used FROM scored")),
        "m19_tier_counts": upto("scored", tiers),
        "x1_importance_given": upto("scored", "SELECT * FROM imp", _contributions() + ", " + importance),
        "x3_drivers": upto("scored", "SELECT CustomerID, direction, position, feature, value, contribution FROM drv", _drivers()),
        "x4_narrative": upto("scored", narrative, _drivers()),
        "d1_mart": select("mart", "*"),
        "d4_dashboard_summary": upto("scored", (
            "SELECT total_customers, active_customers, churned_customers, churn_rate_pct, retention_rate_pct, "
            f"(SELECT {rnd(exact_mean('CustomerHealthScore', 2), 2)} FROM mart) AS average_health_score, avg_satisfaction_score AS average_satisfaction, "
            f"complaint_rate_pct, {at('Critical')} AS critical_risk_count, {at('High')} AS high_risk_count FROM kpi"), _kpi_sql()),
        "d5_report_tables": upto("scored", (
            "SELECT 'kpis' AS report, CAST(1 AS BIGINT) AS rows UNION ALL SELECT 'health_overall', 1 UNION ALL SELECT 'health_categories', 5 "
            "UNION ALL SELECT 'cohorts', 12 UNION ALL SELECT 'risk_tiers', 4 "
            "UNION ALL SELECT 'rfm_segments', count(DISTINCT RFM_Segment) FROM mart "
            "UNION ALL SELECT 'global_importance', count(DISTINCT feature) FROM contrib"), _contributions()),
        "d7_run_metadata": upto("mart", "SELECT 'ONLINE' AS service_status, count(*) AS processed_records_count FROM mart"),
        "b1_health_categories": counts("mart", "Health_Category"),
        "b2_risk_tiers": _ordered("scored", "Prediction_Risk_Level", reports.TIER_ORDER),
        "b3_segments": counts("mart", "RFM_Segment"),
        "b4_flag_penetration": upto("mart", penetration),
        "b5_churn_by_complaint": upto("scored", union(
            f"SELECT '{label}' AS complaint, {rnd(f'coalesce(avg(CASE WHEN Complain = {k} THEN Churn_Prediction END), 0) * 100.0::DOUBLE', 2)} AS predicted_churn_rate_pct FROM scored"
            for k, label in ((0, "No Complaint"), (1, "Complaint Logged")))),
        "b6_satisfaction": counts("mart", "SatisfactionScore"),
        "b7_health_grades": _ordered("mart", "Health_Grade", reports.GRADE_ORDER),
        "b8_health_risks": _ordered("mart", "Risk_Level", reports.RISK_ORDER),
        "b9_service_quality_histogram": _histogram("mart", "Service_Quality_Score", reports.QUALITY_EDGES, reports.SCORE_LABELS),
        "b9_momentum_histogram": _histogram("mart", "Purchase_Momentum_Score", reports.SCORE_EDGES, reports.SCORE_LABELS),
        "b9_engagement_histogram": _histogram("mart", "App_Engagement_Score", reports.SCORE_EDGES, reports.SCORE_LABELS),
        "b10_attention_list": upto("scored", (
            "SELECT CustomerID, CustomerHealthScore, Health_Grade, Risk_Level, Churn_Probability, Prediction_CRM_Action FROM scored "
            "WHERE Prediction_Risk_Level IN ('High', 'Critical') ORDER BY CustomerHealthScore ASC NULLS LAST, CustomerID LIMIT 10")),
        "b11_mean_rfm_sum": upto("mart", f"SELECT {rnd('avg(RFM_Sum)', 4)} AS avg_rfm_sum FROM mart"),
        "b11_mean_rfm_sum_by_segment": upto("mart", f"SELECT RFM_Segment, {rnd('avg(RFM_Sum)', 4)} AS avg_rfm_sum FROM mart GROUP BY 1"),
        "b12_recency_scores": counts("mart", "Recency_Score"),
        "b12_frequency_scores": counts("mart", "Frequency_Score"),
        "b13_flag_averages": upto("scored", averages),
        "b14_largest_cohort": upto("mart", "SELECT flag, count FROM pen ORDER BY count DESC, flag LIMIT 1", f"pen AS ({penetration})"),
        "b15_scored_totals": upto("scored", (
            "SELECT count(*) AS total_scored, count(*) FILTER (WHERE Churn_Prediction = 1) AS predicted_churn, "
            f"count(*) FILTER (WHERE Churn_Prediction = 0) AS predicted_retained, {rnd(exact_mean('Churn_Probability', 4), 4)} AS avg_probability, "
            f"{rnd(exact_mean('Prediction_Confidence', 4), 4)} AS avg_confidence FROM scored")),
        "b16_probability_histogram": _histogram("scored", "Churn_Probability", reports.PROBABILITY_EDGES, reports.PROBABILITY_LABELS),
        "b17_confidence_histogram": _histogram("scored", "Prediction_Confidence", reports.CONFIDENCE_EDGES, reports.CONFIDENCE_LABELS),
        "b18_averages_by_tier": upto("scored", (
            f"SELECT Prediction_Risk_Level, {rnd(exact_mean('CustomerHealthScore', 2), 2)} AS avg_health_score, {rnd('avg(SatisfactionScore)', 2)} AS avg_satisfaction FROM scored GROUP BY 1")),
        "b19_probability_by_segment": upto("scored", (
            f"SELECT RFM_Segment, {rnd(exact_mean('Churn_Probability', 4) + ' * 100.0::DOUBLE', 2)} AS avg_churn_prob_pct FROM scored GROUP BY 1")),
        "b20_audit_grid": grid(""),
        "b20_audit_grid_high": grid(" AND Prediction_Risk_Level = 'High'"),
        "b21_top_drivers": upto("scored", "SELECT * FROM imp ORDER BY importance DESC, feature LIMIT 12", _contributions() + ", " + importance),
    }
    return q


# --- model inputs -------------------------------------------------------------------------------------

def model_queries() -> dict[str, str]:
    numbers = ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in c.MODEL_NUMERIC)
    cats = ", ".join(c.MODEL_CATEGORICAL)
    # Test rows: a fifth of each label, rounded up, in whole numbers.
    sizes = "sz AS (SELECT Churn AS y, count(*) AS n FROM mart GROUP BY 1), st AS (SELECT y, n, (n * 2 + 9) // 10 AS t FROM sz)"
    encoded = [
        f"SELECT '{n}' AS feature, CAST({i} AS INTEGER) AS position, (SELECT count(*) FILTER (WHERE coalesce({n}, 1) <> 0) FROM mart) AS non_zero"
        for i, n in enumerate(c.MODEL_NUMERIC)]
    hot = union(
        f"SELECT '{n}' || '_' || v AS feature, {i} AS col, v, n FROM (SELECT {n} AS v, count(*) AS n FROM mart WHERE {n} IS NOT NULL GROUP BY 1)"
        for i, n in enumerate(c.MODEL_CATEGORICAL))
    # Gaps are filled with the median; a column without variance is scaled to zero.
    filled = "whole_base AS (SELECT CustomerID, " + ", ".join(
        f"coalesce(CAST({n} AS DOUBLE), (SELECT median({n}) FROM mart)) AS {n}" for n in c.MODEL_NUMERIC) + " FROM mart)"
    mean = lambda n: (
        f"CASE WHEN (SELECT stddev_samp({n}) FROM whole_base) = 0 THEN 0.0::DOUBLE ELSE "
        f"({n} - (SELECT avg({n}) FROM whole_base)) / (SELECT stddev_samp({n}) FROM whole_base) END")
    every = lambda name: upto("mart", f"SELECT CustomerID, TRUE AS {name} FROM mart")
    four = lambda name: union(f"SELECT '{a}' AS algorithm, TRUE AS {name}" for a in (
        "LogisticRegression", "RandomForest", "GradientBoosting", "LeafwiseBoosting"))
    features = union([f"SELECT '{n}' AS feature" for n in c.MODEL_NUMERIC]) + f" UNION ALL SELECT feature FROM ({hot})"
    rows_of = union([
        f"SELECT CustomerID, '{n}' AS feature, coalesce(CAST({n} AS DOUBLE), (SELECT median({n}) FROM mart)) AS value FROM mart"
        for n in c.MODEL_NUMERIC] + [
        f"SELECT CustomerID, '{n}' || '_' || v AS feature, CASE WHEN {n} = v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value "
        f"FROM mart CROSS JOIN (SELECT DISTINCT {n} AS v FROM mart WHERE {n} IS NOT NULL)" for n in c.MODEL_CATEGORICAL])
    names = ("LogisticRegression", "RandomForest", "GradientBoosting", "LeafwiseBoosting")
    tests = ("SELECT CAST(sum(CASE WHEN y = 1 THEN t ELSE 0 END) AS BIGINT) AS positives, "
             "CAST(sum(CASE WHEN y = 0 THEN t ELSE 0 END) AS BIGINT) AS negatives, TRUE AS rates_follow FROM st")
    judged = lambda wanted: upto("mart", union(f"SELECT '{a}' AS algorithm, * FROM ({tests})" for a in wanted), sizes)
    # The training rows of each label are cut into five folds, equal up to one row.
    in_fold = lambda y: (
        f"(SELECT CAST((n - t) * (k + 1) // 5 - (n - t) * k // 5 AS BIGINT) FROM st WHERE y = {y})")
    folds = union(f"SELECT '{a}' AS algorithm, CAST(k AS INTEGER) AS fold, {in_fold(1)} AS positives, {in_fold(0)} AS negatives, "
                  "TRUE AS follows FROM range(5) AS r(k)" for a in names)
    # Every pair of a customer who left and one who stayed, in order or not.
    pairs = ("SELECT CAST({fit} AS INTEGER) AS fit, " + rnd(
        "avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)", 9) + " AS roc_auc "
        "FROM given a JOIN given b ON a.y = 1 AND b.y = 0{on} GROUP BY 1")
    with_p = "given AS (SELECT CityTier AS tier, Churn AS y, Churn_Probability AS p FROM scored WHERE CityTier IS NOT NULL)"
    given = "cm AS (SELECT " + ", ".join(
        f"count(*) FILTER (WHERE Churn = {a} AND Churn_Prediction = {b}) AS {k}"
        for k, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))) + " FROM scored)"
    div = lambda a, b: rnd(f"CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END", 4)
    return {
        "m12_confusion_given": upto("scored", "SELECT Churn AS label, Churn_Prediction AS prediction, count(*) AS rows FROM scored GROUP BY 1, 2"),
        "m12_rates_given": upto("scored", (
            f"SELECT tn, fp, fn, tp, {div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {div('tp', 'tp + fp')} AS precision, "
            f"{div('tp', 'tp + fn')} AS recall, {div('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cm"), given),
        "s8_same_when_loaded": every("same"), "d2_predict_only": every("same"), "m16_consistent_scores": every("consistent"),
        "x2_adds_up": every("adds_up"), "x3_x4_follow": every("follows"),
        "d6_explainability": upto("mart", "SELECT min(CustomerID) AS CustomerID, TRUE AS same FROM mart"),
        "d2_data_only": upto("mart", "SELECT * EXCLUDE (src_seq) FROM mart"),
        "m11_scores_in_range": four("in_range"), "m12_metrics_follow": four("follows"), "m13_winner_is_best": "SELECT TRUE AS is_best",
        "m14_features_in_order": f"SELECT CAST(i + 1 AS INTEGER) AS position, TRUE AS in_order FROM range(20) AS r(i)",
        "x1_importance_follows": upto("mart", f"SELECT feature, TRUE AS follows FROM ({features})"),
        "x5_encoded_rows": upto("mart", rows_of),
        "m7_logistic_regression": judged(names[:1]), "m8_random_forest": judged(names[1:2]), "m9_gradient_boosting": judged(names[2:3]),
        "m10_leafwise_boosting": judged(names[3:]), "m12_test_metrics": judged(names), "m11_cross_validation": upto("mart", folds, sizes),
        "m12_auc_given": upto("scored", pairs.format(fit="0", on="") + " UNION ALL " + pairs.format(fit="a.tier", on=" AND a.tier = b.tier"), with_p),
        "m13_winner": "SELECT CAST(4 AS BIGINT) AS candidates, CAST(1 AS BIGINT) AS winners",
        "m14_top_features": "SELECT CAST(i + 1 AS INTEGER) AS position, TRUE AS is_input FROM range(20) AS r(i)",
        "m15_leaderboard": "SELECT CAST(i + 1 AS INTEGER) AS place, i = 0 AS is_best, TRUE AS in_order FROM range(4) AS r(i)",
        "m16_batch_scoring": every("scored"), "s7_s8_model_round_trip": upto("mart", "SELECT count(*) AS customers FROM mart"),
        "x1_global_importance": upto("mart", f"SELECT feature, TRUE AS not_negative FROM ({features})"),
        "x2_contributions": upto("mart", f"SELECT CustomerID, feature, TRUE AS given FROM mart CROSS JOIN ({features})"),
        "x3_x4_explanations": upto("mart", "SELECT CustomerID, TRUE AS tier_fits, TRUE AS named FROM mart"),
        "v6_source_files": upto("raw", "SELECT count(*) AS rows, TRUE AS sized, TRUE AS named FROM raw"),
        "m1_model_inputs": upto("mart", f"SELECT CustomerID, {numbers}, {cats}, CAST(Churn AS DOUBLE) AS label FROM mart"),
        "m2_split_sizes": upto("mart", (
            "SELECT CAST(y AS DOUBLE) AS label, TRUE AS is_test, CAST(t AS BIGINT) AS rows FROM st "
            "UNION ALL SELECT CAST(y AS DOUBLE), FALSE, CAST(n - t AS BIGINT) FROM st"), sizes),
        "m2_fold_sizes": upto("mart", (
            "SELECT CAST(y AS DOUBLE) AS label, CAST(k AS INTEGER) AS fold, CAST(n * (k + 1) // 5 - n * k // 5 AS BIGINT) AS rows "
            "FROM sz CROSS JOIN range(5) AS r(k)"), sizes),
        "m3_class_balance": upto("mart", (
            "SELECT CAST(sum(n - t) AS BIGINT) AS rows, CAST(sum(CASE WHEN y = 1 THEN n - t END) AS BIGINT) AS positives, "
            "CAST(sum(CASE WHEN y = 0 THEN n - t END) AS BIGINT) AS negatives, CAST(sum(CASE WHEN y = 0 THEN n - t END) AS DOUBLE) / "
            "sum(CASE WHEN y = 1 THEN n - t END) AS ratio FROM st"), sizes),
        "m4_m6_encoded_inputs": upto("mart", (
            union(encoded) + f" UNION ALL SELECT feature, CAST({len(c.MODEL_NUMERIC)} + row_number() OVER (ORDER BY col, v) - 1 AS INTEGER), n FROM ({hot})")),
        "m5_scaled_inputs": upto("mart", union(
            f"SELECT CustomerID, '{n}' AS feature, {rnd(mean(n), 6)} AS scaled FROM whole_base" for n in c.MODEL_NUMERIC), filled),
    }


def oracle_sql() -> dict[str, str]:
    return {**ingestion(), **profiles(), **cleaning(), **feature_queries(), **segment_queries(), **kpi_queries(), **report_queries(),
            **model_queries()}
