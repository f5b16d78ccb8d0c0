import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom.errors import (
    FeatureEngineeringError, IngestionError, KPICalculationError, SchemaValidationError,
)
from churnloom.functions import clip, cut, flag, percent, round_even, similarity
from churnloom.operators import (
    feature_quality, features, health, ingest, kpi, profile, reports, rfm, risk, schema_checks, segments,
)
from churnloom.plans.stages import SMALL_ROWS, literal_table, shared_folder, small
from churnloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_cut_edges(spark):
    df = literal_table(spark, {"x": [-0.0005, 0.0, 6.0, 6.1, 12.0, 24.0, 48.0, 120.0, 121.0, None]})
    got = [r[0] for r in df.select(cut("x", c.TENURE_EDGES, c.TENURE_LABELS, True)).collect()]
    assert got == [None, "0-6m", "0-6m", "6-12m", "6-12m", "12-24m", "24-48m", "48m+", None, None]


def test_tenure_group_caps_long_tenures(spark):
    df = literal_table(spark, {"Tenure": [500.0, None]})
    assert [r[0] for r in df.select(features.tenure_group()).collect()] == ["48m+", None]


def test_clip_flag_percent_round(spark):
    null = F.lit(None).cast("double")
    assert one(spark, clip(null, 0.0, 100.0)) is None
    assert one(spark, clip(F.lit(120.0), 0.0, 100.0)) == 100.0
    assert one(spark, flag(null > 1)) == 0
    assert one(spark, percent(F.lit(1), F.lit(0))) == 0.0
    for value in (2.345, 0.125, -0.375, 2.675, 1e6 + 0.005):
        assert one(spark, round_even(F.lit(value), 2)) == np.round(value, 2)


def test_similarity(spark):
    assert one(spark, similarity(F.lit("Tenure"), F.lit("tenur"))) == pytest.approx(1 - 1 / 6)
    assert one(spark, similarity(F.lit("A"), F.lit("a"))) == 1.0
    assert one(spark, similarity(F.lit(""), F.lit(""))) == 1.0


def test_health_bands_on_their_edges(spark):
    df = literal_table(spark, {"x": [0.0, 39.99, 40.0, 59.99, 60.0, 74.99, 75.0, 89.99, 90.0, 100.0]})
    got = [r[0] for r in df.select(cut("x", c.HEALTH_EDGES, c.HEALTH_GRADES)).collect()]
    assert got == list("FFDDCCBBAA")


def test_risk_tiers_on_their_edges(spark):
    df = literal_table(spark, {"p": [0.0, 0.49999, 0.5, 0.74999, 0.75, 0.9, 1.0, None]})
    got = [r[0] for r in df.select(risk.risk_tier("p")).collect()]
    assert got == ["Low", "Low", "Medium", "Medium", "High", "Critical", "Critical", None]


def test_flags_treat_unknown_as_not_met(spark):
    types = {n: "double" for n in ("DaySinceLastOrder", "OrderCount", "CashbackAmount", "CouponUsed", "AppExposure")}
    types |= {n: "string" for n in ("PreferredLoginDevice", "RFM_Segment", "TenureGroup")}
    types |= {n: "int" for n in ("CustomerID", "SatisfactionScore", "Complain", "RuleBasedChurnIndicator")}
    row = literal_table(spark, {n: [None] for n in types}, types)
    assert all(segments.flag_segments(row).first()[f] == 0 for f in c.FLAG_LABELS)
    half = row.withColumn("CouponUsed", F.lit(3.0)).withColumn("RFM_Segment", F.lit("At Risk"))
    flagged = segments.flag_segments(half).first()
    assert flagged["is_discount_seeker"] == 1 and flagged["is_at_risk"] == 1


def test_missing_inputs_raise(spark):
    df = spark.range(1)
    for call, error in (
            (lambda: features.build_features(df), FeatureEngineeringError),
            (lambda: segments.flag_segments(df), KPICalculationError),
            (lambda: health.score_health(df), KPICalculationError),
            (lambda: kpi.calculate_kpis(df), KPICalculationError),
            (lambda: rfm.compute_rfm_scores(df), KPICalculationError),
            (lambda: rfm.assign_segments(df), KPICalculationError)):
        with pytest.raises(error):
            call()


def test_health_weights_must_add_up(mart):
    with pytest.raises(KPICalculationError):
        health.score_health(mart.featured, {"service_quality": 0.9, "purchase_momentum": 0.9,
                                            "app_engagement": 0.0, "tenure_loyalty": 0.0})


def test_zero_satisfaction_gives_no_friction_index(spark):
    df = literal_table(spark, {"Complain": [1], "SatisfactionScore": [0]})
    assert df.select(features.feature_columns()["ComplaintFrictionIndex"]).first()[0] is None


def test_required_columns_and_typos(dirty):
    renamed = dirty.withColumnRenamed("Tenure", "Tenur").drop("Churn")
    status = {r["column"]: r["status"] for r in ingest.required_columns(renamed).collect()}
    assert status["Tenur"] == "extra" and status["Churn"] == "missing" and status["OrderCount"] == "matched"
    typo = ingest.column_typos(renamed).collect()
    assert [(r["found"], r["expected"]) for r in typo] == [("Tenur", "Tenure")]
    with pytest.raises(SchemaValidationError, match="Tenur for Tenure"):
        ingest.ingest(renamed)


def test_downcast_keeps_every_value(spark):
    df = literal_table(spark, {"a": [1, -100], "b": [1, 40000], "c": [1, 2**40], "d": [0.5, None], "e": [0.1, 2.0]})
    small_df = ingest.downcast(df)
    assert dict(small_df.dtypes) == {"a": "tinyint", "b": "int", "c": "bigint", "d": "float", "e": "double"}
    assert sorted(map(str, small_df.collect())) == sorted(map(str, df.collect()))


def test_gate_and_summary(dirty):
    gate = ingest.quality_gate(dirty).first()
    assert not gate.columns_valid and not gate.duplicates_clean and not gate.overall_pass
    only = ingest.quality_gate(dirty.dropDuplicates(["CustomerID"]), expected=("CustomerID",)).first()
    assert only.overall_pass and only.dtypes_valid is False
    summary = ingest.dataset_summary(dirty).first()
    assert (summary.total_rows, summary.null_total, summary.duplicate_rows) == (7, 4, 0)


def test_findings_and_status(mart, dirty):
    report = schema_checks.validate(mart.raw).first()
    assert report.overall_status == "FAILED" and report.critical >= 1
    with pytest.raises(SchemaValidationError):
        schema_checks.validate(dirty, raise_on_critical=True)
    odd = dirty.withColumn("Tenure", F.lit(500.0)).withColumn("SatisfactionScore", F.lit(9))
    ranges = schema_checks.check_ranges(odd).collect()
    assert [(r["column"], r["details"]["boundary"], r["details"]["violation_count"]) for r in ranges] == [
        ("Tenure", "max", "7")]
    domains = {(r["column"], r["value"]): r["row_count"] for r in schema_checks.domain_violations(odd).collect()}
    assert domains[("SatisfactionScore", "9")] == 7
    clean = mart.table.select(*[r.name for r in c.RULES])
    assert schema_checks.validate(clean.where("CashbackAmount IS NOT NULL"), 150).first().overall_status in (
        "PASSED", "WARNINGS")


def test_profile_agrees_with_pandas(mart):
    frame = mart.raw.toPandas()
    for row in profile.numeric_profile(mart.raw).collect():
        series = frame[row["column"]].astype(float)
        assert row["null_count"] == series.isna().sum()
        assert row["mean"] == pytest.approx(series.mean(), abs=1e-4)
        assert row["std"] == pytest.approx(series.std(), abs=1e-4)
        assert row["skewness"] == pytest.approx(series.skew(), abs=1e-4)
        assert row["median"] == series.median() and row["q3"] == series.quantile(0.75)


def test_profile_of_special_columns(spark):
    df = literal_table(spark, {"CustomerID": [1, 2], "gap": [None, None], "same": [4.0, 4.0], "t": ["x", None]},
                       {"gap": "double"})
    rows = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    assert rows["gap"]["error"] == "Column contains only null values" and rows["gap"]["mean"] is None
    assert rows["same"]["is_constant"] and rows["same"]["skewness"] == 0.0 and rows["same"]["cv"] == 0.0
    found = {(r["anomaly"], r["column"]) for r in profile.anomalies(df).collect()}
    assert {("constant", "same"), ("constant", "t"), ("high_null", "gap"), ("high_null", "t")} <= found
    with pytest.raises(SchemaValidationError):
        profile.dataset_profile(df.where("CustomerID > 5"))


def test_feature_audit(spark):
    df = spark.range(40).select(
        F.col("id").alias("x"), (F.col("id") * 2.0).alias("a"), (F.col("id") * 2.0).alias("b"),
        F.lit(1.0).alias("k"), F.when(F.col("id") > 0, F.lit(math.inf)).alias("i"),
        (F.col("id") > 19).cast("int").alias("Churn"), ((F.col("id") > 19).cast("double") * 3).alias("l"))
    wanted = ("a", "b", "k", "i", "l", "gone")
    types = {n: ("double",) for n in wanted}
    found = {(r["kind"], r["feature"]) for r in feature_quality.all_findings(df, wanted, types).collect()}
    assert {("missing_feature", "gone"), ("missing_values", "i"), ("infinite_values", "i"), ("constant", "k"),
            ("zero_variance", "k"), ("high_correlation", "a~b"), ("duplicate", "a~b"),
            ("target_leakage", "l")} <= found
    row = feature_quality.quality_score(df, wanted, types).first()
    assert row["grade"] == "CRITICAL" and row["score"] < 50
    with pytest.raises(FeatureEngineeringError):
        feature_quality.quality_score(df.limit(0), wanted, types)


def test_cohorts_and_categories_without_members_are_listed(mart):
    nobody = mart.table.where("CustomerID < 0")
    cohorts = segments.cohort_summary(nobody).collect()
    assert len(cohorts) == 12 and all(r["customer_count"] == 0 and r["percentage"] == 0.0 for r in cohorts)
    categories = health.category_summary(nobody).collect()
    assert len(categories) == 5 and all(r["customer_count"] == 0 for r in categories)
    assert kpi.calculate_kpis(nobody).first()["total_customers"] == 0


def test_reports_partition_the_base(mart):
    n = mart.table.count()
    assert sum(r["count"] for r in risk.tier_counts(mart.scored).collect()) == n
    assert sum(r["customer_count"] for r in health.category_summary(mart.table).collect()) == n
    listed = reports.attention_list(mart.scored).collect()
    assert len(listed) <= 10 and [r.CustomerHealthScore for r in listed] == sorted(
        r.CustomerHealthScore for r in listed)


def test_customer_profile(mart):
    row = reports.customer_profile(mart.scored, 50003).first()
    assert row["profile"]["customer_id"] == 50003 and row["rfm"]["rfm_sum"] >= 3
    with pytest.raises(KPICalculationError):
        reports.customer_profile(mart.scored, -1)


def test_files(spark, dirty, tmp_path):
    for fmt in ("csv", "json", "parquet", "orc"):
        path = str(tmp_path / fmt)
        files.write_table(dirty.drop("src_seq"), path, fmt)
        back = files.read_customers(spark, path, fmt)
        assert back.count() == 7 and "src_seq" in back.columns
        assert back.where("CustomerID = 711").count() == 2
        assert dict(back.dtypes)["Tenure"] == "double"
        from churnloom.operators import clean

        assert clean.drop_duplicates(back).count() == 6
    files.write_mart(dirty, str(tmp_path / "mart"))
    assert spark.read.parquet(str(tmp_path / "mart")).count() == 7
    assert files.source_files(spark.read.parquet(str(tmp_path / "mart"))).agg(F.sum("rows")).first()[0] == 7
    with pytest.raises(IngestionError):
        files.read_customers(spark, str(tmp_path / "nowhere"))
    files.write_table(dirty.limit(0), str(tmp_path / "empty"))
    with pytest.raises(IngestionError):
        files.read_customers(spark, str(tmp_path / "empty"))
    with pytest.raises(IngestionError):
        files.read_customers(spark, "x", "xlsx")


def test_headers_are_trimmed_on_read(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(" CustomerID ,Tenure\n1,2\n")
    assert files.read_customers(spark, str(path), "csv").columns[:2] == ["CustomerID", "Tenure"]


def test_small_tables_are_marked_and_large_ones_are_not(spark):
    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(small(spark.range(10), "t"))
    big = small(spark.range(SMALL_ROWS + 5), "t")
    assert not hinted(big) and big.count() == SMALL_ROWS + 5
    assert shared_folder(spark)


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
