"""Every operator as a runnable query over a folder of order tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom.functions import round_even
from churnloom.ml import narrative, prep, train
from churnloom.operators import (
    clean, feature_quality, features, health, ingest, kpi, profile, reports, rfm, risk, schema_checks,
    segments,
)
from churnloom.ml.explain import encoded_pairs
from churnloom.ml.score import ChurnPredictor
from churnloom.plans import modes, service
from churnloom.plans.mart import CustomerMart, mart_for
from churnloom.plans.stages import new_path
from churnloom.sources import files

def _gappy(m: CustomerMart) -> DataFrame:
    """Prepared rows in which one payment mode is unknown, to have text to impute."""
    mode = F.col("PreferredPaymentMode")
    return m.prepared.withColumn("PreferredPaymentMode", F.when(mode != "UPI", mode))


def _text_imputed(m: CustomerMart, strategy: str) -> DataFrame:
    df = _gappy(m)
    model = clean.fit_imputation(
        df, categorical_strategy=strategy, numeric_columns=(), categorical_columns=("PreferredPaymentMode",))
    return model.apply(df).select("CustomerID", "PreferredPaymentMode")


def _number_imputed(m: CustomerMart, **strategy) -> DataFrame:
    model = clean.fit_imputation(m.prepared, **strategy)
    return model.apply(m.prepared).select("CustomerID", *c.IMPUTE_NUMERIC)


def _findings(df: DataFrame, **entries: str) -> DataFrame:
    picked = [F.col("details")[key].alias(name) for name, key in entries.items()]
    return df.select("rule", "column", "severity", "message", *picked)


def _round_trip(m: CustomerMart, fmt: str) -> DataFrame:
    path = new_path(m.table.sparkSession, f"export-{fmt}")
    files.write_table(m.table, path, fmt)
    return files.read_customers(m.table.sparkSession, path, fmt, schema=m.table.schema)


def _out_of_range(m: CustomerMart) -> DataFrame:
    """Raw rows with values planted below and above their bounds."""
    k = F.col("CustomerID")
    return m.raw.withColumns({
        "Tenure": F.when(k % 13 == 0, -3.0).when(k % 17 == 0, 130.5).otherwise(F.col("Tenure")),
        "SatisfactionScore": F.when(k % 19 == 0, 9).otherwise(F.col("SatisfactionScore"))})


def _contributions(m: CustomerMart) -> DataFrame:
    """Stand-in contributions of every encoded input: fixed arithmetic on the customer number."""
    found = m.table.agg(*[F.sort_array(F.collect_set(n)).alias(n) for n in c.MODEL_CATEGORICAL]).first()  # the contract's few values
    inputs = [(n, F.col(n).cast("double")) for n in c.MODEL_NUMERIC] + [
        (f"{n}_{v}", F.when(F.col(n) == v, 1.0).otherwise(0.0)) for n in c.MODEL_CATEGORICAL for v in found[n]]
    entries = [
        F.struct(F.lit(name).alias("feature"), value.alias("value"),
                 ((F.pmod(F.col("CustomerID") * (7 + i), F.lit(2001)) - 1000) / 1000.0).alias("contribution"))
        for i, (name, value) in enumerate(inputs)]
    return m.scored.withColumn("contributions", F.array(*entries))


def _given(m: CustomerMart) -> DataFrame:
    return m.scored.select(
        F.col("Churn").alias("label"), F.col("Churn_Prediction").alias("prediction"))


def _encoder(m: CustomerMart):
    return prep.fit_preprocessor(prep.model_inputs(m.table))


def _scaled(m: CustomerMart) -> DataFrame:
    """Every standardised number of every customer."""
    numbers = F.slice(vector_to_array(prep.SCALED), 1, len(c.MODEL_NUMERIC))
    names = F.array(*[F.lit(n) for n in c.MODEL_NUMERIC])
    encoded = prep.encode(_encoder(m), prep.model_inputs(m.table), keep=["CustomerID"])
    return encoded.select("CustomerID", F.posexplode(numbers).alias("at", "scaled")).select(
        "CustomerID", F.get(names, "at").alias("feature"), round_even("scaled", 6).alias("scaled"))


def _saved_reports(m: CustomerMart) -> DataFrame:
    """Every report written, read back and counted."""
    spark, folder = m.table.sparkSession, new_path(m.table.sparkSession, "reports")
    tables = service.report_tables(m, m.scored, narrative.global_importance(_contributions(m)))
    service.write_reports(tables, folder)
    united = None
    for name in tables:
        rows = service.read_report(spark, folder, name).agg(F.count("*").alias("rows")).withColumn(
            "report", F.lit(name))
        united = rows if united is None else united.unionByName(rows)
    return united


def _board(m: CustomerMart) -> DataFrame:
    return m.trained.leaderboard(m.table.sparkSession)


def _adds_up(m: CustomerMart) -> DataFrame:
    """Whether contributions and expected output make up each prediction."""
    rows, expected = m.explainer.contributions(m.table)
    total = F.aggregate("contributions", F.lit(expected), lambda s, d: s + d["contribution"])
    if m.predictor.algorithm != "RandomForest":
        total = 1.0 / (1.0 + F.exp(-total))
    return rows.select("CustomerID", (F.abs(total - F.col("p")) < 1e-6).alias("adds_up"))


def _importance_follows(m: CustomerMart) -> DataFrame:
    """Whether each importance is the mean of the absolute contributions, counted anew."""
    rows = m.explainer.contributions(m.table)[0]
    sizes = rows.select(F.posexplode(F.transform("contributions", lambda d: F.abs(d["contribution"])))).groupBy("pos").agg(
        (F.sum("col") / F.count("*")).alias("mean"))
    names = F.array(*[F.lit(n) for n in m.explainer.names])
    again = sizes.select(F.get(names, "pos").alias("feature"), "mean")
    return m.explainer.global_importance(m.table).join(again, "feature").select(
        "feature", (F.abs(F.col("importance") - F.col("mean")) < 1e-9).alias("follows"))


def _same_when_loaded(m: CustomerMart) -> DataFrame:
    """Whether a model gives each customer the same probability before and after it was saved."""
    kept = ChurnPredictor(m.trained.stages, m.trained.model, m.trained.algorithm).transform(m.table).select(
        "CustomerID", F.col("p").alias("before"))
    return m.predictor.transform(m.table).select("CustomerID", "p").join(kept, "CustomerID").select(
        "CustomerID", (F.col("p") == F.col("before")).alias("same"))


def _consistent_scores(m: CustomerMart) -> DataFrame:
    """Whether prediction, confidence, tier and action of each customer follow from the probability."""
    p = F.col("p")
    expected = risk.with_risk(m.predictor.transform(m.table).select("CustomerID", "p"), "p")
    names = risk_columns()
    other = expected.select("CustomerID", "p", F.struct(*names).alias("expected"))
    found = m.predictor.predict(m.table).select("CustomerID", F.struct(*names).alias("found"))
    return found.join(other, "CustomerID").select("CustomerID", (
        (F.col("found") == F.col("expected")) & p.between(0, 1)).alias("consistent"))


def _explanations_follow(m: CustomerMart) -> DataFrame:
    """Whether tier, drivers and text of each explanation fit the contributions."""
    explained = m.explainer.explain(m.table)
    largest = m.explainer.contributions(m.table)[0].select(
        "CustomerID", F.array_max(F.transform("contributions", lambda d: d["contribution"])).alias("largest"))
    first = F.get("positive_drivers", F.lit(0))["contribution"]
    named = F.contains("executive_summary", F.concat(F.lit("Customer "), F.col("CustomerID").cast("string")))
    fits = named & (F.size("positive_drivers") <= 5) & (F.size("negative_drivers") <= 5) & (
        first.isNull() | (F.abs(first - F.col("largest")) < 1e-6))
    return explained.join(largest, "CustomerID").select("CustomerID", fits.alias("follows"))


def _metrics_follow(m: CustomerMart) -> DataFrame:
    """Whether the cells of each candidate add up to the test rows and its rates follow from them."""
    rows = prep.stratified_split(prep.model_inputs(m.table)).where("is_test").count()
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    follows = (n == rows) & (F.abs((F.col("tn") + F.col("tp")) / n - F.col("accuracy")) < 1e-4) & (
        F.abs(f1 - F.col("f1")) < 1e-4) & F.col("roc_auc").between(0, 1)
    return _board(m).select("algorithm", follows.alias("follows"))


def _winner_is_best(m: CustomerMart) -> DataFrame:
    best = F.max("f1").alias("best"), F.max(F.when(F.col("is_best"), F.col("f1"))).alias("winner")
    return _board(m).agg(*best, F.count_if("is_best").alias("n")).select(
        ((F.col("best") == F.col("winner")) & (F.col("n") == 1)).alias("is_best"))


def _features_in_order(m: CustomerMart) -> DataFrame:
    rows = train.top_features(m.trained.importance(m.table.sparkSession)).agg(
        F.collect_list("importance").alias("x"))  # the report has 20 rows
    return rows.select(F.posexplode("x").alias("at", "value"), "x").select(
        (F.col("at") + 1).cast("int").alias("position"),
        ((F.col("at") == 0) | (F.get("x", F.col("at") - 1) >= F.col("value"))).alias("in_order"))


def _data_only(m: CustomerMart) -> DataFrame:
    """The mart that the data-only mode writes, read back."""
    spark = m.table.sparkSession
    path, source = new_path(spark, "data-only"), new_path(spark, "source")
    files.write_table(m.raw, source)
    modes.run_data_only(spark, source, path)
    return files.read_customers(spark, path, "csv", schema=m.table.drop(c.SEQUENCE).schema, sequence=None)


def _predict_only(m: CustomerMart) -> DataFrame:
    """Whether the predict-only mode scores each customer as the model itself does."""
    spark = m.table.sparkSession
    model, source = new_path(spark, "model"), new_path(spark, "source")
    train.save(spark, m.trained, model)
    files.write_table(m.raw, source)
    scored, _ = modes.run_predict_only(spark, source, model)
    own = m.predictor.predict(m.table).select("CustomerID", F.col("Churn_Probability").alias("own"))
    return scored.join(own, "CustomerID").select("CustomerID", (F.col("Churn_Probability") == F.col("own")).alias("same"))


def _explainability(m: CustomerMart) -> DataFrame:
    """The explanation in the profile of one customer, looked up in the stored ones, beside one worked out anew."""
    customer = m.table.agg(F.min("CustomerID")).first()[0]
    profile = reports.customer_profile(m.scored, customer, m.explanation_of(customer))
    again = m.explainer.explain_customer(m.table, customer).select("CustomerID", F.col("executive_summary").alias("text"))
    return profile.join(again, "CustomerID").select(
        "CustomerID", (F.col("explainability.executive_summary") == F.col("text")).alias("same"))


def _gate_files(m: CustomerMart) -> DataFrame:
    """What the gate knows of the files behind the customer table."""
    found = files.source_files(m.raw.sparkSession.read.parquet(m.source))
    return found.agg(F.sum("rows").alias("rows"), (F.min("bytes") > 0).alias("sized"),
                     F.bool_and(F.endswith("path", F.lit(".parquet"))).alias("named"))


def _rates_follow(tn="tn", fp="fp", fn="fn", tp="tp"):
    """Whether the rates follow from the cells and the area lies between chance and 1."""
    tn, fp, fn, tp = map(F.col, (tn, fp, fn, tp))
    zero = F.lit(0.0)
    near = lambda name, a, b: F.abs(F.coalesce(F.try_divide(a, b), zero) - F.col(name)) < 1e-4
    return (near("accuracy", tn + tp, tn + fp + fn + tp) & near("precision", tp, tp + fp) & near("recall", tp, tp + fn)
            & near("f1", 2 * tp, 2 * tp + fp + fn) & F.col("roc_auc").between(0.5, 1))


def _judged(board: DataFrame) -> DataFrame:
    """Test rows of both classes that each candidate was judged on, and whether its rates follow."""
    return board.select("algorithm", (F.col("fn") + F.col("tp")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"),
                        _rates_follow().alias("rates_follow"))


def _candidate(name: str):
    return lambda m: _judged(m.trained_only(name).leaderboard(m.table.sparkSession).where(F.col("algorithm") == name))


def _cross_validation(m: CustomerMart) -> DataFrame:
    """Rows of both classes in each fold of each candidate, and whether mean and spread of F1 are those of the folds."""
    folds = m.trained.fold_table(m.table.sparkSession)
    summary = folds.groupBy("algorithm").agg(F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"))
    board = _board(m).join(summary, "algorithm").select("algorithm", (
        (F.abs(F.col("mean") - F.col("cv_f1_mean")) < 1e-4) & (F.abs(F.col("std") - F.col("cv_f1_std")) < 1e-4)).alias("follows"))
    return folds.join(board, "algorithm").select("algorithm", "fold", (F.col("fn") + F.col("tp")).alias("positives"),
                                                 (F.col("tn") + F.col("fp")).alias("negatives"), "follows")


def _areas_given(m: CustomerMart) -> DataFrame:
    """Area under the curve of the stand-in probability: of all customers, and by city tier."""
    given = m.scored.select(F.col("CityTier").cast("int").alias("fit"), F.col("Churn").cast("double").alias("label"),
                            F.col("Churn_Probability").alias("score")).where("fit IS NOT NULL")
    both = given.unionAll(given.withColumn("fit", F.lit(0)))
    return train.areas(both).select("fit", round_even("roc_auc", 9).alias("roc_auc"))


def _leaderboard(m: CustomerMart) -> DataFrame:
    """Places of the candidates, whether each is no better than the one before, and which one won."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("f1")).alias("less"), "algorithm", "is_best")))
    board = _board(m).agg(order.alias("b"))  # four rows
    return board.select(F.posexplode("b").alias("at", "row"), "b").select(
        (F.col("at") + 1).alias("place"), F.col("row.is_best").alias("is_best"),
        ((F.col("at") == 0) | (F.get("b", F.col("at") - 1)["less"] <= F.col("row.less"))).alias("in_order"))


def _top_features(m: CustomerMart) -> DataFrame:
    """Places of the reported inputs and whether each is an encoded input."""
    top = train.top_features(m.trained.importance(m.table.sparkSession)).agg(F.collect_list("feature").alias("f"))
    names = F.array(*[F.lit(n) for n in m.trained.names])
    return top.select(F.posexplode("f").alias("at", "feature")).select(
        (F.col("at") + 1).alias("position"), F.array_contains(names, F.col("feature")).alias("is_input"))


def _scored_batch(m: CustomerMart) -> DataFrame:
    """Every customer that was scored, and whether all that a score brings is there."""
    return m.predictor.predict(m.table).select("CustomerID", F.expr(" AND ".join(f"{n} IS NOT NULL" for n in risk_columns())).alias("scored"))


def _profile_part(part: str):
    return lambda m: reports.customer_profiles(m.scored).select("CustomerID", f"{part}.*")


def _predictions(m: CustomerMart) -> DataFrame:
    return m.scored.select("CustomerID", *risk_columns())


def risk_columns():
    return ("Churn_Prediction", "Churn_Probability", "Prediction_Confidence", "Prediction_Risk_Level",
            "Prediction_CRM_Action")


def _kpis(m: CustomerMart) -> DataFrame:
    return kpi.calculate_kpis(m.table)


def definitions() -> dict:
    """Query name to a function of the mart."""
    q = {
        # sources and sinks
        "s1_read_dataset": lambda m: files.read_customers(m.raw.sparkSession, m.source),
        "s5_ingest_gate": lambda m: ingest.ingest(m.raw, optimize=False)[1]["gate"],
        "s6_csv_round_trip": lambda m: _round_trip(m, "csv"),
        "s6_parquet_round_trip": lambda m: _round_trip(m, "parquet"),
        # ingestion gate
        "v1_required_columns": lambda m: ingest.required_columns(m.raw),
        "v2_spelling_suggestions": lambda m: ingest.suggest_spellings(
            schema_checks.domain_violations(m.raw), F.broadcast(schema_checks.domain_table(m.raw.sparkSession))),
        "v3_type_conformity": lambda m: ingest.type_conformity(m.raw),
        "v4_duplicate_keys": lambda m: ingest.duplicate_keys(m.raw),
        "v4_duplicate_total": lambda m: ingest.duplicate_total(m.raw),
        "v5_null_profile": lambda m: ingest.null_profile(m.raw),
        "v5_null_total": lambda m: ingest.null_total(m.raw),
        "v6_quality_gate": lambda m: ingest.quality_gate(m.raw),
        "v7_downcast_plan": lambda m: ingest.downcast_plan(m.raw),
        "v8_dataset_summary": lambda m: ingest.dataset_summary(m.raw),
        # contract validation
        "a1_presence": lambda m: schema_checks.check_presence(
            m.raw.drop("MaritalStatus").withColumn("Region", F.lit("x"))).select(
                "rule", "column", "severity", "message"),
        "a2_types": lambda m: _findings(schema_checks.check_types(
            m.raw.withColumn("CityTier", F.col("CityTier").cast("string"))), actual="actual_dtype"),
        "a3_nullability": lambda m: _findings(
            schema_checks.check_nulls(m.raw), null_count="null_count", null_percentage="null_percentage"),
        "a4_uniqueness": lambda m: _findings(
            schema_checks.check_unique(m.raw), duplicate_row_count="duplicate_row_count",
            unique_duplicated_keys="unique_duplicated_keys", sample_keys="sample_keys"),
        "a5_domain_values": lambda m: schema_checks.domain_violations(m.raw),
        "a5_domain_findings": lambda m: _findings(
            schema_checks.check_domains(m.raw), invalid_values="invalid_value_count", row_count="row_count"),
        "a6_ranges": lambda m: _findings(
            schema_checks.check_ranges(_out_of_range(m)), boundary="boundary", actual_extreme="actual_extreme",
            violation_count="violation_count"),
        "a7_drift": lambda m: _findings(
            schema_checks.check_drift(m.raw), actual_rows="actual_rows", deviation_pct="deviation_pct"),
        "a8_by_severity": lambda m: schema_checks.findings_by_severity(schema_checks.all_findings(m.raw)),
        "a9_by_rule": lambda m: schema_checks.findings_by_rule(schema_checks.all_findings(m.raw)).select(
            "rule", "findings", F.array_join(F.col("items.column"), ",").alias("columns")),
        "a10_validate": lambda m: schema_checks.validate(m.raw),
        "a11_registry": lambda m: schema_checks.registry_table(m.raw),
        # profile
        "p1_numeric_profile": lambda m: profile.numeric_profile(m.raw).drop(
            "outlier_lower", "outlier_upper", "outlier_count", "outlier_percentage", "is_constant",
            "is_low_variance", "error"),
        "p2_outliers": lambda m: profile.numeric_profile(m.raw).select(
            "column", "outlier_lower", "outlier_upper", "outlier_count", "outlier_percentage"),
        "p2_outlier_samples": lambda m: profile.outlier_samples(m.raw),
        "p3_variance_flags": lambda m: profile.numeric_profile(m.raw).select(
            "column", "is_constant", "is_low_variance"),
        "p4_categorical_profile": lambda m: profile.categorical_profile(m.raw).drop(
            "is_constant", "is_high_cardinality", "is_low_variance"),
        "p5_top_values": lambda m: profile.top_values(m.raw),
        "p6_cardinality_flags": lambda m: profile.categorical_profile(m.raw).select(
            "column", "is_constant", "is_high_cardinality", "is_low_variance"),
        "p7_dataset_profile": lambda m: profile.dataset_profile(m.raw),
        "p8_anomalies": lambda m: profile.anomalies(m.table.select(
            "CustomerID", F.lit(1).alias("OneValue"), "TenureGroup", "RFM_Score", "CashbackAmount",
            F.when(F.col("Complain") == 1, F.col("OrderCount")).alias("MostlyNull"))),
        # cleaning
        "c1_trim_text": lambda m: clean.trim_text(m.raw),
        "c2a_exact_duplicates": lambda m: clean.drop_duplicates(clean.trim_text(m.raw), primary_key=None),
        "c2b_keep_first": lambda m: clean.drop_duplicates(clean.trim_text(m.raw)),
        "c2b_keep_last": lambda m: clean.drop_duplicates(clean.trim_text(m.raw), keep="last"),
        "c2b_drop_all": lambda m: clean.drop_duplicates(clean.trim_text(m.raw), keep="drop"),
        "c2_duplicate_audit": lambda m: m.cleaned.duplicates(),
        "c3_merge_synonyms": lambda m: clean.merge_synonyms(clean.trim_text(m.raw)),
        "c4a_grouped_median": lambda m: _number_imputed(m),
        "c4b_global_median": lambda m: _number_imputed(m, group_by=None),
        "c4c_global_mean": lambda m: _number_imputed(m, numeric_strategy="mean"),
        "c4d_mode": lambda m: _text_imputed(m, "mode"),
        "c4e_constant": lambda m: _text_imputed(m, "Missing"),
        "c4f_imputation_audit": lambda m: m.cleaned.imputed(),
        "c5a_clip": lambda m: m.cleaned.df.select("CustomerID", *c.CLIP_COLUMNS),
        "c5b_clip_audit": lambda m: m.cleaned.capped(),
        "c6_enforce_types": lambda m: clean.enforce_types(m.cleaned.df),
        "c7_clean": lambda m: m.cleaned.df,
    }
    # features, one query each, then all of them
    for i, name in enumerate(c.FEATURE_TYPES, 1):
        q[f"f{i}_{name}"] = lambda m, name=name: m.cleaned.df.select(
            "CustomerID", features.feature_columns()[name].alias(name))
    q |= {
        "f13_build_features": lambda m: features.build_features(m.cleaned.df),
        "f13_registry": lambda m: features.feature_registry(m.table),
        # feature audit
        "q1_presence": lambda m: feature_quality.missing_features(m.table.drop("AppExposure")),
        "q2_nulls": lambda m: feature_quality.null_features(m.table.withColumn(
            "OrderVelocity", F.when(F.col("Complain") == 0, F.col("OrderVelocity")))),
        "q3_infinities": lambda m: feature_quality.infinite_features(m.table.withColumn(
            "OrderVelocity", F.when(F.col("Complain") == 1, F.lit(float("inf"))).otherwise(
                F.col("OrderVelocity")))),
        "q4_constants": lambda m: feature_quality.constant_features(
            m.table.withColumn("AppExposure", F.lit(7.0))),
        "q5_zero_variance": lambda m: feature_quality.zero_variance(
            m.table.withColumn("AppExposure", F.lit(7.0))),
        "q6_correlations": lambda m: feature_quality.correlations(m.table).withColumn(
            "coefficient", round_even("coefficient", 4)),
        "q6_high_correlation": lambda m: feature_quality.high_correlation(m.table.withColumn(
            "OrderVelocity", F.col("AppExposure") * 2.0 + 1.0)),
        "q7_duplicates": lambda m: feature_quality.duplicate_features(
            m.table.withColumn("OrderVelocity", F.col("CashbackEfficiency"))),
        "q8_types": lambda m: feature_quality.type_mismatches(m.table.withColumn(
            "AppExposure", F.col("AppExposure").cast("string"))),
        "q9_target_leakage": lambda m: feature_quality.target_leakage(m.table.withColumn(
            "AppExposure", F.col("Churn") * 2.0)),
        "q10_quality_score": lambda m: feature_quality.quality_score(m.table),
        "q11_degraded_score": lambda m: feature_quality.quality_score(
            m.table.drop("TenureGroup").withColumn("AppExposure", F.col("Churn") * 2.0)),
        # recency, frequency, monetary
        "r1_quintile": lambda m: rfm.score(m.featured, m.cuts).select("CustomerID", "Recency_Score"),
        "r2_scores": lambda m: rfm.score(m.featured, m.cuts).select(
            "CustomerID", "Recency_Score", "Frequency_Score", "Monetary_Score"),
        "r3_composite": lambda m: rfm.score(m.featured, m.cuts).select("CustomerID", "RFM_Score", "RFM_Sum"),
        "r4_segments": lambda m: rfm.assign_segments(rfm.score(m.featured, m.cuts)).select(
            "CustomerID", "RFM_Score", "RFM_Segment"),
        "r5_recommendations": lambda m: rfm.assign_segments(rfm.score(m.featured, m.cuts)).select(
            "CustomerID", "RFM_Segment", "RFM_Recommendation"),
        "r6_segment_statistics": lambda m: rfm.segment_statistics(m.table),
        "r7_analyze": lambda m: rfm.analyze_rfm(m.featured)[0],
    }
    for i, name in enumerate(c.FLAG_LABELS, 1):
        q[f"g{i}_{name}"] = lambda m, name=name: m.table.select(
            "CustomerID", segments.flag_columns()[name].alias(name))
    q |= {
        "g13_cohort_summary": lambda m: segments.cohort_summary(m.table),
        # health
        "h1_service_quality": lambda m: m.table.select(
            "CustomerID", health.service_quality().alias("Service_Quality_Score")),
        "h2_purchase_momentum": lambda m: m.table.select(
            "CustomerID", health.purchase_momentum().alias("Purchase_Momentum_Score")),
        "h3_app_engagement": lambda m: m.table.select(
            "CustomerID", health.app_engagement().alias("App_Engagement_Score")),
        "h4_tenure_loyalty": lambda m: m.table.select(
            "CustomerID", health.tenure_loyalty().alias("Tenure_Loyalty_Score")),
        "h5_health_score": lambda m: health.score_health(m.featured).select(
            "CustomerID", "CustomerHealthScore"),
        "h6_bands": lambda m: health.score_health(m.featured).select(
            "CustomerID", "Health_Category", "Health_Grade", "Risk_Level"),
        "h7_category_summary": lambda m: health.category_summary(m.table),
        "h8_overall": lambda m: health.overall_summary(m.table),
        # indicators
        "k0_all": _kpis,
        "k8_recommendations": lambda m: kpi.recommendations(_kpis(m)),
        "k9_dictionary": lambda m: kpi.kpi_dictionary(_kpis(m)),
    }
    for i, group in enumerate(kpi.GROUPS, 1):
        q[f"k{i}_{group}"] = lambda m, group=group: kpi.kpi_group(_kpis(m), group)
    q |= {
        # risk on a given probability
        "m17_risk_tiers": _predictions,
        "m18_crm_actions": lambda m: reports.counts(m.scored, "Prediction_CRM_Action"),
        "m19_batch_statistics": lambda m: risk.batch_statistics(m.scored).drop("model_version"),
        "m19_tier_counts": lambda m: risk.tier_counts(m.scored),
        "x1_importance_given": lambda m: narrative.global_importance(_contributions(m)).withColumn(
            "importance", round_even("importance", 6)),
        "x3_drivers": lambda m: narrative.driver_rows(narrative.local_explanations(_contributions(m))),
        "x4_narrative": lambda m: narrative.local_explanations(_contributions(m)).select(
            "CustomerID", "churn_probability", "risk_level", "executive_summary"),
        "m12_confusion_given": lambda m: train.confusion(_given(m)),
        "m12_rates_given": lambda m: train.rates(_given(m)),
        # preparation of model inputs
        "m1_model_inputs": lambda m: prep.model_inputs(m.table),
        "m2_split_sizes": lambda m: prep.stratified_split(prep.model_inputs(m.table)).groupBy(
            "label", "is_test").agg(F.count("*").alias("rows")),
        "m2_fold_sizes": lambda m: prep.stratified_folds(prep.model_inputs(m.table)).groupBy(
            "label", "fold").agg(F.count("*").alias("rows")),
        "m3_class_balance": lambda m: prep.class_balance(
            prep.stratified_split(prep.model_inputs(m.table)).where("NOT is_test")),
        "m4_m6_encoded_inputs": lambda m: prep.encoded_totals(_encoder(m), prep.model_inputs(m.table)),
        "m5_scaled_inputs": _scaled,
        "m12_auc_given": _areas_given,
        "x5_encoded_rows": lambda m: encoded_pairs(_encoder(m), m.table).select("CustomerID", F.inline("inputs")),
        # mart service
        "d2_data_only": _data_only,
        "v6_source_files": _gate_files,
        "d1_mart": lambda m: m.table,
        "d4_dashboard_summary": lambda m: reports.dashboard_summary(
            _kpis(m), health.overall_summary(m.table), risk.tier_counts(m.scored)),
        "d5_report_tables": _saved_reports,
        "d6_profile": _profile_part("profile"),
        "d6_activity": _profile_part("activity_metrics"),
        "d6_rfm": _profile_part("rfm"),
        "d6_health": _profile_part("health"),
        "d6_predictions": lambda m: _profile_part("predictions")(m).drop(
            "prediction_timestamp", "model_version"),
        "d7_run_metadata": lambda m: reports.run_metadata(m.table, m.source).select(
            "service_status", "processed_records_count"),
        # report tables
        "b1_health_categories": lambda m: reports.counts(m.table, "Health_Category"),
        "b2_risk_tiers": lambda m: reports.counts_in_order(
            m.scored, "Prediction_Risk_Level", reports.TIER_ORDER),
        "b3_segments": lambda m: reports.counts(m.table, "RFM_Segment"),
        "b4_flag_penetration": lambda m: reports.flag_penetration(m.table),
        "b5_churn_by_complaint": lambda m: reports.churn_by_complaint(m.scored),
        "b6_satisfaction": lambda m: reports.satisfaction_distribution(m.table),
        "b7_health_grades": lambda m: reports.counts_in_order(m.table, "Health_Grade", reports.GRADE_ORDER),
        "b8_health_risks": lambda m: reports.counts_in_order(m.table, "Risk_Level", reports.RISK_ORDER),
        "b9_service_quality_histogram": lambda m: reports.histogram(
            m.table, "Service_Quality_Score", reports.QUALITY_EDGES, reports.SCORE_LABELS),
        "b9_momentum_histogram": lambda m: reports.histogram(
            m.table, "Purchase_Momentum_Score", reports.SCORE_EDGES, reports.SCORE_LABELS),
        "b9_engagement_histogram": lambda m: reports.histogram(
            m.table, "App_Engagement_Score", reports.SCORE_EDGES, reports.SCORE_LABELS),
        "b10_attention_list": lambda m: reports.attention_list(m.scored),
        "b11_mean_rfm_sum": lambda m: reports.mean_rfm_sum(m.table),
        "b11_mean_rfm_sum_by_segment": lambda m: reports.mean_rfm_sum_by_segment(m.table),
        "b12_recency_scores": lambda m: reports.score_distribution(m.table, "Recency_Score"),
        "b12_frequency_scores": lambda m: reports.score_distribution(m.table, "Frequency_Score"),
        "b13_flag_averages": lambda m: reports.flag_averages(m.scored),
        "b14_largest_cohort": lambda m: reports.largest_cohort(m.table),
        "b15_scored_totals": lambda m: reports.scored_totals(m.scored),
        "b16_probability_histogram": lambda m: reports.histogram(
            m.scored, "Churn_Probability", reports.PROBABILITY_EDGES, reports.PROBABILITY_LABELS),
        "b17_confidence_histogram": lambda m: reports.histogram(
            m.scored, "Prediction_Confidence", reports.CONFIDENCE_EDGES, reports.CONFIDENCE_LABELS),
        "b18_averages_by_tier": lambda m: reports.averages_by_tier(m.scored),
        "b19_probability_by_segment": lambda m: reports.probability_by_segment(m.scored),
        "b20_audit_grid": lambda m: reports.audit_grid(m.scored, 0.5),
        "b20_audit_grid_high": lambda m: reports.audit_grid(m.scored, 0.5, "High"),
        "b21_top_drivers": lambda m: reports.top_drivers(
            narrative.global_importance(_contributions(m)).withColumn(
                "importance", round_even("importance", 6))),
        # trained models, last as they take longest; what is compared holds for any model fitted on these rows
        "m7_logistic_regression": _candidate("LogisticRegression"),
        "m8_random_forest": _candidate("RandomForest"),
        "m9_gradient_boosting": _candidate("GradientBoosting"),
        "m10_leafwise_boosting": _candidate("LeafwiseBoosting"),
        "m11_cross_validation": _cross_validation,
        "m12_test_metrics": lambda m: _judged(_board(m)),
        "m13_winner": lambda m: _board(m).agg(F.count("*").alias("candidates"), F.count_if("is_best").alias("winners")),
        "m14_top_features": _top_features,
        "m15_leaderboard": _leaderboard,
        "m16_batch_scoring": _scored_batch,
        "s7_s8_model_round_trip": lambda m: risk.tier_counts(m.predictor.predict(m.table)).agg(F.sum("count").alias("customers")),
        "x1_global_importance": lambda m: m.explainer.global_importance(m.table).select(
            "feature", (F.col("importance") >= 0).alias("not_negative")),
        "x2_contributions": lambda m: m.explainer.contributions(m.table)[0].select(
            "CustomerID", F.inline("contributions")).select("CustomerID", "feature", F.col("contribution").isNotNull().alias("given")),
        "x3_x4_explanations": lambda m: m.explainer.explain(m.table).select(
            "CustomerID", (F.col("risk_level") == risk.risk_tier("churn_probability")).alias("tier_fits"),
            F.startswith("executive_summary", F.concat(F.lit("Customer "), F.col("CustomerID").cast("string"))).alias("named")),
        # facts that hold for any trained model
        "s8_same_when_loaded": _same_when_loaded,
        "m11_scores_in_range": lambda m: _board(m).select(
            "algorithm", (F.col("cv_f1_mean").between(0, 1) & F.col("cv_f1_std").between(0, 1)).alias("in_range")),
        "m12_metrics_follow": _metrics_follow,
        "m13_winner_is_best": _winner_is_best,
        "m14_features_in_order": _features_in_order,
        "m16_consistent_scores": _consistent_scores,
        "x1_importance_follows": _importance_follows,
        "x2_adds_up": _adds_up,
        "x3_x4_follow": _explanations_follow,
        # run modes
        "d2_predict_only": _predict_only,
        "d6_explainability": _explainability,
    }
    return q


def queries() -> dict:
    """Query name to a function (spark, folder) -> DataFrame."""
    return {
        name: lambda spark, folder, build=build: build(mart_for(spark, folder))
        for name, build in definitions().items()}
