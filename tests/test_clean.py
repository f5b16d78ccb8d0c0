import pytest
from pyspark.sql import functions as F

from churnloom.errors import ImputationError
from churnloom.operators import clean
from churnloom.plans.stages import literal_table
from tests.conftest import DIRTY


def column(df, name, order="src_seq"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_trim_headers_and_cells(dirty):
    df = clean.trim_text(dirty.withColumnRenamed("CustomerID", " CustomerID "))
    assert "CustomerID" in df.columns
    assert column(df, "PreferredLoginDevice")[4] == "Mobile Phone"


def test_trim_removes_tabs_and_keeps_null(spark):
    df = literal_table(spark, {"a": ["\t x y \n", None, " z"]})
    assert {r["a"] for r in clean.trim_text(df).collect()} == {"x y", None, "z"}


def test_key_duplicates_keep_first_and_last(dirty):
    first = clean.drop_duplicates(dirty)
    assert first.count() == 6
    assert first.where("CustomerID = 711").first()["Tenure"] is None
    assert clean.drop_duplicates(dirty, keep="last").where("CustomerID = 711").first()["Tenure"] == 7.0
    assert {r[0] for r in clean.drop_duplicates(dirty, keep="drop").select("CustomerID").collect()} == {
        710, 712, 713, 714, 715}
    audit = clean.duplicate_audit(dirty).first()
    assert (audit.initial_rows, audit.final_rows, audit.exact_duplicates_removed,
            audit.pk_duplicates_removed) == (7, 6, 0, 1)


def test_exact_duplicates(dirty):
    copied = dirty.unionByName(dirty.where("src_seq = 0").withColumn("src_seq", F.lit(9).cast("bigint")))
    assert clean.drop_duplicates(copied, primary_key=None).count() == 7
    audit = clean.duplicate_audit(copied, primary_key=None).first()
    assert (audit.exact_duplicates_removed, audit.pk_duplicates_removed, audit.total_removed) == (1, 0, 1)


def test_drop_keeps_a_key_whose_other_rows_were_copies(spark):
    df = literal_table(spark, {"CustomerID": [1, 1, 1, 2], "x": [7, 7, 8, 9], "src_seq": [0, 1, 2, 0]})
    kept = clean.drop_duplicates(df, keep="drop").select("CustomerID", "x").collect()
    assert sorted(map(tuple, kept)) == [(1, 8), (2, 9)]
    audit = clean.duplicate_audit(df, keep="drop").first()
    assert audit.final_rows == 2 and audit.total_removed == 2


def test_a_third_of_all_rows_share_a_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("CustomerID"),
        F.col("id").alias("x"), F.col("id").alias("src_seq"))
    kept = clean.drop_duplicates(df)
    assert kept.count() == 2001
    assert kept.where("CustomerID = 0").first()["x"] == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_bad_keep(dirty):
    with pytest.raises(ValueError):
        clean.drop_duplicates(dirty, keep="sometimes")


def test_synonyms(dirty):
    df = clean.merge_synonyms(dirty)
    assert "Phone" not in column(df, "PreferredLoginDevice")
    assert set(column(df, "PreferredPaymentMode")) == {"UPI", "Credit Card", "COD", "E wallet"}
    assert "Mobile" not in column(df, "PreferedOrderCat")


def test_grouped_median(dirty):
    model = clean.fit_imputation(dirty)
    df = model.apply(dirty)
    for name in ("Tenure", "WarehouseToHome", "OrderAmountHikeFromlastYear", "DaySinceLastOrder"):
        assert df.where(F.col(name).isNull()).count() == 0
    assert column(df, "Tenure")[1] == 6.0  # the middle of 7 and 5, the known values of its group
    assert column(df, "WarehouseToHome")[5] == 19.0  # a group without values: the median of all
    audit = {r["column"]: r["imputed_count"] for r in model.audit(dirty.sparkSession).collect()}
    assert audit["Tenure"] == 1 and set(audit) == {
        "Tenure", "WarehouseToHome", "OrderAmountHikeFromlastYear", "DaySinceLastOrder"}


def test_missing_group_and_nan_fall_back_to_the_global_median(spark):
    df = literal_table(spark, {
        "PreferedOrderCat": [None, "a", "a", "b"], "Tenure": [None, 1.0, 5.0, float("nan")]})
    filled = clean.fit_imputation(df).apply(df)
    assert sorted(r["Tenure"] for r in filled.collect()) == [1.0, 3.0, 3.0, 5.0]


def test_column_without_any_value_stays_null(spark):
    df = literal_table(spark, {"PreferedOrderCat": ["a", "b"], "Tenure": [None, None]}, {"Tenure": "double"})
    assert [r["Tenure"] for r in clean.fit_imputation(df).apply(df).collect()] == [None, None]


def test_unknown_strategy(dirty):
    with pytest.raises(ImputationError):
        clean.fit_imputation(dirty, numeric_strategy="guess")


def test_mean_mode_and_constant(dirty):
    df = dirty.withColumn("PreferredLoginDevice", F.when(F.col("src_seq") > 1, F.col("PreferredLoginDevice")))
    kwargs = dict(numeric_strategy="mean", group_by=None, numeric_columns=("Tenure",),
                  categorical_columns=("PreferredLoginDevice",))
    filled = clean.fit_imputation(df, categorical_strategy="mode", **kwargs).apply(df)
    assert column(filled, "PreferredLoginDevice")[0] == "Phone"
    assert column(filled, "Tenure")[1] == pytest.approx(125 / 6)
    constant = clean.fit_imputation(df, categorical_strategy="Missing", **kwargs).apply(df)
    assert column(constant, "PreferredLoginDevice")[0] == "Missing"


def test_mode_tie_goes_to_the_smallest(spark):
    df = literal_table(spark, {"x": ["b", "a", None]})
    model = clean.fit_imputation(df, numeric_columns=(), categorical_columns=("x",))
    assert model.categorical["x"] == "a"


def test_clip(dirty):
    filled = clean.fit_imputation(dirty, group_by=None).apply(dirty)
    model = clean.fit_clipping(filled, columns=("Tenure",))
    assert model.bounds["Tenure"] == (0.0, 16.0)  # quartiles 6 and 10
    assert max(column(model.apply(filled), "Tenure")) == model.bounds["Tenure"][1]
    assert model.audit(filled).first()["total_capped"] == 1


def test_zero_multiplier_is_a_multiplier(spark):
    df = literal_table(spark, {"Tenure": [0.0, 1.0, 2.0, 3.0, 100.0]})
    model = clean.fit_clipping(df, multiplier=0, columns=("Tenure",))
    assert model.bounds["Tenure"] == (1.0, 3.0)


def test_clip_keeps_null(spark):
    df = literal_table(spark, {"Tenure": [0.0, 1.0, None, 2.0]})
    assert None in [r[0] for r in clean.fit_clipping(df, columns=("Tenure",)).apply(df).collect()]


def test_enforce_types(dirty):
    kinds = dict(clean.enforce_types(dirty).dtypes)
    assert kinds["Tenure"] == "float" and kinds["CustomerID"] == "int" and kinds["PreferedOrderCat"] == "string"


def test_whole_cleaning(dirty):
    result = clean.clean(dirty)
    rows = result.df.drop("src_seq").collect()
    assert len(rows) == 6 and not any(v is None for r in rows for v in r)
    assert len(result.df.drop("src_seq").columns) == len(DIRTY) - 1
    assert "Phone" not in [r["PreferredLoginDevice"] for r in rows]


def test_empty_table(spark):
    df = spark.createDataFrame([], "CustomerID long, Churn int, Tenure double")
    assert clean.clean(df).df.count() == 0
