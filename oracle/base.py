"""Shared common table expressions: from the order tables to the scored customer mart."""

from churnloom import contract as c


def rnd(expr: str, digits: int) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case_map(key: str, table: dict, default: str | None = None) -> str:
    arms = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items())
    other = "NULL" if default is None else text(default)
    return f"CASE {key} {arms} ELSE {other} END"


def cut(value: str, edges, labels, include_lowest: bool = False) -> str:
    arms = []
    for i, (lo, hi, label) in enumerate(zip(edges, edges[1:], labels)):
        op = ">=" if include_lowest and i == 0 else ">"
        upper = "" if hi is None else f" AND {value} <= {hi}::DOUBLE"
        arms.append(f"WHEN {value} {op} {lo}::DOUBLE{upper} THEN {text(label)}")
    return "CASE " + " ".join(arms) + " END"


def clip(value: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN NULL ELSE greatest(least({value}, {hi}), {lo}) END"


def flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, FALSE) AS INTEGER)"


def exact_mean(value: str, decimals: int) -> str:
    scale = f"{10 ** decimals}.0::DOUBLE"
    units = f"CAST(round_even(({value}) * {scale}, 0) AS BIGINT)"
    return f"(CAST(sum({units}) AS DOUBLE) / count({units}) / {scale})"


RAW = """
p AS (SELECT (SELECT max(o_orderdate) FROM orders) AS ref, (SELECT max(user_id) + 1 FROM events) AS nu),
oa AS (
  SELECT o_custkey AS k, max(o_orderdate) AS last_d, min(o_orderdate) AS first_d,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n_all,
         count(*) FILTER (WHERE date_diff('day', o_orderdate, (SELECT ref FROM p)) <= 1095) AS n_recent
  FROM orders GROUP BY 1),
la AS (
  SELECT o_custkey AS k, count(*) FILTER (WHERE l_discount >= 0.09::DOUBLE) AS n_disc,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_ret, count(*) AS n_lines,
         count(DISTINCT l_suppkey) AS n_supp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
ea AS (SELECT user_id AS u, count(*) AS n_ev FROM events GROUP BY 1),
j AS (
  SELECT c_custkey AS k, c_nationkey, c_acctbal, c_mktsegment, cents, n_all, n_recent, n_disc, n_ret,
         n_lines, n_supp, n_ev, date_diff('day', last_d, ref) AS rec, date_diff('day', first_d, last_d) AS span
  FROM customer CROSS JOIN p LEFT JOIN oa ON oa.k = c_custkey LEFT JOIN la ON la.k = c_custkey
       LEFT JOIN ea ON ea.u = c_custkey % p.nu),
raw0 AS (
  SELECT k, 0 AS src_seq, k + 50001 AS CustomerID,
    CAST(CASE WHEN rec > 300 OR (n_ret * 5 > n_lines * 2 AND k % 3 = 0) THEN 1 ELSE 0 END AS INTEGER) AS Churn,
    CASE WHEN k % 21 <> 3 THEN CAST((span % 1830) // 30 AS DOUBLE) END AS Tenure,
    ['Mobile Phone', ' Mobile Phone ', 'Phone', 'Computer'][CAST(k % 4 + 1 AS INTEGER)] AS PreferredLoginDevice,
    CAST(1 + c_nationkey % 3 AS INTEGER) AS CityTier,
    CASE WHEN k % 23 <> 4 THEN CAST(CASE WHEN k % 50 = 0 THEN 126 ELSE 5 + (k * 13) % 31 END AS DOUBLE) END
      AS WarehouseToHome,
    ['Debit Card', 'Credit Card', 'CC', 'E wallet', 'UPI', 'COD', 'Cash on Delivery'][CAST(k % 7 + 1 AS INTEGER)]
      AS PreferredPaymentMode,
    ['Male', 'Female'][CAST(k % 2 + 1 AS INTEGER)] AS Gender,
    CASE WHEN k % 22 <> 5 THEN CAST(n_ev % 6 AS DOUBLE) END AS HourSpendOnApp,
    CAST(1 + n_supp % 6 AS INTEGER) AS NumberOfDeviceRegistered,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Laptop & Accessory' WHEN 'BUILDING' THEN 'Mobile'
      WHEN 'FURNITURE' THEN 'Mobile Phone' WHEN 'HOUSEHOLD' THEN 'Fashion' WHEN 'MACHINERY' THEN 'Grocery' END
      AS PreferedOrderCat,
    CAST(1 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 5 AS INTEGER) AS SatisfactionScore,
    ['Single', 'Married', 'Divorced'][CAST(k % 3 + 1 AS INTEGER)] AS MaritalStatus,
    CAST(CASE WHEN k % 60 = 0 THEN 22 ELSE 1 + (k * 7) % 11 END AS INTEGER) AS NumberOfAddress,
    CAST(CASE WHEN n_ret * 5 > n_lines * 2 THEN 1 ELSE 0 END AS INTEGER) AS Complain,
    CASE WHEN k % 24 <> 6 THEN CAST(11 + (k * 5) % 16 AS DOUBLE) END AS OrderAmountHikeFromlastYear,
    CASE WHEN k % 25 <> 7 THEN CAST(n_disc // 4 AS DOUBLE) END AS CouponUsed,
    CASE WHEN k % 26 <> 8 THEN CAST(n_recent AS DOUBLE) END AS OrderCount,
    CASE WHEN k % 19 <> 9 THEN floor(CAST(rec AS DOUBLE) / 10.0::DOUBLE) END AS DaySinceLastOrder,
    CAST(cents // (n_all * 1000) AS DOUBLE) / 100.0::DOUBLE AS CashbackAmount
  FROM j),
raw AS (
  SELECT * EXCLUDE (k) FROM raw0
  UNION ALL SELECT * EXCLUDE (k) REPLACE (1 AS src_seq) FROM raw0 WHERE k % 101 = 7
  UNION ALL SELECT * EXCLUDE (k) REPLACE (2 AS src_seq, Tenure + 1.0::DOUBLE AS Tenure) FROM raw0 WHERE k % 97 = 5)
"""

_TEXT = [n for n, t in c.SOURCE_TYPES.items() if t == "string"]


def trimmed(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


TRIMMED = "trimmed AS (SELECT * REPLACE (" + ", ".join(
    f"{trimmed(n)} AS {n}" for n in _TEXT) + ") FROM raw)"

PREPARED = "prepared AS (SELECT * REPLACE (" + ", ".join(
    f"CASE {n} " + " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in m.items()) + f" ELSE {n} END AS {n}"
    for n, m in c.SYNONYMS.items()) + (
    ") FROM trimmed QUALIFY row_number() OVER (PARTITION BY CustomerID ORDER BY src_seq) = 1)")

MEDIANS = "gm AS (SELECT PreferedOrderCat AS grp, " + ", ".join(
    f"median({n}) AS m_{n}" for n in c.IMPUTE_NUMERIC) + " FROM prepared GROUP BY 1),\n" + (
    "tm AS (SELECT " + ", ".join(f"median({n}) AS t_{n}" for n in c.IMPUTE_NUMERIC) + " FROM prepared)")

IMPUTED = "imputed AS (SELECT prepared.* REPLACE (" + ", ".join(
    f"coalesce({n}, m_{n}, t_{n}) AS {n}" for n in c.IMPUTE_NUMERIC) + (
    ") FROM prepared LEFT JOIN gm ON grp = PreferedOrderCat CROSS JOIN tm)")

BOUNDS = "q AS (SELECT " + ", ".join(
    f"quantile_cont(CAST({n} AS DOUBLE), 0.25) AS q1_{n}, quantile_cont(CAST({n} AS DOUBLE), 0.75) AS q3_{n}"
    for n in c.CLIP_COLUMNS) + " FROM imputed),\nbounds AS (SELECT " + ", ".join(
    f"q1_{n} - 1.5::DOUBLE * (q3_{n} - q1_{n}) AS lo_{n}, q3_{n} + 1.5::DOUBLE * (q3_{n} - q1_{n}) AS hi_{n}"
    for n in c.CLIP_COLUMNS) + " FROM q)"

CLEAN = "clean AS (SELECT imputed.* REPLACE (" + ", ".join(
    f"{clip(f'CAST({n} AS DOUBLE)', f'lo_{n}', f'hi_{n}')} AS {n}" for n in c.CLIP_COLUMNS) + (
    ") FROM imputed CROSS JOIN bounds)")

FEATURES = f"""feat AS (SELECT *,
  {cut("(CASE WHEN Tenure IS NULL THEN NULL ELSE least(Tenure, 119.9::DOUBLE) END)", c.TENURE_EDGES, c.TENURE_LABELS, True)} AS TenureGroup,
  {cut("WarehouseToHome", c.DISTANCE_EDGES, c.DISTANCE_LABELS, True)} AS WarehouseDistanceBucket,
  OrderCount / (DaySinceLastOrder + 1.0::DOUBLE) AS OrderVelocity,
  HourSpendOnApp * NumberOfDeviceRegistered AS AppExposure,
  CashbackAmount / (OrderCount + 1.0::DOUBLE) AS CashbackEfficiency,
  CAST(Complain AS DOUBLE) / CAST(SatisfactionScore AS DOUBLE) AS ComplaintFrictionIndex,
  {cut("OrderCount", c.FREQUENCY_EDGES, c.FREQUENCY_LABELS, True)} AS OrderFrequencyTier,
  Tenure * SatisfactionScore AS CustomerLoyaltyScore,
  NumberOfAddress / (Tenure + 1.0::DOUBLE) AS AddressStabilityIndex,
  OrderCount / (Tenure + 1.0::DOUBLE) AS TenureOrderRatio,
  SatisfactionScore - 2.0::DOUBLE * Complain + HourSpendOnApp / 5.0::DOUBLE AS RawHealthIndex,
  {flag("Complain = 1 AND SatisfactionScore <= 2")} AS RuleBasedChurnIndicator
  FROM clean)"""


def quintile(order: str) -> str:
    rn = f"row_number() OVER (ORDER BY {order}, CustomerID)"
    n = "count(*) OVER ()"
    return f"CAST(greatest(1, (5 * ({rn} - 1) + ({n} - 2)) // ({n} - 1)) AS INTEGER)"


RFM = f"""filled AS (SELECT *,
    coalesce(DaySinceLastOrder, (SELECT median(DaySinceLastOrder) FROM feat)) AS f_r,
    coalesce(OrderCount, (SELECT median(OrderCount) FROM feat)) AS f_f,
    coalesce(CashbackAmount, (SELECT median(CashbackAmount) FROM feat)) AS f_m FROM feat),
scores AS (SELECT * EXCLUDE (f_r, f_f, f_m), {quintile("f_r DESC")} AS Recency_Score,
    {quintile("f_f")} AS Frequency_Score, {quintile("f_m")} AS Monetary_Score FROM filled),
rfm0 AS (SELECT *, CAST(Recency_Score AS VARCHAR) || CAST(Frequency_Score AS VARCHAR)
    || CAST(Monetary_Score AS VARCHAR) AS RFM_Score,
    CAST(Recency_Score + Frequency_Score + Monetary_Score AS INTEGER) AS RFM_Sum FROM scores)"""


def _rfm_named() -> str:
    from churnloom import playbooks

    segment = case_map("RFM_Score", c.RFM_SEGMENTS, c.RFM_DEFAULT_SEGMENT)
    action = case_map("RFM_Segment", playbooks.RFM_ACTIONS, playbooks.RFM_DEFAULT_ACTION)
    return (f"rfm1 AS (SELECT *, {segment} AS RFM_Segment FROM rfm0),\n"
            f"rfm AS (SELECT *, {action} AS RFM_Recommendation FROM rfm1)")


RULES = {
    "is_champion": "RFM_Segment = 'Champions'",
    "is_loyal": "RFM_Segment = 'Loyal Customers'",
    "is_high_value": "CashbackAmount >= 220",
    "is_growth": "TenureGroup = '6-12m' AND Complain = 0",
    "is_frequent_buyer": "OrderCount >= 5",
    "is_discount_seeker": "CouponUsed >= 3 OR CashbackAmount / (OrderCount + 1.0::DOUBLE) >= 60",
    "is_mobile_first": "PreferredLoginDevice IN ('Mobile Phone', 'Phone')",
    "is_high_engagement": "AppExposure >= 15",
    "is_at_risk": "RFM_Segment = 'At Risk' OR RuleBasedChurnIndicator = 1",
    "is_dissatisfied": "SatisfactionScore <= 2",
    "is_complaint_prone": "Complain = 1",
    "is_inactive": "DaySinceLastOrder >= 10",
}
FLAGS = "flags AS (SELECT *, " + ", ".join(f"{flag(r)} AS {n}" for n, r in RULES.items()) + " FROM rfm)"

HEALTH = f"""parts AS (SELECT *,
    {clip("(SatisfactionScore / 5.0::DOUBLE * 100.0::DOUBLE - Complain * 40.0::DOUBLE)", "0::DOUBLE", "100::DOUBLE")} AS Service_Quality_Score,
    {clip("((1.0::DOUBLE - DaySinceLastOrder / 30.0::DOUBLE) * 100.0::DOUBLE)", "0::DOUBLE", "100::DOUBLE")} AS Purchase_Momentum_Score,
    {clip("(AppExposure / 20.0::DOUBLE * 100.0::DOUBLE)", "0::DOUBLE", "100::DOUBLE")} AS App_Engagement_Score,
    {clip("(Tenure / 48.0::DOUBLE * 100.0::DOUBLE)", "0::DOUBLE", "100::DOUBLE")} AS Tenure_Loyalty_Score FROM flags),
weighed AS (SELECT *, {rnd("Service_Quality_Score * 0.35::DOUBLE + Purchase_Momentum_Score * 0.25::DOUBLE + App_Engagement_Score * 0.2::DOUBLE + Tenure_Loyalty_Score * 0.2::DOUBLE", 2)} AS CustomerHealthScore FROM parts),
mart AS (SELECT *,
    {cut("CustomerHealthScore", c.HEALTH_EDGES, c.HEALTH_CATEGORIES)} AS Health_Category,
    {cut("CustomerHealthScore", c.HEALTH_EDGES, c.HEALTH_GRADES)} AS Health_Grade,
    {cut("CustomerHealthScore", c.HEALTH_EDGES, c.HEALTH_RISKS)} AS Risk_Level FROM weighed)"""


def _scored() -> str:
    from churnloom import playbooks

    tier = ("CASE WHEN p0 >= 0.9::DOUBLE THEN 'Critical' WHEN p0 >= 0.75::DOUBLE THEN 'High' "
            "WHEN p0 >= 0.5::DOUBLE THEN 'Medium' WHEN p0 IS NOT NULL THEN 'Low' END")
    return f"""prob AS (SELECT *, CAST((CustomerID * 37) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS p0 FROM mart),
scored0 AS (SELECT *, CAST(p0 > 0.5::DOUBLE AS INTEGER) AS Churn_Prediction, {rnd("p0", 4)} AS Churn_Probability,
    {rnd("CASE WHEN p0 > 0.5::DOUBLE THEN p0 ELSE 1.0::DOUBLE - p0 END", 4)} AS Prediction_Confidence,
    {tier} AS Prediction_Risk_Level FROM prob),
scored AS (SELECT *, {case_map("Prediction_Risk_Level", playbooks.CRM_ACTIONS)} AS Prediction_CRM_Action FROM scored0)"""


STEPS = [
    ("raw", RAW.strip()), ("trimmed", TRIMMED), ("prepared", PREPARED), ("imputed", MEDIANS + ",\n" + IMPUTED),
    ("clean", BOUNDS + ",\n" + CLEAN), ("feat", FEATURES), ("rfm", RFM + ",\n" + _rfm_named()),
    ("flags", FLAGS), ("mart", HEALTH), ("scored", _scored()),
]


def upto(stage: str, body: str, extra: str = "") -> str:
    """A query over all expressions up to ``stage``."""
    parts = []
    for name, sql in STEPS:
        parts.append(sql)
        if name == stage:
            break
    else:
        raise KeyError(stage)
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body
