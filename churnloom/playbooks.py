"""Texts attached to segments, health categories, risk tiers and indicators."""

# Action per recency/frequency/monetary segment.
RFM_ACTIONS: dict[str, str] = {
    "Champions":
        "Reward loyalty with premium perks. Invite to exclusive VIP events, "
        "provide early access to new product releases, and recruit as brand advocates.",
    "Loyal Customers":
        "Upsell high-value products. Offer personalized bundle discounts and "
        "introduce loyalty tier progression milestones to increase lifetime spend.",
    "Promising":
        "Increase purchase frequency. Target with recommendation-based cross-selling, "
        "provide limited-time trial vouchers, and initiate re-engagement email flows.",
    "Need Attention":
        "Prevent slide into churn. Launch time-sensitive win-back cashback offers, "
        "collect feedback on recent friction points, and provide targeted support surveys.",
    "About to Sleep":
        "Reactivate relationship. Distribute high-value reactivation discount coupons, "
        "recommend popular trending products, and highlight recent checkout improvements.",
    "Can't Lose Them":
        "VIP rescue protocol. Assign dedicated customer support handlers, "
        "offer premium cashback/coupon rewards, and contact directly to resolve complaints.",
    "At Risk":
        "Aggressive retention intervention. Target with high-priority personalized "
        "discount incentives, execute custom retargeting ads, and send feedback requests.",
    "Hibernating":
        "Low-cost reactivation. Include in periodic standard newsletters, "
        "offer basic discount coupons, or deprioritize marketing spend to preserve margins.",
}
# Action where no segment is known, and the texts a cohort has.
RFM_DEFAULT_ACTION = "Standard engagement campaign."

COHORT_FIELDS = (
    "definition", "business_value", "marketing_strategy", "retention_strategy",
    "executive_recommendation",
)
# The five texts of each flagged cohort, in COHORT_FIELDS order.
COHORT_TEXTS: dict[str, tuple[str, ...]] = {
    "Champions": (
        "Top RFM tier: high recency, high frequency, and high monetary proxy values.",
        "Core revenue advocates; high repeat purchases and highest average lifetime value.",
        "VIP tier invites, early-access campaigns, referral code rewards.",
        "Direct executive reach-outs, white-glove support, brand ambassador perks.",
        "Maximize customer advocacy. Deploy referral programs to acquire lookalike cohorts.",
    ),
    "Loyal Customers": (
        "Active customers with high transaction frequencies and consistent loyalty index scores.",
        "Stable revenue base; high brand affinity and regular transaction history.",
        "Value cross-selling, upsell tiers, product reviews and loyalty milestone incentives.",
        "Exclusive loyalty points, tier rewards, and priority support routing.",
        "Transition to Champions. Offer upsell bundles and milestone progress alerts.",
    ),
    "High Value Spenders": (
        "Customers in the top tier of cashback rewards (spent proxy > $220).",
        "Highest margin contributions per order; high average order value (AOV).",
        "Premium product category showcases, personalized shopping guides, high-ticket cross-selling.",
        "Free express shipping, priority customer support channels, customized packaging.",
        "Protect high margins. Set up automatic support overrides for any complaints logged by this cohort.",
    ),
    "Growth Customers": (
        "Onboarding customers (tenure 6-12 months) who show consistent purchasing activity and no complaints.",
        "Mid-tier potential; represents the next generation of loyal advocates.",
        "Category expansion campaigns, recurring purchase reminders, educational app content.",
        "Satisfaction follow-up surveys, milestone anniversary coupons.",
        "Deepen category adoption. Suggest categories outside their primary purchase cluster.",
    ),
    "Frequent Buyers": (
        "Customers with high purchase volumes (> 5 orders) regardless of tenure or monetary value.",
        "High operational touchpoints; strong utility value for the platform.",
        "Replenishment discounts, subscription program options, bulk purchase offers.",
        "Fast shipping guarantees, frictionless checkout flows.",
        "Convert to subscription services. Pitch automated replenishment programs.",
    ),
    "Discount Seekers": (
        "Customers demonstrating high coupon usage (> 3 coupons) or high cashback dependency ratios.",
        "Margin-sensitive; transactional transactions are highly dependent on promotions.",
        "Flash discount sales, clearing out slow-moving inventory, targeted cashback campaigns.",
        "Affordable value-bundle promotions, low-tier discount newsletters.",
        "Prevent margin erosion. Limit direct discount offerings and test bundles with higher AOVs.",
    ),
    "Mobile-First Users": (
        "Customers whose preferred login device is defined as Mobile Phone or Phone.",
        "High digital accessibility; responsive to mobile push notifications and app alerts.",
        "App-exclusive discounts, location-targeted alerts, mobile checkout specials.",
        "Biometric log-in support, app performance improvements, transactional SMS updates.",
        "Drive push-notification permissions. Deliver real-time cart recovery alerts.",
    ),
    "High Engagement Users": (
        "Customers showing high application exposure metrics (Hours * Devices >= 15.0).",
        "Strong brand mindshare; high browsing duration and active session history.",
        "Social sharing incentives, product wish-list reminders, community updates.",
        "Seamless app UX, personalized homepage feeds, interactive UI rewards.",
        "Convert browsing duration to orders. Trigger exit-intent offers during high-browse sessions.",
    ),
    "At Risk Customers": (
        "Customers flagged by predictive model scores or rule-based churn indicators.",
        "Likely near-term churn; represents imminent monthly recurring revenue leakage.",
        "High-value win-back offers, direct customer support follow-ups, product replacement benefits.",
        "Direct customer support calls, high discount values, direct escalation channels.",
        "Deploy defensive campaigns immediately. Prioritize high-value accounts for CRM win-back.",
    ),
    "Dissatisfied Customers": (
        "Customers who gave low satisfaction ratings (CSAT score <= 2).",
        "High churn risk and brand detractor potential.",
        "Service recovery discounts, apology messages, feedback surveys.",
        "Escalation to senior customer support teams, rapid incident resolution, refund/credit offers.",
        "Execute service recovery campaigns. Route support cases to resolution teams immediately.",
    ),
    "Complaint-Prone Customers": (
        "Customers who have logged complaints during the reporting period.",
        "High customer support cost and potential brand detractor.",
        "Frictionless return program highlights, direct support guides.",
        "Direct case resolution tracking, feedback loops, priority ticketing.",
        "Analyze root cause of complaints. Match complaints to logistics or product quality teams.",
    ),
    "Inactive Customers": (
        "Customers with high days elapsed since last purchase (>= 10 days).",
        "Dormant account; low near-term revenue generation.",
        "Welcome back campaigns, trending products showcases, generic reactivate promotions.",
        "Low-cost email newsletters, basic reactivate discount alerts.",
        "Deploy automated reactivation sequences. Retain budget if no engagement within 90 days.",
    ),
}

# Description and action per health category.
HEALTH_TEXTS: dict[str, tuple[str, str]] = {
    "Excellent": (
        "Premium brand advocates. Highly satisfied with consistent purchasing activity.",
        "Enroll in VIP referral program. Request product review quotes and offer loyalty tier upgrades.",
    ),
    "Healthy": (
        "Engaged and satisfied customer base with regular purchases.",
        "Trigger new category recommendation ads and offer bundle discounts to increase LTV.",
    ),
    "Stable": (
        "Customers showing flat transactional activity. Average satisfaction.",
        "Send engagement surveys, recommend popular trending products, and offer small cashback incentives.",
    ),
    "Warning": (
        "Customers showing signs of friction or dropping purchase frequencies.",
        "Deliver high-value win-back coupons, target with reactive push notifications, and gather feedback.",
    ),
    "Critical": (
        "Severe customer friction (Complained and low CSAT) or prolonged inactivity.",
        "Activate emergency recovery protocol. Route directly to senior support teams for resolution.",
    ),
}

# Action per predicted risk tier.
CRM_ACTIONS: dict[str, str] = {
    "Critical": "Immediate Retention Call: Dispatch account manager or customer success specialist "
                "to resolve complaints.",
    "High": "Loyalty Campaign: Deploy high-incentive target cashback vouchers and satisfaction "
            "recovery surveys.",
    "Medium": "Premium Offer: Send standard loyalty upgrade offers and category cross-selling incentives.",
    "Low": "No Action Required: Continue standard baseline newsletter and support services.",
}

# Business name and meaning of each indicator.
KPI_TEXTS: dict[str, tuple[str, str]] = {
    "total_customers": ("Total Customer Base",
        "Total count of unique customer IDs registered in the analytical store."),
    "active_customers": ("Active Customer Count",
        "Total count of customers classified as active (Churn = 0)."),
    "churned_customers": ("Churned Customer Count",
        "Total count of customers classified as churned (Churn = 1)."),
    "churn_rate_pct": ("Customer Churn Rate",
        "The percentage of the customer base lost during the reporting period."),
    "retention_rate_pct": ("Customer Retention Rate",
        "The percentage of the customer base retained during the reporting period."),
    "avg_satisfaction_score": ("Average Satisfaction Score (CSAT)",
        "The average satisfaction rating self-reported by customers (scale 1-5)."),
    "complaint_rate_pct": ("Customer Complaint Rate",
        "The percentage of customers who logged complaints during the reporting period."),
    "avg_app_usage_hours": ("Average App Usage",
        "The average number of hours spent by customers browsing or ordering on the application."),
    "avg_cashback_amount": ("Average Cashback Reward",
        "The average cashback amount received by customers."),
    "avg_order_count": ("Average Order Count",
        "The average number of orders completed by customers."),
    "high_engagement_pct": ("High Engagement User Ratio",
        "The percentage of the customer base classified as highly engaged on the application."),
    "high_loyalty_pct": ("High Loyalty User Ratio",
        "The percentage of the customer base demonstrating a high brand attachment score."),
    "mobile_first_pct": ("Mobile-First User Ratio",
        "The percentage of the customer base utilizing mobile devices as their primary login channel."),
    "discount_seeker_pct": ("Discount Seeker Ratio",
        "The percentage of the customer base with high coupon usage or high cashback reliance."),
    "frequent_buyer_pct": ("Frequent Buyer Ratio",
        "The percentage of the customer base with a high total volume of purchases."),
    "champions_pct": ("Champions Cohort Ratio",
        "The percentage of customers classified within the top RFM Champions tier."),
    "loyal_customers_pct": ("Loyal Customers Cohort Ratio",
        "The percentage of customers classified within the Loyal Customers RFM tier."),
    "at_risk_pct": ("At Risk Cohort Ratio",
        "The percentage of customers classified as having a high risk of churn."),
    "high_value_pct": ("High Value Cohort Ratio",
        "The percentage of customers classified as premium high-spenders."),
    "complaint_prone_pct": ("Complaint-Prone Cohort Ratio",
        "The percentage of customers who have logged operational complaints."),
    "avg_rfm_sum": ("Average RFM Sum",
        "The average sum of the Recency, Frequency, and Monetary scores (scale 3-15)."),
    "top_rfm_segment": ("Top Customer Segment",
        "The RFM customer cohort containing the highest volume of unique accounts."),
    "weakest_rfm_segment": ("Weakest Customer Segment",
        "The RFM customer cohort containing the lowest volume of unique accounts."),
    "customer_health_index": ("Customer Health Index",
        "Aggregate scale of satisfaction, app engagement, and complaint penalties."),
    "engagement_index": ("Engagement Index",
        "Average monthly hours spent across registered devices."),
    "satisfaction_index_pct": ("Satisfaction Index (CSAT)",
        "Average customer satisfaction rating normalized out of 100%."),
    "loyalty_index": ("Loyalty Index", "Average tenure-weighted satisfaction rating."),
}
