"""Churn models: preparation, training, scoring and explanation with Spark ML."""
