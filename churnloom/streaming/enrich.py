"""Enriching a stream of customer rows with the parameters of a batch.

Trimming, synonyms, imputation, clipping, features, scores, flags and health are pure
column expressions once their parameters are known, so the batch functions serve the
stream unchanged. Group medians are a static lookup table. Duplicates are not removed:
a row that arrives again is a new version of the customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from churnloom.operators import clean
from churnloom.plans.mart import enrich


def enrich_stream(stream: DataFrame, imputation: clean.Imputation, clipping: clean.Clipping, cuts) -> DataFrame:
    """The mart columns of every arriving row."""
    tidy = clean.merge_synonyms(clean.trim_text(stream))
    return enrich(clipping.apply(imputation.apply(tidy)), cuts)
