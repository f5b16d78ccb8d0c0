"""Operators of a training-data pipeline: cleaning, duplicates, scoring, mixing, packing.

Nothing outside this package imports it.
"""
