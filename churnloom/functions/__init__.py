"""Column builders shared by all operators."""

from churnloom.functions.exprs import (
    clip, cut, exact_mean, flag, is_missing, lookup, number, percent, quote, round_even, similarity,
    strip,
)

__all__ = [
    "clip", "cut", "exact_mean", "flag", "is_missing", "lookup", "number", "percent", "quote",
    "round_even", "similarity", "strip",
]
