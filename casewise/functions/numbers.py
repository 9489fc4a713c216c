"""Rounding and percent display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(digits: int) -> str:
    return "0." + "0" * digits if digits else "0"


def round_exact(value: Column, digits: int) -> Column:
    """Round half to even on the exact binary value, as Python's ``round`` does.

    ``round`` and ``bround`` work on the printed decimal, so they differ at apparent ties.
    """
    return F.call_function("format_number", value.cast("double"), F.lit(_pattern(digits))).cast("double")


def percent(share: Column) -> Column:
    """A share shown with one decimal, such as ``12.3%``."""
    shown = F.call_function("format_number", share.cast("double") * 100, F.lit(_pattern(1)))
    return F.concat(shown, F.lit("%"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Division in doubles that gives 0 for an empty denominator."""
    return F.when(denominator != 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def balanced_weight(total: Column, classes: Column, class_size: Column) -> Column:
    """Weight that gives every class the same total: ``n / (k * n_class)``."""
    return total.cast("double") / (classes * class_size)
