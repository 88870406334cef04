"""Scalar number expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# In units of the last place kept: how far below a tie still counts as the tie.
TIE_TOLERANCE = 1e-5


def round_places(x: Column, places: int) -> Column:
    """Round half up. A value a hair below a tie counts as the tie, so that the last bits of a sum, which
    depend on the order of adding, do not decide the digit."""
    scale = float(10**places)
    return F.floor(x * scale + (0.5 + TIE_TOLERANCE)) / scale


def positive_part(x: Column) -> Column:
    """max(x, 0); NULL stays NULL."""
    return F.when(x > 0, x).when(x <= 0, F.lit(0.0))


def negative_part(x: Column) -> Column:
    """max(-x, 0); NULL stays NULL."""
    return F.when(x < 0, -x).when(x >= 0, F.lit(0.0))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def to_number(text: Column) -> Column:
    """Number in a text cell, NULL when it is none."""
    return F.trim(text).try_cast("double")


def log_or_null(x: Column) -> Column:
    """Natural log; NULL for values that are not positive."""
    return F.when(x > 0, F.ln(x))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def stars(t: Column, cutoffs: Sequence[float], none: str | None = None) -> Column:
    """Significance stars of a t value: above the first, second and third cut-off."""
    one, two, three = cutoffs
    size = F.abs(t)
    marked = F.when(size > three, "***").when(size > two, "**").when(size > one, "*")
    return marked.when(size.isNotNull(), F.lit(none)) if none is not None else marked


def fixed_decimals(x: Column, places: int) -> Column:
    """Text with a fixed number of decimals, no grouping; NULL stays NULL."""
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", round_places(x, places)))


def in_parentheses(text: Column) -> Column:
    return F.concat(F.lit("("), text, F.lit(")"))
