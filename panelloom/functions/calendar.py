"""Periods as integers: ``year * freq + sub_period - 1``, so lag k is ``period_idx - k``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season by quarter, and by month (December opens the winter).
QUARTER_SEASONS = {1: "winter", 2: "spring", 3: "summer", 4: "autumn"}
MONTH_SEASONS = {
    12: "winter", 1: "winter", 2: "winter",
    3: "spring", 4: "spring", 5: "spring",
    6: "summer", 7: "summer", 8: "summer",
    9: "autumn", 10: "autumn", 11: "autumn",
}

# Spanish month abbreviations.
MONTH_ABBREVIATIONS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")


def month_index(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def quarter_index(day: Column) -> Column:
    return (F.year(day) * 4 + F.quarter(day) - 1).cast("int")


def index_of(year: int, sub_period: int, freq: int) -> int:
    return year * freq + sub_period - 1


def year_of(idx: Column, freq: int) -> Column:
    return F.floor(idx / freq).cast("int")


def sub_period_of(idx: Column, freq: int) -> Column:
    return (F.pmod(idx, F.lit(freq)) + 1).cast("int")


def quarter_of_month(month: Column) -> Column:
    return F.floor((month + 2) / 3).cast("int")


def month_to_quarter_index(idx: Column) -> Column:
    return F.floor(idx / 3).cast("int")


def period_start(idx: Column, freq: int) -> Column:
    """First day of the period."""
    return F.make_date(year_of(idx, freq), (sub_period_of(idx, freq) - 1) * (12 // freq) + 1, F.lit(1))


def quarter_end_month(idx: Column) -> Column:
    """First day of the last month of a quarter: quarter 4 is December."""
    return F.make_date(year_of(idx, 4), sub_period_of(idx, 4) * 3, F.lit(1))


def quarter_label(idx: Column) -> Column:
    return F.format_string("%d Q%d", year_of(idx, 4), sub_period_of(idx, 4))


def parse_quarter(text: Column) -> Column:
    """Quarter index of ``2003 Q4``, ``2003Q4``, ``2003/4`` or ``2003-4``; NULL when the text is none of these."""
    pattern = r"^\s*(\d{4})\s*[Qq/.-]\s*Q?([1-4])\s*$"
    year = F.regexp_extract(text, pattern, 1).try_cast("int")
    quarter = F.regexp_extract(text, pattern, 2).try_cast("int")
    return (year * 4 + quarter - 1).cast("int")


def parse_month(text: Column) -> Column:
    """Month index of ``YYYY-MM``; NULL when the text is not one."""
    pattern = r"^(\d{4})-(\d{1,2})$"
    year = F.regexp_extract(text, pattern, 1).try_cast("int")
    month = F.regexp_extract(text, pattern, 2).try_cast("int")
    return F.when(month.between(1, 12), year * 12 + month - 1).cast("int")


def season(sub_period: Column, freq: int) -> Column:
    """Season label of a quarter (freq 4) or month (freq 12); other values give NULL."""
    labels = QUARTER_SEASONS if freq == 4 else MONTH_SEASONS
    labelled = F.expr("map(" + ", ".join(f"{value}, '{label}'" for value, label in labels.items()) + ")")
    return F.try_element_at(labelled, sub_period.cast("int"))


def month_number(abbreviation: Column) -> Column:
    """Month of a Spanish abbreviation; NULL for anything else, such as a yearly total."""
    position = F.array_position(F.array(*[F.lit(m) for m in MONTH_ABBREVIATIONS]), abbreviation)
    return F.when(position > 0, position).cast("int")
