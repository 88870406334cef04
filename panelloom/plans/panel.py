"""The merged panel and the frames taken from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions import calendar as cal
from panelloom.operators import selection, windows


def merge_weather(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two weather panels side by side; a period that only one of them has is kept."""
    return first.join(second, list(keys), "full")


def merge_panel(prices: DataFrame, output: DataFrame, weather: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Price rows with output and, once per norm, weather.

    All inputs are unique on ``keys`` (weather on norm and keys), so no join multiplies rows further.
    """
    return prices.join(output, list(keys), "left").join(weather, list(keys), "left")


def estimation_panel(panel: DataFrame, columns: Sequence[str], flag: str = "is_total", freq: int = 4) -> DataFrame:
    """Without the national row and incomplete rows, dated by the quarter's last month."""
    kept = selection.complete_cases(selection.drop_total(panel, flag), columns)
    day = cal.quarter_end_month(F.col("period_idx")) if freq == 4 else cal.period_start(F.col("period_idx"), freq)
    return kept.withColumn("date", day)


def inflation_panel(
    panel: DataFrame, keys: Sequence[str], values: Sequence[str], rate: str, freq: int, log: bool = True
) -> DataFrame:
    """Rates of change of price and output columns, the rows before the first rate left out."""
    changed = windows.rate_of_change(panel, keys, values, rate, freq, log)
    return windows.drop_undefined(changed.select(*keys, "period_idx", *values), values[0])


def anomaly_change(panel: DataFrame, keys: Sequence[str], deviation: str) -> DataFrame:
    """First difference of an anomaly, without its undefined first row."""
    change = windows.difference(F.col(deviation), keys)
    return windows.drop_undefined(
        panel.select(*keys, "period_idx", change.alias(f"d_{deviation}")), f"d_{deviation}"
    )
