"""Price, activity and output panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import calendar as cal
from panelloom.functions.names import conform
from panelloom.operators import aggregate, blocked, joins, reshape, selection, windows

# English names of the price categories.
PRICE_CATEGORIES = {
    "general": "headline",
    "subyacente": "core",
    "alimentos": "food",
    "mercnoalim": "nonfood",
    "servicios": "services",
    "agropecuarios": "agriculture",
    "energeticos": "energy",
}


def price_panel(
    prices: DataFrame,
    categories: Mapping[str, str],
    start: int,
    end: int,
    freq: int = 4,
    adjusted: bool = True,
    aliases: DataFrame | None = None,
    method: str = "classical",
) -> DataFrame:
    """Long price indices ``(entity, period_idx, category, value)`` to one column per category.

    Quarters are strict means; ``start`` and ``end`` are months; ``method`` is that of the adjustment.
    """
    kept = selection.in_range(prices, "period_idx", start, end).where(F.col("category").isin(*categories))
    wide = joins.fold_full(kept, ["entity", "period_idx"], "category", "value", list(categories))
    wide = wide.withColumnsRenamed(dict(categories))
    names = list(categories.values())
    if aliases is not None:
        wide = conform(wide, "entity", aliases)
    if freq == 4:
        wide = aggregate.to_quarters(wide, ["entity"], names, strict_mean=True)
    if not adjusted:
        return wide
    return windows.seasonal_adjust(joins.complete_periods(wide, ["entity"]), ["entity"], names, freq, method=method)


def activity_index(
    report: DataFrame,
    sectors: Sequence[str],
    start: int,
    end: int,
    adjusted: bool = True,
    freq: int = 4,
) -> DataFrame:
    """Long activity report ``(entity, sector, period_idx, value text)`` to one column per sector."""
    kept = selection.in_range(report, "period_idx", start, end)
    kept = kept.withColumn("value", F.col("value").try_cast("double"))
    wide = reshape.to_wide(kept, ["entity", "period_idx"], "sector", "value", sectors)
    if not adjusted:
        return wide
    return windows.seasonal_adjust(joins.complete_periods(wide, ["entity"]), ["entity"], sectors, freq)


def annual_to_quarterly(annual: DataFrame, indicator: DataFrame, aligned: bool = False, block: int | None = None) -> DataFrame:
    """Annual levels ``(entity, sector, year, level)`` to quarters along ``(entity, sector, period_idx, indicator)``.

    Each level stands at its year's fourth quarter. Sectors are rows, so all series go through one window; long ones are
    scanned by blocks of ``block`` quarters.
    """
    anchors = annual.select(
        "entity", "sector", (F.col("year") * 4 + 3).cast("int").alias("period_idx"), "level"
    )
    keys = ["entity", "sector"]
    aligned_rows = indicator.join(anchors, [*keys, "period_idx"], "left")
    spine = joins.complete_periods(aligned_rows, keys)
    if block:
        return blocked.extrapolate_anchored(spine, keys, "level", "indicator", "value", block, aligned)
    return windows.extrapolate_anchored(spine, keys, "level", "indicator", "value", aligned)


def per_capita(
    output: DataFrame, dimension: DataFrame, group: str, value: str = "value", population: str = "population"
) -> DataFrame:
    """Output per head by group, sector and period: sum of output over sum of population."""
    joined = output.join(dimension.select("entity", group, population), "entity")
    return aggregate.ratio_of_sums(
        joined.withColumnRenamed(group, "region"), ["region", "sector", "period_idx"], value, population, value
    )


def national_per_capita(
    national: DataFrame, population_total: DataFrame, sectors: Sequence[str], label: str, freq: int = 4
) -> DataFrame:
    """National output ``(quarter text, sector columns)`` per head, seasonally adjusted.

    ``population_total`` is one row with the column ``population``.
    """
    dated = national.withColumn("period_idx", cal.parse_quarter(F.col("quarter"))).where(
        F.col("period_idx").isNotNull()
    )
    heads = population_total.select("population").scalar()
    scaled = dated.select(
        F.lit(label).alias("region"), "period_idx", *[(F.col(s).cast("double") / heads).alias(s) for s in sectors]
    )
    return windows.seasonal_adjust(joins.complete_periods(scaled, ["region"]), ["region"], sectors, freq)


def sector_of(text: Column, sectors: Sequence[str], prefix: str) -> Column:
    """Sector label inside a free text, with a prefix: ``gdp.primarias``."""
    from panelloom.functions.names import extract_label

    return F.concat_ws(".", F.lit(prefix), extract_label(text, list(sectors)))
