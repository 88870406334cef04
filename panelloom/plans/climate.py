"""Weighted weather indices, trailing norms and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions import calendar as cal
from panelloom.functions.text import ident
from panelloom.operators import aggregate, selection, windows

NATIONAL = "national"

# Fixed values: (region, entity) pairs that the city list puts in the wrong region.
WRONG_REGION_PAIRS = (
    ("Noreste", "Tamaulipas"),
    ("Noreste", "Chihuahua"),
    ("Noreste", "Coahuila"),
    ("Sur", "Veracruz"),
)


def region_dimension(
    cities: DataFrame, entity: str, levels: Sequence[str], wrong: DataFrame, wrong_on: Sequence[str],
    national: bool = False,
) -> DataFrame:
    """City list to one row per entity with its region at each level."""
    pairs = selection.distinct_rows(cities, [entity, *levels])
    dimension = selection.exclude_pairs(pairs, wrong, wrong_on).withColumn("is_total", F.lit(False))
    if not national:
        return dimension
    fields = {f.name: f.dataType for f in pairs.schema.fields}
    total = cities.sparkSession.range(1).select(
        *[
            F.lit(NATIONAL if fields[c].simpleString() == "string" else 0).cast(fields[c]).alias(c)
            for c in pairs.columns
        ],
        F.lit(True).alias("is_total"),
    )
    return dimension.unionByName(total)


def population_weights(population: DataFrame, is_entity: Column, entity: str, amount: str) -> DataFrame:
    """Census report rows to ``(entity, population in millions, weight)``."""
    rows = population.where(is_entity).select(
        F.col(entity).alias("entity"), (F.col(amount).try_cast("double") / 1e6).alias("population")
    )
    return aggregate.shares(rows, "entity", "population")


def weighted_index(
    values: DataFrame,
    dimension: DataFrame,
    group: str,
    value: str = "value",
    entity: str = "entity",
    weighted: bool = True,
    centred: bool = False,
    places: int | None = 2,
    national: str = "mean",
) -> DataFrame:
    """Entity values to group contributions and a national row, in one pass.

    Values are rounded half-even to ``places``, multiplied by the entity's national share and summed by group.
    The national row is the mean of the weighted values over entities, or with ``national="sum"`` their sum.

    The join loses nobody: a group is NULL in a period in which one of the dimension's entities has no value, and the
    national row also where an entity with a value is not in the dimension (``aggregate.unmatched`` names them).
    """
    x = ident(value) if places is None else f"bround({ident(value)}, {places})"
    sized = aggregate.with_members(dimension, group)
    joined = values.join(sized.select(entity, group, "_members", "_everyone", *(["weight"] if weighted else [])), entity, "left")
    everyone = sized.agg(F.max("_everyone")).scalar()
    rows = joined.withColumn("_everyone", everyone).selectExpr(
        "period_idx",
        f"{x} * weight AS _x" if weighted else f"CASE WHEN _members IS NOT NULL THEN {x} END AS _x",
        f"inline(array(named_struct('region', cast({ident(group)} AS string), 'is_total', false, '_wanted', _members),"
        f" named_struct('region', '{NATIONAL}', 'is_total', true, '_wanted', _everyone)))",
    )
    total = "sum(_x)" if national == "sum" else "avg(_x)"
    complete = "count(_x) = count(*) AND count(*) = max(_wanted)"
    strict = f"CASE WHEN {complete} THEN CASE WHEN is_total THEN {total} ELSE sum(_x) END END"
    index = rows.where("region IS NOT NULL").groupBy("region", "is_total", "period_idx").agg(F.expr(f"{strict} AS {ident(value)}"))
    if centred:
        index = aggregate.zscore(index, ["region"], value, value)
    return index


def climate_norm(
    index: DataFrame, keys: Sequence[str], value: str, years: int, start: int, freq: int = 4
) -> DataFrame:
    """Trailing norm of a monthly index from month ``start`` on, by month or as quarterly mean."""
    normed = windows.trailing_norms(index, keys, [value], [years]).select(
        *keys, "period_idx", F.col(f"norm_{years}_{value}").alias("norm")
    )
    normed = normed.where((F.col("period_idx") >= start) & F.col("norm").isNotNull())
    return aggregate.to_quarters(normed, keys, ["norm"]) if freq == 4 else normed


def observed_panel(
    index: DataFrame, keys: Sequence[str], values: Sequence[str], start: int, end: int, freq: int = 4
) -> DataFrame:
    """Observed values in a closed month range with year, sub-period and season.

    A range that starts inside a quarter leaves a first quarter of fewer months.
    """
    kept = selection.in_range(index, "period_idx", start, end)
    if freq == 4:
        kept = aggregate.to_quarters(kept, keys, values)
    return with_calendar(kept, freq)


def with_calendar(panel: DataFrame, freq: int) -> DataFrame:
    sub = f"cast(pmod(period_idx, {freq}) + 1 AS int)"
    dated = panel.selectExpr("*", f"cast(floor(period_idx / {freq}) AS int) AS year", f"{sub} AS sub_period")
    return dated.withColumn("season", cal.season(F.col("sub_period"), freq))


def anomaly(panel: DataFrame, value: str, norm: str, years: str | int, suffix: str) -> DataFrame:
    """Scaled deviation from the norm, 2/(m+1) (x - norm), with its size and its signed parts.

    ``years`` is m itself or the name of the column that holds it.
    """
    d = ident(f"deviation_{suffix}")
    scaled = panel.selectExpr("*", f"2.0D / ({years} + 1) * ({ident(value)} - {ident(norm)}) AS {d}")
    return scaled.selectExpr(
        "*",
        f"abs({d}) AS {ident(f'abs_deviation_{suffix}')}",
        f"CASE WHEN {d} > 0 THEN {d} WHEN {d} <= 0 THEN 0D END AS {ident(f'pos_dev_{suffix}')}",
        f"CASE WHEN {d} < 0 THEN -{d} WHEN {d} >= 0 THEN 0D END AS {ident(f'neg_dev_{suffix}')}",
    )


def extreme_season_flags(panel: DataFrame, deviation: str, threshold: float) -> DataFrame:
    """Hot and cold season indicators.

    A season's indicator is 1 for the extreme, NULL for the opposite extreme in that season, 0 otherwise.
    """
    d, season = F.col(deviation), F.col("season")
    hot, cold = d >= threshold, d <= -threshold

    def flag(name: str, extreme: Column, opposite: Column) -> Column:
        inside = season == name
        value = F.when(inside & extreme, 1).when(inside & opposite, F.lit(None)).otherwise(0)
        return F.when(d.isNotNull() | (season != name), value).cast("int")

    return panel.withColumns(
        {
            "all_seasons": F.when(d.isNotNull(), (F.abs(d) >= threshold).cast("int")),
            "h_winter": flag("winter", hot, cold),
            "h_spring": flag("spring", hot, cold),
            "h_summer": flag("summer", hot, cold),
            "h_autumn": flag("autumn", hot, cold),
            "c_winter": flag("winter", cold, hot),
        }
    )


def all_norms(
    index: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    years: Sequence[int],
    start: int,
    end: int,
    freq: int = 4,
) -> DataFrame:
    """Observed values, norms and anomalies for every measure and norm length, keyed by ``norm_years``.

    The norms are frames of one window, the quarterly means one aggregation for all of them, and only the
    rolled-up rows are repeated per norm.
    """
    names = [f"norm_{m}_{v}" for m in years for v in values]
    # The end may be cut before the window, since a norm looks back only; the start may not.
    normed = windows.trailing_norms(index.where(F.col("period_idx") <= end), keys, values, years)
    observed = observed_panel(normed, keys, [*values, *names], start, end, freq)
    long = windows.norms_long(observed, values, years)
    for v in values:
        long = anomaly(long, v, f"mean_{v}", "norm_years", v)
    return long
