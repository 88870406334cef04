"""Event impacts by region: list cells, dimension join, monthly means, calendar, quarters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.names import conform
from panelloom.operators import aggregate, joins, reshape

# Event groups of interest.
EVENT_GROUPS = ("Hydrological", "Meteorological", "Climatological")


def event_panel(
    events: DataFrame,
    places: DataFrame,
    dimension: DataFrame,
    group: str,
    event_groups: Sequence[str],
    aliases: DataFrame,
    start: int,
    end: int,
    freq: int = 4,
) -> DataFrame:
    """Events ``(event_id, location, event_group, period_idx, impact)`` to one impact column per event group.

    ``places`` has ``(event_id, location, states)``, the states as a comma list. Impacts are averaged by month,
    region and event group, the months completed to the given range, and rolled up to quarters.
    """
    wanted = events.where(F.col("event_group").isin(list(event_groups)))
    located = wanted.join(places, ["event_id", "location"], "full")
    exploded = reshape.split_rows(
        located.select("event_group", "period_idx", "impact", "states"), "states"
    )
    named = conform(exploded, "states", aliases).drop("states")
    regional = named.join(dimension.select("entity", F.col(group).alias("region")), "entity")
    monthly = aggregate.group_mean(regional, ["region", "event_group", "period_idx"], "impact", "impact")
    monthly = monthly.where(F.col("period_idx").between(start, end))
    wide = reshape.to_wide(monthly, ["region", "period_idx"], "event_group", "impact", list(event_groups))
    complete = joins.complete_periods(wide, ["region"], start, end)
    if freq == 4:
        return aggregate.to_quarters(complete, ["region"], list(event_groups))
    return complete
