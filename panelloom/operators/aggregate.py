"""Group totals, roll-ups and distributions, with explicit rules for missing values.

``strict`` means that one missing value makes the result missing; the default skips missing values.
All of these combine on the map side first, so a key that holds most rows ships one partial row per task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import calendar as cal
from panelloom.functions.text import ident
from panelloom.operators.ranking import exact_quantiles


def strict(aggregate: Column, x: Column) -> Column:
    """The aggregate where no value of the group is missing, else NULL."""
    return F.when(F.count(x) == F.count(F.lit(1)), aggregate)


def sum_or_zero(x: Column) -> Column:
    """Sum that skips missing values and is 0, not NULL, when all are missing."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def to_quarters(panel: DataFrame, keys: Sequence[str], values: Sequence[str], strict_mean: bool = False) -> DataFrame:
    """Monthly panel to quarterly means."""
    means = {v: f"avg({ident(v)})" for v in values}
    if strict_mean:
        means = {v: f"CASE WHEN count({ident(v)}) = count(*) THEN {mean} END" for v, mean in means.items()}
    quarter = cal.month_to_quarter_index(F.col("period_idx")).alias("period_idx")
    return panel.groupBy(*keys, quarter).agg(*[F.expr(f"{mean} AS {ident(v)}") for v, mean in means.items()])


def weighted_total(
    panel: DataFrame,
    dimension: DataFrame,
    group: str,
    value: str = "value",
    entity: str = "entity",
    weighted: bool = True,
) -> DataFrame:
    """Group total of entity values times the entity's share of the grand total.

    The shares are national, so a group's total is its contribution and not its mean. It is NULL in a period in which
    one of the group's entities has no value; entities outside the dimension belong to no group (``unmatched``).
    """
    contribution = F.col(value) * F.col("weight") if weighted else F.col(value)
    sized = with_members(dimension, group)
    joined = panel.join(sized.select(entity, group, "_members", *(["weight"] if weighted else [])), entity)
    complete = (F.count(contribution) == F.count(F.lit(1))) & (F.count(F.lit(1)) == F.max("_members"))
    return joined.groupBy(group, "period_idx").agg(F.when(complete, F.sum(contribution)).alias(value))


def with_members(dimension: DataFrame, group: str) -> DataFrame:
    """The dimension with the number of entities of each group and of all, ``_members`` and ``_everyone``."""
    counts = dimension.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_members"))
    sized = dimension.join(counts, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    return sized.withColumn("_everyone", dimension.agg(F.count(F.lit(1))).scalar())


def unmatched(panel: DataFrame, dimension: DataFrame, entity: str = "entity") -> DataFrame:
    """``entity, side``: entities of the panel that the dimension lacks (``values``), and the reverse (``dimension``)."""
    lacking = panel.select(entity).distinct().join(dimension, entity, "left_anti").withColumn("side", F.lit("values"))
    return lacking.unionByName(dimension.select(entity).distinct().join(panel, entity, "left_anti").withColumn("side", F.lit("dimension")))


def national_row(
    panel: DataFrame, dimension: DataFrame, value: str = "value", entity: str = "entity", mode: str = "mean",
    weighted: bool = True,
) -> DataFrame:
    """The national value per period: by default the plain mean over entities of their weighted values.

    ``mode="sum"`` gives the proper weighted mean, their sum. It is NULL in a period in which an entity of the
    dimension has no value, or one with a value is not in the dimension.
    """
    known = dimension.select(entity, F.lit(True).alias("_known"), *(["weight"] if weighted else []))
    contribution = F.col(value) * F.col("weight") if weighted else F.when(F.col("_known"), F.col(value))
    joined = panel.join(known, entity, "left").withColumn("_everyone", dimension.agg(F.count(F.lit(1))).scalar())
    total = F.avg(contribution) if mode == "mean" else F.sum(contribution)
    complete = (F.count(contribution) == F.count(F.lit(1))) & (F.count(F.lit(1)) == F.max("_everyone"))
    return joined.groupBy("period_idx").agg(F.when(complete, total).alias(value))


def entity_mean(panel: DataFrame, value: str = "value") -> DataFrame:
    """Unweighted mean over all entities by period."""
    return panel.groupBy("period_idx").agg(strict(F.avg(value), F.col(value)).alias(value))


def shares(df: DataFrame, entity: str, amount: str) -> DataFrame:
    """Each entity's share of the grand total, which is a scalar subquery: one value, no join."""
    total = df.agg(F.sum(amount)).scalar()
    return df.withColumn("weight", F.col(amount) / total)


def ratio_of_sums(df: DataFrame, keys: Sequence[str], numerator: str, denominator: str, name: str) -> DataFrame:
    """Sum over sum by group; a group whose numerators are all missing counts as 0."""
    return df.groupBy(*keys).agg(
        F.try_divide(sum_or_zero(F.col(numerator)), F.sum(denominator)).alias(name)
    )


def describe_by(panel: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, standard deviation and quartiles of a panel measure.

    The exact quartiles keep a group's distinct values in memory: on a panel, one per period.
    """
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = panel.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdv"), quartiles.alias("_q")
    )
    return stats.select(
        *keys, "mean", "stdv", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    )


def describe_rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``describe_by`` for raw rows, where one group may hold most of them."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdv"))
    names = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    quartiles = exact_quantiles(df, keys, value, list(names)).groupBy(*keys).pivot("probability", list(names))
    wide = quartiles.agg(F.first("quantile")).withColumnsRenamed({str(p): n for p, n in names.items()})
    return moments.join(wide, list(keys), "left")


def zscore(panel: DataFrame, keys: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Centre and scale each entity's series."""
    w = Window.partitionBy(*keys)
    centred = F.col(value) - F.avg(value).over(w)
    return panel.withColumn(name, F.try_divide(centred, F.stddev_samp(value).over(w)))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins over each group's own range; the largest value belongs to the last bin."""
    ranges = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    x, low, high = F.col(value), F.col("low"), F.col("high")
    place = F.floor(F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0)) * bins)
    ranged = df.where(x.isNotNull()).join(ranges, list(keys))
    return ranged.groupBy(*keys, F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(low + (high - low) * (F.least(place, F.lit(bins - 1)) / bins)).alias("bin_low"),
    )


def kernel_density(panel: DataFrame, keys: Sequence[str], value: str, points: int = 64) -> DataFrame:
    """Gaussian kernel density of a panel measure on a grid, by group.

    Bandwidth 0.9 min(sd, IQR/1.34) n^(-1/5); the grid spans the range plus three bandwidths each way.
    Every (row, grid point) pair is summed on the map side, so the shuffle carries one row per point.
    """
    rows = panel.where(F.col(value).isNotNull())
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.stddev_samp(value).alias("_sd"),
        quartiles.alias("_q"),
        F.min(value).alias("_low"),
        F.max(value).alias("_high"),
    )
    spread = F.least(F.col("_sd"), (F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))) / 1.34)
    spread = F.coalesce(F.nullif(spread, F.lit(0.0)), F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0))
    stats = stats.select(*keys, "_low", "_high", (0.9 * spread * F.pow("_n", F.lit(-0.2))).alias("_h"))
    h = F.col("_h")
    step = (F.col("_high") - F.col("_low") + 6 * h) / (points - 1)
    gridded = rows.select(*keys, F.col(value).alias("_x")).join(stats, list(keys)).select(
        *keys, "_x", "_h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
        (F.col("_low") - 3 * h).alias("_from"), step.alias("_step"),
    )
    at = F.col("_from") + F.col("point") * F.col("_step")
    kernel = F.exp(-0.5 * F.pow((at - F.col("_x")) / h, F.lit(2.0)))
    return gridded.groupBy(*keys, "point").agg(
        F.min(at).alias("x"), (F.avg(kernel) / (F.min(h) * math.sqrt(2 * math.pi))).alias("density")
    )


def binned_density(df: DataFrame, keys: Sequence[str], value: str, points: int = 64, refine: int = 16) -> DataFrame:
    """``kernel_density`` of raw rows, from linearly binned counts: the work per row does not depend on the grid.

    Between two grid points lie ``refine`` bins of width d. A row shares its weight between the two ends of its bin by
    distance, so a bin is a count and a sum that merge on the map side, and the kernel is summed over bins, not rows.
    The result is off by at most d^2 / (8 h^3 sqrt(2 pi)), h being the bandwidth. Quartiles are exact, by ranks over
    range partitions, so no task holds a group. Rows without a value take no part.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    stats = describe_rows(rows, keys, "_x").join(sizes, list(keys))
    spread = F.least(F.col("stdv"), (F.col("p75") - F.col("p25")) / 1.34)
    spread = F.coalesce(F.nullif(spread, F.lit(0.0)), F.nullif(F.col("stdv"), F.lit(0.0)), F.lit(1.0))
    h = F.col("_h")
    stats = stats.select(*keys, "_n", "_low", "_high", (0.9 * spread * F.pow("_n", F.lit(-0.2))).alias("_h")).select(
        *keys, "_n", "_h", (F.col("_low") - 3 * h).alias("_from"),
        ((F.col("_high") - F.col("_low") + 6 * h) / ((points - 1) * refine)).alias("_step"),
    )
    at = (F.col("_x") - F.col("_from")) / F.col("_step")
    placed_rows = rows.join(stats.select(*keys, "_from", "_step"), list(keys)).select(*keys, F.floor(at).alias("_bin"), (at - F.floor(at)).alias("_far"))
    bins = placed_rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_far").alias("_far"))
    # At most (points - 1) x refine bins a group from here on.
    spots = bins.join(stats, list(keys)).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    apart = (F.col("point") * refine - F.col("_bin")) * F.col("_step") / h
    kernel = lambda u: F.exp(-0.5 * u * u)
    mass = (F.col("_rows") - F.col("_far")) * kernel(apart) + F.col("_far") * kernel(apart - F.col("_step") / h)
    return spots.groupBy(*keys, "point").agg(
        F.min(F.col("_from") + F.col("point") * refine * F.col("_step")).alias("x"),
        (F.sum(mass) / (F.min("_n") * F.min(h) * math.sqrt(2 * math.pi))).alias("density"),
    )


def balance(panel: DataFrame, keys: Sequence[str], period: str = "period_idx") -> DataFrame:
    """Rows and periods per entity, and whether its calendar has no gap."""
    counts = panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(period).alias("n_periods"),
        (F.max(period) - F.min(period) + 1).alias("span"),
    )
    return counts.withColumn(
        "gap_free", (F.col("n_rows") == F.col("n_periods")) & (F.col("n_periods") == F.col("span"))
    )


def group_mean(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean per group that skips missing values; a group without values is NULL."""
    return df.groupBy(*keys).agg(F.avg(value).alias(name))
