"""Roll-ups, weighted totals and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalogue.registry import query, rnd, rounded
from panelloom.catalogue.sql import SEASON, TABLES
from panelloom.functions import calendar as cal
from panelloom.operators import aggregate
from panelloom.plans import climate, macro, views
from panelloom.plans import tables as tb


@query("A1", f"SELECT entity, period_idx // 3 AS period_idx, {rnd('avg(value)', 4)} AS value FROM spine GROUP BY 1, 2")
def quarter_mean_skip(spark, sf):
    return rounded(aggregate.to_quarters(tb.monthly_panel(spark, sf), ["entity"], ["value"]), 4, "value")


@query(
    "A2 N2",
    f"SELECT entity, period_idx // 3 AS period_idx, {rnd('CASE WHEN count(value) = count(*) THEN avg(value) END', 4)} AS value FROM spine GROUP BY 1, 2",
)
def quarter_mean_strict(spark, sf):
    quarters = aggregate.to_quarters(tb.monthly_panel(spark, sf), ["entity"], ["value"], strict_mean=True)
    return rounded(quarters, 4, "value")


@query(
    "D3 A3 A4 A6 U1 N1",
    f"SELECT region, is_total, period_idx, {rnd('value', 4)} AS value FROM contributions UNION ALL SELECT region, is_total, period_idx, {rnd('value', 4)} FROM national_mean",
)
def weighted_region_index(spark, sf):
    index = climate.weighted_index(tb.monthly_panel(spark, sf), tb.weights(spark, sf), "r_name", places=None)
    return rounded(index, 4, "value")


def _index_sql(national: str, source: str = "spine", x: str = "value * weight") -> str:
    """Contributions and the national row over the completed panel, NULL where an entity has no value."""
    return f"""SELECT r_name AS region, false AS is_total, period_idx, CASE WHEN count(value) = count(*) THEN sum({x}) END AS value
      FROM {source} JOIN weighted USING (entity) GROUP BY 1, 2, 3
    UNION ALL SELECT 'national', true, period_idx, CASE WHEN count(value) = count(*) THEN {national}({x}) END
      FROM {source} JOIN weighted USING (entity) GROUP BY 1, 2, 3"""


# Half-even at the decimal digits that a number shows, as exact decimals.
_CENTS = "CAST(CAST(value AS VARCHAR) AS DECIMAL(30, 12)) * 100"
_EVEN = f"""(SELECT entity, period_idx, CAST(CASE WHEN part < 0.5 THEN low WHEN part > 0.5 THEN low + 1 ELSE low + low % 2 END AS DOUBLE) / 100 AS value
  FROM (SELECT *, floor({_CENTS}) AS low, {_CENTS} - floor({_CENTS}) AS part FROM spine))"""


@query("D3 F17", f"SELECT region, is_total, period_idx, {rnd('value', 6)} AS value FROM ({_index_sql('avg', _EVEN)})")
def rounded_region_index(spark, sf):
    """Values rounded half-even to two places before they are weighted."""
    index = climate.weighted_index(tb.monthly_panel(spark, sf), tb.weights(spark, sf), "r_name", places=2)
    return rounded(index, 6, "value")


@query("D3 A4", f"SELECT region, is_total, period_idx, {rnd('value', 4)} AS value FROM ({_index_sql('sum')})")
def national_sum_index(spark, sf):
    """The national row as the sum of the weighted values."""
    index = climate.weighted_index(tb.monthly_panel(spark, sf), tb.weights(spark, sf), "r_name", places=None, national="sum")
    return rounded(index, 4, "value")


@query(
    "D3 A9",
    f"""SELECT region, is_total, period_idx, {rnd('(value - avg(value) OVER (PARTITION BY region)) / nullif(stddev_samp(value) OVER (PARTITION BY region), 0)', 4)} AS value
    FROM ({_index_sql('avg')})""",
)
def centred_region_index(spark, sf):
    index = climate.weighted_index(tb.monthly_panel(spark, sf), tb.weights(spark, sf), "r_name", places=None, centred=True)
    return rounded(index, 4, "value")


# One nation is missing from the dimension, another one has no values.
_GONE, _SILENT = 3, 5


@query(
    "D3 A3 A4",
    f"""SELECT region, is_total, period_idx, {rnd('CASE WHEN NOT is_total AND NOT silent THEN value END', 4)} AS value FROM (
      SELECT r_name AS region, false AS is_total, period_idx, CASE WHEN count(value) = count(*) THEN sum(value * weight) END AS value, bool_or(lost) AS silent
      FROM (SELECT * FROM spine WHERE entity <> {_SILENT}) JOIN (SELECT *, bool_or(entity = {_SILENT}) OVER (PARTITION BY r_name) AS lost FROM weighted WHERE entity <> {_GONE}) USING (entity)
      GROUP BY 1, 2, 3 UNION ALL SELECT 'national', true, period_idx, NULL, true FROM calendar)""",
)
def incomplete_region_index(spark, sf):
    """Groups with an absent entity, and the national row, are NULL; nobody is dropped in silence."""
    values, dimension = tb.monthly_panel(spark, sf).where(f"entity <> {_SILENT}"), tb.weights(spark, sf).where(f"entity <> {_GONE}")
    return rounded(climate.weighted_index(values, dimension, "r_name", places=None), 4, "value")


@query("D3 J3", f"SELECT CAST(unnest([{_GONE}, {_SILENT}]) AS INTEGER) AS entity, unnest(['values', 'dimension']) AS side")
def unmatched_entities(spark, sf):
    values, dimension = tb.monthly_values(spark, sf).where(f"entity <> {_SILENT}"), tb.weights(spark, sf).where(f"entity <> {_GONE}")
    return aggregate.unmatched(values, dimension)


@query(
    "A3 D3",
    f"""SELECT r_name, period_idx, {rnd('CASE WHEN count(value) = count(*) THEN sum(value) END', 4)} AS value
    FROM spine JOIN weighted USING (entity) GROUP BY 1, 2""",
)
def unweighted_region_total(spark, sf):
    totals = aggregate.weighted_total(tb.monthly_panel(spark, sf), tb.weights(spark, sf), "r_name", weighted=False)
    return rounded(totals, 4, "value")


@query("A5", f"SELECT period_idx, {rnd('CASE WHEN count(value) = count(*) THEN avg(value) END', 4)} AS value FROM spine GROUP BY 1")
def entity_mean(spark, sf):
    return rounded(aggregate.entity_mean(tb.monthly_panel(spark, sf)), 4, "value")


@query("A6", f"SELECT entity, population, {rnd('weight', 8)} AS weight FROM weighted")
def national_shares(spark, sf):
    return rounded(tb.weights(spark, sf).select("entity", "population", "weight"), 8, "weight")


TABLES["regional_output"] = """
SELECT r_name AS region, c_mktsegment AS sector, period_idx, coalesce(sum(amount), 0.0) / sum(population) AS value
FROM segment_quarters JOIN weighted USING (entity) GROUP BY 1, 2, 3"""


@query("A7 D12 N4", f"SELECT region, sector, period_idx, {rnd('value', 4)} AS value FROM regional_output")
def per_capita_ratio(spark, sf):
    output = (
        tb.located_orders(spark, sf)
        .groupBy("entity", F.col("c_mktsegment").alias("sector"), cal.month_to_quarter_index(F.col("period_idx")).alias("period_idx"))
        .agg((F.sum("cents") / 100.0).alias("value"))
    )
    return rounded(macro.per_capita(output, tb.weights(spark, sf), "r_name"), 4, "value")


@query(
    "A8 N8",
    f"""SELECT entity, {rnd('avg(value)', 4)} AS mean, {rnd('stddev_samp(value)', 4)} AS stdv,
    {rnd('quantile_cont(value, 0.25)', 4)} AS p25, {rnd('quantile_cont(value, 0.5)', 4)} AS p50, {rnd('quantile_cont(value, 0.75)', 4)} AS p75
    FROM monthly GROUP BY 1""",
)
def summary_stats(spark, sf):
    stats = aggregate.describe_by(tb.monthly_values(spark, sf), ["entity"], "value")
    return rounded(stats, 4, "mean", "stdv", "p25", "p50", "p75")


@query(
    "A8 N8",
    f"""SELECT l_returnflag, {rnd('avg(l_extendedprice)', 2)} AS mean, {rnd('stddev_samp(l_extendedprice)', 2)} AS stdv,
    {rnd('quantile_cont(l_extendedprice, 0.25)', 4)} AS p25, {rnd('quantile_cont(l_extendedprice, 0.5)', 4)} AS p50, {rnd('quantile_cont(l_extendedprice, 0.75)', 4)} AS p75
    FROM lineitem GROUP BY 1""",
)
def summary_stats_rows(spark, sf):
    """Exact quartiles over raw rows in three large groups."""
    stats = aggregate.describe_rows(tb.read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(rounded(stats, 2, "mean", "stdv"), 4, "p25", "p50", "p75")


@query(
    "A9",
    f"""SELECT entity, period_idx, {rnd('(value - avg(value) OVER (PARTITION BY entity)) / stddev_samp(value) OVER (PARTITION BY entity)', 6)} AS z FROM monthly""",
)
def zscore_entity(spark, sf):
    scored = aggregate.zscore(tb.monthly_values(spark, sf), ["entity"], "value")
    return rounded(scored.select("entity", "period_idx", "z"), 6, "z")


@query(
    "A10",
    f"""SELECT event_type, CAST(dayofmonth(ts) AS INTEGER) AS day, {rnd('sum(CAST(round(value * 100) AS BIGINT)) / 100.0 / count(value)', 6)} AS impact FROM events GROUP BY 1, 2""",
)
def event_impact_mean(spark, sf):
    events = tb.read(spark, sf, "events").select(
        "event_type", F.dayofmonth("ts").alias("day"), tb.cents("value").alias("c")
    )
    means = aggregate.group_mean(events, ["event_type", "day"], "c", "impact")
    return rounded(means.withColumn("impact", F.col("impact") / 100.0), 6, "impact")


TABLES["seasonal_values"] = f"SELECT entity, {SEASON} AS season, value FROM (SELECT entity, period_idx // 3 AS period_idx, value FROM monthly)"


def _by_season(spark, sf):
    quarter = cal.sub_period_of(cal.month_to_quarter_index(F.col("period_idx")), 4)
    return tb.monthly_values(spark, sf).withColumn("season", cal.season(quarter, 4))


@query(
    "A12",
    f"""WITH s AS (SELECT entity, season, count(*) AS n, stddev_samp(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
      min(value) AS low, max(value) AS high FROM seasonal_values GROUP BY 1, 2),
    b AS (SELECT *, 0.9 * coalesce(nullif(least(sd, iqr / 1.34), 0), nullif(sd, 0), 1.0) * pow(n, -0.2) AS h FROM s),
    g AS (SELECT *, low - 3 * h + p * (high - low + 6 * h) / 63 AS x FROM b, (SELECT CAST(unnest(range(64)) AS INTEGER) AS p))
    SELECT g.entity, g.season, p AS point, {rnd('any_value(x)', 3)} AS x,
      {rnd('1e6 * avg(exp(-0.5 * pow((x - value) / h, 2))) / (any_value(h) * sqrt(2 * pi()))', 4)} AS density
    FROM g JOIN seasonal_values v ON v.entity = g.entity AND v.season = g.season GROUP BY 1, 2, 3""",
)
def kde_season(spark, sf):
    density = aggregate.kernel_density(_by_season(spark, sf), ["entity", "season"], "value")
    return rounded(rounded(density.withColumn("density", F.col("density") * 1e6), 4, "density"), 3, "x")


@query(
    "A12",
    f"""WITH r AS (SELECT entity, season, min(value) AS low, max(value) AS high FROM seasonal_values GROUP BY 1, 2)
    SELECT entity, season, bin, count(*) AS n, {rnd('min(low + (high - low) * (bin / 10.0))', 4)} AS bin_low FROM (
      SELECT entity, season, low, high, CAST(least(floor(coalesce((value - low) / nullif(high - low, 0), 0) * 10), 9) AS INTEGER) AS bin
      FROM seasonal_values JOIN r USING (entity, season)) GROUP BY 1, 2, 3""",
)
def histogram_season(spark, sf):
    return rounded(aggregate.histogram(_by_season(spark, sf), ["entity", "season"], "value", 10), 4, "bin_low")


@query(
    "A12 N8",
    f"""WITH s AS (SELECT l_returnflag, count(*) AS n, stddev_samp(l_extendedprice) AS sd, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr,
      min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1),
    b AS (SELECT *, 0.9 * coalesce(nullif(least(sd, iqr / 1.34), 0), nullif(sd, 0), 1.0) * pow(n, -0.2) AS h FROM s),
    d AS MATERIALIZED (SELECT *, low - 3 * h AS start, (high - low + 6 * h) / 1008.0 AS step FROM b),
    u AS (SELECT l_returnflag, (l_extendedprice - start) / step AS u FROM lineitem JOIN d USING (l_returnflag)),
    c AS MATERIALIZED (SELECT l_returnflag, floor(u) AS node, count(*) AS m, sum(u - floor(u)) AS f FROM u GROUP BY 1, 2),
    nodes AS MATERIALIZED (SELECT l_returnflag, node, sum(mass) AS mass FROM (SELECT l_returnflag, node, m - f AS mass FROM c UNION ALL SELECT l_returnflag, node + 1, f FROM c) GROUP BY 1, 2)
    SELECT l_returnflag, p AS point, {rnd('any_value(start + 16 * p * step)', 3)} AS x,
      {rnd('1e6 * sum(mass * exp(-0.5 * pow((16 * p - node) * step / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 4)} AS density
    FROM nodes JOIN d USING (l_returnflag), (SELECT CAST(unnest(range(64)) AS INTEGER) AS p) GROUP BY 1, 2""",
)
def kde_price_binned(spark, sf):
    """Density of raw rows in three large groups."""
    density = aggregate.binned_density(tb.read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(rounded(density.withColumn("density", F.col("density") * 1e6), 4, "density"), 3, "x")


TABLES["summary_long"] = """
SELECT region, unnest(['gdp_total', 'deviation_temp']) AS var, unnest([1, 2]) AS var_order, unnest([gdp_total, deviation_temp]) AS x
FROM (SELECT CAST(entity AS VARCHAR) AS region, gdp_total, deviation_temp FROM output_quarters
  FULL JOIN (SELECT entity, period_idx, deviation_temp FROM temp_anomalies WHERE norm_years = 1) USING (entity, period_idx))"""

_shown = ", ".join(
    f"CASE WHEN {c} IS NULL THEN NULL WHEN var = 'gdp_total' THEN printf('%.2f', {rnd(c, 2)}) ELSE printf('%.4f', {rnd(c, 4)}) END AS {c}"
    for c in ("mean", "stdv", "p25", "p50", "p75")
)


@query(
    "V1 A8 F8 P12",
    f"""WITH s AS (SELECT var, var_order, region, avg(x) AS mean, stddev_samp(x) AS stdv, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75
      FROM summary_long GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY var_order ORDER BY region <> '0', region) AS "row" FROM s)
    SELECT CAST(var_order AS INTEGER) AS var_order, CAST("row" AS INTEGER) AS "row",
      CASE WHEN "row" = 1 THEN CASE var WHEN 'gdp_total' THEN 'Total output' ELSE 'Temperature anomalies' END END AS title, region, {_shown}
    FROM o""",
)
def summary_view(spark, sf):
    """Text summary by variable and region; nation 0 stands in the place of the national row."""
    anomalies = tb.weather(spark, sf).where(F.col("norm_years") == 1).select("entity", "period_idx", "deviation_temp")
    output = tb.outputs(spark, sf).select("entity", "period_idx", "gdp_total")
    both = output.join(anomalies, ["entity", "period_idx"], "full")
    panel = both.withColumn("region", F.col("entity").cast("string"))
    titles = {"gdp_total": ("Total output", 2), "deviation_temp": ("Temperature anomalies", 4)}
    return views.summary_table(panel, titles, total="0")
