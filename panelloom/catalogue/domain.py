"""Composite operators: anomalies, merged panels, event panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalogue.registry import query, rnd, rounded
from panelloom.catalogue.sql import END, SEASON, START, TABLES, adjusted, anomalies
from panelloom.functions import calendar as cal
from panelloom.plans import climate, events, macro, panel
from panelloom.plans import tables as tb

TABLES["value_anomalies"] = anomalies("value", "monthly")

_PARTS = ["deviation_value", "abs_deviation_value", "pos_dev_value", "neg_dev_value"]


@query(
    "D5 D7 A3 W1 P4 A1 F15 F17",
    f"""WITH r AS (SELECT r_name AS entity, period_idx, CASE WHEN count(value) = count(*) THEN sum(value * weight) END AS value
      FROM spine JOIN weighted USING (entity) GROUP BY 1, 2),
    x AS ({anomalies('value', 'r', [3])})
    SELECT entity AS region, CAST(period_idx // 4 AS INTEGER) AS year, CAST(period_idx % 4 + 1 AS INTEGER) AS quarter, {SEASON} AS season,
      {rnd('value', 4)} AS value, {rnd('mean_value', 4)} AS norm, {", ".join(f"{rnd(p, 4)} AS {p}" for p in _PARTS)} FROM x""",
)
def scaled_anomaly_quarter(spark, sf):
    """Share-weighted monthly index by region, its three-year norm, and the scaled quarterly anomaly.

    A month in which one of the region's nations has no orders has no index.
    """
    index = climate.weighted_index(tb.monthly_panel(spark, sf), tb.weights(spark, sf), "r_name", places=None)
    index = index.where(~F.col("is_total"))
    long = climate.all_norms(index, ["region"], ["value"], [3], START, END)
    table = long.select(
        "region", "year", F.col("sub_period").alias("quarter"), "season", "value", F.col("mean_value").alias("norm"), *_PARTS
    )
    return rounded(table, 4, "value", "norm", *_PARTS)


@query(
    "D4 D5 D8 J9",
    f"SELECT norm_years, entity, period_idx, {rnd('value', 4)} AS value, {rnd('mean_value', 4)} AS mean_value, {rnd('deviation_value', 4)} AS deviation_value FROM value_anomalies",
)
def all_norms_long(spark, sf):
    long = climate.all_norms(tb.monthly_values(spark, sf), ["entity"], ["value"], tb.NORMS, START, END)
    columns = ["value", "mean_value", "deviation_value"]
    return rounded(long.select("norm_years", "entity", "period_idx", *columns), 4, *columns)


@query("D4", f"SELECT entity, period_idx, {rnd('mean_value', 4)} AS norm FROM value_anomalies WHERE norm_years = 2 AND mean_value IS NOT NULL")
def climate_norm(spark, sf):
    norm = climate.climate_norm(tb.monthly_values(spark, sf).where(F.col("period_idx") <= END), ["entity"], "value", 2, START)
    return rounded(norm, 4, "norm")


_THRESHOLD = tb.EXTREME
_SEASONS = {"h_winter": "winter", "h_spring": "spring", "h_summer": "summer", "h_autumn": "autumn"}


def _flag(season: str, extreme: str, opposite: str, name: str) -> str:
    return f"""CAST(CASE WHEN season <> '{season}' THEN 0 WHEN d {extreme} THEN 1 WHEN d {opposite} THEN NULL
      WHEN d IS NOT NULL THEN 0 END AS INTEGER) AS {name}"""


@query(
    "D6 F15 H12",
    f"""SELECT norm_years, entity, period_idx, CAST(abs(d) >= {_THRESHOLD} AS INTEGER) AS all_seasons,
      {", ".join(_flag(s, f">= {_THRESHOLD}", f"<= -{_THRESHOLD}", n) for n, s in _SEASONS.items())},
      {_flag("winter", f"<= -{_THRESHOLD}", f">= {_THRESHOLD}", "c_winter")}
    FROM (SELECT norm_years, entity, period_idx, deviation_temp AS d, {SEASON} AS season FROM temp_anomalies)""",
)
def extreme_flags(spark, sf):
    index = tb.shipments(spark, sf).select("entity", "period_idx", "temp")
    long = climate.all_norms(index, ["entity"], ["temp"], tb.NORMS, START, END)
    flagged = climate.extreme_season_flags(long, "deviation_temp", _THRESHOLD)
    return flagged.select("norm_years", "entity", "period_idx", "all_seasons", *_SEASONS, "c_winter")


@query(
    "D9 A2 R2 J5",
    "SELECT entity, period_idx, " + ", ".join(f"{rnd(p, 4)} AS {p}" for p in tb.PRICES) + " FROM price_quarters",
)
def price_panel(spark, sf):
    price = macro.price_panel(tb.prices(spark, sf), tb.PRIORITIES, START, END, adjusted=False)
    return rounded(price, 4, *tb.PRICES)


def _report(spark, sf):
    """A long activity report with text values."""
    return tb.located_orders(spark, sf).groupBy(
        "entity", F.col("c_mktsegment").alias("sector"), cal.month_to_quarter_index(F.col("period_idx")).alias("period_idx")
    ).agg((F.sum("cents") / 100.0).cast("string").alias("value"))


@query(
    "D10 F19 R2",
    f"""SELECT entity, period_idx, {", ".join(f"{rnd(c, 2)} AS {c}" for c in tb.SECTORS)} FROM output_quarters
    WHERE period_idx BETWEEN {START // 3} AND {END // 3}""",
)
def activity_index(spark, sf):
    """A long report with text values to one column per sector."""
    wide = macro.activity_index(_report(spark, sf), list(tb.SEGMENTS), START // 3, END // 3, adjusted=False)
    return rounded(wide.withColumnsRenamed(tb.SEGMENTS), 2, *tb.SECTORS)


TABLES["output_spine"] = f"""
WITH o AS (SELECT * FROM output_quarters WHERE period_idx BETWEEN {START // 3} AND {END // 3}),
s AS (SELECT entity, CAST(unnest(range(min(period_idx), max(period_idx) + 1)) AS INTEGER) AS period_idx FROM o GROUP BY 1)
SELECT s.entity, s.period_idx, {", ".join(tb.SECTORS)} FROM s LEFT JOIN o ON o.entity = s.entity AND o.period_idx = s.period_idx"""


def _all_adjusted(source: str, key: str, columns: list[str]) -> str:
    """SQL: every column seasonally adjusted on its own, side by side."""
    parts = [f"({adjusted(source, key, c)}) AS a_{c}" + (f" USING ({key}, period_idx)" if i else "") for i, c in enumerate(columns)]
    return f"SELECT {key}, period_idx, " + ", ".join(f"{rnd(c, 4)} AS {c}, {c}_sa_ok" for c in columns) + " FROM " + " JOIN ".join(parts)


@query("D10 W14 R2 F19", _all_adjusted("output_spine", "entity", tb.SECTORS))
def activity_index_adjusted(spark, sf):
    """The report's sectors, seasonally adjusted; series that cannot be adjusted keep their values and are flagged."""
    wide = macro.activity_index(_report(spark, sf).replace(tb.SEGMENTS, subset="sector"), tb.SECTORS, START // 3, END // 3)
    return rounded(wide.select("entity", "period_idx", *[x for c in tb.SECTORS for x in (c, f"{c}_sa_ok")]), 4, *tb.SECTORS)


_NATIONAL = ["total", *tb.SECTORS]

TABLES["national_output"] = f"""
SELECT 'national' AS region, m // 3 AS period_idx, CAST(sum(cents) AS DOUBLE) / 100.0 / (SELECT count(*) FROM customer) AS total,
  {", ".join(f"CAST(sum(cents) FILTER (c_mktsegment = '{s}') AS DOUBLE) / 100.0 / (SELECT count(*) FROM customer) AS {c}" for s, c in tb.SEGMENTS.items())}
FROM located GROUP BY 1, 2"""


@query("D13 R3 F12 A6 W14", _all_adjusted("national_output", "region", _NATIONAL))
def national_per_capita(spark, sf):
    """National output in all and by sector, per head and seasonally adjusted."""
    quarter = cal.month_to_quarter_index(F.col("period_idx"))
    text = F.format_string("%d/%d", cal.year_of(quarter, 4), cal.sub_period_of(quarter, 4))
    of = lambda s: F.when(F.col("c_mktsegment") == s, F.col("cents"))
    national = tb.located_orders(spark, sf).groupBy(text.alias("quarter")).agg(
        (F.sum("cents") / 100.0).alias("total"), *[(F.sum(of(s)) / 100.0).alias(c) for s, c in tb.SEGMENTS.items()]
    )
    population = tb.read(spark, sf, "customer").agg(F.count(F.lit(1)).alias("population"))
    per_head = macro.national_per_capita(national, population, _NATIONAL, climate.NATIONAL)
    return rounded(per_head.select("region", "period_idx", *[x for c in _NATIONAL for x in (c, f"{c}_sa_ok")]), 4, *_NATIONAL)


@query(
    "D14 J2 J3",
    "SELECT norm_years, entity, period_idx, season, "
    + ", ".join(f"{rnd(c, 4)} AS {c}" for c in [*tb.PRICES, *tb.OUTPUTS, *tb.SHOCKS])
    + f" FROM (SELECT *, CASE WHEN norm_years IS NOT NULL THEN {SEASON} END AS season FROM merged)",
)
def merge_panel(spark, sf):
    columns = [*tb.PRICES, *tb.OUTPUTS, *tb.SHOCKS]
    return rounded(tb.merged(spark, sf).select("norm_years", "entity", "period_idx", "season", *columns), 4, *columns)


@query(
    "D15 P14 F13 P7",
    f"""SELECT norm_years, entity, period_idx, make_date(period_idx // 4, (period_idx % 4 + 1) * 3, 1) AS date, {rnd('gdp_total', 2)} AS gdp_total
    FROM estimation WHERE entity <> 0""",
)
def estimation_panel(spark, sf):
    """Complete rows with nation 0 in the place of the national row."""
    flagged = tb.model_panel(spark, sf).withColumn("is_total", F.col("entity") == 0)
    kept = panel.estimation_panel(flagged, ["norm_years", *tb.MODEL_PRICES, *tb.MODEL_OUTPUTS, *tb.SHOCKS])
    return rounded(kept.select("norm_years", "entity", "period_idx", "date", "gdp_total"), 2, "gdp_total")


_GROUPS = ("error", "click", "purchase")
_FIRST, _LAST = cal.index_of(2024, 1, 12), cal.index_of(2024, 12, 12)

TABLES["event_places"] = f"""
SELECT event_type, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS m, CAST(round(value * 100) AS BIGINT) AS cents, r_name
FROM (SELECT event_type, ts, value, unnest(CASE WHEN user_id % 25 = (user_id + 7 * (event_id % 2)) % 25 THEN [user_id % 25] ELSE [user_id % 25, (user_id + 7) % 25] END) AS nation FROM events)
JOIN weighted ON entity = nation
WHERE event_type IN {_GROUPS}"""


@query(
    "D20 R4 A10 J7 F6",
    f"""WITH m AS (SELECT r_name AS region, event_type, m AS period_idx, CAST(sum(cents) AS DOUBLE) / 100.0 / count(cents) AS impact FROM event_places GROUP BY 1, 2, 3),
    s AS (SELECT region, CAST(unnest(range({_FIRST}, {_LAST + 1})) AS INTEGER) AS period_idx FROM (SELECT DISTINCT region FROM m)),
    w AS (SELECT s.region, s.period_idx, {", ".join(f"max(CASE WHEN event_type = '{g}' THEN impact END) AS {g}" for g in _GROUPS)}
      FROM s LEFT JOIN m ON m.region = s.region AND m.period_idx = s.period_idx GROUP BY 1, 2)
    SELECT region, period_idx // 3 AS period_idx, {", ".join(f"{rnd(f'avg({g})', 4)} AS {g}" for g in _GROUPS)} FROM w GROUP BY 1, 2""",
)
def disaster_panel(spark, sf):
    """Events with a comma list of places, averaged by region and month, completed and rolled up."""
    source = tb.read(spark, sf, "events")
    main = source.select(
        "event_id", F.concat(F.lit("at "), "user_id").alias("location"), F.col("event_type").alias("event_group"),
        cal.month_index(F.col("ts").cast("date")).alias("period_idx"), tb.cents("value").alias("impact"),
    )
    one, two = F.col("user_id") % 25, (F.col("user_id") + 7) % 25
    named = lambda key: F.concat(F.lit("Nation_"), key)
    listed = F.when(F.col("event_id") % 2 == 0, named(one)).otherwise(F.concat_ws(", ", named(one), named(two), F.lit(" ")))
    places = source.select("event_id", F.concat(F.lit("at "), "user_id").alias("location"), listed.alias("states"))
    dimension = tb.regions(spark, sf).drop("entity").withColumnRenamed("n_name", "entity")
    aliases = dimension.select(F.lower(F.replace("entity", F.lit("_"), F.lit("."))).alias("alias_slug"), "entity")
    quarters = events.event_panel(main, places, dimension, "r_name", _GROUPS, aliases, _FIRST, _LAST)
    return rounded(quarters.withColumns({g: F.col(g) / 100.0 for g in _GROUPS}), 4, *_GROUPS)
