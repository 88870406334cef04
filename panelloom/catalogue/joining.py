"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalogue.registry import query, rnd, rounded
from panelloom.catalogue.sql import END, START
from panelloom.operators import joins
from panelloom.plans import climate, panel
from panelloom.plans import tables as tb


@query(
    "J2",
    f"""SELECT entity, period_idx, {rnd('headline', 4)} AS headline, {rnd('gdp_total', 2)} AS gdp_total
    FROM price_quarters LEFT JOIN output_quarters USING (entity, period_idx)""",
)
def left_join_panels(spark, sf):
    from panelloom.plans import macro

    price = macro.price_panel(tb.prices(spark, sf), tb.PRIORITIES, START, END, adjusted=False)
    output = tb.outputs(spark, sf).select("entity", "period_idx", "gdp_total")
    joined = price.join(output, ["entity", "period_idx"], "left")
    return rounded(rounded(joined.select("entity", "period_idx", "headline", "gdp_total"), 4, "headline"), 2, "gdp_total")


@query(
    "J3",
    f"""SELECT entity, period_idx, {rnd('value', 4)} AS value, {rnd('precip', 6)} AS precip
    FROM monthly FULL JOIN shipped USING (entity, period_idx)""",
)
def full_join_panels(spark, sf):
    shipped = tb.shipments(spark, sf).select("entity", "period_idx", "precip")
    joined = tb.monthly_values(spark, sf).join(shipped, ["entity", "period_idx"], "full")
    return rounded(rounded(joined, 4, "value"), 6, "precip")


@query(
    "D14 J3",
    "SELECT norm_years, entity, period_idx, " + ", ".join(f"{rnd(f'deviation_{v}', 6)} AS deviation_{v}" for v in ("temp", "precip")) + " FROM weather",
)
def weather_in_full(spark, sf):
    """Two weather sources, one per measure, joined in full."""
    frames = [
        climate.all_norms(tb.shipments(spark, sf).select("entity", "period_idx", v), ["entity"], [v], tb.NORMS, tb.START, tb.END)
        for v in ("temp", "precip")
    ]
    both = panel.merge_weather(*frames, ["norm_years", "entity", "period_idx", "year", "sub_period", "season"])
    return rounded(both.select("norm_years", "entity", "period_idx", "deviation_temp", "deviation_precip"), 6, "deviation_temp", "deviation_precip")


@query("J4", "SELECT entity, n_name, r_name, r_regionkey, period_idx FROM weighted NATURAL JOIN (SELECT entity, period_idx FROM monthly)")
def natural_join(spark, sf):
    months = tb.monthly_values(spark, sf).select("entity", "period_idx")
    return joins.natural_join(months, tb.regions(spark, sf))


@query(
    "N6",
    """SELECT a.kind, a.n, b.total_users FROM
      (SELECT nullif(event_type, 'error') AS kind, count(*) AS n FROM events GROUP BY 1) a
      JOIN (SELECT nullif(event_type, 'error') AS kind, count(DISTINCT user_id) AS total_users FROM events GROUP BY 1) b
      ON a.kind IS NOT DISTINCT FROM b.kind""",
)
def null_safe_join(spark, sf):
    """A missing key on one side matches a missing key on the other."""
    events = tb.read(spark, sf, "events").select(F.nullif("event_type", F.lit("error")).alias("kind"), "user_id")
    counts = events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    users = events.distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("total_users"))
    return joins.null_safe_join(counts, users, ["kind"])


@query("J7 M6", f"SELECT entity, period_idx, {rnd('value', 4)} AS value FROM spine")
def calendar_spine(spark, sf):
    return rounded(tb.monthly_panel(spark, sf), 4, "value")


@query(
    "J8 F21",
    """SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'headline' WHEN '2-HIGH' THEN 'food'
      WHEN '3-MEDIUM' THEN 'nonfood' WHEN '4-NOT SPECIFIED' THEN 'services' WHEN '5-LOW' THEN 'energy' END AS title, count(*) AS n
    FROM orders GROUP BY 1, 2""",
)
def dictionary_lookup(spark, sf):
    titles = F.create_map(*[F.lit(x) for pair in tb.PRIORITIES.items() for x in pair])
    counts = tb.read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("title", titles[F.col("o_orderpriority")])


@query(
    "J9 E10",
    """SELECT CAST(m.m AS INTEGER) AS norm_years, CAST(h.h AS INTEGER) AS horizon, t.entity, t.last_period - h.h >= t.first_period + 12 * m.m AS feasible
    FROM (SELECT unnest([1, 2, 3]) AS m) m, (SELECT unnest([0, 1, 2, 3, 4]) AS h) h,
      (SELECT entity, max(period_idx) AS last_period, min(period_idx) AS first_period FROM monthly GROUP BY 1) t""",
)
def parameter_grid(spark, sf):
    """Which (norm, horizon) pairs each nation's series can carry."""
    spans = tb.monthly_values(spark, sf).groupBy("entity").agg(
        F.max("period_idx").alias("last"), F.min("period_idx").alias("first")
    )
    feasible = F.col("last") - F.col("horizon") >= F.col("first") + 12 * F.col("norm_years")
    grid = joins.with_parameters(spans, norm_years=tb.NORMS, horizon=range(tb.HORIZON + 1))
    return grid.select("norm_years", "horizon", "entity", feasible.alias("feasible"))


@query("U1 A4", f"SELECT region, is_total, period_idx, {rnd('value', 4)} AS value FROM contributions UNION ALL SELECT region, is_total, period_idx, {rnd('value', 4)} FROM national_mean")
def national_union(spark, sf):
    """Group totals with the national row appended, each from its own aggregation."""
    from panelloom.operators import aggregate

    panel, dimension = tb.monthly_panel(spark, sf), tb.weights(spark, sf)
    groups = aggregate.weighted_total(panel, dimension, "r_name").withColumnRenamed("r_name", "region")
    nation = aggregate.national_row(panel, dimension).withColumn("region", F.lit(climate.NATIONAL))
    both = groups.withColumn("is_total", F.lit(False)).unionByName(nation.withColumn("is_total", F.lit(True)))
    return rounded(both, 4, "value")


@query(
    "U2",
    f"""SELECT entity, period_idx FROM spine EXCEPT SELECT entity, period_idx FROM monthly""",
)
def set_difference(spark, sf):
    """Cells of the calendar that no order falls in."""
    keys = ["entity", "period_idx"]
    return tb.monthly_panel(spark, sf).select(*keys).exceptAll(tb.monthly_values(spark, sf).select(*keys))


@query(
    "D21 P8 F5",
    "SELECT lower(replace(n_name, '_', '.')) AS entity, lower(replace(r_name, ' ', '.')) AS label, n_customers FROM (SELECT n_name, r_name, population AS n_customers FROM weighted)",
)
def region_attributes(spark, sf):
    """Nation names to region labels, both in slug form, with their customers."""
    from panelloom.functions.names import slug

    return tb.weights(spark, sf).select(
        slug(F.col("n_name")).alias("entity"), slug(F.col("r_name")).alias("label"),
        F.col("population").alias("n_customers"),
    )
