"""The given tables in the roles of the covered data: regions, monthly values, prices, output, weather.

Money is summed in whole cents, so that a total does not depend on the order in which tasks add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions import calendar as cal
from panelloom.operators import aggregate, joins
from panelloom.plans import climate, macro, panel
from panelloom.schema import GIVEN_TABLES

NORMS = (1, 2, 3)
HORIZON = 4
# Horizon of the projections by month.
MONTHLY_HORIZON = 8

# Months covered by orders; the last quarter of the calendar is partial.
START = cal.index_of(1995, 1, 12)
END = cal.index_of(2001, 8, 12)

PRIORITIES = {
    "1-URGENT": "headline",
    "2-HIGH": "food",
    "3-MEDIUM": "nonfood",
    "4-NOT SPECIFIED": "services",
    "5-LOW": "energy",
}
SEGMENTS = {
    "AUTOMOBILE": "gdp_primary",
    "BUILDING": "gdp_secondary",
    "FURNITURE": "gdp_tertiary",
    "HOUSEHOLD": "gdp_household",
    "MACHINERY": "gdp_machinery",
}
PRICES = list(PRIORITIES.values())
SECTORS = list(SEGMENTS.values())
OUTPUTS = ["gdp_total", *SECTORS]
# Outcomes of the regressions: coarser groups, so that every cell of the calendar is filled.
MODEL_PRICES = ["headline", "food", "energy"]
MODEL_OUTPUTS = ["gdp_total", "gdp_primary", "gdp_secondary"]
LONG_RUN_OUTPUTS = [*MODEL_OUTPUTS, "gdp_tertiary"]
MONTHLY_PRICES = ["headline", "food", "nonfood", "services", "goods", "energy"]
# Extreme seasons: the size of an anomaly that counts, and the indicators that are shocks of the projections.
EXTREME = 0.3
FLAGS = ["all_seasons", "c_winter", "h_spring", "h_summer"]
SHOCKS = [f"{kind}_{v}" for v in ("temp", "precip") for kind in ("deviation", "pos_dev", "neg_dev")]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.schema(GIVEN_TABLES[table]).parquet(f"{sf}/{table}.parquet")


def cents(amount: str) -> Column:
    return F.expr(f"cast(round({amount} * 100) AS bigint)")


MONTH = "cast(year({0}) * 12 + month({0}) - 1 AS int) AS period_idx"
MEAN_CENTS = "sum(cents) / 100.0D / count(*)"


def located_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer's nation and segment."""
    orders = read(spark, sf, "orders").selectExpr(
        "o_custkey AS c_custkey",
        "o_orderkey",
        MONTH.format("o_orderdate"),
        "o_orderpriority",
        "cast(round(o_totalprice * 100) AS bigint) AS cents",
    )
    customers = read(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey AS entity", "c_mktsegment")
    return orders.join(customers, "c_custkey")


def monthly_values(spark: SparkSession, sf: str) -> DataFrame:
    """Mean order value by nation and month."""
    return (
        located_orders(spark, sf)
        .groupBy("entity", "period_idx")
        .agg(F.expr(f"{MEAN_CENTS} AS value"))
    )


def monthly_panel(spark: SparkSession, sf: str) -> DataFrame:
    """``monthly_values`` on a gap-free calendar."""
    return joins.complete_periods(monthly_values(spark, sf), ["entity"], START, END)


def regions(spark: SparkSession, sf: str) -> DataFrame:
    nations = read(spark, sf, "nation").select(
        F.col("n_nationkey").alias("entity"), "n_name", F.col("n_regionkey").alias("r_regionkey")
    )
    return nations.join(read(spark, sf, "region"), "r_regionkey").select("entity", "n_name", "r_regionkey", "r_name")


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with their region, customer count and share of all customers."""
    counts = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("entity")).agg(
        F.count(F.lit(1)).alias("population")
    )
    return regions(spark, sf).join(aggregate.shares(counts, "entity", "population"), "entity")


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """Mean quantity and mean discount by supplier nation and ship month."""
    lines = read(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS s_suppkey",
        MONTH.format("l_shipdate"),
        "l_quantity",
        "cast(round(l_discount * 100) AS bigint) AS points",
    )
    suppliers = read(spark, sf, "supplier").selectExpr("s_suppkey", "s_nationkey AS entity")
    totals = lines.join(suppliers, "s_suppkey").groupBy("entity", "period_idx").agg(
        F.expr("sum(l_quantity) AS quantity"), F.expr("sum(points) AS points"), F.expr("count(*) AS n")
    )
    return totals.selectExpr("entity", "period_idx", "quantity", "quantity / n AS temp", "points / n AS precip")


def order_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Orders summed by nation, month, priority and segment: what prices and outputs have in common, read once."""
    keys = ["entity", "period_idx", F.col("o_orderpriority").alias("category"), "c_mktsegment"]
    return located_orders(spark, sf).groupBy(*keys).agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("orders"))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """Mean order value by nation, month and priority, in the role of price indices."""
    return order_cells(spark, sf).groupBy("entity", "period_idx", "category").agg(F.expr("sum(cents) / 100.0D / sum(orders) AS value"))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Order value by nation and quarter, by segment and in total."""
    by_segment = (
        order_cells(spark, sf)
        .groupBy("entity", cal.month_to_quarter_index(F.col("period_idx")).alias("period_idx"), "c_mktsegment")
        .agg(F.sum("cents").alias("cents"))
    )
    wide = by_segment.groupBy("entity", "period_idx").pivot("c_mktsegment", list(SEGMENTS)).agg(
        F.first(F.col("cents") / 100.0)
    )
    wide = wide.withColumnsRenamed(SEGMENTS)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in SECTORS[1:]), F.coalesce(F.col(SECTORS[0]), F.lit(0.0)))
    return wide.withColumn("gdp_total", F.round(total, 2))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Both weather measures with their anomalies, quarterly, by nation and norm, from one scan and one window."""
    both = shipments(spark, sf).select("entity", "period_idx", "temp", "precip")
    return climate.all_norms(both, ["entity"], ["temp", "precip"], NORMS, START, END).drop("year", "sub_period")


def merged(spark: SparkSession, sf: str) -> DataFrame:
    """The full panel: prices, output and weather by norm, nation and quarter."""
    price = macro.price_panel(prices(spark, sf), PRIORITIES, START, END, adjusted=False)
    return panel.merge_panel(price, outputs(spark, sf), weather(spark, sf), ["entity", "period_idx"])


def outcomes(spark: SparkSession, sf: str, months: int = 3) -> DataFrame:
    """Price and output columns of the regressions, in one aggregation of the orders, by periods of so many months."""
    urgent, primary = "o_orderpriority IN ('1-URGENT', '2-HIGH')", "c_mktsegment IN ('AUTOMOBILE', 'BUILDING')"
    mean = "sum(cents) FILTER (WHERE {0}) / 100.0D / nullif(count(*) FILTER (WHERE {0}), 0)"
    total = "sum(cents) FILTER (WHERE {0}) / 100.0D"
    columns = {
        "headline": MEAN_CENTS,
        "food": mean.format(urgent),
        "energy": mean.format(f"NOT {urgent}"),
        "nonfood": mean.format("o_orderpriority IN ('2-HIGH', '3-MEDIUM')"),
        "services": mean.format("o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')"),
        "goods": mean.format("o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')"),
        "gdp_total": total.format("true"),
        "gdp_primary": total.format(primary),
        "gdp_secondary": total.format(f"NOT {primary}"),
        "gdp_tertiary": total.format("c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')"),
    }
    period = F.expr(f"cast(floor(period_idx / {months}) AS int) AS period_idx")
    return located_orders(spark, sf).groupBy("entity", period).agg(*[F.expr(f"{x} AS {c}") for c, x in columns.items()])


def model_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes with weather, once per norm."""
    return outcomes(spark, sf).join(weather(spark, sf), ["entity", "period_idx"], "left")


def estimation(spark: SparkSession, sf: str) -> DataFrame:
    """Complete rows of the model panel, on a gap-free calendar again."""
    flagged = model_panel(spark, sf).withColumn("is_total", F.lit(False))
    columns = ["norm_years", *MODEL_PRICES, *MODEL_OUTPUTS, *SHOCKS]
    kept = panel.estimation_panel(flagged, columns)
    kept = kept.select("norm_years", "entity", "period_idx", *columns[1:], "gdp_tertiary", "abs_deviation_temp", "abs_deviation_precip")
    return joins.complete_periods(kept, ["norm_years", "entity"])


def flagged_estimation(spark: SparkSession, sf: str) -> DataFrame:
    """The estimation panel with its extreme-season indicators."""
    kept = estimation(spark, sf).withColumn("season", cal.season(cal.sub_period_of(F.col("period_idx"), 4), 4))
    return climate.extreme_season_flags(kept, "deviation_temp", EXTREME).drop("season")


def monthly_model_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes by month with monthly weather anomalies, once per norm, on a gap-free calendar; an empty cell is NULL."""
    both = shipments(spark, sf).select("entity", "period_idx", "temp", "precip")
    monthly = climate.all_norms(both, ["entity"], ["temp", "precip"], NORMS, START, END, freq=12)
    kept = monthly.select("norm_years", "entity", "period_idx", *SHOCKS).join(outcomes(spark, sf, 1), ["entity", "period_idx"], "left")
    columns = [*MONTHLY_PRICES, *LONG_RUN_OUTPUTS, *SHOCKS]
    return joins.complete_periods(kept.select("norm_years", "entity", "period_idx", *columns), ["norm_years", "entity"])


def annual_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Order value by nation, segment and year."""
    return (
        located_orders(spark, sf)
        .groupBy("entity", F.col("c_mktsegment").alias("sector"), cal.year_of(F.col("period_idx"), 12).alias("year"))
        .agg((F.sum("cents") / 100.0).alias("level"))
    )


def quarterly_indicator(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped quantity by nation and quarter, repeated for every segment."""
    quantity = shipments(spark, sf).groupBy(
        "entity", cal.month_to_quarter_index(F.col("period_idx")).alias("period_idx")
    ).agg(F.sum("quantity").alias("indicator"))
    sectors = F.array(*[F.lit(s) for s in SEGMENTS])
    return quantity.select("entity", F.explode(sectors).alias("sector"), "period_idx", "indicator")
