"""Long and wide forms, split cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalogue.registry import query, rnd, rounded
from panelloom.functions.numbers import fixed_decimals, in_parentheses
from panelloom.operators import reshape
from panelloom.plans import tables as tb


@query(
    "R1",
    f"""SELECT entity, period_idx, measure, {rnd('value', 6)} AS value FROM (
      SELECT entity, period_idx, 'quantity' AS measure, quantity AS value FROM shipped
      UNION ALL SELECT entity, period_idx, 'temp', temp FROM shipped
      UNION ALL SELECT entity, period_idx, 'precip', precip FROM shipped)""",
)
def unpivot_measures(spark, sf):
    long = reshape.to_long(
        tb.shipments(spark, sf), ["entity", "period_idx"], ["quantity", "temp", "precip"], "measure", "value"
    )
    return rounded(long, 6, "value")


@query(
    "R2 J5",
    "SELECT entity, period_idx, " + ", ".join(f"{rnd(p, 4)} AS {p}" for p in tb.PRICES) + " FROM price_months",
)
def price_panel_pivot(spark, sf):
    """A full join of five one-category tables, as one pivot."""
    from panelloom.operators import joins

    prices = tb.prices(spark, sf).where(F.col("period_idx").between(tb.START, tb.END))
    wide = joins.fold_full(prices, ["entity", "period_idx"], "category", "value", list(tb.PRIORITIES))
    return rounded(wide.withColumnsRenamed(tb.PRIORITIES), 4, *tb.PRICES)


@query(
    "R3",
    """SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN left(url, position('://' IN url) - 1) ELSE url END AS scheme,
    CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages""",
)
def split_first_sep(spark, sf):
    """Split at the first separator only; later ones stay in the rest."""
    pages = tb.read(spark, sf, "pages").select("page_id", "url")
    return reshape.split_column(pages, "url", ["scheme", "rest"], "://", merge_rest=True)


@query(
    "R4 F4 M10",
    """SELECT item, count(*) AS n FROM (
      SELECT p_brand AS item FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_name FROM part) GROUP BY 1""",
)
def split_list_explode(spark, sf):
    cells = tb.read(spark, sf, "part").select(
        F.concat_ws(", ", "p_brand", F.concat(F.lit(" "), "p_type"), F.lit(""), "p_name").alias("item")
    )
    return reshape.split_rows(cells, "item").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query(
    "R5",
    f"""SELECT 'orders' AS measure, entity, period_idx, {rnd('value', 4)} AS value FROM monthly
    UNION ALL SELECT 'shipments', entity, period_idx, {rnd('temp', 4)} FROM shipped""",
)
def stack_tables(spark, sf):
    shipped = tb.shipments(spark, sf).select("entity", "period_idx", F.col("temp").alias("value"))
    stacked = reshape.stack_tables({"orders": tb.monthly_values(spark, sf), "shipments": shipped}, "measure")
    return rounded(stacked, 4, "value")


@query(
    "R6 J6 J1",
    f"""SELECT entity, period_idx, {rnd('value', 4)} AS value, {rnd('temp', 6)} AS temp
    FROM monthly JOIN shipped USING (entity, period_idx)""",
)
def bind_columns(spark, sf):
    shipped = tb.shipments(spark, sf).select("entity", "period_idx", "temp")
    bound = reshape.bind_columns(tb.monthly_values(spark, sf), shipped, ["entity", "period_idx"])
    return rounded(rounded(bound, 4, "value"), 6, "temp")


@query(
    "R8 W10",
    f"""WITH s AS (SELECT c_mktsegment AS segment, c_nationkey AS entity, {rnd('avg(c_acctbal)', 2)} AS mean, {rnd('stddev_samp(c_acctbal)', 3)} AS sd
      FROM customer GROUP BY 1, 2),
    l AS (SELECT segment, entity, 1 AS line, 'mean' AS stat, printf('%.2f', mean) AS cell FROM s
      UNION ALL SELECT segment, entity, 2, 'sd', CASE WHEN sd IS NOT NULL THEN '(' || printf('%.3f', sd) || ')' END FROM s)
    SELECT segment, CASE WHEN "row" % 2 = 1 THEN entity END AS entity, stat, cell, "row" FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY entity, line) AS INTEGER) AS "row" FROM l)""",
)
def interleaved_rows(spark, sf):
    stats = tb.read(spark, sf, "customer").groupBy(
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("entity")
    ).agg(
        fixed_decimals(F.avg("c_acctbal"), 2).alias("mean"),
        in_parentheses(fixed_decimals(F.stddev_samp("c_acctbal"), 3)).alias("sd"),
    )
    return reshape.interleave(stats, ["segment"], "mean", "sd", "entity", [F.col("entity")])


@query(
    "W10",
    """SELECT CASE WHEN "row" = 1 THEN r_name END AS r_name, n_name, n_orders, "row" FROM (
      SELECT r_name, n_name, n_orders, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_orders DESC, n_name) AS INTEGER) AS "row" FROM (
        SELECT r_name, n_name, count(*) AS n_orders FROM located JOIN weighted USING (entity) GROUP BY 1, 2))""",
)
def first_row_label(spark, sf):
    counts = tb.located_orders(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n_orders"))
    named = counts.join(tb.regions(spark, sf), "entity").select("r_name", "n_name", "n_orders")
    return reshape.label_first_row(named, ["r_name"], "r_name", [F.col("n_orders").desc(), F.col("n_name")])
