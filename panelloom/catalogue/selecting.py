"""Projections, filters, row choice and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalogue.registry import query, rnd, rounded
from panelloom.catalogue.sql import END, START, TABLES
from panelloom.functions import calendar as cal
from panelloom.operators import aggregate, selection
from panelloom.plans import climate
from panelloom.plans import tables as tb


@query(
    "P1 P2 P3",
    "SELECT entity AS nation, period_idx AS quarter, "
    + ", ".join(f"{rnd(c, 2)} AS {c.upper()}" for c in sorted(tb.OUTPUTS))
    + " FROM output_quarters",
)
def columns_by_name(spark, sf):
    panel = tb.outputs(spark, sf)
    chosen = selection.names_like(panel, prefix="gdp", regex=r"_[a-z]+$")
    picked = panel.select(*selection.all_of(panel, ["entity", "period_idx"]), *sorted(chosen))
    renamed = selection.rename_all(picked, lambda c: c.upper() if c.startswith("gdp") else c)
    renamed = renamed.withColumnsRenamed({"entity": "nation", "period_idx": "quarter"})
    return rounded(selection.move_first(renamed, ["quarter"]), 2, *[c.upper() for c in chosen])


@query(
    "P4 A1",
    f"""SELECT entity, period_idx // 3 AS period_idx, {rnd('avg(value)', 4)} AS value, count(*) AS n_months
    FROM monthly WHERE period_idx BETWEEN {START + 2} AND {END} GROUP BY 1, 2""",
)
def partial_first_quarter(spark, sf):
    """A range that starts in a quarter's last month leaves that quarter one month."""
    kept = selection.in_range(tb.monthly_values(spark, sf), "period_idx", START + 2, END)
    quarters = kept.groupBy("entity", cal.month_to_quarter_index(F.col("period_idx")).alias("period_idx")).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_months")
    )
    return rounded(quarters, 4, "value")


@query(
    "P5 P6",
    """SELECT p_partkey, p_name, p_type FROM part
    WHERE p_type IN ('ECONOMY', 'STANDARD') AND p_name <> 'small ring' AND regexp_matches(p_name, '^(small|large).*g$')""",
)
def pattern_filter(spark, sf):
    part = tb.read(spark, sf, "part")
    return part.where(
        F.col("p_type").isin("ECONOMY", "STANDARD")
        & (F.col("p_name") != "small ring")
        & F.col("p_name").rlike("^(small|large).*g$")
    ).select("p_partkey", "p_name", "p_type")


@query("P7 D15", "SELECT norm_years, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM estimation GROUP BY 1")
def complete_cases(spark, sf):
    kept = tb.estimation(spark, sf)
    # The rows that the calendar was filled up with have none of these; other columns may be NULL in a complete row.
    return selection.complete_cases(kept, [*tb.MODEL_PRICES, *tb.MODEL_OUTPUTS, *tb.SHOCKS]).groupBy("norm_years").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity").alias("n_entities")
    )


@query("P8", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_pairs(spark, sf):
    return selection.distinct_rows(tb.read(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


EXCLUDED = [("ASIA", "BUILDING"), ("ASIA", "MACHINERY"), ("EUROPE", "HOUSEHOLD"), ("AFRICA", "FURNITURE")]


@query(
    "P9 D1 U1",
    f"""SELECT DISTINCT CAST(r_name || '/' || c_mktsegment AS VARCHAR) AS entity, r_name, c_mktsegment, false AS is_total
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE (r_name, c_mktsegment) NOT IN ({", ".join(map(repr, EXCLUDED))})
    UNION ALL SELECT 'national', 'national', 'national', true""",
)
def rule_exclusion(spark, sf):
    """Distinct pairs of the customer list, four wrong ones removed, with the national row."""
    places = tb.read(spark, sf, "customer").join(
        tb.regions(spark, sf), F.col("c_nationkey") == F.col("entity")
    ).select(F.concat_ws("/", "r_name", "c_mktsegment").alias("entity"), "r_name", "c_mktsegment")
    wrong = spark.createDataFrame(EXCLUDED, "r_name string, c_mktsegment string")
    return climate.region_dimension(
        places, "entity", ["r_name", "c_mktsegment"], wrong, ["r_name", "c_mktsegment"], national=True
    )


@query(
    "P10",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    WHERE n <= 3""",
)
def last_rows_per_group(spark, sf):
    order = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    last = selection.first_rows(tb.read(spark, sf, "orders"), ["o_custkey"], order, 3)
    return last.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "P10 W15",
    f"""SELECT entity, period_idx, {rnd('value', 4)} AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_idx) AS n FROM monthly) WHERE n > 2""",
)
def drop_first_rows(spark, sf):
    panel = tb.monthly_values(spark, sf)
    return rounded(selection.drop_first_rows(panel, ["entity"], [F.col("period_idx")], 2), 4, "value")


@query(
    "P11 P12",
    """SELECT o_orderpriority, count(*) AS n, CAST(CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS INTEGER) AS sort_key
    FROM orders GROUP BY 1""",
)
def custom_order(spark, sf):
    counts = tb.read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    keyed = selection.with_sort_key(counts, "o_orderpriority", ["3-MEDIUM", "1-URGENT"])
    return keyed.orderBy("sort_key", "o_orderpriority")


@query(
    "P13",
    """SELECT level, "group", period_idx, cents / 100.0 AS amount FROM (
      SELECT 'nation' AS level, CAST(entity AS VARCHAR) AS "group", m AS period_idx, CAST(sum(cents) AS DOUBLE) AS cents FROM located GROUP BY 1, 2, 3
      UNION ALL SELECT 'region', r_name, m, CAST(sum(cents) AS DOUBLE) FROM located JOIN weighted USING (entity) GROUP BY 1, 2, 3
      UNION ALL SELECT 'segment', c_mktsegment, m, CAST(sum(cents) AS DOUBLE) FROM located GROUP BY 1, 2, 3)""",
)
def level_switch(spark, sf):
    """Totals at three levels in one pass."""
    rows = tb.located_orders(spark, sf).join(tb.regions(spark, sf), "entity").select(
        F.col("entity").alias("nation"), F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("segment"), "period_idx", "cents",
    )
    leveled = selection.with_all_levels(rows, ["nation", "region", "segment"])
    return leveled.groupBy("level", "group", "period_idx").agg((F.sum("cents") / 100.0).alias("amount"))


@query(
    "P13 P15",
    """SELECT r_name AS "group", count(*) AS n FROM customer JOIN weighted ON c_nationkey = entity GROUP BY 1""",
)
def one_level(spark, sf):
    rows = tb.read(spark, sf, "customer").join(tb.regions(spark, sf), F.col("c_nationkey") == F.col("entity"))
    rows = selection.drop_unless(rows, False, ["c_acctbal", "no_such_column"])
    return selection.with_level(rows, "r_name", ["r_name", "n_name"]).groupBy("group").agg(
        F.count(F.lit(1)).alias("n")
    )


TABLES["contributions"] = """
SELECT r_name AS region, false AS is_total, period_idx, CASE WHEN count(value) = count(*) THEN sum(value * weight) END AS value
FROM spine JOIN weighted USING (entity) GROUP BY 1, 2, 3"""
TABLES["national_mean"] = """
SELECT 'national' AS region, true AS is_total, period_idx, CASE WHEN count(value) = count(*) THEN avg(value * weight) END AS value
FROM spine JOIN weighted USING (entity) GROUP BY 1, 2, 3"""


@query("P14", f"SELECT region, period_idx, {rnd('value', 4)} AS value FROM contributions")
def drop_total(spark, sf):
    index = climate.weighted_index(
        tb.monthly_panel(spark, sf), tb.weights(spark, sf), "r_name", places=None
    )
    kept = selection.drop_total(index).select("region", "period_idx", "value")
    return rounded(kept, 4, "value")


@query(
    "A13",
    """SELECT entity, count(*) AS n_rows, count(DISTINCT period_idx) AS n_periods, max(period_idx) - min(period_idx) + 1 AS span,
    count(*) = max(period_idx) - min(period_idx) + 1 AS gap_free FROM monthly GROUP BY 1""",
)
def balance_check(spark, sf):
    checked = aggregate.balance(tb.monthly_values(spark, sf), ["entity"])
    return checked.withColumn("span", F.col("span").cast("int"))
