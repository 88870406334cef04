"""Window operators on the monthly and quarterly panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalogue.registry import STATEMENTS, query, rnd, rounded
from panelloom.catalogue.sql import TABLES, adjusted, adjusted_by_filters, norm_frames, solved
from panelloom.operators import blocked, joins, ranking, windows
from panelloom.operators.seasonal import trend_weights
from panelloom.operators.spline import spline_to_months
from panelloom.plans import macro, panel
from panelloom.plans import tables as tb

KEY = ["entity"]
_W = "(PARTITION BY entity ORDER BY period_idx)"


@query(
    "W1",
    f"""SELECT entity, period_idx, {rnd('norm_1', 4)} AS norm_1, {rnd('norm_2', 4)} AS norm_2, {rnd('norm_3', 4)} AS norm_3
    FROM ({norm_frames('value', 'monthly')})""",
)
def trailing_norm(spark, sf):
    normed = windows.trailing_norms(tb.monthly_values(spark, sf), KEY, ["value"], tb.NORMS)
    normed = normed.select(*KEY, "period_idx", *[F.col(f"norm_{m}_value").alias(f"norm_{m}") for m in tb.NORMS])
    return rounded(normed, 4, "norm_1", "norm_2", "norm_3")


@query(
    "W2 J10",
    f"""SELECT entity, period_idx, {rnd(f'lag(value, 1) OVER {_W}', 4)} AS value_lag1, {rnd(f'lag(value, 4) OVER {_W}', 4)} AS value_lag4,
    {rnd(f'lead(value, 2) OVER {_W}', 4)} AS value_lead2 FROM spine""",
)
def panel_lag_lead(spark, sf):
    shifted = windows.lag_lead(tb.monthly_panel(spark, sf), KEY, "value", [1, 4, -2]).drop("value")
    return rounded(shifted, 4, "value_lag1", "value_lag4", "value_lead2")


@query("W3", f"SELECT entity, period_idx, {rnd(f'value - lag(value, 1) OVER {_W}', 4)} AS diff FROM spine")
def first_diff(spark, sf):
    change = windows.difference(F.col("value"), KEY)
    return rounded(tb.monthly_panel(spark, sf).select("entity", "period_idx", change.alias("diff")), 4, "diff")


@query("W4 F16 N9", f"SELECT entity, period_idx, {rnd(f'ln(value) - ln(lag(value, 1) OVER {_W})', 8)} AS dlog FROM spine")
def log_diff(spark, sf):
    change = windows.log_difference(F.col("value"), KEY)
    return rounded(tb.monthly_panel(spark, sf).select("entity", "period_idx", change.alias("dlog")), 8, "dlog")


@query(
    "W5",
    "SELECT entity, period_idx, horizon, y FROM ("
    + " UNION ALL ".join(
        f"SELECT entity, period_idx, CAST({h} AS INTEGER) AS horizon, {rnd(f'ln(lead(value, {h}) OVER {_W}) - ln(lag(value, 1) OVER {_W})', 8)} AS y FROM spine"
        for h in range(tb.HORIZON + 1)
    )
    + ")",
)
def cumulative_log_change(spark, sf):
    changes = windows.cumulative_log_change(tb.monthly_panel(spark, sf), KEY, "value", tb.HORIZON)
    return rounded(changes.drop("value"), 8, "y")


@query("W6", f"SELECT entity, period_idx, {rnd(f'100 * (value / lag(value, 12) OVER {_W} - 1)', 6)} AS value FROM spine")
def pct_change_exact(spark, sf):
    return rounded(windows.rate_of_change(tb.monthly_panel(spark, sf), KEY, ["value"], "y", 12), 6, "value")


@query("W6", f"SELECT entity, period_idx, {rnd(f'100 * (ln(value) - ln(lag(value, 3) OVER {_W}))', 6)} AS value FROM spine")
def pct_change_log(spark, sf):
    return rounded(windows.rate_of_change(tb.monthly_panel(spark, sf), KEY, ["value"], "q", 12, log=True), 6, "value")


@query(
    "W6",
    f"SELECT entity, period_idx, {rnd(f'100 * (value / lag(value, 4) OVER {_W} - 1)', 6)} AS value FROM spine",
)
def pct_change_original_lag(spark, sf):
    """Quarterly rate on months with the original four-month lag."""
    changed = windows.rate_of_change(tb.monthly_panel(spark, sf), KEY, ["value"], "q", 12, monthly_q_lag=4)
    return rounded(changed, 6, "value")


@query("W7", f"SELECT entity, period_idx, {rnd(f'last_value(value IGNORE NULLS) OVER {_W}', 4)} AS value FROM spine")
def fill_down(spark, sf):
    return rounded(windows.fill_down(tb.monthly_panel(spark, sf), KEY, ["value"]), 4, "value")


TABLES["anchors"] = """
SELECT entity, c_mktsegment AS sector, m // 12 AS year, CAST(sum(cents) AS DOUBLE) / 100.0 AS level FROM located GROUP BY 1, 2, 3"""

TABLES["quantity_quarters"] = """
SELECT entity, sector, period_idx // 3 AS period_idx, sum(quantity) AS indicator
FROM shipped, (SELECT DISTINCT c_mktsegment AS sector FROM customer) GROUP BY 1, 2, 3"""

_S = "(PARTITION BY entity, sector ORDER BY period_idx)"

# The indicator on its own gap-free span, with the level at each fourth quarter.
TABLES["anchored"] = f"""
WITH span AS (SELECT entity, sector, CAST(unnest(range(min(period_idx), max(period_idx) + 1)) AS INTEGER) AS period_idx FROM quantity_quarters GROUP BY 1, 2),
base AS (SELECT s.entity, s.sector, s.period_idx, i.indicator, CASE WHEN i.period_idx IS NOT NULL THEN a.level END AS level FROM span s
  LEFT JOIN quantity_quarters i ON i.entity = s.entity AND i.sector = s.sector AND i.period_idx = s.period_idx
  LEFT JOIN anchors a ON a.entity = s.entity AND a.sector = s.sector AND a.year * 4 + 3 = s.period_idx)
SELECT *, count(level) OVER {_S} AS anchor, last_value(level IGNORE NULLS) OVER {_S} AS held,
  CASE WHEN level IS NULL THEN lead(indicator) OVER {_S} / indicator ELSE 1.0 END AS ahead,
  CASE WHEN level IS NULL THEN indicator / lag(indicator) OVER {_S} ELSE 1.0 END AS behind,
  lead(period_idx) OVER {_S} IS NULL AS is_last FROM base"""

BEHIND = "behind"
_SEGMENT = "(PARTITION BY entity, sector, anchor ORDER BY period_idx)"


def _moved(change: str) -> str:
    return f"CASE WHEN count(*) OVER {_SEGMENT} = count({change}) OVER {_SEGMENT} THEN held * product({change}) OVER {_SEGMENT} END"


_LAST4 = "(PARTITION BY entity, sector ORDER BY period_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"


@query(
    "W8 D11 J7 J1 H3 H16",
    f"""WITH x AS (SELECT entity, sector, period_idx, is_last, CASE WHEN anchor = 0 THEN 0.0 ELSE {_moved('ahead')} END AS value FROM anchored)
    SELECT entity, sector, period_idx, {rnd(f"CASE WHEN is_last THEN CASE WHEN count(value) OVER {_LAST4} = count(*) OVER {_LAST4} THEN avg(value) OVER {_LAST4} END ELSE value END", 2)} AS value FROM x""",
)
def anchored_extrapolation(spark, sf):
    quarterly = macro.annual_to_quarterly(tb.annual_levels(spark, sf), tb.quarterly_indicator(spark, sf))
    return rounded(quarterly.select("entity", "sector", "period_idx", "value"), 2, "value")


@query(
    "W8 D11",
    f"SELECT entity, sector, period_idx, {rnd(f'CASE WHEN anchor > 0 THEN {_moved(BEHIND)} END', 2)} AS value FROM anchored",
)
def annual_to_quarterly(spark, sf):
    """The aligned form: moves with the indicator's own change."""
    quarterly = macro.annual_to_quarterly(
        tb.annual_levels(spark, sf), tb.quarterly_indicator(spark, sf), aligned=True
    )
    return rounded(quarterly.select("entity", "sector", "period_idx", "value"), 2, "value")


@query("W9 F21", "SELECT c_custkey, c_name, CAST(dense_rank() OVER (ORDER BY c_name) AS BIGINT) AS group_id FROM customer")
def group_id(spark, sf):
    return ranking.group_id(tb.read(spark, sf, "customer").select("c_custkey", "c_name"), "c_name")


@query(
    "W11",
    """WITH s AS (SELECT entity, min(period_idx) AS low, max(period_idx) AS high FROM monthly GROUP BY 1),
    w AS (SELECT entity, unnest(range(low, high - 22)) AS b FROM s WHERE high - low >= 23)
    SELECT entity, CAST(b // 12 AS INTEGER) AS start_year, CAST(b % 12 + 1 AS INTEGER) AS start_sub,
      CAST((b + 23) // 12 AS INTEGER) AS end_year, CAST((b + 23) % 12 + 1 AS INTEGER) AS end_sub FROM w""",
)
def rolling_window_bounds(spark, sf):
    return windows.window_bounds(tb.monthly_values(spark, sf), KEY, 2)


@query(
    "W12",
    "SELECT entity, period_idx, "
    + ", ".join(f"{rnd(f'lag(value, {j}) OVER {_W}', 4)} AS lag{j}" for j in range(4))
    + " FROM spine",
)
def distributed_lags(spark, sf):
    blocks = windows.distributed_lags(tb.monthly_panel(spark, sf), KEY, "value", 0, 3, "lags")
    flat = blocks.select("entity", "period_idx", *[F.get("lags", F.lit(j)).alias(f"lag{j}") for j in range(4)])
    return rounded(flat, 4, *[f"lag{j}" for j in range(4)])


_KNOTS = (tb.END // 3) - (tb.START // 3) + 1

# Natural cubic spline: second derivatives at the inner knots solve a tridiagonal system, by nation.
TABLES["knots"] = """
SELECT entity, x, y, i, n, x - lag(x) OVER w AS h0, lead(x) OVER w - x AS h1, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS s0, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s1
FROM (SELECT entity, period_idx * 3 + 1 AS x, gdp_total AS y, row_number() OVER (PARTITION BY entity ORDER BY period_idx) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n
  FROM output_quarters WHERE gdp_total IS NOT NULL)
WINDOW w AS (PARTITION BY entity ORDER BY x)"""

_PIECE = """CASE WHEN n = 1 THEN y ELSE (bend * pow(x1 - mo, 3) + bend1 * pow(mo - x, 3)) / (6.0 * (x1 - x))
  + (y / (x1 - x) - bend * (x1 - x) / 6) * (x1 - mo) + (y1 / (x1 - x) - bend1 * (x1 - x) / 6) * (mo - x) END"""


@query(
    "W13",
    f"""WITH cells AS MATERIALIZED (SELECT a.entity AS spec, a.i, b.i AS j,
        CASE WHEN a.i = b.i THEN 2.0 * (a.h0 + a.h1) WHEN b.i = a.i - 1 THEN 1.0 * a.h0 WHEN b.i = a.i + 1 THEN 1.0 * a.h1 ELSE 0.0 END + 0e0 AS v
      FROM knots a JOIN knots b ON a.entity = b.entity WHERE a.i BETWEEN 1 AND a.n - 2 AND b.i BETWEEN 1 AND a.n - 2),
    {solved("cells", _KNOTS - 2)},
    bends AS (SELECT inverse.spec AS entity, inverse.i, sum(inverse.v * 6 * (s1 - s0)) AS bend FROM inverse JOIN knots k ON k.entity = inverse.spec AND k.i = inverse.j GROUP BY 1, 2),
    curve AS MATERIALIZED (SELECT k.*, coalesce(bend, 0.0) AS bend FROM knots k LEFT JOIN bends USING (entity, i)),
    pieces AS MATERIALIZED (SELECT entity, i, n, x, y, bend, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(bend) OVER w AS bend1 FROM curve WINDOW w AS (PARTITION BY entity ORDER BY i)),
    months AS (SELECT entity, CAST(unnest(range(min(period_idx) * 3, max(period_idx) * 3 + 3)) AS INTEGER) AS mo FROM output_quarters GROUP BY 1),
    spots AS (SELECT m.entity, m.mo, greatest(least(sum(CASE WHEN k.x <= m.mo THEN 1 ELSE 0 END) - 1, any_value(k.n) - 2), 0) AS i FROM months m JOIN knots k ON k.entity = m.entity GROUP BY 1, 2)
    SELECT s.entity, s.mo AS period_idx, {rnd(_PIECE, 2)} AS value FROM spots s JOIN pieces p ON p.entity = s.entity AND p.i = s.i""",
)
def spline_monthly(spark, sf):
    quarters = tb.outputs(spark, sf).select("entity", "period_idx", "gdp_total")
    return rounded(spline_to_months(quarters, KEY, "gdp_total", "value"), 2, "value")


# The cubic through the four outer knots on each side: its third divided difference.
TABLES["knot_ends"] = """
SELECT entity, coalesce(max(CASE WHEN i = 0 THEN f3 END), 0.0) AS first, coalesce(max(CASE WHEN i = n - 4 THEN f3 END), 0.0) AS last
FROM (SELECT *, (lead(f2) OVER w - f2) / (lead(x, 3) OVER w - x) AS f3
  FROM (SELECT *, (lead(s1) OVER w - s1) / (lead(x, 2) OVER w - x) AS f2 FROM knots WINDOW w AS (PARTITION BY entity ORDER BY x))
  WINDOW w AS (PARTITION BY entity ORDER BY x)) GROUP BY 1"""


@query(
    "W13",
    f"""WITH cells AS MATERIALIZED (SELECT a.entity AS spec, a.i, b.i AS j,
        CASE WHEN a.i = b.i THEN 2.0 * (a.h0 + a.h1) + CASE WHEN a.i = 1 THEN a.h0 ELSE 0 END + CASE WHEN a.i = a.n - 2 THEN a.h1 ELSE 0 END
          WHEN b.i = a.i - 1 THEN 1.0 * a.h0 WHEN b.i = a.i + 1 THEN 1.0 * a.h1 ELSE 0.0 END + 0e0 AS v
      FROM knots a JOIN knots b ON a.entity = b.entity WHERE a.i BETWEEN 1 AND a.n - 2 AND b.i BETWEEN 1 AND a.n - 2),
    {solved("cells", _KNOTS - 2)},
    sides AS (SELECT k.entity, i, 6 * (s1 - s0) + CASE WHEN i = 1 THEN 6 * h0 * h0 * first ELSE 0 END - CASE WHEN i = n - 2 THEN 6 * h1 * h1 * last ELSE 0 END AS side
      FROM knots k JOIN knot_ends e ON e.entity = k.entity),
    inner_bends AS MATERIALIZED (SELECT inverse.spec AS entity, inverse.i, sum(inverse.v * side) AS bend FROM inverse JOIN sides ON sides.entity = inverse.spec AND sides.i = inverse.j GROUP BY 1, 2),
    curve AS MATERIALIZED (SELECT k.*, CASE WHEN n < 3 THEN 0.0 WHEN k.i = 0 THEN after.bend - 6 * h1 * first WHEN k.i = n - 1 THEN before.bend + 6 * h0 * last ELSE own.bend END AS bend
      FROM knots k JOIN knot_ends e ON e.entity = k.entity LEFT JOIN inner_bends own ON own.entity = k.entity AND own.i = k.i
      LEFT JOIN inner_bends after ON after.entity = k.entity AND after.i = k.i + 1 LEFT JOIN inner_bends before ON before.entity = k.entity AND before.i = k.i - 1),
    pieces AS MATERIALIZED (SELECT entity, i, n, x, y, bend, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(bend) OVER w AS bend1 FROM curve WINDOW w AS (PARTITION BY entity ORDER BY i)),
    months AS (SELECT entity, CAST(unnest(range(min(period_idx) * 3, max(period_idx) * 3 + 3)) AS INTEGER) AS mo FROM output_quarters GROUP BY 1),
    spots AS (SELECT m.entity, m.mo, greatest(least(sum(CASE WHEN k.x <= m.mo THEN 1 ELSE 0 END) - 1, any_value(k.n) - 2), 0) AS i FROM months m JOIN knots k ON k.entity = m.entity GROUP BY 1, 2)
    SELECT s.entity, s.mo AS period_idx, {rnd(_PIECE, 2)} AS value FROM spots s JOIN pieces p ON p.entity = s.entity AND p.i = s.i""",
)
def spline_monthly_cubic(spark, sf):
    """With end cubics through the four outer quarters."""
    quarters = tb.outputs(spark, sf).select("entity", "period_idx", "gdp_total")
    return rounded(spline_to_months(quarters, KEY, "gdp_total", "value", ends="cubic"), 2, "value")


TABLES["all_price_spine"] = """
SELECT s.entity, s.period_idx, q.* EXCLUDE (entity, period_idx) FROM
  (SELECT entity, CAST(unnest(range(min(period_idx), max(period_idx) + 1)) AS INTEGER) AS period_idx FROM price_quarters GROUP BY 1) s
LEFT JOIN price_quarters q ON q.entity = s.entity AND q.period_idx = s.period_idx"""


@query(
    "W14 D9",
    "SELECT entity, period_idx, " + ", ".join(f"{rnd(p, 4)} AS {p}, {p}_sa_ok" for p in tb.PRICES) + " FROM "
    + " JOIN ".join(f"({adjusted('all_price_spine', 'entity', p)}) AS a_{p}" + (" USING (entity, period_idx)" if i else "") for i, p in enumerate(tb.PRICES)),
)
def seasonal_adjust_classical(spark, sf):
    """All price columns by the classical decomposition, each with its flag."""
    found = macro.price_panel(tb.prices(spark, sf), tb.PRIORITIES, tb.START, tb.END)
    return rounded(found.select("entity", "period_idx", *[c for p in tb.PRICES for c in (p, f"{p}_sa_ok")]), 4, *tb.PRICES)


@query(
    "W14 D9",
    "SELECT entity, period_idx, " + ", ".join(f"{rnd(p, 4)} AS {p}, {p}_sa_ok" for p in tb.PRICES) + " FROM "
    + " JOIN ".join(f"({adjusted_by_filters('all_price_spine', 'entity', p, 4, trend_weights(2))}) AS a_{p}" + (" USING (entity, period_idx)" if i else "") for i, p in enumerate(tb.PRICES)),
)
def seasonal_adjust_filters(spark, sf):
    """All price columns with factors that move from year to year: 5-term trend."""
    found = macro.price_panel(tb.prices(spark, sf), tb.PRIORITIES, tb.START, tb.END, method="filters")
    return rounded(found.select("entity", "period_idx", *[c for p in tb.PRICES for c in (p, f"{p}_sa_ok")]), 4, *tb.PRICES)


@query(
    "W14",
    f"SELECT entity, period_idx, {rnd('value', 4)} AS value, value_sa_ok FROM ({adjusted_by_filters('spine', 'entity', 'value', 12, trend_weights(6))})",
)
def seasonal_adjust_filters_monthly(spark, sf):
    """Monthly values: 13-term trend."""
    return rounded(windows.seasonal_adjust(tb.monthly_panel(spark, sf), KEY, ["value"], 12, method="filters"), 4, "value")


@query(
    "D17 W3 W15 V5",
    """SELECT entity, period_idx, d_deviation_temp FROM (
      SELECT entity, period_idx, """
    + rnd(f"deviation_temp - lag(deviation_temp) OVER {_W}", 6)
    + " AS d_deviation_temp FROM temp_anomalies WHERE norm_years = 1) WHERE d_deviation_temp IS NOT NULL",
)
def anomaly_change(spark, sf):
    anomalies = tb.weather(spark, sf).where(F.col("norm_years") == 1).select("entity", "period_idx", "deviation_temp")
    spine = joins.complete_periods(anomalies, KEY)
    return rounded(panel.anomaly_change(spine, KEY, "deviation_temp"), 6, "d_deviation_temp")


TABLES["outcome_spine"] = """
SELECT s.entity, s.period_idx, o.* EXCLUDE (entity, period_idx) FROM
  (SELECT entity, CAST(unnest(range(min(period_idx), max(period_idx) + 1)) AS INTEGER) AS period_idx FROM model_outcomes GROUP BY 1) s
LEFT JOIN model_outcomes o ON o.entity = s.entity AND o.period_idx = s.period_idx"""

_RATES = ["headline", "food", "energy", "gdp_total"]


@query(
    "D16 W6 V5",
    f"""WITH c AS (SELECT entity, period_idx, {", ".join(f"100 * (ln({c}) - ln(lag({c}) OVER {_W})) AS {c}" for c in _RATES)} FROM outcome_spine)
    SELECT CAST(entity AS VARCHAR) AS region, period_idx, {", ".join(f"{rnd(c, 6)} AS {c}" for c in _RATES)},
      entity = 0 AS is_total, CAST(CASE WHEN entity = 0 THEN 0 ELSE 1 END AS INTEGER) AS sort_key FROM c WHERE headline IS NOT NULL""",
)
def inflation_panel(spark, sf):
    """Rates of change by nation with one nation marked as the national series."""
    from panelloom.plans import views

    outcomes = tb.outcomes(spark, sf).withColumn("region", F.col("entity").cast("string"))
    spine = joins.complete_periods(outcomes.select("region", "period_idx", *_RATES), ["region"])
    changed = panel.inflation_panel(spine, ["region"], _RATES, "q", 4)
    return rounded(views.series_frame(changed, _RATES, total="0"), 6, *_RATES)


# The scans over blocks give the rows of the windows over whole series: a monthly series has 20 blocks here.
BLOCK_MONTHS, BLOCK_QUARTERS = 4, 2


@query("W1", STATEMENTS["trailing_norm"])
def trailing_norm_blocked(spark, sf):
    normed = blocked.trailing_norms(tb.monthly_values(spark, sf), KEY, ["value"], tb.NORMS, BLOCK_MONTHS)
    normed = normed.select(*KEY, "period_idx", *[F.col(f"norm_{m}_value").alias(f"norm_{m}") for m in tb.NORMS])
    return rounded(normed, 4, "norm_1", "norm_2", "norm_3")


@query("W2 J10", STATEMENTS["panel_lag_lead"])
def panel_lag_lead_blocked(spark, sf):
    shifted = blocked.lag_lead(tb.monthly_panel(spark, sf), KEY, "value", [1, 4, -2], BLOCK_MONTHS).drop("value")
    return rounded(shifted, 4, "value_lag1", "value_lag4", "value_lead2")


@query("W7", STATEMENTS["fill_down"])
def fill_down_blocked(spark, sf):
    return rounded(blocked.fill_down(tb.monthly_panel(spark, sf), KEY, ["value"], BLOCK_MONTHS), 4, "value")


@query("W8 D11", STATEMENTS["anchored_extrapolation"])
def anchored_extrapolation_blocked(spark, sf):
    quarterly = macro.annual_to_quarterly(tb.annual_levels(spark, sf), tb.quarterly_indicator(spark, sf), block=BLOCK_QUARTERS)
    return rounded(quarterly.select("entity", "sector", "period_idx", "value"), 2, "value")
