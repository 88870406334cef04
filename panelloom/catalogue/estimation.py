"""Fixed-effects fits, local projections and long-run models on the merged panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.catalogue.registry import query, rnd, rounded
from panelloom.catalogue.sql import SEASON, TABLES, within_fit
from panelloom.operators import estimators, windows
from panelloom.operators.estimators import Spec
from panelloom.plans import longrun, projections, views
from panelloom.plans import tables as tb

KEYS, ENTITY = ["norm_years"], ["entity"]
H, LAGS = tb.HORIZON, 8
OUTCOMES = [*tb.MODEL_PRICES, *tb.MODEL_OUTPUTS]
_W = "(PARTITION BY norm_years, entity ORDER BY period_idx)"
_BANDWIDTH = "floor(pow(count(DISTINCT t), 0.25) + 1e-9)"


def _unpivot(name: str, columns: list[str]) -> str:
    return f"unnest([{', '.join(map(repr, columns))}]) AS {name}, unnest([{', '.join(columns)}]) AS x"


# One regressor and two regressors: output on weather levels, by norm.
TABLES["levels_design"] = f"""
SELECT norm_years AS spec, entity AS e, period_idx AS t, ln(gdp_total) AS y, deviation_temp AS x1, deviation_precip AS x2 FROM estimation"""


def _levels(spark, sf):
    kept = tb.estimation(spark, sf)
    return kept.withColumn("log_output", F.ln("gdp_total"))


TABLES["levels_within"] = """
SELECT spec, e, t, y - avg(y) OVER w AS y, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2
FROM levels_design WINDOW w AS (PARTITION BY spec, e)"""


@query(
    "E1 E3 A11",
    f"""WITH b AS (SELECT spec, sum(x1 * y) / sum(x1 * x1) AS b FROM levels_within GROUP BY 1)
    SELECT b.spec AS norm_years, {rnd('any_value(b)', 6)} AS estimate, {rnd('1 - sum((y - b * x1) * (y - b * x1)) / sum(y * y)', 6)} AS r2, count(*) AS n_obs
    FROM levels_within w JOIN b ON b.spec = w.spec GROUP BY 1""",
)
def fe_ols_1(spark, sf):
    fits = estimators.fit(_levels(spark, sf), [Spec("one", "log_output", ("deviation_temp",))], ENTITY, KEYS)
    rows = estimators.coefficients(fits, KEYS).select("norm_years", "estimate", "r2", "n_obs")
    return rounded(rows, 6, "estimate", "r2")


@query(
    "E1 E3",
    f"""WITH s AS (SELECT spec, sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS p, sum(x2 * y) AS q, sum(y * y) AS yy, count(*) AS n FROM levels_within GROUP BY 1),
    f AS (SELECT spec, (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2, p, q, yy, n FROM s)
    SELECT spec AS norm_years, 'deviation_temp' AS term, {rnd('b1', 6)} AS estimate, {rnd('(b1 * p + b2 * q) / yy', 6)} AS r2, n AS n_obs FROM f
    UNION ALL SELECT spec, 'deviation_precip', {rnd('b2', 6)}, {rnd('(b1 * p + b2 * q) / yy', 6)}, n FROM f""",
)
def fe_ols_2(spark, sf):
    spec = Spec("two", "log_output", ("deviation_temp", "deviation_precip"))
    fits = estimators.fit(_levels(spark, sf), [spec], ENTITY, KEYS)
    rows = estimators.coefficients(fits, KEYS).select("norm_years", "term", "estimate", "r2", "n_obs")
    return rounded(rows, 6, "estimate", "r2")


@query(
    "E2",
    f"""WITH b AS (SELECT spec, sum(x1 * y) / sum(x1 * x1) AS b, sum(x1 * x1) AS g FROM levels_within GROUP BY 1),
    h AS (SELECT w.spec, t, sum(x1 * (y - b * x1)) AS h FROM levels_within w JOIN b ON b.spec = w.spec GROUP BY 1, 2),
    o AS (SELECT a.spec, sum(a.h * c.h * (1 - abs(a.t - c.t) / 3.0)) AS omega FROM h a JOIN h c ON a.spec = c.spec AND abs(a.t - c.t) <= 2 GROUP BY 1)
    SELECT b.spec AS norm_years, {rnd('sqrt(omega) / g', 6)} AS se, {rnd('b / (sqrt(omega) / g)', 4)} AS t FROM b JOIN o ON o.spec = b.spec""",
)
def dk_se_1(spark, sf):
    fits = estimators.fit(
        _levels(spark, sf), [Spec("one", "log_output", ("deviation_temp",))], ENTITY, KEYS, max_lag=2
    )
    rows = estimators.coefficients(fits, KEYS).select("norm_years", "se", "t")
    return rounded(rounded(rows, 6, "se"), 4, "t")


_LONG = "(PARTITION BY norm_years, entity, outcome ORDER BY period_idx)"

# Per outcome: the log changes ahead, and the lagged log differences.
TABLES["outcome_changes"] = f"""
SELECT norm_years, entity AS e, period_idx AS t, outcome, lx - lag(lx) OVER {_LONG} AS dl,
  [{", ".join(f"lead(lx, {h}) OVER {_LONG} - lag(lx) OVER {_LONG}" for h in range(H + 1))}] AS ahead,
  [{", ".join(f"lag(lx, {j}) OVER {_LONG} - lag(lx, {j + 1}) OVER {_LONG}" for j in range(1, H + 1))}] AS lags
FROM (SELECT norm_years, entity, period_idx, outcome, ln(x) AS lx FROM (SELECT norm_years, entity, period_idx, {_unpivot("outcome", OUTCOMES)} FROM estimation_spine))"""

TABLES["shock_changes"] = f"""
SELECT norm_years, entity AS e, period_idx AS t, shock, x - lag(x) OVER (PARTITION BY norm_years, entity, shock ORDER BY period_idx) AS ds
FROM (SELECT norm_years, entity, period_idx, {_unpivot("shock", tb.SHOCKS)} FROM estimation_spine)"""

TABLES["projection_sets"] = """
SELECT o.norm_years, o.e, o.t, outcome, shock, CAST(h AS INTEGER) AS h, ahead[h + 1] AS y, dl, ds, lags
FROM outcome_changes o JOIN shock_changes s ON s.norm_years = o.norm_years AND s.e = o.e AND s.t = o.t, (SELECT unnest(range({})) AS h)
WHERE ahead[h + 1] IS NOT NULL AND ds IS NOT NULL AND list_count(lags) = len(lags)""".format(H + 1)


@query(
    "D18 W4 W5 W12",
    f"""SELECT norm_years, e AS entity, t AS period_idx, h AS horizon, {rnd('y', 6)} AS y, {rnd('dl', 6)} AS d_log_outcome, {rnd('ds', 6)} AS d_shock,
      {rnd('lags[1]', 6)} AS lag1, {rnd(f'lags[{H}]', 6)} AS lag_last
    FROM projection_sets WHERE outcome = 'gdp_total' AND shock = 'deviation_temp'""",
)
def lp_dataset(spark, sf):
    rows = projections.projection_dataset(
        tb.estimation(spark, sf), [*KEYS, *ENTITY], "deviation_temp", "gdp_total", H
    )
    flat = rows.select(
        "norm_years", "entity", "period_idx", "horizon", "y", "d_log_outcome", "d_shock",
        F.get("lags", F.lit(0)).alias("lag1"), F.get("lags", F.lit(H - 1)).alias("lag_last"),
    )
    return rounded(flat, 6, "y", "d_log_outcome", "d_shock", "lag1", "lag_last")


@query(
    "D19 W3 W4",
    "SELECT norm_years, entity, period_idx, "
    + ", ".join(f"{rnd(c, 6)} AS {c}" for c in [*tb.MODEL_OUTPUTS, *tb.SHOCKS])
    + " FROM (SELECT norm_years, entity, period_idx, lag(period_idx) OVER "
    + _W
    + " AS before, "
    + ", ".join(
        [f"ln({o}) - ln(lag({o}) OVER {_W}) AS {o}" for o in tb.MODEL_OUTPUTS]
        + [f"{s} - lag({s}) OVER {_W} AS {s}" for s in tb.SHOCKS]
    )
    + " FROM estimation_spine) WHERE before IS NOT NULL",
)
def ardl_dataset(spark, sf):
    rows = longrun.difference_panel(tb.estimation(spark, sf), [*KEYS, *ENTITY], tb.MODEL_OUTPUTS, tb.SHOCKS)
    return rounded(rows, 6, *tb.MODEL_OUTPUTS, *tb.SHOCKS)


# All projections: one specification per norm, shock, outcome and horizon.
TABLES["projection_rows"] = f"""
SELECT norm_years || '|' || shock || '|' || outcome || '|' || h AS spec, e, t, unnest(range({H + 2})) AS i, unnest(list_concat([y, ds], lags)) AS v
FROM projection_sets"""

TABLES["responses"] = f"""
WITH {within_fit("projection_rows", H + 1, _BANDWIDTH, small_sample=True)}
SELECT CAST(split_part(fit.spec, '|', 1) AS INTEGER) AS norm_years, split_part(fit.spec, '|', 2) AS shock, split_part(fit.spec, '|', 3) AS outcome,
  CAST(split_part(fit.spec, '|', 4) AS INTEGER) AS horizon, b AS estimate, sqrt(cov.v) AS se, r2, n AS nt
FROM fit JOIN beta ON beta.spec = fit.spec AND beta.i = 1 JOIN cov ON cov.spec = fit.spec AND cov.i = 1 AND cov.j = 1"""


def _responses(spark, sf):
    return projections.project(tb.estimation(spark, sf), ENTITY, OUTCOMES, tb.SHOCKS, H, KEYS)


@query(
    "E4 E1 E2 E10 D18",
    f"SELECT norm_years, shock, outcome, horizon, {rnd('estimate', 5)} AS estimate, {rnd('se', 5)} AS se, {rnd('r2', 6)} AS r2, nt FROM responses",
)
def lp_irf(spark, sf):
    return rounded(rounded(_responses(spark, sf), 5, "estimate", "se"), 6, "r2")


# The same by month: all outcomes, and horizons that the quarters are too few for.
MONTHLY_H, MONTHLY_OUTCOMES = tb.MONTHLY_HORIZON, [*tb.MONTHLY_PRICES, *tb.LONG_RUN_OUTPUTS]

TABLES["month_changes"] = f"""
SELECT norm_years, entity AS e, period_idx AS t, outcome,
  [{", ".join(f"lead(lx, {h}) OVER {_LONG} - lag(lx) OVER {_LONG}" for h in range(MONTHLY_H + 1))}] AS ahead,
  [{", ".join(f"lag(lx, {j}) OVER {_LONG} - lag(lx, {j + 1}) OVER {_LONG}" for j in range(1, MONTHLY_H + 1))}] AS lags
FROM (SELECT norm_years, entity, period_idx, outcome, ln(nullif(greatest(x, 0), 0)) AS lx FROM (SELECT norm_years, entity, period_idx, {_unpivot("outcome", MONTHLY_OUTCOMES)} FROM month_spine))"""

TABLES["month_shocks"] = f"""
SELECT norm_years, entity AS e, period_idx AS t, shock, x - lag(x) OVER (PARTITION BY norm_years, entity, shock ORDER BY period_idx) AS ds
FROM (SELECT norm_years, entity, period_idx, {_unpivot("shock", tb.SHOCKS)} FROM month_spine)"""

TABLES["month_projection_rows"] = f"""
SELECT norm_years || '|' || shock || '|' || outcome || '|' || h AS spec, e, t, unnest(range({MONTHLY_H + 2})) AS i, unnest(list_concat([y, ds], lags)) AS v
FROM (SELECT o.norm_years, o.e, o.t, outcome, shock, CAST(h AS INTEGER) AS h, ahead[h + 1] AS y, ds, lags
  FROM month_changes o JOIN month_shocks s ON s.norm_years = o.norm_years AND s.e = o.e AND s.t = o.t, (SELECT unnest(range({MONTHLY_H + 1})) AS h)
  WHERE ahead[h + 1] IS NOT NULL AND ds IS NOT NULL AND list_count(lags) = len(lags))"""

TABLES["month_responses"] = f"""
WITH {within_fit("month_projection_rows", MONTHLY_H + 1, _BANDWIDTH, small_sample=True)}
SELECT CAST(split_part(fit.spec, '|', 1) AS INTEGER) AS norm_years, split_part(fit.spec, '|', 2) AS shock, split_part(fit.spec, '|', 3) AS outcome,
  CAST(split_part(fit.spec, '|', 4) AS INTEGER) AS horizon, b AS estimate, sqrt(cov.v) AS se, r2, n AS nt, entities
FROM fit JOIN beta ON beta.spec = fit.spec AND beta.i = 1 JOIN cov ON cov.spec = fit.spec AND cov.i = 1 AND cov.j = 1"""


# A fit needs more rows than regressors and means of its nations; with fewer its numbers are NULL.
_DETERMINED = f"nt > entities + {MONTHLY_H + 1}"


@query(
    "E4 E10",
    "SELECT norm_years, shock, outcome, horizon, "
    + ", ".join(f"CASE WHEN {_DETERMINED} THEN {rnd(c, n)} END AS {c}" for c, n in (("estimate", 5), ("se", 5), ("r2", 6)))
    + ", nt FROM month_responses",
)
def lp_monthly(spark, sf):
    """1,620 projections: three norms, six shocks, ten outcomes, horizons 0 to 8."""
    fits = projections.project(tb.monthly_model_panel(spark, sf), ENTITY, MONTHLY_OUTCOMES, tb.SHOCKS, MONTHLY_H, KEYS)
    return rounded(rounded(fits, 5, "estimate", "se"), 6, "r2")


_STARS = "CASE WHEN abs(estimate / se) > 2.576 THEN '***' WHEN abs(estimate / se) > 1.96 THEN '**' WHEN abs(estimate / se) > 1.645 THEN '*' END"


@query(
    "E5 F22 F23",
    f"""SELECT norm_years, shock, outcome, horizon, {rnd('100 * estimate', 3)} AS estimate, {rnd('100 * se', 3)} AS se, {rnd('100 * (estimate - 1.96 * se)', 3)} AS ci_low,
      {rnd('100 * (estimate + 1.96 * se)', 3)} AS ci_up, 1.96 + 0e0 AS t_cval, {_STARS} AS signif FROM responses""",
)
def irf_table(spark, sf):
    table = projections.response_table(_responses(spark, sf)).drop("r2", "nt")
    return rounded(table, 3, "estimate", "se", "ci_low", "ci_up")


@query(
    "V6",
    f"""SELECT shock, outcome, horizon, {rnd('100 * estimate', 3)} AS estimate, {rnd('100 * (estimate - 1.96 * se)', 3)} AS ci_low, {rnd('100 * (estimate + 1.96 * se)', 3)} AS ci_up
    FROM responses WHERE norm_years = 2""",
)
def irf_frame(spark, sf):
    frame = views.response_frame(projections.response_table(_responses(spark, sf)), 2)
    return rounded(frame, 3, "estimate", "ci_low", "ci_up")


ASYMMETRIC = [s for s in tb.SHOCKS if not s.startswith("deviation")]


def _pivot_lines(ids: str, key: str, names: dict[str, str], lines: dict[int, str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, CAST({line} AS INTEGER) AS line, "
        + ", ".join(f"max(CASE WHEN {key} = {k} THEN {cell} END) AS {n}" for k, n in names.items())
        + f" FROM {source} GROUP BY ALL"
        for line, cell in lines.items()
    )


@query(
    "V2 V4 R8 P6",
    f"""WITH c AS (SELECT norm_years, shock, outcome, horizon, printf('%.2f', {rnd('100 * estimate', 2)}) || coalesce(' ' || {_STARS}, '') AS cell, '(' || printf('%.3f', {rnd('100 * se', 3)}) || ')' AS error
      FROM responses WHERE shock NOT LIKE 'deviation%'),
    p AS ({_pivot_lines("norm_years, shock, outcome", "horizon", {str(h): f"h{h}" for h in range(H + 1)}, {1: "cell", 2: "error"}, "c")})
    SELECT norm_years, 'dev' AS family, CASE WHEN outcome LIKE 'gdp%' THEN 'output' ELSE 'prices' END AS part, shock, outcome, line,
      CASE WHEN line = 1 THEN outcome END AS label, {", ".join(f"h{h}" for h in range(H + 1))} FROM p""",
)
def lp_wide_view(spark, sf):
    table = projections.response_table(_responses(spark, sf))
    return views.response_layout(table, KEYS, H, ASYMMETRIC)


# Extreme seasons as shocks: an indicator is NULL in its season's opposite extreme, and its changes are the shocks.
def _indicator(season: str, extreme: str, opposite: str) -> str:
    return f"CASE WHEN season <> '{season}' THEN 0 WHEN d {extreme} THEN 1 WHEN d {opposite} THEN NULL WHEN d IS NOT NULL THEN 0 END"


_HOT, _COLD = f">= {tb.EXTREME}", f"<= -{tb.EXTREME}"

TABLES["season_indicators"] = f"""
SELECT norm_years, entity, period_idx, CAST(abs(d) >= {tb.EXTREME} AS INTEGER) AS all_seasons,
  {_indicator("winter", _COLD, _HOT)} AS c_winter, {_indicator("spring", _HOT, _COLD)} AS h_spring, {_indicator("summer", _HOT, _COLD)} AS h_summer
FROM (SELECT norm_years, entity, period_idx, deviation_temp AS d, {SEASON} AS season FROM estimation_spine)"""

TABLES["flag_projection_rows"] = f"""
SELECT o.norm_years || '|' || shock || '|' || outcome || '|' || h AS spec, o.e, o.t, unnest(range({H + 2})) AS i, unnest(list_concat([ahead[h + 1], CAST(ds AS DOUBLE)], lags)) AS v
FROM outcome_changes o JOIN (
  SELECT norm_years, entity AS e, period_idx AS t, shock, x - lag(x) OVER (PARTITION BY norm_years, entity, shock ORDER BY period_idx) AS ds
  FROM (SELECT norm_years, entity, period_idx, {_unpivot("shock", tb.FLAGS)} FROM season_indicators)) s ON s.norm_years = o.norm_years AND s.e = o.e AND s.t = o.t,
  (SELECT unnest(range({H + 1})) AS h)
WHERE ahead[h + 1] IS NOT NULL AND ds IS NOT NULL AND list_count(lags) = len(lags)"""

TABLES["flag_fits"] = f"""
WITH {within_fit("flag_projection_rows", H + 1, _BANDWIDTH, small_sample=True)}
SELECT CAST(split_part(fit.spec, '|', 1) AS INTEGER) AS norm_years, split_part(fit.spec, '|', 2) AS shock, split_part(fit.spec, '|', 3) AS outcome,
  CAST(split_part(fit.spec, '|', 4) AS INTEGER) AS horizon, b AS estimate, sqrt(cov.v) AS se, r2, n AS nt
FROM fit JOIN beta ON beta.spec = fit.spec AND beta.i = 1 JOIN cov ON cov.spec = fit.spec AND cov.i = 1 AND cov.j = 1"""


@query(
    "E4 E10 D6 V4",
    f"SELECT norm_years, shock, outcome, horizon, {rnd('estimate', 5)} AS estimate, {rnd('se', 5)} AS se, {rnd('r2', 6)} AS r2, nt FROM flag_fits",
)
def lp_season_flags(spark, sf):
    """360 projections on the extreme-season indicators."""
    fits = projections.project(tb.flagged_estimation(spark, sf), ENTITY, OUTCOMES, tb.FLAGS, H, KEYS)
    return rounded(rounded(fits, 5, "estimate", "se"), 6, "r2")


@query(
    "V2 V4 D6 R8",
    f"""WITH c AS (SELECT norm_years, shock, outcome, horizon, printf('%.2f', {rnd('100 * estimate', 2)}) || coalesce(' ' || {_STARS}, '') AS cell, '(' || printf('%.3f', {rnd('100 * se', 3)}) || ')' AS error
      FROM (SELECT * FROM responses WHERE shock NOT LIKE 'deviation%' UNION ALL SELECT * FROM flag_fits)),
    p AS ({_pivot_lines("norm_years, shock, outcome", "horizon", {str(h): f"h{h}" for h in range(H + 1)}, {1: "cell", 2: "error"}, "c")})
    SELECT norm_years, CASE WHEN shock LIKE '%dev%' THEN 'dev' ELSE 'ext' END AS family, CASE WHEN outcome LIKE 'gdp%' THEN 'output' ELSE 'prices' END AS part, shock, outcome, line,
      CASE WHEN line = 1 THEN outcome END AS label, {", ".join(f"h{h}" for h in range(H + 1))} FROM p""",
)
def lp_families_view(spark, sf):
    """Tables of both families, anomalies and extreme seasons, from one job."""
    shocks = [*ASYMMETRIC, *tb.FLAGS]
    fits = projections.project(tb.flagged_estimation(spark, sf), ENTITY, OUTCOMES, shocks, H, KEYS)
    return views.response_layout(projections.response_table(fits), KEYS, H, shocks)


# Long-run models.
VARIABLES = list(dict.fromkeys(v for m in longrun.MODELS.values() for v in m))

_NAMES = [*tb.LONG_RUN_OUTPUTS, *VARIABLES]
_NAMED = "(PARTITION BY norm_years, entity, name ORDER BY period_idx)"

# Lags 0..p of every difference, as rows.
TABLES["lag_long"] = f"""
SELECT norm_years, entity AS e, period_idx AS t, name, unnest(range({LAGS + 1})) AS j,
  unnest([{", ".join(f"lag(x, {j}) OVER {_NAMED} - lag(x, {j + 1}) OVER {_NAMED}" for j in range(LAGS + 1))}]) AS v
FROM (SELECT norm_years, entity, period_idx, name, CASE WHEN name LIKE 'gdp%' THEN ln(nullif(greatest(x, 0), 0)) ELSE x END AS x
  FROM (SELECT norm_years, entity, period_idx, {_unpivot("name", _NAMES)} FROM estimation_spine))"""


def _model_terms(model: int) -> list[tuple[str, int]]:
    return [("phi", j) for j in range(1, LAGS + 1)] + [(v, j) for v in longrun.MODELS[model] for j in range(LAGS + 1)]


# Which variable and lag each regressor of each model is; ``phi`` stands for the outcome itself.
TABLES["lag_terms"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({m}, {i}, {name!r}, {j})" for m in longrun.MODELS for i, (name, j) in enumerate([("phi", 0), *_model_terms(m)])
) + ") AS terms(model, i, var, j)"

TABLES["lag_rows"] = f"""
SELECT spec, e, t, i, v FROM (
  SELECT *, count(v) OVER (PARTITION BY spec, e, t) = count(*) OVER (PARTITION BY spec, e, t) AS whole FROM (
    SELECT norm_years || '|' || outcome || '|' || model AS spec, e, t, i, v
    FROM (SELECT unnest([{", ".join(map(repr, tb.LONG_RUN_OUTPUTS))}]) AS outcome) CROSS JOIN lag_terms
    JOIN lag_long ON lag_long.name = CASE WHEN var = 'phi' THEN outcome ELSE var END AND lag_long.j = lag_terms.j))
WHERE whole"""

_WIDEST = max(len(_model_terms(m)) for m in longrun.MODELS)

TABLES["long_run_effects"] = f"""
WITH {within_fit("lag_rows", _WIDEST, _BANDWIDTH, small_sample=False)},
named AS (SELECT beta.spec, beta.i, b, var, CAST(split_part(beta.spec, '|', 3) AS INTEGER) AS model FROM beta
  JOIN lag_terms ON lag_terms.i = beta.i AND lag_terms.model = CAST(split_part(beta.spec, '|', 3) AS INTEGER)),
sums AS (SELECT spec, model, var, sum(b) AS b FROM named GROUP BY 1, 2, 3),
sizes AS (SELECT c.spec, a.var, sqrt(sum(c.v)) AS size FROM cov c JOIN named a ON a.spec = c.spec AND a.i = c.i
  JOIN named d ON d.spec = c.spec AND d.i = c.j AND d.var = a.var GROUP BY 1, 2),
phis AS (SELECT spec, 1 - b AS phi FROM sums WHERE var = 'phi')
SELECT CAST(split_part(s.spec, '|', 1) AS INTEGER) AS norm_years, split_part(s.spec, '|', 2) AS y_var, model, s.var,
  CASE WHEN s.var = 'phi' THEN phi ELSE b / phi END AS lr_coeff, CASE WHEN s.var = 'phi' THEN size ELSE size / abs(phi) END AS se
FROM sums s JOIN sizes z ON z.spec = s.spec AND z.var = s.var JOIN phis p ON p.spec = s.spec"""


def _long_run(spark, sf):
    return longrun.long_run_models(tb.estimation(spark, sf), ENTITY, tb.LONG_RUN_OUTPUTS, LAGS)


_LONG_RUN_STARS = "CASE WHEN tval > 2.326 THEN '***' WHEN tval > 1.96 THEN '**' WHEN tval > 1.645 THEN '*' ELSE '' END"


@query(
    "E6 E7 E8 E9 E10 D19",
    f"""SELECT norm_years, y_var, model, var, {rnd('lr_coeff', 5)} AS lr_coeff, {rnd('se', 5)} AS se, {rnd('tval', 3)} AS tval, {_LONG_RUN_STARS} AS signif,
      {rnd("CASE WHEN var <> 'phi' THEN 2.0 / (norm_years + 1) * lr_coeff END", 5)} AS lr_effect
    FROM (SELECT *, abs(lr_coeff / se) AS tval FROM long_run_effects)""",
)
def long_run(spark, sf):
    table = _long_run(spark, sf)
    table = table.withColumn("var", F.when(F.col("is_phi"), "phi").otherwise(F.col("var"))).drop("is_phi")
    return rounded(rounded(table, 5, "lr_coeff", "se", "lr_effect"), 3, "tval")


@query(
    "E6 R7 M11",
    f"""WITH {within_fit("lag_rows", _WIDEST, _BANDWIDTH, small_sample=False)}
    SELECT CAST(split_part(fit.spec, '|', 1) AS INTEGER) AS norm_years, split_part(fit.spec, '|', 2) || '|' || split_part(fit.spec, '|', 3) AS spec_id,
      CAST(beta.i - 1 AS INTEGER) AS pos, {rnd('b', 5)} AS estimate, {rnd('sqrt(cov.v)', 5)} AS se, {rnd('r2', 6)} AS r2, n AS n_obs
    FROM fit JOIN beta ON beta.spec = fit.spec JOIN cov ON cov.spec = fit.spec AND cov.i = beta.i AND cov.j = beta.i""",
)
def ardl_fit(spark, sf):
    wide = longrun.lag_columns(tb.estimation(spark, sf), [*KEYS, *ENTITY], tb.LONG_RUN_OUTPUTS, VARIABLES, LAGS)
    fits = estimators.fit(wide, longrun.model_specs(tb.LONG_RUN_OUTPUTS, LAGS), ENTITY, KEYS)
    rows = estimators.coefficients(fits, KEYS).select("norm_years", "spec_id", "pos", "estimate", "se", "r2", "n_obs")
    return rounded(rounded(rows, 5, "estimate", "se"), 6, "r2")


_COLUMNS = {(m, n): f"m{m}_n{n}" for m in (1, 2, 3) for n in tb.NORMS}


@query(
    "V3 R2",
    f"""WITH c AS (SELECT y_var, var, model * 10 + norm_years AS col, trim(printf('%.3f', {rnd('lr_coeff', 3)}) || ' ' || {_LONG_RUN_STARS}) AS estimate,
        '(' || printf('%.3f', {rnd('se', 3)}) || ')' AS error FROM (SELECT *, abs(lr_coeff / se) AS tval FROM long_run_effects) WHERE model IN (1, 2, 3)),
    p AS ({_pivot_lines("y_var, var", "col", {str(m * 10 + n): c for (m, n), c in _COLUMNS.items()}, {1: "estimate", 2: "error"}, "c")})
    SELECT CASE WHEN y_var = 'gdp_total' THEN 'total' ELSE 'sector' END AS part, * FROM p""",
)
def ardl_compare_view(spark, sf):
    return views.long_run_comparison(_long_run(spark, sf), [1, 2, 3], tb.NORMS, "gdp_total")


TABLES["design_rows"] = f"""
SELECT CAST(norm_years AS VARCHAR) AS spec, e, t, unnest(range(4)) AS i, unnest([y, l1, l2, x]) AS v FROM (
  SELECT norm_years, entity AS e, period_idx AS t, ln(gdp_total) AS y, ln(lag(gdp_total, 1) OVER {_W}) AS l1, ln(lag(gdp_total, 2) OVER {_W}) AS l2, deviation_temp AS x
  FROM estimation_spine) WHERE y IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL AND x IS NOT NULL"""


@query(
    "W12 E1 E2",
    f"""WITH {within_fit("design_rows", 3, _BANDWIDTH, small_sample=False)}
    SELECT CAST(fit.spec AS INTEGER) AS spec_id, 'x' || (beta.i - 1) AS term, {rnd('b', 6)} AS estimate, {rnd('sqrt(cov.v)', 6)} AS se, {rnd('r2', 6)} AS r2, n AS n_obs, CAST(periods AS INTEGER) AS n_periods
    FROM fit JOIN beta ON beta.spec = fit.spec JOIN cov ON cov.spec = fit.spec AND cov.i = beta.i AND cov.j = beta.i""",
)
def fe_ols_batch(spark, sf):
    """Designs given as rows, one fit per outcome: output on its own two lags and the weather anomaly."""
    panel = tb.estimation(spark, sf)
    lags = windows.lag_block([*KEYS, *ENTITY], "log_output", 1, 2)
    rows = panel.withColumn("log_output", F.ln("gdp_total")).select(
        F.col("norm_years").alias("spec_id"), "entity", "period_idx", F.col("log_output").alias("y"),
        F.array(*lags, F.col("deviation_temp")).alias("x"),
    )
    fits = estimators.fit_designs(rows, 3)
    rows = estimators.coefficients(fits).select("spec_id", "term", "estimate", "se", "r2", "n_obs", "n_periods")
    return rounded(rows, 6, "estimate", "se", "r2")
