"""Window operators on panels.

A panel is unique in (entity, period), so a window partition holds at most one row per period of the
calendar, however large the raw data or however uneven its keys. All of them partition by entity, so
chained operators share one shuffle and one sort. Lags count periods: they need a gap-free calendar
(``joins.complete_periods``), on which one row is one period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.config import rate_lag
from panelloom.functions import calendar as cal
from panelloom.functions.numbers import log_or_null
from panelloom.functions.text import ident, idents, over
from panelloom.operators.seasonal import adjust_by_filters


def series_window(keys: Sequence[str], period: str = "period_idx"):
    return Window.partitionBy(*keys).orderBy(period)


def trailing_norms(
    panel: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    years: Sequence[int],
    freq: int = 12,
    exclude_current: bool = False,
) -> DataFrame:
    """Mean over the last ``m`` years up to and including the period, for all measures and ``m`` in one pass.

    Missing values are skipped. A norm is given only where the series reaches back over its whole window.
    The frames count calendar periods, so gaps are allowed. Result columns: ``norm_<m>_<value>``.

    A window's sum is the difference of two running sums, so a row costs the same for 40 years as for one. The
    sums are of deviations from the series' first value, which keeps them small and a constant series exact.
    """
    late = 1 if exclude_current else 0
    so_far = over(keys, frame="ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    known = {v: f"CASE WHEN NOT isnan({ident(v)}) THEN {ident(v)} END" for v in values}
    based = panel.selectExpr(
        "*",
        f"min(period_idx) {so_far} AS _first",
        *[f"first_value({x}, true) {so_far} AS {ident(f'_base_{v}')}" for v, x in known.items()],
    )
    based = based.selectExpr("*", *[f"{x} - {ident(f'_base_{v}')} AS {ident(f'_dev_{v}')}" for v, x in known.items()])

    def up_to(back: int, function: str, v: str) -> str:
        end = f"{back} PRECEDING" if back else "CURRENT ROW"
        frame = over(keys, frame=f"RANGE BETWEEN UNBOUNDED PRECEDING AND {end}")
        return f"coalesce({function}({ident(f'_dev_{v}')}) {frame}, 0)"

    norms = []
    for m in years:
        length = m * freq - 1 + late
        for v in values:
            total = f"({up_to(late, 'sum', v)} - {up_to(length + 1, 'sum', v)})"
            count = f"({up_to(late, 'count', v)} - {up_to(length + 1, 'count', v)})"
            mean = f"{ident(f'_base_{v}')} + {total} / nullif({count}, 0)"
            norms.append(f"CASE WHEN period_idx - _first >= {length} THEN {mean} END AS {ident(f'norm_{m}_{v}')}")
    return based.selectExpr(*idents(panel.columns), *norms)


def norms_long(panel: DataFrame, values: Sequence[str], years: Sequence[int]) -> DataFrame:
    """``norm_<m>_<value>`` columns to rows keyed by ``norm_years``, with one column ``mean_<value>`` each."""
    rows = [
        f"named_struct('norm_years', {m}, {', '.join(f"'mean_{v}', {ident(f'norm_{m}_{v}')}" for v in values)})" for m in years
    ]
    wide = {f"norm_{m}_{v}" for m in years for v in values}
    kept = [c for c in panel.columns if c not in wide]
    return panel.selectExpr(*idents(kept), f"inline(array({', '.join(rows)}))")


def lag_lead(panel: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int]) -> DataFrame:
    """Lagged (k > 0) and led (k < 0) values, as ``<value>_lag<k>`` and ``<value>_lead<k>``."""
    w = series_window(keys)
    return panel.withColumns(
        {f"{value}_{'lag' if k >= 0 else 'lead'}{abs(k)}": F.lag(value, k).over(w) for k in lags}
    )


def difference(x: Column, keys: Sequence[str], k: int = 1) -> Column:
    return x - F.lag(x, k).over(series_window(keys))


def log_difference(x: Column, keys: Sequence[str], k: int = 1) -> Column:
    return difference(log_or_null(x), keys, k)


def cumulative_log_change(panel: DataFrame, keys: Sequence[str], value: str, horizon: int) -> DataFrame:
    """``log x(t+h) - log x(t-1)`` for h = 0..horizon, one row per h."""
    w = series_window(keys)
    before = F.lag(log_or_null(F.col(value))).over(w)
    ahead = [F.lead(log_or_null(F.col(value)), h).over(w) - before for h in range(horizon + 1)]
    return panel.select("*", F.array(*ahead).alias("_y")).select(
        *panel.columns, F.posexplode("_y").alias("horizon", "y")
    )


def rate_of_change(
    panel: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    rate: str,
    freq: int,
    log: bool = False,
    monthly_q_lag: int = 3,
) -> DataFrame:
    """Percent change of each column over the lag that ``rate`` names, exact or in logs."""
    k = rate_lag(rate, freq, monthly_q_lag)
    w = series_window(keys)

    def change(v: str) -> Column:
        if log:
            return 100 * (log_or_null(F.col(v)) - F.lag(log_or_null(F.col(v)), k).over(w))
        return 100 * (F.try_divide(F.col(v), F.lag(v, k).over(w)) - 1)

    return panel.withColumns({v: change(v) for v in values})


def fill_down(panel: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Carry the last known value forward."""
    w = series_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def extrapolate_anchored(
    panel: DataFrame, keys: Sequence[str], level: str, indicator: str, name: str, aligned: bool = False
) -> DataFrame:
    """Carry sparse levels forward with the rate of change of a dense indicator.

    Rows with a level keep it. From there on the default moves with the indicator's *next* change,
    out(t) = out(t-1) * ind(t+1)/ind(t); it gives 0 before the first level, and sets the last row to the
    mean of the four rows before it. ``aligned`` moves with ind(t)/ind(t-1), gives NULL before the first
    level, and leaves the last row alone. A missing change makes the rest missing up to the next level.

    The recursion is the level times a running product, so no state is carried row by row.
    """
    w = series_window(keys)
    x = F.col(indicator)
    change = F.try_divide(x, F.lag(x).over(w)) if aligned else F.try_divide(F.lead(x).over(w), x)
    up_to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    staged = panel.withColumns(
        {
            "_anchor": F.count(level).over(up_to_here),
            "_base": F.last(level, ignorenulls=True).over(up_to_here),
            "_change": F.when(F.col(level).isNull(), change).otherwise(F.lit(1.0)),
        }
    )
    segment = Window.partitionBy(*keys, "_anchor").orderBy("period_idx")
    segment = segment.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.count(F.when(F.col("_change").isNull(), 1)).over(segment) > 0
    moved = F.when(~broken, F.col("_base") * F.product("_change").over(segment))
    before_first = F.lit(None).cast("double") if aligned else F.lit(0.0)
    staged = staged.withColumn(name, F.when(F.col("_anchor") == 0, before_first).otherwise(moved))
    if not aligned:
        is_last = F.lead("period_idx").over(w).isNull()
        tail = F.avg(name).over(w.rowsBetween(-4, -1))
        whole = F.count(name).over(w.rowsBetween(-4, -1)) == F.count(F.lit(1)).over(w.rowsBetween(-4, -1))
        staged = staged.withColumn(name, F.when(is_last, F.when(whole, tail)).otherwise(F.col(name)))
    return staged.drop("_anchor", "_base", "_change")


def window_bounds(panel: DataFrame, keys: Sequence[str], years: int, freq: int = 12) -> DataFrame:
    """First and last period of every full trailing window of ``years`` years."""
    size = years * freq
    span = panel.groupBy(*keys).agg(F.min("period_idx").alias("low"), F.max("period_idx").alias("high"))
    starts = span.where(F.col("high") - F.col("low") + 1 >= size).select(
        *keys, F.explode(F.sequence("low", F.col("high") - size + 1)).alias("start_idx")
    )
    end = F.col("start_idx") + size - 1
    return starts.select(
        *keys,
        cal.year_of(F.col("start_idx"), freq).alias("start_year"),
        cal.sub_period_of(F.col("start_idx"), freq).alias("start_sub"),
        cal.year_of(end, freq).alias("end_year"),
        cal.sub_period_of(end, freq).alias("end_sub"),
    )


def lag_block(keys: Sequence[str], value: str | Column, first: int, last: int) -> list[Column]:
    """Lags ``first..last`` of a column over one window."""
    w = series_window(keys)
    return [F.lag(value, j).over(w) if j else (F.col(value) if isinstance(value, str) else value) for j in range(first, last + 1)]


def distributed_lags(
    panel: DataFrame, keys: Sequence[str], value: str, first: int, last: int, name: str
) -> DataFrame:
    """Lags ``first..last`` as one array column."""
    return panel.withColumn(name, F.array(*lag_block(keys, value, first, last)))


def seasonal_adjust(
    panel: DataFrame, keys: Sequence[str], values: Sequence[str], freq: int, period: str = "period_idx", method: str = "classical"
) -> DataFrame:
    """Multiplicative decomposition of each entity's series, on a gap-free calendar.

    ``method="filters"`` follows a season that moves (``seasonal.adjust_by_filters``); "classical" has one factor per
    sub-period:

    The trend is the centred 2 x freq moving average; a sub-period's factor is its mean ratio to the trend,
    scaled so that the factors average 1; the result is the value over its factor. A series shorter than two
    cycles, with a gap or with a value that is not positive keeps its raw values. Each column gets a flag
    ``<column>_sa_ok``.
    """
    if method == "filters":
        return adjust_by_filters(panel, keys, values, freq, period)
    if method != "classical":
        raise ValueError(f"method is 'classical' or 'filters', not {method!r}")
    half = freq // 2
    inner = over(keys, period, f"ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING")
    series, entity, cycle = over(keys, period), over(keys, None), over([*keys, "_sub"], None)
    ratios, factors, checks, finals = [], [], [], []
    for v in values:
        x, r, f, m, ok = (ident(n) for n in (v, f"_r_{v}", f"_f_{v}", f"_m_{v}", f"{v}_sa_ok"))
        ends = f"0.5D * lag({x}, {half}) {series} + 0.5D * lead({x}, {half}) {series}"
        ratios.append(f"try_divide({x}, (sum({x}) {inner} + {ends}) / {freq}) AS {r}")
        factors.append(f"avg({r}) {cycle} AS {f}")
        checks.append(
            f"count(*) {entity} >= {2 * freq} AND count({x}) {entity} = count(*) {entity}"
            f" AND coalesce(min({x}) {entity} > 0, false) AS {ok}"
        )
        # Each sub-period counts once: a row is weighted by one over the rows of its sub-period.
        checks.append(f"sum({f} / _n) {entity} / {freq} AS {m}")
        finals.append(f"CASE WHEN {ok} THEN {x} / ({f} / {m}) ELSE {x} END AS {x}")
        finals.append(ok)
    kept = [c for c in panel.columns if c not in values]
    trend = panel.selectExpr("*", f"pmod({ident(period)}, {freq}) AS _sub", *ratios)
    scaled = trend.selectExpr("*", f"count(*) {cycle} AS _n", *factors).selectExpr("*", *checks)
    return scaled.selectExpr(*idents(kept), *finals)


def drop_undefined(panel: DataFrame, column: str) -> DataFrame:
    """Without the rows a difference leaves undefined."""
    return panel.where(F.col(column).isNotNull())
