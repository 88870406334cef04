"""Local projections: responses of outcomes to shocks, by horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.config import PROJECTION_CUTOFFS, critical_value
from panelloom.functions.numbers import log_or_null, stars
from panelloom.functions.text import ident, idents, log_of, over
from panelloom.operators import estimators
from panelloom.operators.estimators import Spec
from panelloom.operators.windows import series_window


def projection_columns(
    panel: DataFrame, keys: Sequence[str], outcomes: Sequence[str], shocks: Sequence[str], horizon: int
) -> DataFrame:
    """Everything the projections use, once per row of a gap-free panel.

    Per outcome ``y_<o>_<h>`` = log o(t+h) - log o(t-1) and ``l_<o>_<j>`` = lag j of its log difference; per
    shock ``d_<s>``, its first difference. One window gives all of them; the horizons share the lags.
    """
    series, ids = over(keys), [*idents(keys), "period_idx"]
    logs = ", ".join(f"'{o}', {log_of(ident(o))}" for o in outcomes)
    levels = ", ".join(f"'{s}', {ident(s)}" for s in shocks)
    # One struct per row, so that a shift is one window expression for all outcomes.
    packed = panel.selectExpr(*ids, f"named_struct({logs}) AS _o", f"named_struct({levels}) AS _s")
    shifted = packed.selectExpr(
        *ids, "_s", f"lag(_s) {series} AS _s1",
        *[f"lag(_o, {j}) {series} AS _o{j + horizon}" for j in range(-horizon, horizon + 2)],
    )
    at = lambda o, j: f"_o{j + horizon}.{ident(o)}"
    return shifted.selectExpr(
        *ids,
        *[f"_s.{ident(s)} - _s1.{ident(s)} AS {ident(f'd_{s}')}" for s in shocks],
        *[f"{at(o, -h)} - {at(o, 1)} AS {ident(f'y_{o}_{h}')}" for o in outcomes for h in range(horizon + 1)],
        *[f"{at(o, j)} - {at(o, j + 1)} AS {ident(f'l_{o}_{j}')}" for o in outcomes for j in range(1, horizon + 1)],
    )


def projection_specs(outcomes: Sequence[str], shocks: Sequence[str], horizon: int) -> list[Spec]:
    """One specification per shock, outcome and horizon."""
    return [
        Spec(f"{s}|{o}|{h}", f"y_{o}_{h}", (f"d_{s}", *[f"l_{o}_{j}" for j in range(1, horizon + 1)]))
        for s in shocks
        for o in outcomes
        for h in range(horizon + 1)
    ]


def projection_dataset(
    panel: DataFrame, keys: Sequence[str], shock: str, outcome: str, horizon: int
) -> DataFrame:
    """Rows ``(keys, period_idx, horizon, y, d_log_outcome, d_shock, lags)`` of one projection, complete cases."""
    w = series_window(keys)
    logs = panel.select(*keys, "period_idx", F.col(shock).alias("_s"), log_or_null(F.col(outcome)).alias("_o"))
    lag = lambda j: F.lag("_o", j).over(w)
    rows = logs.select(
        *keys,
        "period_idx",
        (F.col("_s") - F.lag("_s").over(w)).alias("d_shock"),
        (F.col("_o") - lag(1)).alias("d_log_outcome"),
        F.array(*[lag(j) - lag(j + 1) for j in range(1, horizon + 1)]).alias("lags"),
        F.array(*[lag(-h) - lag(1) for h in range(horizon + 1)]).alias("_y"),
    )
    long = rows.select(
        *keys, "period_idx", F.posexplode("_y").alias("horizon", "y"), "d_log_outcome", "d_shock", "lags"
    )
    whole = ~F.exists("lags", lambda x: x.isNull())
    return long.where(F.col("y").isNotNull() & F.col("d_shock").isNotNull() & whole)


def project(
    panel: DataFrame,
    entity: Sequence[str],
    outcomes: Sequence[str],
    shocks: Sequence[str],
    horizon: int,
    keys: Sequence[str] = (),
    max_lag: int | None = None,
    small_sample: bool = True,
) -> DataFrame:
    """Response of every outcome to every shock at every horizon, all fits in one job.

    The panel is gap-free by (keys, entity). A shock that its lags span has estimate 0 and error 0; a
    fit that leaves no residual has neither.
    """
    wide = projection_columns(panel, [*keys, *entity], outcomes, shocks, horizon)
    specs = projection_specs(outcomes, shocks, horizon)
    fits = estimators.fit(wide, specs, entity, keys, max_lag, small_sample)
    parts = F.split("spec_id", r"\|")
    first = lambda c: F.get(c, F.lit(0))
    return fits.select(
        *keys,
        F.get(parts, F.lit(0)).alias("shock"),
        F.get(parts, F.lit(1)).alias("outcome"),
        F.get(parts, F.lit(2)).cast("int").alias("horizon"),
        F.when(F.col("beta").isNotNull(), F.coalesce(first("beta"), F.lit(0.0))).alias("estimate"),
        F.sqrt(first("cov")).alias("se"),
        "r2",
        F.col("n_obs").alias("nt"),
    )


def response_table(responses: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Responses in percent with confidence bounds and stars."""
    z = critical_value(alpha)
    scaled = responses.withColumns({"estimate": F.col("estimate") * 100, "se": F.col("se") * 100})
    t = F.try_divide(F.col("estimate"), F.col("se"))
    return scaled.withColumns(
        {
            "ci_low": F.col("estimate") - z * F.col("se"),
            "ci_up": F.col("estimate") + z * F.col("se"),
            "t_cval": F.lit(z),
            "signif": stars(t, PROJECTION_CUTOFFS),
        }
    )
