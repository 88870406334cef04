"""Panel distributed-lag models and their long-run effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.config import LONG_RUN_CUTOFFS
from panelloom.functions.numbers import stars
from panelloom.functions.text import ident, idents, log_of, over
from panelloom.operators import estimators
from panelloom.operators.estimators import Spec

# Shock variables of the nine models.
MODELS = {
    1: ("pos_dev_temp", "neg_dev_temp", "pos_dev_precip", "neg_dev_precip"),
    2: ("pos_dev_temp", "neg_dev_temp"),
    3: ("pos_dev_precip", "neg_dev_precip"),
    4: ("abs_deviation_temp", "abs_deviation_precip"),
    5: ("abs_deviation_temp",),
    6: ("abs_deviation_precip",),
    7: ("deviation_temp", "deviation_precip"),
    8: ("deviation_temp",),
    9: ("deviation_precip",),
}


def lag_columns(
    panel: DataFrame, keys: Sequence[str], outcomes: Sequence[str], variables: Sequence[str], lags: int
) -> DataFrame:
    """Lags 0..p of the log difference of each outcome and of the difference of each variable.

    Columns ``<name>@<j>``; the panel is gap-free by ``keys``.
    """
    series, ids, names = over(keys), [*idents(keys), "period_idx"], [*outcomes, *variables]
    values = [*[log_of(ident(o)) for o in outcomes], *idents(variables)]
    # One struct per row, so that a lag is one window expression for all columns.
    packed = panel.selectExpr(*ids, f"named_struct({', '.join(f"'{n}', {x}" for n, x in zip(names, values))}) AS _x")
    shifted = packed.selectExpr(*ids, *[f"lag(_x, {j}) {series} AS _x{j}" for j in range(lags + 2)])
    return shifted.selectExpr(
        *ids,
        *[
            f"_x{j}.{ident(n)} - _x{j + 1}.{ident(n)} AS {ident(f'{n}@{j}')}"
            for n in names
            for j in range(lags + 1)
        ],
    )


def difference_panel(
    panel: DataFrame, keys: Sequence[str], outcomes: Sequence[str], variables: Sequence[str]
) -> DataFrame:
    """Log differences of the outcomes and differences of the variables, first rows left out."""
    series, ids = over(keys), [*idents(keys), "period_idx"]
    logs = [log_of(ident(o)) for o in outcomes]
    rows = panel.selectExpr(
        *ids,
        *[f"{x} - lag({x}) {series} AS {ident(o)}" for x, o in zip(logs, outcomes)],
        *[f"{v} - lag({v}) {series} AS {v}" for v in idents(variables)],
        f"lag(period_idx) {series} IS NULL AS _first",
    )
    return rows.where("NOT _first").drop("_first")


def model_specs(
    outcomes: Sequence[str], lags: int, models: Mapping[int, Sequence[str]] = MODELS
) -> list[Spec]:
    """Own lags 1..p and lags 0..p of each of the model's variables."""
    return [
        Spec(
            f"{o}|{m}",
            f"{o}@0",
            (
                *[f"{o}@{j}" for j in range(1, lags + 1)],
                *[f"{v}@{j}" for v in variables for j in range(lags + 1)],
            ),
        )
        for o in outcomes
        for m, variables in models.items()
    ]


def long_run_effects(fits: DataFrame, keys: Sequence[str] = (), full_delta: bool = False) -> DataFrame:
    """Adjustment term and long-run effects of each fit, with delta-method errors.

    With own-lag sum s, phi = 1 - s; the effect of a variable is the sum of its coefficients over phi. Errors
    treat phi as a constant, or with ``full_delta`` as estimated. Terms are picked by exact variable name.
    The sums are array expressions over each fit's coefficient vector and covariance.
    """
    variable = lambda t: F.substring_index(t, "@", 1)
    own = F.substring_index("y", "@", 1)
    # Fixed order of columns in the covariance: row-major, k x k.
    k = F.size("terms")

    def picks(name):
        return F.transform("terms", lambda t: (variable(t) == name).cast("double"))

    def weighted_sum(weights):
        pairs = F.zip_with(weights, "beta", lambda a, b: a * F.coalesce(b, F.lit(0.0)))
        return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)

    def quadratic(a, b):
        cells = F.transform(
            "cov", lambda c, i: c * F.get(a, F.floor(i / k).cast("int")) * F.get(b, F.pmod(i, k))
        )
        return F.aggregate(cells, F.lit(0.0), lambda total, x: total + x)

    base = fits.withColumn("own", own).withColumn("_own", picks(F.col("own")))
    base = base.withColumn("phi", 1 - weighted_sum(F.col("_own")))
    names = F.array_distinct(F.transform("terms", variable))
    rows = base.select("*", F.explode(names).alias("var")).withColumn("_var", picks(F.col("var")))
    theta = F.try_divide(weighted_sum(F.col("_var")), F.col("phi"))
    is_phi = F.col("var") == F.col("own")
    rows = rows.withColumn("lr_coeff", F.when(is_phi, F.col("phi")).otherwise(theta))
    if full_delta:
        gradient = F.zip_with("_var", "_own", lambda v, o: v + o * F.col("lr_coeff"))
        rows = rows.withColumn("_gradient", F.when(is_phi, F.col("_own")).otherwise(gradient))
    else:
        rows = rows.withColumn("_gradient", F.col("_var"))
    size = F.sqrt(quadratic(F.col("_gradient"), F.col("_gradient")))
    se = F.when(is_phi, size).otherwise(F.try_divide(size, F.abs("phi")))
    return rows.select(*keys, "spec_id", "own", "var", is_phi.alias("is_phi"), "lr_coeff", se.alias("se"))


def long_run_table(effects: DataFrame, keys: Sequence[str], years: str = "norm_years") -> DataFrame:
    """t values, stars and the scaled effect 2/(m+1) times the coefficient (none for the adjustment term)."""
    t = F.abs(F.try_divide(F.col("lr_coeff"), F.col("se")))
    parts = F.split("spec_id", r"\|")
    return effects.select(
        *keys,
        F.get(parts, F.lit(0)).alias("y_var"),
        F.get(parts, F.lit(1)).cast("int").alias("model"),
        "var",
        "is_phi",
        "lr_coeff",
        "se",
        t.alias("tval"),
        stars(t, LONG_RUN_CUTOFFS, "").alias("signif"),
        F.when(~F.col("is_phi"), 2.0 / (F.col(years) + 1) * F.col("lr_coeff")).alias("lr_effect"),
    )


def long_run_models(
    panel: DataFrame,
    entity: Sequence[str],
    outcomes: Sequence[str],
    lags: int,
    keys: Sequence[str] = ("norm_years",),
    models: Mapping[int, Sequence[str]] = MODELS,
    max_lag: int | None = None,
) -> DataFrame:
    """All models of all outcomes and norms in one job, as a table of long-run effects."""
    variables = list(dict.fromkeys(v for m in models.values() for v in m))
    wide = lag_columns(panel, [*keys, *entity], outcomes, variables, lags)
    fits = estimators.fit(wide, model_specs(outcomes, lags, models), entity, keys, max_lag)
    return long_run_table(long_run_effects(fits, keys), keys)
