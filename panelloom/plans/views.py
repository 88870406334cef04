"""Result tables: layouts of estimates, without any drawing or file format."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.functions.numbers import fixed_decimals, in_parentheses
from panelloom.operators import aggregate, reshape, selection


def summary_table(
    panel: DataFrame,
    variables: Mapping[str, tuple[str, int]],
    region: str = "region",
    total: str = "national",
) -> DataFrame:
    """Mean, deviation and quartiles by variable and region, as text, the national row first.

    ``variables`` maps a column to its title and decimals, in table order.
    """
    long = reshape.to_long(panel.select(region, *variables), [region], list(variables), "var", "x")
    stats = aggregate.describe_by(long, ["var", region], "x")
    stats = selection.with_sort_key(stats, "var", list(variables), "var_order")
    places = F.col("var").isin([v for v, (_, digits) in variables.items() if digits == 2])
    shown = {
        c: F.when(places, fixed_decimals(F.col(c), 2)).otherwise(fixed_decimals(F.col(c), 4))
        for c in ("mean", "stdv", "p25", "p50", "p75")
    }
    titles = F.create_map(*[F.lit(x) for v, (title, _) in variables.items() for x in (v, title)])
    table = stats.withColumns(shown).withColumn("title", titles[F.col("var")])
    order = [F.col(region) != total, F.col(region)]
    return reshape.label_first_row(table, ["var_order"], "title", order).select(
        "var_order", "row", "title", region, "mean", "stdv", "p25", "p50", "p75"
    )


def response_layout(
    responses: DataFrame, keys: Sequence[str], horizon: int, shocks: Sequence[str]
) -> DataFrame:
    """``est stars`` over ``(se)``, one column per horizon, for the listed shocks.

    ``keys`` come before shock and outcome. ``part`` separates price and output outcomes, ``family`` the
    anomaly shocks from the season indicators. ``row`` numbers the lines of one (keys, part, shock) table.
    """
    cells = responses.where(F.col("shock").isin(list(shocks))).select(
        *keys,
        "shock",
        "outcome",
        "horizon",
        F.concat_ws(" ", fixed_decimals(F.col("estimate"), 2), F.col("signif")).alias("cell"),
        in_parentheses(fixed_decimals(F.col("se"), 3)).alias("error"),
    )
    ids = [*keys, "shock", "outcome"]
    columns = list(range(horizon + 1))
    # Both lines of every horizon in one pivot.
    wide = cells.groupBy(*ids).pivot("horizon", columns).agg(
        reshape.only("cell").alias("cell"), reshape.only("error").alias("error")
    )
    lines = F.array(
        F.struct(F.lit(1).alias("line"), *[F.col(f"{h}_cell").alias(f"h{h}") for h in columns]),
        F.struct(F.lit(2).alias("line"), *[F.col(f"{h}_error").alias(f"h{h}") for h in columns]),
    )
    long = wide.select(*ids, F.inline(lines)).withColumns(
        {"part": part_of(F.col("outcome")), "family": family_of(F.col("shock")), "label": F.col("outcome")}
    )
    # An outcome's two lines need no numbering.
    table = long.withColumn("label", F.when(F.col("line") == 1, F.col("label")))
    return table.select(
        *keys, "family", "part", "shock", "outcome", "line", "label", *[f"h{h}" for h in columns]
    )


def part_of(outcome: Column) -> Column:
    return F.when(outcome.startswith("gdp"), "output").otherwise("prices")


def family_of(shock: Column) -> Column:
    """Anomalies (``dev``) apart from extreme-season indicators (``ext``)."""
    return F.when(shock.contains("dev"), "dev").otherwise("ext")


def long_run_comparison(
    table: DataFrame, models: Sequence[int], years: Sequence[int], total: str
) -> DataFrame:
    """Models and norms side by side: a column per (model, norm), estimate over error, total apart from sectors."""
    cells = table.where(F.col("model").isin(list(models))).select(
        "y_var",
        F.when(F.col("is_phi"), "phi").otherwise(F.col("var")).alias("var"),
        F.concat(F.lit("m"), F.col("model"), F.lit("_n"), F.col("norm_years")).alias("column"),
        F.trim(F.concat_ws(" ", fixed_decimals(F.col("lr_coeff"), 3), F.col("signif"))).alias("estimate"),
        in_parentheses(fixed_decimals(F.col("se"), 3)).alias("error"),
    )
    names = [f"m{m}_n{n}" for m in models for n in years]
    wide = cells.groupBy("y_var", "var").pivot("column", names).agg(
        reshape.only("estimate").alias("estimate"), reshape.only("error").alias("error")
    )
    lines = F.array(
        F.struct(F.lit(1).alias("line"), *[F.col(f"{n}_estimate").alias(n) for n in names]),
        F.struct(F.lit(2).alias("line"), *[F.col(f"{n}_error").alias(n) for n in names]),
    )
    return wide.select("y_var", "var", F.inline(lines)).select(
        F.when(F.col("y_var") == total, "total").otherwise("sector").alias("part"), "y_var", "var", "line", *names
    )


def series_frame(frame: DataFrame, columns: Sequence[str], region: str = "region", total: str = "national") -> DataFrame:
    """Series by region with the national one marked and placed first."""
    return frame.select(
        region, "period_idx", *columns,
        (F.col(region) == total).alias("is_total"),
        F.when(F.col(region) == total, 0).otherwise(1).alias("sort_key"),
    )


def response_frame(responses: DataFrame, years: int) -> DataFrame:
    """Horizon, estimate and bounds of one norm, the frame behind a response figure."""
    return responses.where(F.col("norm_years") == years).select(
        "shock", "outcome", "horizon", "estimate", "ci_low", "ci_up"
    )
