"""Joins. None carries a broadcast hint.

A dimension is broadcast when Spark finds it below ``spark.sql.autoBroadcastJoinThreshold``, from its
files' size or, at run time, from its shuffle's size. Beyond that the join shuffles both sides, and
adaptive execution splits a partition that one hot key makes too large.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.text import ident, idents, over
from panelloom.operators.reshape import to_wide


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every common column name."""
    common = sorted(set(left.columns) & set(right.columns))
    if not common:
        raise ValueError("the tables have no common column")
    return left.join(right, common, how)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which a missing key matches a missing key; keys are coalesced."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    matches = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on])
    joined = left.join(right, matches, how)
    for k in on:
        joined = joined.withColumn(k, F.coalesce(k, f"_r_{k}"))
    return joined.drop(*[f"_r_{k}" for k in on])


def fold_full(long: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Full outer join of many one-measure tables, given as one long table.

    The rows are those of the join, with one shuffle in place of one per table.
    """
    return to_wide(long, keys, name, value, names)


def complete_periods(
    panel: DataFrame,
    keys: Sequence[str],
    low: int | None = None,
    high: int | None = None,
    period: str = "period_idx",
) -> DataFrame:
    """Give every entity a row for each period, with NULL measures where it had none.

    Each row is expanded up to the row before its successor, so no join with a calendar is needed, and
    the result stays partitioned by entity for the windows that follow. Without bounds the span is the
    entity's own; bounds only ever widen it.
    """
    series, at = over(keys, period), ident(period)
    start = at if low is None else f"if(lag({at}) {series} IS NULL, least({at}, {low}), {at})"
    last = at if high is None else f"greatest({at}, {high})"
    stop = f"coalesce(lead({at}) {series} - 1, {last})"
    measures = [c for c in panel.columns if c not in (*keys, period)]
    ranged = panel.selectExpr("*", f"{start} AS _start", f"{stop} AS _stop")
    ranged = ranged.selectExpr("*", "explode(sequence(_start, _stop)) AS _at")
    return ranged.selectExpr(
        *idents(keys), f"_at AS {at}", *[f"if(_at = {at}, {ident(m)}, NULL) AS {ident(m)}" for m in measures]
    )


def with_parameters(df: DataFrame, **lists: Sequence[object]) -> DataFrame:
    """Each row once per combination of parameter values; the lists are literals, so nothing is joined."""
    for name, values in lists.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df
