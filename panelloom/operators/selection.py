"""Column choice, filters, row choice and order."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.text import ident


def names_like(
    df: DataFrame, *, prefix: str = "", suffix: str = "", regex: str = "", exclude: Sequence[str] = ()
) -> list[str]:
    """Columns whose name has the prefix and suffix and contains the pattern."""
    return [
        c
        for c in df.columns
        if c.startswith(prefix) and c.endswith(suffix) and re.search(regex, c) and c not in exclude
    ]


def any_of(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that exist."""
    return [c for c in names if c in df.columns]


def all_of(df: DataFrame, names: Sequence[str]) -> list[str]:
    """``names``, all of which must exist."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return list(names)


def drop_unless(df: DataFrame, keep: bool, names: Sequence[str]) -> DataFrame:
    """Drop the optional columns of a definition that is switched off."""
    return df if keep else df.drop(*any_of(df, names))


def rename_all(df: DataFrame, rule) -> DataFrame:
    """Rename every column by a function of its name."""
    return df.toDF(*[rule(c) for c in df.columns])


def move_first(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names, *[c for c in df.columns if c not in names])


def in_range(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """Closed range. Apply it before rolling up: a range that cuts a quarter leaves part of it."""
    return df.where(F.col(column).between(low, high))


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with neither NULL nor NaN in the columns.

    Plain conditions, unlike ``dropna``, reach the scan and turn an outer join below into an inner one.
    """
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}
    tests = [
        f"{ident(c)} IS NOT NULL" + (f" AND NOT isnan({ident(c)})" if c in floats else "") for c in columns or df.columns
    ]
    return df.where(" AND ".join(tests))


def exclude_pairs(df: DataFrame, rules: DataFrame, on: Sequence[str]) -> DataFrame:
    """Drop the rows that match a rule table on all of ``on``."""
    return df.join(rules.select(*on).distinct(), list(on), "left_anti")


def distinct_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    return df.distinct() if keys is None else df.select(*keys).distinct()


def _numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group; Spark cuts each map output to ``n`` rows per group before the shuffle."""
    return _numbered(df, keys, order, "_n").where(F.col("_n") <= n).drop("_n")


def drop_first_rows(panel: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """All but the first ``n`` rows of each group of a panel."""
    return _numbered(panel, keys, order, "_n").where(F.col("_n") > n).drop("_n")


def drop_total(df: DataFrame, flag: str = "is_total") -> DataFrame:
    """Without the pseudo-entity that stands for all entities together."""
    return df.where(~F.col(flag))


def with_level(df: DataFrame, level: str, levels: Sequence[str]) -> DataFrame:
    """Make one of several grouping columns the group key, and drop the others."""
    if level not in levels:
        raise ValueError(f"level must be one of {list(levels)}")
    return df.withColumn("group", F.col(level).cast("string")).drop(*levels)


def with_all_levels(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Each row once per grouping column, to total over every level in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("group")) for c in levels])
    kept = [c for c in df.columns if c not in levels]
    return df.select(*kept, F.inline(pairs))


def with_sort_key(df: DataFrame, column: str, order: Sequence[str], name: str = "sort_key") -> DataFrame:
    """Place of a label in an explicit order; labels outside it come last."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return df.withColumn(name, F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))
