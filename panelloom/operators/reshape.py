"""Long and wide forms, split cells, label layouts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.operators.ranking import numbered


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, columns: Sequence[object]
) -> DataFrame:
    """One column per listed value. The list is required: without it Spark runs a job to find the values.

    Two values for one cell are an error.
    """
    return df.groupBy(*ids).pivot(name, list(columns)).agg(only(value).alias(value))


def only(value: str) -> Column:
    """The group's one value that is not NULL; an error where it has several."""
    several = F.raise_error(F.lit(f"more than one value of {value} for one cell"))
    return F.when(F.count(value) > 1, several).otherwise(F.first(value, ignorenulls=True))


def split_column(
    df: DataFrame, column: str, into: Sequence[str], pattern: str, merge_rest: bool = False
) -> DataFrame:
    """Split one column into several; ``merge_rest`` leaves all further separators in the last."""
    parts = F.split(column, pattern, len(into) if merge_rest else -1)
    return df.select(
        *[c for c in df.columns if c != column],
        *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(into)],
    )


def split_rows(df: DataFrame, column: str, pattern: str = r",\s*") -> DataFrame:
    """One row per item of a list cell, trimmed; empty items are dropped."""
    kept = [c for c in df.columns if c != column]
    items = df.select(*kept, F.explode(F.split(column, pattern)).alias(column))
    return items.withColumn(column, F.trim(column)).where(F.col(column) != "")


def stack_tables(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Tables of one schema into one, with the table's name as a column."""
    keyed = [df.withColumn(key, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), keyed)


def bind_columns(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Put the columns of two aligned tables side by side, by key."""
    return left.join(right, list(on))


def tidy_vectors(df: DataFrame, keys: Sequence[str], vectors: Sequence[str]) -> DataFrame:
    """Parallel array columns to one row per position."""
    zipped = F.arrays_zip(*[F.col(v) for v in vectors])
    return df.select(*keys, F.posexplode(zipped).alias("pos", "_z")).select(
        *keys, "pos", *[F.col(f"_z.{v}").alias(v) for v in vectors]
    )


def interleave(
    df: DataFrame, keys: Sequence[str], upper: str, lower: str, label: str, order: Sequence[Column]
) -> DataFrame:
    """Two rows per row, ``upper`` over ``lower``; the label is shown on the upper one only.

    ``row`` numbers the lines within each group of ``keys``.
    """
    lines = F.array(
        F.struct(F.lit(1).alias("line"), F.lit(upper).alias("stat"), F.col(upper).alias("cell")),
        F.struct(F.lit(2).alias("line"), F.lit(lower).alias("stat"), F.col(lower).alias("cell")),
    )
    kept = [c for c in df.columns if c not in (upper, lower)]
    long = df.select(*kept, F.inline(lines))
    rows = numbered(long, keys, [*order, F.col("line")])
    return rows.withColumn(label, F.when(F.col("row") % 2 == 1, F.col(label))).drop("line")


def label_first_row(
    df: DataFrame, keys: Sequence[str], label: str, order: Sequence[Column]
) -> DataFrame:
    """Show the label on the first row of each group only; ``row`` numbers the group's rows."""
    return numbered(df, keys, order).withColumn(label, F.when(F.col("row") == 1, F.col(label)))
