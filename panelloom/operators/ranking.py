"""Places in a global order, without one task that sees it all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.text import idents
from panelloom.session import ensure_checkpoint_dir


def placed(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partition by ``order`` and mark each row with its partition and its place in it, ``_part``, ``_pos``.

    The rows are written once by ``checkpoint``: what is computed from them twice sees the same partitions, even
    when an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = ranged.withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    return marked.selectExpr(*idents(df.columns), "shiftright(_at, 33) AS _part", "_at & 8589934591 AS _pos")


def group_id(df: DataFrame, key: str, name: str = "group_id") -> DataFrame:
    """Number the groups 1, 2, ... in key order: place in the partition plus the size of those before it."""
    keys = placed(df.select(key).where(F.col(key).isNotNull()).distinct(), [key])
    # One row per partition of the exchange, whatever the number of keys.
    sizes = keys.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    ids = keys.join(offsets, "_part").select(key, (F.col("_offset") + F.col("_pos") + 1).alias(name))
    return df.join(ids, key, "left")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row") -> DataFrame:
    """Number the rows 1, 2, ... in each group in the given order; a group of any size spreads over many tasks."""
    rows = placed(df, [*[F.col(k) for k in keys], *order])
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_pos").alias("_first"))
    # One row per group and partition of the exchange.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    met = rows.alias("r").join(offsets.alias("o"), reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*keys, "_part"]]))
    return met.selectExpr(*[f"r.{c}" for c in idents(df.columns)], f"CAST(_pos - _first + _offset + 1 AS INT) AS {idents([name])[0]}")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of groups of any size, as ``(keys, probability, quantile)``.

    Equal values are counted first, so a heavy value is one row. The distinct values are range-partitioned by
    group and value, counted up within each partition and offset by the partitions before; only the rows that
    hold a wanted rank go on. A group spreads over as many tasks as its values need.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    rows = placed(counts, [*keys, value])
    sizes = rows.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    # One row per group and partition of the exchange.
    w = Window.partitionBy(*keys)
    before = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"), F.sum("_size").over(w).alias("_total")
    )
    within = Window.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.select(*keys, "_part", value, "_n", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_start"))
    ranked = ranked.join(offsets, [*keys, "_part"]).withColumn("_start", F.col("_start") + F.col("_offset"))
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    spots = ranked.select(*keys, value, "_n", "_start", "_total", F.explode(wanted).alias("probability"))
    spots = spots.selectExpr("*", "probability * (_total - 1) AS _h")
    holds = "_start <= {0} AND {0} < _start + _n"
    spots = spots.where(f"({holds.format('floor(_h)')}) OR ({holds.format('ceil(_h)')})")
    ends = spots.groupBy(*keys, "probability").agg(
        F.expr(f"min(`{value}`) AS _low"), F.expr(f"max(`{value}`) AS _high"), F.expr("min(_h - floor(_h)) AS _part_way")
    )
    return ends.selectExpr(*idents(keys), "probability", "_low + _part_way * (_high - _low) AS quantile")
