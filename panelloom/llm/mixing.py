"""Mixing sources to target weights by systematic sampling.

Every source has a weight and a size in words. Targets share the whole size by weight; none exceeds ``most`` times its
source, and what is above goes to the others by weight. A document's expected copies are target / source size. Within
a source, in the order of (size, doc_id), the expected copies are summed up, one random offset is added, and a document
is emitted once for each integer boundary that its stretch crosses. Neighbours in that order have nearly equal sizes,
so a source's words come within about one document of its target, and no document is taken more often than its
expected copies rounded up.

The order runs over range partitions (``operators.ranking.placed``), so a source of any size spreads over many tasks.
Equal rows are counted before the shuffle and share their copies out evenly along their stretch.

NULL texts have size 0, NULL sources are one source, last in the order. An empty table gives an empty result. Columns
of any name may come along: only the result's own columns are built here.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import WORD
from panelloom.operators.ranking import placed

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
OFFSET = random.Random(7).random()


def with_size(docs: DataFrame, name: str = "size", text: str = "text") -> DataFrame:
    return docs.withColumn(name, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from one row per source: ``source, source_size``.

    In the order of most * size / weight the capped sources come first. Behind those, every source gets the same
    multiple of its weight, the level; it is the first one that the next source can bear.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("_place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    held = numbered.withColumn("_weight", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by_bound = Window.orderBy(F.expr("_cap / _weight"), "_place")
    before, rest = by_bound.rowsBetween(Window.unboundedPreceding, -1), by_bound.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    steps = held.select(
        "*",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)).alias("_level"),
        F.row_number().over(by_bound).alias("_step"),
    )
    level = F.min(F.expr("CASE WHEN _level <= _cap / _weight THEN struct(_step, _level) END")).over(everything)
    return steps.select("*", level.alias("_chosen")).selectExpr(
        "source", "source_size", "least(coalesce(_chosen._level, _cap / _weight) * _weight, _cap) AS target"
    )


def planned(docs: DataFrame, weights=WEIGHTS, most: int = MOST, offset: float = OFFSET, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per distinct (source, size, doc_id, *extra) with its number of rows ``n``, its stretch and its source's target.

    ``docs`` has ``source``, ``size`` and ``doc_id``. ``start`` counts the documents before it in its source, ``rate`` is
    the expected copies of each.
    """
    keys = ["source", "size", "doc_id", *extra]
    units = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = placed(units, keys)
    by_part = rows.groupBy("source", "_part").agg(F.sum("n").alias("_rows"), F.sum(F.expr("n * size")).alias("_words"))
    sizes = by_part.groupBy("source").agg(F.sum("_words").alias("source_size"))
    # One row per source and partition of the exchange.
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("source", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    offsets = offsets.join(targets(sizes, weights, most).withColumnRenamed("source", "_s"), F.expr("source <=> _s")).drop("_s")
    offsets = offsets.withColumnsRenamed({"source": "_s", "_part": "_p"})
    within = Window.partitionBy("source", "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    joined = ranked.join(offsets, F.expr("source <=> _s AND _part = _p"))
    return joined.selectExpr(
        *keys, "n", "source_size", "target", "_start + _offset AS start",
        "CASE WHEN source_size > 0 THEN target / source_size ELSE 0D END AS rate", f"{offset!r}D AS offset",
    )


# Boundaries crossed between two places of the order.
def crossed(first: str, last: str) -> str:
    return f"CAST(floor(({last}) * rate + offset) - floor(({first}) * rate + offset) AS BIGINT)"


def copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, offset: float = OFFSET) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``, one row per document of ``docs`` (with ``size``)."""
    spread = planned(docs, weights, most, offset).withColumn("_i", F.explode(F.expr("sequence(start, start + n - 1)")))
    return spread.selectExpr("doc_id", "source", "size", "source_size", "target", f"{crossed('_i', '_i + 1')} AS copies")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, offset: float = OFFSET) -> DataFrame:
    """The documents, each as often as the mix takes it, in the columns of ``docs``."""
    names = docs.columns
    sized = with_size(docs.withColumnsRenamed({c: f"_c{i}" for i, c in enumerate(names)}), "_size", f"_c{names.index('text')}")
    key = {"_source": F.col(f"_c{names.index('source')}"), "_doc": F.col(f"_c{names.index('doc_id')}"), "_row": F.xxhash64(*[f"_c{i}" for i in range(len(names))])}
    keyed = sized.withColumns(key)
    plan = planned(keyed.selectExpr("_source AS source", "_size AS size", "_doc AS doc_id", "_row"), weights, most, offset, ("_row",))
    plan = plan.selectExpr("source AS s", "size AS z", "doc_id AS d", "_row AS r", f"{crossed('start', 'start + n')} AS copies").where("copies > 0")
    # Equal rows meet before the shuffle; the join runs on their partitioning.
    once = keyed.groupBy("_row", "_doc", "_source", "_size").agg(*[F.first(f"_c{i}").alias(f"_c{i}") for i in range(len(names))])
    taken = once.join(plan, F.expr("_row = r AND _doc <=> d AND _source <=> s AND _size = z"))
    return taken.withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
