"""Window operators on series of any length, as scans over blocks of periods.

``windows`` puts an entity into one task. Here a series is cut into blocks of ``size`` periods, and a task holds a block:

1. each block is scanned on its own, in one window partition per (entity, block);
2. its state at the end (sums, counts, the last known value, a running product with its reset) is one summary row;
3. a scan over the summaries of an entity, one row per block, gives the state before each block;
4. that carry meets the rows by (entity, block), which is the partitioning they have, so they are shuffled once.

Lags take halo rows instead: a row is copied to the neighbouring blocks that look back or ahead to it. The operators give
the rows of their namesakes in ``windows``; products and sums may differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions.text import ident, idents

# Entity and block in one struct: NULL entities meet in joins like others, and windows and joins share a partitioning.
BLOCK = "_at"


def in_blocks(panel: DataFrame, keys: Sequence[str], size: int, period: str = "period_idx") -> DataFrame:
    fields = "".join(f"{k}, " for k in idents(keys))
    return panel.withColumn(BLOCK, F.expr(f"struct({fields}CAST(floor({ident(period)} / {size}) AS BIGINT) AS _block)"))


def _rows_so_far(order: Sequence[str]) -> Window:
    return Window.partitionBy(BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _series(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"{BLOCK}.{ident(k)}") for k in keys]


def _before(keys: Sequence[str]) -> Window:
    """The blocks of a series before this one; a window holds one row per block."""
    return Window.partitionBy(*_series(keys)).orderBy(F.col(f"{BLOCK}._block")).rowsBetween(Window.unboundedPreceding, -1)


def lag_lead(panel: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int], size: int) -> DataFrame:
    """``windows.lag_lead`` on a gap-free calendar: a row goes to every block that a lag or a lead reaches it from."""
    back, ahead = max([*lags, 0]), max([*(-k for k in lags), 0])
    own = f"floor(period_idx / {size})"
    reach = f"sequence(CAST(floor((period_idx - {ahead}) / {size}) AS BIGINT), CAST(floor((period_idx + {back}) / {size}) AS BIGINT))"
    fields = "".join(f"{k}, " for k in idents(keys))
    copies = panel.selectExpr("*", f"explode({reach}) AS _to").selectExpr(*idents(panel.columns), f"struct({fields}_to AS _block) AS {BLOCK}", f"_to = {own} AS _own")
    w = Window.partitionBy(BLOCK).orderBy("period_idx")
    shifted = {f"{value}_{'lag' if k >= 0 else 'lead'}{abs(k)}": F.lag(value, k).over(w) for k in lags}
    return copies.withColumns(shifted).where("_own").drop("_own", BLOCK)


def fill_down(panel: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int) -> DataFrame:
    """``windows.fill_down``: the last known value of the block, or else of the blocks before it."""
    filled = _filled(in_blocks(panel, keys, size), keys, columns, ["period_idx"])
    return filled.select(*panel.columns)


def _filled(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` (in blocks) with the last value known up to each row in the columns."""
    so_far = _rows_so_far(order)
    local = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})
    ends = rows.groupBy(BLOCK).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_{i}") for i, c in enumerate(columns)])
    carry = ends.select(F.col(BLOCK), *[F.last(f"_{i}", ignorenulls=True).over(_before(keys)).alias(f"_carry{i}") for i in range(len(columns))])
    met = local.join(carry, BLOCK)
    return met.withColumns({c: F.coalesce(c, f"_carry{i}") for i, c in enumerate(columns)}).drop(*[f"_carry{i}" for i in range(len(columns))])


def running_sums(panel: DataFrame, keys: Sequence[str], values: Sequence[str], size: int) -> DataFrame:
    """``panel`` with ``_first``, the first period of the series, and per value ``_base_<v>``, the first known one, and
    ``_sum_<v>`` and ``_n_<v>``: the sum of deviations from it and their number, up to and including the row."""
    known = {v: f"CASE WHEN NOT isnan({ident(v)}) THEN {ident(v)} END" for v in values}
    rows = in_blocks(panel, keys, size)
    so_far = _rows_so_far(["period_idx"])
    # Deviations from the block's first value stay small, and are 0 in a constant series.
    based = rows.withColumns({f"_base_{v}": F.first(F.expr(x), ignorenulls=True).over(so_far) for v, x in known.items()})
    inside = based.withColumns(
        {f"_sum_{v}": F.sum(F.expr(f"{x} - {ident(f'_base_{v}')}")).over(so_far) for v, x in known.items()}
        | {f"_n_{v}": F.count(F.expr(x)).over(so_far) for v, x in known.items()}
    )
    kinds = ("_base_", "_sum_", "_n_")
    last = F.max_by(F.struct(*[F.col(f"{k}{v}") for v in values for k in kinds]), "period_idx")
    ends = inside.groupBy(BLOCK).agg(F.min("period_idx").alias("_from"), last.alias("_end")).select(BLOCK, "_from", "_end.*")
    whole = Window.partitionBy(*_series(keys)).orderBy(F.col(f"{BLOCK}._block"))
    series = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = ends.withColumns({"_first": F.min("_from").over(series)} | {f"_all_{v}": F.first(f"_base_{v}", ignorenulls=True).over(series) for v in values})
    moved = {f"_sum_{v}": F.expr(f"{ident(f'_sum_{v}')} + {ident(f'_n_{v}')} * ({ident(f'_base_{v}')} - {ident(f'_all_{v}')})") for v in values}
    carried = started.withColumns(moved).select(
        BLOCK, "_first", *[f"_all_{v}" for v in values],
        *[F.coalesce(F.sum(f"_{k}_{v}").over(_before(keys)), F.lit(0)).alias(f"_carry_{k}_{v}") for v in values for k in ("sum", "n")],
    )
    met = inside.join(carried, BLOCK)
    totals = {}
    for v in values:
        base, every, part, n, sum_before, n_before = (ident(f"{k}_{v}") for k in ("_base", "_all", "_sum", "_n", "_carry_sum", "_carry_n"))
        totals[f"_sum_{v}"] = F.expr(f"{sum_before} + coalesce({part} + {n} * ({base} - {every}), 0)")
        totals[f"_n_{v}"] = F.expr(f"{n_before} + {n}")
        totals[f"_base_{v}"] = F.expr(every)
    return met.withColumns(totals).select(*panel.columns, "_first", *[f"{k}{v}" for v in values for k in kinds])


def trailing_norms(
    panel: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    years: Sequence[int],
    size: int,
    freq: int = 12,
    exclude_current: bool = False,
) -> DataFrame:
    """``windows.trailing_norms``: differences of running sums of the whole series.

    The sums as they stood a window's length ago come as rows of their own, dated that much later, and the last of them
    up to a row is its subtrahend. So a window may span any number of blocks, and the calendar may have gaps.
    """
    late = 1 if exclude_current else 0
    summed = running_sums(panel, keys, values, size)
    state = F.struct(*[F.col(f"{k}{v}") for v in values for k in ("_sum_", "_n_")])
    backs = {f"_ago_{m}": m * freq + late for m in years} | ({"_ago_0": late} if late else {})
    kind = summed.select(state.alias("s")).schema["s"].dataType.simpleString()
    rows = summed.withColumns({name: F.lit(None).cast(kind) for name in backs} | {"_row": F.lit(True)})
    for name, back in backs.items():
        others = {n: F.lit(None).cast(kind) for n in backs if n != name} | {name: state}
        dated = summed.withColumns(others).withColumns({"period_idx": (F.col("period_idx") + back).cast(summed.schema["period_idx"].dataType), "_row": F.lit(False)})
        rows = rows.unionByName(dated)
    # An earlier state of the same date comes first.
    filled = _filled(in_blocks(rows, keys, size), keys, list(backs), ["period_idx", "_row"]).where("_row")
    norms = []
    for m in years:
        for v in values:
            now = ("coalesce(_ago_0.{0}, 0)" if late else "{0}").format
            total = f"({now(ident(f'_sum_{v}'))} - coalesce(_ago_{m}.{ident(f'_sum_{v}')}, 0))"
            count = f"({now(ident(f'_n_{v}'))} - coalesce(_ago_{m}.{ident(f'_n_{v}')}, 0))"
            mean = f"{ident(f'_base_{v}')} + {total} / nullif({count}, 0)"
            norms.append(f"CASE WHEN period_idx - _first >= {m * freq - 1 + late} THEN {mean} END AS {ident(f'norm_{m}_{v}')}")
    return filled.selectExpr(*idents(panel.columns), *norms)


def extrapolate_anchored(panel: DataFrame, keys: Sequence[str], level: str, indicator: str, name: str, size: int, aligned: bool = False) -> DataFrame:
    """``windows.extrapolate_anchored``: a running product that each known level resets.

    A block's state is the product after its last level (or over all of it), whether a change was missing there, and
    that level. The scan over blocks multiplies these back to the last block with a level.
    """
    beside = lag_lead(panel, keys, indicator, [1, -1], size)
    lag, lead, x = ident(f"{indicator}_lag1"), ident(f"{indicator}_lead1"), ident(indicator)
    change = f"try_divide({x}, {lag})" if aligned else f"try_divide({lead}, {x})"
    rows = in_blocks(beside, keys, size).withColumn("_change", F.expr(f"CASE WHEN {ident(level)} IS NULL THEN {change} ELSE 1D END"))
    so_far = _rows_so_far(["period_idx"])
    held = rows.withColumns({"_anchor": F.count(level).over(so_far), "_base": F.last(level, ignorenulls=True).over(so_far)})
    segment = Window.partitionBy(BLOCK, "_anchor").orderBy("period_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = held.withColumns({"_product": F.product("_change").over(segment), "_broken": F.count(F.when(F.col("_change").isNull(), 1)).over(segment) > 0})
    end = F.max_by(F.struct("_anchor", "_base", "_product", "_broken"), "period_idx")
    ends = inside.groupBy(BLOCK).agg(end.alias("_end")).select(BLOCK, "_end.*")
    # Over blocks: those up to the next one with a level share their anchor.
    series = Window.partitionBy(*_series(keys)).orderBy(F.col(f"{BLOCK}._block"))
    upto = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    staged = ends.withColumns({"_run": F.count(F.when(F.col("_anchor") > 0, 1)).over(upto), "_level": F.last("_base", ignorenulls=True).over(upto)})
    run = Window.partitionBy(*_series(keys), "_run").orderBy(F.col(f"{BLOCK}._block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = staged.withColumns({"_moved": F.product("_product").over(run), "_lost": F.max("_broken").over(run)})
    carry = after.select(BLOCK, *[F.lag(c).over(series).alias(f"_in{c}") for c in ("_run", "_level", "_moved", "_lost")])
    before_first = "CAST(NULL AS DOUBLE)" if aligned else "0D"
    carried = f"CASE WHEN coalesce(_in_run, 0) = 0 THEN {before_first} WHEN NOT (_in_lost OR _broken) THEN _in_level * (_in_moved * _product) END"
    value = f"CASE WHEN _anchor > 0 THEN CASE WHEN NOT _broken THEN _base * _product END ELSE {carried} END"
    found = inside.join(carry, BLOCK).withColumn(name, F.expr(value))
    kept = [*panel.columns, *([name] if name not in panel.columns else [])]
    if aligned:
        return found.select(*kept)
    # The last row of a series is the mean of the four before it, which may lie in the block before.
    last = Window.partitionBy(BLOCK).orderBy(F.col("period_idx").desc())
    ended = found.withColumn("_back", F.row_number().over(last)).where("_back <= 5").select(BLOCK, "period_idx", name)
    tail = Window.partitionBy(*_series(keys)).orderBy(F.col("period_idx").desc())
    five = ended.withColumn("_back", F.row_number().over(tail)).where("_back <= 5")
    means = five.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(_series(keys))]).agg(
        F.max_by(BLOCK, "period_idx").alias("_last"), F.max("period_idx").alias("_period"),
        F.expr(f"CASE WHEN count_if(_back > 1 AND {ident(name)} IS NULL) = 0 THEN avg({ident(name)}) FILTER (WHERE _back > 1) END").alias("_mean"),
    ).select("_last", "_period", "_mean")
    met = found.drop("_mean", "_last").join(means, F.col(BLOCK) == F.col("_last"), "left")
    return met.withColumn(name, F.expr(f"CASE WHEN period_idx <=> _period THEN _mean ELSE {ident(name)} END")).select(*kept)
