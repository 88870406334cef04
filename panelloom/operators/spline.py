"""Quarter to month interpolation by a cubic spline."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.text import ident


def _end_cubic(x: np.ndarray, y: np.ndarray) -> float:
    """Third divided difference of four knots; 0 with fewer, which leaves a parabola or a line."""
    slopes = y
    for k in (1, 2, 3):
        slopes = np.diff(slopes) / (x[k:] - x[:-k])
    return float(slopes[0]) if len(x) == 4 else 0.0


def _bends(x: np.ndarray, y: np.ndarray, ends: str) -> np.ndarray:
    """Second derivatives at the knots: forward elimination of the tridiagonal system, then back.

    Natural ends have none. Cubic ends take the third derivative of the cubic through the first four knots, and through
    the last four, so the outer unknown is its neighbour less or plus a known number and leaves the system.
    """
    n = len(x)
    bend = np.zeros(n)
    if n < 3:
        return bend
    step = np.diff(x)
    right = 6 * np.diff(np.diff(y) / step)
    pivots = 2 * (step[:-1] + step[1:])
    if ends == "cubic":
        first, last = 6 * step[0] * _end_cubic(x[:4], y[:4]), 6 * step[-1] * _end_cubic(x[-4:], y[-4:])
        pivots[0] += step[0]
        pivots[-1] += step[-1]
        right[0] += step[0] * first
        right[-1] -= step[-1] * last
    ratio, value = [0.0] * (n - 2), [0.0] * (n - 2)
    for i in range(n - 2):
        pivot = pivots[i] - (step[i] * ratio[i - 1] if i else 0.0)
        ratio[i] = step[i + 1] / pivot
        value[i] = (right[i] - (step[i] * value[i - 1] if i else 0.0)) / pivot
    for i in range(n - 3, -1, -1):
        bend[i + 1] = value[i] - ratio[i] * bend[i + 2]
    if ends == "cubic":
        bend[0], bend[-1] = bend[1] - first, bend[-2] + last
    return bend


def _spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, ends: str) -> np.ndarray:
    """Values at ``at`` of the cubic spline through (x, y), continued by its end cubics."""
    n = len(x)
    if n == 1:
        return np.full(len(at), y[0])
    step, bend = np.diff(x), _bends(x, y, ends)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    left, right, h = at - x[i], x[i + 1] - at, step[i]
    cubic = (bend[i] * right**3 + bend[i + 1] * left**3) / (6 * h)
    return cubic + (y[i] / h - bend[i] * h / 6) * right + (y[i + 1] / h - bend[i + 1] * h / 6) * left


def spline_to_months(
    panel: DataFrame, keys: Sequence[str], value: str, name: str, placed_at: int = 1, ends: str = "natural"
) -> DataFrame:
    """Quarterly values to the three months of each quarter.

    The quarter's value stands at its month number ``placed_at`` (0, 1, 2; the middle month by default) and
    the others are interpolated. Months run from the first quarter's first to the last quarter's last. A group
    is one entity's series, one row per quarter; the series are packed and interpolated in batches.

    ``ends``: "natural" has no second derivative at the outer knots; "cubic" takes the third derivative there from the
    cubic through the four outer knots, which gives any cubic back (a parabola from three knots, a line from two).
    """
    if ends not in ("natural", "cubic"):
        raise ValueError(f"ends is 'natural' or 'cubic', not {ends!r}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.select(*keys).schema.fields)
    row = F.expr(f"named_struct('p', period_idx, 'v', CAST({ident(value)} AS DOUBLE))")
    # One list per entity, at most one item per quarter of the calendar.
    packed = panel.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("series"))

    def interpolate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series = batch.column(batch.num_columns - 1)
            lengths = series.value_lengths().to_numpy(zero_copy_only=False)
            quarters = series.flatten().field("p").to_numpy(zero_copy_only=False)
            values = series.flatten().field("v").to_numpy(zero_copy_only=False).astype(float)
            stops = np.cumsum(lengths)
            months, results = [], []
            for a, b in zip(stops - lengths, stops):
                at = np.arange(quarters[a] * 3, quarters[b - 1] * 3 + 3, dtype="int32")
                known = np.isfinite(values[a:b])
                x, y = quarters[a:b][known].astype(float) * 3 + placed_at, values[a:b][known]
                months.append(at)
                results.append(_spline(x, y, at.astype(float), ends) if len(x) else np.full(len(at), np.nan))
            owner = pa.array(np.repeat(np.arange(len(lengths)), [len(m) for m in months]))
            columns = [c.take(owner) for c in batch.columns[:-1]]
            found = np.concatenate([*results, []])
            columns += [pa.array(np.concatenate([*months, []]).astype("int32")), pa.array(found, pa.float64(), mask=np.isnan(found))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "period_idx", name])

    return packed.mapInArrow(interpolate, f"{fields}, period_idx int, `{name}` double")
