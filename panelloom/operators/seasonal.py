"""Seasonal adjustment by moving filters: the season may change from cycle to cycle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

from panelloom.functions.text import ident, idents, over

# Moving averages of one sub-period over its cycles, 3 x 3 and 3 x 5 terms.
SHORT_SEASON = (1, 2, 3, 2, 1)
LONG_SEASON = (1, 2, 3, 3, 3, 2, 1)
# Irregular parts within LOW standard deviations count in full, beyond HIGH not at all.
LOW, HIGH = 1.5, 2.5


def henderson(half: int) -> list[float]:
    """The symmetric trend filter of ``2 half + 1`` terms: keeps cubics, smoothest third differences."""
    m = half + 2
    scale = 8 * m * (m**2 - 1) * (4 * m**2 - 1) * (4 * m**2 - 9) * (4 * m**2 - 25) / 315

    def weight(j: int) -> float:
        return ((m - 1) ** 2 - j**2) * (m**2 - j**2) * ((m + 1) ** 2 - j**2) * (3 * m**2 - 16 - 11 * j**2) / scale

    return [weight(j) for j in range(-half, half + 1)]


def trend_weights(half: int, noise: float = 3.5) -> list[list[float]]:
    """Filters by position: entry ``half + c`` serves a row that lacks c terms after it (c < 0: before it).

    The end filters revise the symmetric one least, in mean square, for a series that is a straight line plus an
    irregular part ``noise`` times as large as the line's change per period. All sum to 1.
    """
    full = henderson(half)
    slope = 4 / (math.pi * noise**2)

    def cut(missing: int) -> list[float]:
        m = len(full) - missing
        middle = (m + 1) / 2
        lost = full[m:]
        tilt = sum((i - middle) * w for i, w in enumerate(lost, m + 1)) * slope / (1 + m * (m - 1) * (m + 1) / 12 * slope)
        return [w + sum(lost) / m + (j - middle) * tilt for j, w in enumerate(full[:m], 1)] + [0.0] * missing

    ends = [cut(c) for c in range(1, half + 1)]
    return [e[::-1] for e in reversed(ends)] + [full] + ends


def _numbers(values: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def _shifts(x: str, half: int, step: int, series: str) -> str:
    """The values from ``half`` steps before to ``half`` steps after a row, as one array."""
    return f"array({', '.join(f'lag({x}, {-j * step}) {series}' for j in range(-half, half + 1))})"


def _mean(items: str, weights: str) -> str:
    """Weighted mean of the items that are there: at the ends the weights of the missing ones are shared out."""
    total = "aggregate(zip_with({}, {}, (v, w) -> {}), 0D, (a, b) -> a + b)"
    above = total.format(items, weights, "coalesce(v * w, 0D)")
    return f"try_divide({above}, {total.format(items, weights, 'IF(v IS NULL, 0D, w)')})"


def _centred(x: str, freq: int, keys: Sequence[str], period: str) -> str:
    """Centred 2 x freq moving mean, NULL half a cycle from the ends."""
    half = freq // 2
    series = over(keys, period)
    inner = over(keys, period, f"ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING")
    return f"(0.5D * lag({x}, {half}) {series} + sum({x}) {inner} + 0.5D * lead({x}, {half}) {series}) / {freq}"


class _Series:
    """Columns of several measures that go through the same steps, all in windows over one entity's series."""

    def __init__(self, frame: DataFrame, keys: Sequence[str], values: Sequence[str], freq: int, period: str) -> None:
        self.frame, self.keys, self.values, self.freq, self.period = frame, keys, values, freq, period
        self.series, self.entity = over(keys, period), over(keys, None)

    def step(self, name: str, expression) -> None:
        """Add ``_<name>_<measure>`` for every measure; ``expression`` gets a function from step to column."""
        columns = []
        for v in self.values:
            at = lambda n, v=v: ident(f"_{n}_{v}") if n else ident(v)
            columns.append(f"{expression(at)} AS {at(name)}")
        # A step taken again replaces its column.
        old = {f"_{name}_{v}" for v in self.values}
        kept = [c for c in self.frame.columns if c not in old]
        self.frame = self.frame.selectExpr(*idents(kept), *columns)

    def season(self, weights: Sequence[int], again: bool = False) -> None:
        """``factor`` from ``ratio``, averaging 1 over any cycle around a row; ``again`` counts ratios by their ``share``."""
        half, filters = len(weights) // 2, _numbers(weights)
        if again:
            self.step("sure", lambda at: _shifts(at("share"), half, self.freq, self.series))
            own = lambda at: f"zip_with({at('sure')}, {filters}, (e, w) -> e * w)"
            # Where every cycle in reach is extreme, the factor stays.
            self.step("raw", lambda at: f"coalesce({_mean(at('near'), own(at))}, {at('factor')})")
        else:
            self.step("near", lambda at: _shifts(at("ratio"), half, self.freq, self.series))
            self.step("raw", lambda at: _mean(at("near"), filters))
        self.step("level", lambda at: _centred(at("raw"), self.freq, self.keys, self.period))
        before, after = (over(self.keys, self.period, f"ROWS BETWEEN {f}") for f in ("UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
        held = "coalesce({0}, last_value({0}, true) {1}, first_value({0}, true) {2})"
        self.step("factor", lambda at: f"try_divide({at('raw')}, {held.format(at('level'), before, after)})")

    def season_without_extremes(self, weights: Sequence[int]) -> None:
        """Factors, then again with less weight on ratios whose irregular part is extreme."""
        self.season(weights)
        self.step("odd", lambda at: f"abs(try_divide({at('ratio')}, {at('factor')}) - 1)")
        self.step("wide", lambda at: f"sqrt(avg({at('odd')} * {at('odd')}) {self.entity})")
        inside = lambda at: f"IF({at('odd')} <= {HIGH}D * {at('wide')}, {at('odd')} * {at('odd')}, NULL)"
        self.step("sd", lambda at: f"sqrt(avg({inside(at)}) {self.entity})")
        self.step("share", lambda at: f"greatest(0D, least(1D, ({HIGH}D - coalesce(try_divide({at('odd')}, {at('sd')}), 0D)) / {HIGH - LOW}D))")
        self.season(weights, again=True)


def adjust_by_filters(
    panel: DataFrame, keys: Sequence[str], values: Sequence[str], freq: int, period: str = "period_idx", noise: float = 3.5
) -> DataFrame:
    """Multiplicative adjustment of each entity's gap-free series for a season that may move.

    First trend: the centred 2 x freq mean. Factors: 3 x 3 means of the ratios by sub-period, scaled to average 1;
    ratios whose irregular part is over 1.5 standard deviations lose weight, from 2.5 on all of it, and the factors are
    taken again. Second trend: a Henderson filter of freq + 1 terms of the adjusted values, with end
    filters; an extreme value enters it with its irregular part reduced by that weight. Final factors: the same with 3 x 5 means. At the ends, means by sub-period take the cycles that are there.

    A series shorter than two cycles, with a gap, with a value that is not positive, or with a factor that is not
    positive keeps its raw values; the flag ``<column>_sa_ok`` says which. ``freq`` is even.
    """
    half = freq // 2
    work = _Series(panel, keys, values, freq, period)
    entity = work.entity
    work.frame = panel.selectExpr(
        "*", f"CAST(row_number() {work.series} AS INT) AS _place", f"CAST(count(*) {entity} AS INT) AS _length"
    )
    work.step("whole", lambda at: (
        f"_length >= {2 * freq} AND count({at('')}) {entity} = _length AND coalesce(min({at('')}) {entity} > 0, false)"
    ))
    work.step("x", lambda at: f"IF({at('whole')}, CAST({at('')} AS DOUBLE), NULL)")
    work.step("trend", lambda at: _centred(at("x"), freq, keys, period))
    work.step("ratio", lambda at: f"try_divide({at('x')}, {at('trend')})")
    work.season_without_extremes(SHORT_SEASON)

    filters = f"array({', '.join(_numbers(w) for w in trend_weights(half, noise))})"
    # Terms that a row lacks after it, less those it lacks before it: one of the two is 0 from two cycles on.
    own = f"get({filters}, {half} + greatest(0, {half} + _place - _length) - greatest(0, {half + 1} - _place))"
    work.step("calm", lambda at: f"try_divide({at('x')}, {at('factor')})")
    # What the value would be with its irregular part drawn in: ratio over factor is 1 plus that part.
    drawn = lambda at: f"(1 + {at('share')} * ({at('ratio')} / {at('factor')} - 1)) * {at('factor')} / {at('ratio')}"
    work.step("calm", lambda at: f"{at('calm')} * coalesce({drawn(at)}, 1D)")
    work.step("near", lambda at: _shifts(at("calm"), half, 1, work.series))
    products = lambda at: f"zip_with({at('near')}, {own}, (v, w) -> coalesce(v * w, 0D))"
    work.step("trend", lambda at: f"aggregate({products(at)}, 0D, (a, b) -> a + b)")
    work.step("ratio", lambda at: f"IF({at('trend')} > 0, {at('x')} / {at('trend')}, NULL)")
    work.season_without_extremes(LONG_SEASON)

    work.step("ok", lambda at: f"{at('whole')} AND coalesce(min(coalesce({at('factor')}, 0D)) {entity} > 0, false)")
    kept = [c for c in panel.columns if c not in values]
    finals = []
    for v in values:
        x, factor, ok = ident(v), ident(f"_factor_{v}"), ident(f"_ok_{v}")
        finals += [f"IF({ok}, {x} / {factor}, {x}) AS {x}", f"{ok} AS {ident(f'{v}_sa_ok')}"]
    return work.frame.selectExpr(*idents(kept), *finals)
