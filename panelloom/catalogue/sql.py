"""Shared SQL expressions: the given tables in their roles."""

from __future__ import annotations

from collections.abc import Sequence

from panelloom.catalogue.registry import TABLES
from panelloom.plans import tables as tb

START, END = tb.START, tb.END

TABLES["located"] = """
SELECT o_orderkey, c_custkey, c_nationkey AS entity, c_mktsegment, o_orderpriority,
  CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents
FROM orders JOIN customer ON o_custkey = c_custkey"""

TABLES["monthly"] = """
SELECT entity, m AS period_idx, CAST(sum(cents) AS DOUBLE) / 100.0 / count(*) AS value
FROM located GROUP BY 1, 2"""

TABLES["calendar"] = f"SELECT CAST(unnest(range({START}, {END + 1})) AS INTEGER) AS period_idx"

TABLES["spine"] = """
SELECT e.entity, c.period_idx, v.value
FROM (SELECT DISTINCT entity FROM monthly) e CROSS JOIN calendar c
LEFT JOIN monthly v ON v.entity = e.entity AND v.period_idx = c.period_idx"""

TABLES["weighted"] = """
SELECT n_nationkey AS entity, n_name, r_regionkey, r_name, population, population / (SELECT CAST(count(*) AS DOUBLE) FROM customer) AS weight
FROM nation JOIN region ON n_regionkey = r_regionkey
JOIN (SELECT c_nationkey, count(*) AS population FROM customer GROUP BY 1) ON c_nationkey = n_nationkey"""

TABLES["shipped"] = """
SELECT s_nationkey AS entity, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS period_idx,
  sum(l_quantity) AS quantity, sum(l_quantity) / count(*) AS temp,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS precip
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""

TABLES["priced"] = """
SELECT entity, m AS period_idx, o_orderpriority AS category, CAST(sum(cents) AS DOUBLE) / 100.0 / count(*) AS value
FROM located GROUP BY 1, 2, 3"""


def pivoted(names: dict[str, str], key: str, value: str) -> str:
    return ", ".join(f"max(CASE WHEN {key} = '{k}' THEN {value} END) AS {n}" for k, n in names.items())


TABLES["price_months"] = f"""
SELECT entity, period_idx, {pivoted(tb.PRIORITIES, "category", "value")}
FROM priced WHERE period_idx BETWEEN {START} AND {END} GROUP BY 1, 2"""


def strict_mean(column: str) -> str:
    return f"CASE WHEN count({column}) = count(*) THEN avg({column}) END"


TABLES["price_quarters"] = f"""
SELECT entity, period_idx // 3 AS period_idx, {", ".join(f"{strict_mean(p)} AS {p}" for p in tb.PRICES)}
FROM price_months GROUP BY 1, 2"""

TABLES["segment_quarters"] = """
SELECT entity, m // 3 AS period_idx, c_mktsegment, CAST(sum(cents) AS DOUBLE) / 100.0 AS amount
FROM located GROUP BY 1, 2, 3"""

TABLES["output_quarters"] = f"""
SELECT entity, period_idx, round(sum(amount), 2) AS gdp_total, {pivoted(tb.SEGMENTS, "c_mktsegment", "amount")}
FROM segment_quarters GROUP BY 1, 2"""


def norm_frames(value: str, source: str, years: Sequence[int] = tb.NORMS) -> str:
    frames = ", ".join(
        f"CASE WHEN age >= {12 * m - 1} THEN avg({value}) OVER (PARTITION BY entity ORDER BY period_idx "
        f"RANGE BETWEEN {12 * m - 1} PRECEDING AND CURRENT ROW) END AS norm_{m}"
        for m in years
    )
    return f"""SELECT entity, period_idx, {value}, {frames} FROM (
  SELECT entity, period_idx, {value}, period_idx - min(period_idx) OVER (PARTITION BY entity) AS age FROM {source})"""


def anomalies(value: str, source: str, years: Sequence[int] = tb.NORMS, months: int = 3) -> str:
    """All norms of a monthly series, by periods of so many months, with anomalies."""
    means = ", ".join(f"avg(norm_{m}) AS norm_{m}" for m in years)
    long = " UNION ALL ".join(
        f"SELECT CAST({m} AS INTEGER) AS norm_years, entity, period_idx, {value}, norm_{m} AS norm FROM q" for m in years
    )
    return f"""WITH n AS ({norm_frames(value, f"(SELECT * FROM {source} WHERE period_idx <= {END})", years)}),
q AS (SELECT entity, period_idx // {months} AS period_idx, avg({value}) AS {value}, {means} FROM n
  WHERE period_idx BETWEEN {START} AND {END} GROUP BY 1, 2),
l AS ({long})
SELECT norm_years, entity, period_idx, {value}, norm AS mean_{value}, d AS deviation_{value}, abs(d) AS abs_deviation_{value},
  CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0.0 END AS pos_dev_{value},
  CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0.0 END AS neg_dev_{value}
FROM (SELECT *, 2.0 / (norm_years + 1) * ({value} - norm) AS d FROM l)"""


TABLES["temp_anomalies"] = anomalies("temp", "shipped")
TABLES["precip_anomalies"] = anomalies("precip", "shipped")

SEASON = """CASE period_idx % 4 WHEN 0 THEN 'winter' WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END"""

TABLES["weather"] = """
SELECT * FROM temp_anomalies FULL JOIN precip_anomalies USING (norm_years, entity, period_idx)"""

TABLES["merged"] = """
SELECT * FROM price_quarters LEFT JOIN output_quarters USING (entity, period_idx)
LEFT JOIN weather USING (entity, period_idx)"""

_URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
_PRIMARY = "c_mktsegment IN ('AUTOMOBILE', 'BUILDING')"


def _mean_cents(rows: str) -> str:
    return f"CAST(sum(cents) FILTER ({rows}) AS DOUBLE) / 100.0 / nullif(count(*) FILTER ({rows}), 0)"


_TERTIARY = "c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')"
TABLES["model_outcomes"] = f"""
SELECT entity, m // 3 AS period_idx, {_mean_cents("true")} AS headline, {_mean_cents(_URGENT)} AS food, {_mean_cents(f"NOT {_URGENT}")} AS energy,
  CAST(sum(cents) FILTER ({_TERTIARY}) AS DOUBLE) / 100.0 AS gdp_tertiary,
  CAST(sum(cents) AS DOUBLE) / 100.0 AS gdp_total, CAST(sum(cents) FILTER ({_PRIMARY}) AS DOUBLE) / 100.0 AS gdp_primary,
  CAST(sum(cents) FILTER (NOT {_PRIMARY}) AS DOUBLE) / 100.0 AS gdp_secondary
FROM located GROUP BY 1, 2"""

TABLES["model_rows"] = "SELECT * FROM model_outcomes LEFT JOIN weather USING (entity, period_idx)"

_complete = ["norm_years", *tb.MODEL_PRICES, *tb.MODEL_OUTPUTS, *tb.SHOCKS]
TABLES["estimation"] = f"""
SELECT norm_years, entity, period_idx, {", ".join(_complete[1:])}, gdp_tertiary, abs_deviation_temp, abs_deviation_precip
FROM model_rows WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _complete)}"""

# Gap-free by norm and entity over each one's own span.
TABLES["estimation_spine"] = """
SELECT s.norm_years, s.entity, s.period_idx, e.* EXCLUDE (norm_years, entity, period_idx)
FROM (SELECT norm_years, entity, CAST(unnest(range(min(period_idx), max(period_idx) + 1)) AS INTEGER) AS period_idx
  FROM estimation GROUP BY 1, 2) s
LEFT JOIN estimation e ON e.norm_years = s.norm_years AND e.entity = s.entity AND e.period_idx = s.period_idx"""


# The monthly panel of the projections: an empty cell is NULL, the calendar has no gap.
TABLES["month_outcomes"] = f"""
SELECT entity, m AS period_idx, {_mean_cents("true")} AS headline, {_mean_cents(_URGENT)} AS food, {_mean_cents(f"NOT {_URGENT}")} AS energy,
  {_mean_cents("o_orderpriority IN ('2-HIGH', '3-MEDIUM')")} AS nonfood, {_mean_cents("o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')")} AS services,
  {_mean_cents("o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')")} AS goods,
  CAST(sum(cents) AS DOUBLE) / 100.0 AS gdp_total, CAST(sum(cents) FILTER ({_PRIMARY}) AS DOUBLE) / 100.0 AS gdp_primary,
  CAST(sum(cents) FILTER (NOT {_PRIMARY}) AS DOUBLE) / 100.0 AS gdp_secondary, CAST(sum(cents) FILTER ({_TERTIARY}) AS DOUBLE) / 100.0 AS gdp_tertiary
FROM located GROUP BY 1, 2"""
TABLES["month_temp"] = anomalies("temp", "shipped", months=1)
TABLES["month_precip"] = anomalies("precip", "shipped", months=1)
TABLES["month_rows"] = """
SELECT * FROM month_temp FULL JOIN month_precip USING (norm_years, entity, period_idx) LEFT JOIN month_outcomes USING (entity, period_idx)"""
TABLES["month_spine"] = """
SELECT s.norm_years, s.entity, s.period_idx, r.* EXCLUDE (norm_years, entity, period_idx)
FROM (SELECT norm_years, entity, CAST(unnest(range(min(period_idx), max(period_idx) + 1)) AS INTEGER) AS period_idx FROM month_rows GROUP BY 1, 2) s
LEFT JOIN month_rows r ON r.norm_years = s.norm_years AND r.entity = s.entity AND r.period_idx = s.period_idx"""

# Quarterly price series on each nation's own gap-free span.
TABLES["price_spine"] = """
SELECT s.entity, s.period_idx, q.headline FROM
  (SELECT entity, CAST(unnest(range(min(period_idx), max(period_idx) + 1)) AS INTEGER) AS period_idx FROM price_quarters GROUP BY 1) s
LEFT JOIN price_quarters q ON q.entity = s.entity AND q.period_idx = s.period_idx"""


def adjusted(source: str, key: str, value: str, freq: int = 4) -> str:
    """Classical seasonal adjustment of the gap-free series in ``source``."""
    half = freq // 2
    w = f"(PARTITION BY {key} ORDER BY period_idx)"
    inner = f"(PARTITION BY {key} ORDER BY period_idx ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING)"
    return f"""WITH t AS (SELECT *, {value} / ((0.5 * lag({value}, {half}) OVER {w} + sum({value}) OVER {inner} + 0.5 * lead({value}, {half}) OVER {w}) / {freq}) AS r,
      count(*) OVER (PARTITION BY {key}) >= {2 * freq} AND count({value}) OVER (PARTITION BY {key}) = count(*) OVER (PARTITION BY {key})
        AND min({value}) OVER (PARTITION BY {key}) > 0 AS ok FROM {source}),
    f AS (SELECT {key}, period_idx % {freq} AS sub, avg(r) AS factor FROM t GROUP BY 1, 2),
    n AS (SELECT {key}, sum(factor) / {freq} AS scale FROM f GROUP BY 1)
    SELECT t.{key}, t.period_idx, CASE WHEN ok THEN {value} / (factor / scale) ELSE {value} END AS {value}, coalesce(ok, false) AS {value}_sa_ok
    FROM t JOIN f ON f.{key} = t.{key} AND f.sub = t.period_idx % {freq} JOIN n ON n.{key} = t.{key}"""


TABLES["adjusted_headline"] = adjusted("price_spine", "entity", "headline")


def _season_steps(tag: str, ratios: str, key: str, freq: int, weights: Sequence[int], again: bool = False) -> str:
    """``<tag>_factor(key, t, ratio, share, factor)`` from ``ratios``, by joins of each row to its cycles."""
    half = len(weights) // 2
    shares = ", ".join(f"({j}, {float(w)!r}e0)" for j, w in enumerate(weights, -half))
    inner = f"(PARTITION BY {key} ORDER BY t ROWS BETWEEN {freq // 2 - 1} PRECEDING AND {freq // 2 - 1} FOLLOWING)"
    w = f"(PARTITION BY {key} ORDER BY t)"
    own = "s.w * b.share" if again else "s.w"
    mean = f"sum({own} * b.ratio) / nullif(sum(CASE WHEN b.ratio IS NOT NULL THEN {own} END), 0)"
    raw = f"coalesce({mean}, any_value(a.factor))" if again else mean
    return f"""{tag}_raw AS MATERIALIZED (SELECT a.{key}, a.t, any_value(a.ratio) AS ratio, {"any_value(a.share)" if again else "1.0"} AS share, {raw} AS raw
  FROM {ratios} a CROSS JOIN (VALUES {shares}) s(j, w) LEFT JOIN {ratios} b ON b.{key} = a.{key} AND b.t = a.t + s.j * {freq} GROUP BY 1, 2),
{tag}_level AS MATERIALIZED (SELECT *, (0.5 * lag(raw, {freq // 2}) OVER {w} + sum(raw) OVER {inner} + 0.5 * lead(raw, {freq // 2}) OVER {w}) / {freq} AS level FROM {tag}_raw),
{tag}_factor AS MATERIALIZED (SELECT {key}, t, ratio, share, raw / coalesce(level, last_value(level IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY t ROWS UNBOUNDED PRECEDING),
  first_value(level IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS factor FROM {tag}_level)"""


def _trusted(tag: str, factors: str, key: str) -> str:
    """``<tag>_ratio``: ratios with the share they keep, 1 within 1.5 standard deviations, 0 from 2.5 on."""
    return f"""{tag}_odd AS (SELECT *, abs(ratio / factor - 1) AS odd FROM {factors}),
{tag}_wide AS (SELECT *, sqrt(avg(odd * odd) OVER (PARTITION BY {key})) AS wide FROM {tag}_odd),
{tag}_sd AS (SELECT *, sqrt(avg(CASE WHEN odd <= 2.5 * wide THEN odd * odd END) OVER (PARTITION BY {key})) AS sd FROM {tag}_wide),
{tag}_ratio AS MATERIALIZED (SELECT {key}, t, ratio, factor, CASE WHEN odd / sd >= 2.5 THEN 0.0 WHEN odd / sd > 1.5 THEN 2.5 - odd / sd ELSE 1.0 END AS share FROM {tag}_sd)"""


def adjusted_by_filters(source: str, key: str, value: str, freq: int, trend: Sequence[Sequence[float]]) -> str:
    """Seasonal adjustment with moving factors; ``trend`` holds the trend filters, from rows at the start to the end."""
    half = freq // 2
    w = f"(PARTITION BY {key} ORDER BY period_idx)"
    inner = f"(PARTITION BY {key} ORDER BY period_idx ROWS BETWEEN {half - 1} PRECEDING AND {half - 1} FOLLOWING)"
    filters = ", ".join(f"({c}, {j}, {v:.17e})" for c, row in enumerate(trend, -half) for j, v in enumerate(row, -half))
    short, long = (1, 2, 3, 2, 1), (1, 2, 3, 3, 3, 2, 1)
    return f"""WITH base AS MATERIALIZED (SELECT {key}, period_idx, {value} AS original, row_number() OVER {w} AS place, count(*) OVER (PARTITION BY {key}) AS total,
  count(*) OVER (PARTITION BY {key}) >= {2 * freq} AND count({value}) OVER (PARTITION BY {key}) = count(*) OVER (PARTITION BY {key})
    AND coalesce(min({value}) OVER (PARTITION BY {key}) > 0, false) AS whole FROM {source}),
xs AS MATERIALIZED (SELECT *, period_idx AS t, CASE WHEN whole THEN CAST(original AS DOUBLE) END AS x FROM base),
first_ratio AS MATERIALIZED (SELECT {key}, t, x / ((0.5 * lag(x, {half}) OVER {w} + sum(x) OVER {inner} + 0.5 * lead(x, {half}) OVER {w}) / {freq}) AS ratio FROM xs),
{_season_steps("a", "first_ratio", key, freq, short)},
{_trusted("a", "a_factor", key)},
{_season_steps("b", "a_ratio", key, freq, short, again=True)},
calm AS MATERIALIZED (SELECT xs.{key}, xs.t, place, total, x,
  x / factor * coalesce((factor + share * (ratio - factor)) / ratio, 1) AS y FROM xs JOIN b_factor f ON f.{key} = xs.{key} AND f.t = xs.t),
filters(c, j, w) AS (VALUES {filters}),
trended AS MATERIALIZED (SELECT a.{key}, a.t, any_value(a.x) AS x, sum(f.w * b.y) AS trend FROM calm a
  JOIN filters f ON f.c = greatest(0, {half} - (a.total - a.place)) - greatest(0, {half} - (a.place - 1))
  JOIN calm b ON b.{key} = a.{key} AND b.t = a.t + f.j GROUP BY 1, 2),
second_ratio AS MATERIALIZED (SELECT {key}, t, CASE WHEN trend > 0 THEN x / trend END AS ratio FROM trended),
{_season_steps("c", "second_ratio", key, freq, long)},
{_trusted("c", "c_factor", key)},
{_season_steps("d", "c_ratio", key, freq, long, again=True)},
closed AS (SELECT xs.*, factor, whole AND coalesce(min(coalesce(factor, 0.0)) OVER (PARTITION BY xs.{key}) > 0, false) AS ok
  FROM xs JOIN d_factor f ON f.{key} = xs.{key} AND f.t = xs.t)
SELECT {key}, period_idx, CASE WHEN ok THEN original / factor ELSE original END AS {value}, ok AS {value}_sa_ok FROM closed"""


def solved(cells: str, k: int, keys: str = "spec") -> str:
    """Common table expressions that invert each specification's Gram by Gauss-Jordan steps.

    ``cells`` holds ``(spec, i, j, v)``, rows and columns 1..width of x; a specification may be narrower than k.
    Result: ``inverse(spec, i, j, v)``.
    """
    steps = [
        f"""g0 AS MATERIALIZED (
SELECT spec, i, j, v FROM {cells} WHERE i >= 1 AND j >= 1
UNION ALL SELECT spec, i, j + {k}, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM {cells} WHERE i >= 1 AND j >= 1)"""
    ]
    for p in range(1, k + 1):
        steps.append(f"""g{p} AS MATERIALIZED (
SELECT a.spec, a.i, a.j, CASE
  WHEN r.v IS NULL THEN a.v
  WHEN a.i = {p} THEN a.v / d.v
  ELSE a.v - f.v * r.v / d.v END AS v
FROM g{p - 1} a
LEFT JOIN g{p - 1} d ON d.spec = a.spec AND d.i = {p} AND d.j = {p}
LEFT JOIN g{p - 1} r ON r.spec = a.spec AND r.i = {p} AND r.j = a.j
LEFT JOIN g{p - 1} f ON f.spec = a.spec AND f.i = a.i AND f.j = {p})""")
    steps.append(f"inverse AS MATERIALIZED (SELECT spec, i, j - {k} AS j, v FROM g{k} WHERE j > {k})")
    return ",\n".join(steps)


def within_fit(design: str, k: int, bandwidth: str, small_sample: bool) -> str:
    """Common table expressions for within OLS with Driscoll-Kraay covariance.

    ``design`` holds complete rows ``(spec, e, t, i, v)``: position 0 is the outcome. Results: ``beta(spec, i, b)``,
    ``cov(spec, i, j, v)`` and ``fit(spec, r2, n, periods)``.
    """
    factor = "periods / (periods - 1.0) * (n - 1.0) / (n - width)" if small_sample else "1.0"
    return f"""z AS MATERIALIZED (SELECT spec, e, t, i, v - avg(v) OVER (PARTITION BY spec, e, i) AS v FROM {design}),
grams AS MATERIALIZED (SELECT a.spec, a.i, b.i AS j, sum(a.v * b.v) AS v
  FROM z a JOIN z b ON a.spec = b.spec AND a.e = b.e AND a.t = b.t GROUP BY 1, 2, 3),
{solved("grams", k)},
beta AS MATERIALIZED (SELECT inverse.spec, inverse.i, sum(inverse.v * g.v) AS b
  FROM inverse JOIN grams g ON g.spec = inverse.spec AND g.i = inverse.j AND g.j = 0 GROUP BY 1, 2),
res AS MATERIALIZED (SELECT y.spec, y.e, y.t, any_value(y.v) - sum(x.v * b) AS u
  FROM z y JOIN z x ON x.spec = y.spec AND x.e = y.e AND x.t = y.t AND y.i = 0 AND x.i > 0
  JOIN beta ON beta.spec = x.spec AND beta.i = x.i GROUP BY 1, 2, 3),
fit AS MATERIALIZED (SELECT res.spec, 1 - sum(u * u) / any_value(g.v) AS r2, count(*) AS n, count(DISTINCT t) AS periods, count(DISTINCT res.e) AS entities,
  {bandwidth} AS bandwidth, any_value(width) AS width
  FROM res JOIN grams g ON g.spec = res.spec AND g.i = 0 AND g.j = 0
  JOIN (SELECT spec, max(i) AS width FROM grams GROUP BY 1) w ON w.spec = res.spec GROUP BY 1),
h AS MATERIALIZED (SELECT x.spec, x.t, x.i, sum(x.v * u) AS v FROM z x JOIN res ON x.spec = res.spec AND x.e = res.e AND x.t = res.t
  WHERE x.i > 0 GROUP BY 1, 2, 3),
omega AS MATERIALIZED (SELECT a.spec, a.i, b.i AS j, sum(a.v * b.v * (1 - abs(a.t - b.t) / (bandwidth + 1.0))) AS v
  FROM h a JOIN fit ON fit.spec = a.spec JOIN h b ON b.spec = a.spec AND abs(a.t - b.t) <= bandwidth GROUP BY 1, 2, 3),
half AS MATERIALIZED (SELECT l.spec, l.i, o.j, sum(l.v * o.v) AS v FROM inverse l JOIN omega o ON o.spec = l.spec AND o.i = l.j GROUP BY 1, 2, 3),
cov AS MATERIALIZED (SELECT half.spec, half.i, r.j, sum(half.v * r.v) * any_value({factor}) AS v
  FROM half JOIN inverse r ON r.spec = half.spec AND r.i = half.j JOIN fit ON fit.spec = half.spec GROUP BY 1, 2, 3)"""
