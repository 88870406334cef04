"""Scans over blocks of periods against the windows over whole series."""

import math
import random

import pytest

from panelloom.operators import blocked, windows


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or math.isnan(a) and math.isnan(b)
    return a == b


def compare(one, two):
    assert one.columns == two.columns
    x, y = (sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[0]), r[1])) for df in (one, two))
    assert len(x) == len(y)
    for a, b in zip(x, y):
        assert all(map(same, a, b)), (a, b)


def series(seed, periods, missing=0.3, levels=0.1):
    rnd = random.Random(seed)
    out = []
    for entity in ("a", "b", None, "short"):
        for p in range(-7 if entity == "a" else 5, 9 if entity == "short" else periods):
            value = None if rnd.random() < missing else rnd.choice([rnd.uniform(1, 9), 5.0])
            level = rnd.uniform(10, 20) if rnd.random() < levels and entity != "b" else None
            out.append((entity, p, value, rnd.uniform(1, 3) if rnd.random() > 0.03 else None, level))
    return out


COLUMNS = "entity string, period_idx int, value double, indicator double, level double"
SIZES = [1, 7, 1000]


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(series(1, 120), COLUMNS).cache()


@pytest.mark.parametrize("size", SIZES)
def test_lag_lead_and_fill_down(panel, size):
    lags = [1, 4, 30, 0, -2, -17]
    compare(blocked.lag_lead(panel, ["entity"], "value", lags, size), windows.lag_lead(panel, ["entity"], "value", lags))
    compare(blocked.fill_down(panel, ["entity"], ["value", "level"], size), windows.fill_down(panel, ["entity"], ["value", "level"]))


@pytest.mark.parametrize("size", SIZES)
def test_trailing_norms(spark, panel, size):
    exclude = size == 7
    gaps = panel.where("period_idx % 11 <> 3 OR period_idx < 0")
    constant = spark.createDataFrame([("c", p, 0.1, 1.0, float("nan")) for p in range(90)], COLUMNS)
    rows = gaps.union(constant)
    args = (["entity"], ["value", "level"], [1, 2, 5])
    got = blocked.trailing_norms(rows, *args, size, freq=4, exclude_current=exclude)
    compare(got, windows.trailing_norms(rows, *args, freq=4, exclude_current=exclude))
    assert {r[0] for r in got.where("entity = 'c' AND period_idx > 4").select("norm_1_value").distinct().collect()} == {0.1}


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("aligned", [False, True])
def test_extrapolation(spark, panel, size, aligned):
    sure = spark.createDataFrame(series(2, 60, levels=0.04), COLUMNS).fillna(2.0, ["indicator"])
    for rows in (panel, sure):
        args = (["entity"], "level", "indicator", "out")
        compare(blocked.extrapolate_anchored(rows, *args, size, aligned), windows.extrapolate_anchored(rows, *args, aligned))


def test_empty_panels(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert blocked.trailing_norms(none, ["entity"], ["value"], [1], 4).count() == 0
    assert blocked.extrapolate_anchored(none, ["entity"], "level", "indicator", "out", 4).count() == 0


def test_a_task_holds_one_block_of_a_long_series(spark):
    """One series of five million periods: the rows that meet in a partition are those of its blocks."""
    size, periods = 50_000, 5_000_000
    long = spark.range(periods).selectExpr("'x' AS entity", "CAST(id AS INT) AS period_idx", "CASE WHEN id % 3 = 0 THEN CAST(id % 1000 AS DOUBLE) END AS value")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        filled = blocked.fill_down(long, ["entity"], ["value"], size)
        sizes = filled.selectExpr("spark_partition_id() AS p", "period_idx", "value").groupBy("p").agg({"p": "count", "value": "max"}).collect()
        blocks = periods // size
        assert sum(r["count(p)"] for r in sizes) == periods and len(sizes) > blocks / 3
        # Blocks are dealt by hash, so a partition may have a few of them, never all.
        assert max(r["count(p)"] for r in sizes) <= 6 * size
        assert all(r["count(p)"] % size == 0 for r in sizes)
        norms = blocked.trailing_norms(long, ["entity"], ["value"], [30], size)
        row = norms.where("period_idx = 4000000").first()
        want = [p % 1000 for p in range(4_000_000 - 359, 4_000_001) if p % 3 == 0]
        assert math.isclose(row["norm_30_value"], sum(want) / len(want), rel_tol=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
