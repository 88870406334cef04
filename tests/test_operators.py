import functools
import math

import pytest
from pyspark.sql import functions as F

from panelloom.operators import aggregate, joins, ranking, reshape, selection, windows
from panelloom.operators.seasonal import henderson, trend_weights
from panelloom.operators.spline import spline_to_months

KEY = ["e"]


def series(spark, values, entity="a", start=0):
    data = [(entity, start + i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "e string, period_idx int, x double")


def values(df, column="x"):
    return [r[column] for r in df.orderBy("e", "period_idx").collect()]


def anchored(spark, levels, indicator, **options):
    rows = [("a", t, levels.get(t), float(v) if v is not None else None) for t, v in enumerate(indicator)]
    df = spark.createDataFrame(rows, "e string, period_idx int, level double, ind double")
    return values(windows.extrapolate_anchored(df, KEY, "level", "ind", "out", **options), "out")


def test_anchored_default(spark):
    got = anchored(spark, {1: 10.0, 5: 10.0}, range(1, 10))
    expected = [0.0, 10.0, 10 * 4 / 3, 10 * 5 / 3, 10 * 6 / 3, 10.0, 10 * 8 / 7, 10 * 9 / 7]
    assert got[:8] == pytest.approx(expected)
    assert got[8] == pytest.approx(sum(expected[4:8]) / 4)


def test_anchored_aligned(spark):
    got = anchored(spark, {1: 10.0, 5: 10.0}, range(1, 10), aligned=True)
    assert got[0] is None
    assert got[1:] == pytest.approx([10, 15, 20, 25, 10, 10 * 7 / 6, 10 * 8 / 6, 10 * 9 / 6])


def test_anchored_matches_the_loop(spark):
    """Row by row, as a loop would carry it."""
    ind = [3, 5, 4, 8, 9, 7, 6, 12, 11, 10, 13, 9]
    levels = {3: 100.0, 7: 80.0}
    out, state = [], 0.0
    for t in range(len(ind)):
        state = levels[t] if t in levels else (state * ind[t + 1] / ind[t] if t + 1 < len(ind) else math.nan)
        out.append(state)
    out[-1] = sum(out[-5:-1]) / 4
    assert anchored(spark, levels, ind) == pytest.approx(out)


def test_anchored_missing_change_lasts_to_the_next_anchor(spark):
    got = anchored(spark, {0: 10.0, 4: 20.0}, [1, 2, None, 4, 5, 6, 7, 8], aligned=True)
    assert got[1] == 20.0 and got[2] is None and got[3] is None
    assert got[4] == 20.0 and got[5] == pytest.approx(24.0)


def test_zero_indicator_gives_null_not_an_error(spark):
    got = anchored(spark, {0: 10.0}, [1, 0, 3, 4], aligned=True)
    assert got == [10.0, 0.0, None, None]


def test_spine_fills_and_widens(spark):
    df = spark.createDataFrame([("a", 3, 1.0), ("a", 6, 2.0), ("b", 5, 3.0)], "e string, period_idx int, x double")
    own = joins.complete_periods(df, KEY)
    assert [(r["e"], r["period_idx"], r["x"]) for r in own.orderBy("e", "period_idx").collect()] == [
        ("a", 3, 1.0), ("a", 4, None), ("a", 5, None), ("a", 6, 2.0), ("b", 5, 3.0)
    ]
    wide = joins.complete_periods(df, KEY, 2, 7)
    assert wide.groupBy("e").count().collect()[0]["count"] == 6
    assert wide.where("x IS NOT NULL").count() == 3
    # Bounds inside the span cut nothing.
    assert joins.complete_periods(df, KEY, 4, 5).where("x IS NOT NULL").count() == 3


def test_trailing_norm_needs_the_whole_window(spark):
    df = series(spark, range(30))
    got = values(windows.trailing_norms(df, KEY, ["x"], [1, 2]), "norm_1_x")
    assert got[:11] == [None] * 11
    assert got[11] == pytest.approx(5.5) and got[29] == pytest.approx(23.5)
    assert values(windows.trailing_norms(df, KEY, ["x"], [2]), "norm_2_x")[22:24] == [None, pytest.approx(11.5)]
    late = values(windows.trailing_norms(df, KEY, ["x"], [1], exclude_current=True), "norm_1_x")
    assert late[11] is None and late[12] == pytest.approx(5.5)


def test_trailing_norm_counts_periods_not_rows(spark):
    full = series(spark, range(24))
    gaps = full.where("period_idx NOT IN (13, 17)")
    got = {r["period_idx"]: r["norm_1_x"] for r in windows.trailing_norms(gaps, KEY, ["x"], [1]).collect()}
    kept = [v for v in range(12, 24) if v not in (13, 17)]
    assert got[23] == pytest.approx(sum(kept) / len(kept))


def test_trailing_norm_skips_missing_values_and_equals_a_loop(spark):
    data = [None, None] + [None if t % 7 == 0 else 1e6 + (t * 37 % 101) / 3 for t in range(60)]
    data[20] = float("nan")
    got = values(windows.trailing_norms(series(spark, data), KEY, ["x"], [1, 2]), "norm_2_x")
    for t in range(23, len(data)):
        kept = [v for v in data[t - 23 : t + 1] if v is not None and not math.isnan(v)]
        assert got[t] == pytest.approx(sum(kept) / len(kept), rel=1e-14)
    assert values(windows.trailing_norms(series(spark, [None] * 13), KEY, ["x"], [1]), "norm_1_x") == [None] * 13


def test_norm_of_a_constant_is_the_constant(spark):
    got = values(windows.trailing_norms(series(spark, [7] * 40), KEY, ["x"], [3]), "norm_3_x")
    assert got[35:] == [7.0] * 5


def test_lags_leads_and_differences(spark):
    df = series(spark, [1, 2, 4, 8])
    shifted = windows.lag_lead(df, KEY, "x", [1, -1])
    assert values(shifted, "x_lag1") == [None, 1.0, 2.0, 4.0]
    assert values(shifted, "x_lead1") == [2.0, 4.0, 8.0, None]
    assert values(df.withColumn("d", windows.difference(F.col("x"), KEY, 2)), "d") == [None, None, 3.0, 6.0]
    logs = values(df.withColumn("d", windows.log_difference(F.col("x"), KEY)), "d")
    assert logs[1:] == pytest.approx([math.log(2)] * 3)


def test_lags_do_not_cross_entities(spark):
    df = series(spark, [1, 2]).unionByName(series(spark, [5, 6], "b"))
    assert values(windows.lag_lead(df, KEY, "x", [1]), "x_lag1") == [None, 1.0, None, 5.0]


def test_rates(spark):
    df = series(spark, [100, 110, 121, 133.1, 0, 5])
    assert values(windows.rate_of_change(df, KEY, ["x"], "q", 4))[1:4] == pytest.approx([10.0] * 3)
    got = values(windows.rate_of_change(df, KEY, ["x"], "q", 4))
    assert got[0] is None and got[5] is None
    log = values(windows.rate_of_change(df, KEY, ["x"], "q", 4, log=True))
    assert log[1] == pytest.approx(100 * math.log(1.1)) and log[4] is None


def test_fill_down(spark):
    assert values(windows.fill_down(series(spark, [None, 1, None, None, 2]), KEY, ["x"])) == [None, 1.0, 1.0, 1.0, 2.0]


def test_group_id_is_dense_and_ordered(spark, rows):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 1000).cast("string").alias("k"))
    got = rows(ranking.group_id(df, "k").distinct(), "k", "group_id")
    assert [i for _, i in got] == list(range(1, 1001))


def test_group_id_leaves_null_keys_null(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "k string")
    assert {r["k"]: r["group_id"] for r in ranking.group_id(df, "k").collect()} == {"a": 1, "b": 2, None: None}


def test_window_bounds(spark):
    got = windows.window_bounds(series(spark, range(26), start=24), KEY, 2).orderBy("start_year", "start_sub").collect()
    assert [tuple(r)[1:] for r in got] == [(2, 1, 3, 12), (2, 2, 4, 1), (2, 3, 4, 2)]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1001])
def test_exact_quantiles_equal_percentile(spark, n):
    """Against the built-in aggregate, with a group that repeats one value and missing values."""
    df = spark.range(0, n, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"),
        F.when(F.col("id") % 2 == 0, 5.0).when(F.col("id") % 11 != 0, F.col("id") * 37 % 101 / 7).alias("x"),
    )
    got = {(r["g"], r["probability"]): r["quantile"] for r in ranking.exact_quantiles(df, ["g"], "x", [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]).collect()}
    for (group, p), quantile in got.items():
        wanted = df.where(F.col("g") == group).agg(F.percentile("x", F.lit(p))).first()[0]
        assert quantile == pytest.approx(wanted, rel=1e-12)
    assert len(got) == 6 * df.where("x IS NOT NULL").select("g").distinct().count()


def seasonal(n, freq, trend=0.0):
    shape = [0.8, 1.1, 1.3, 0.8] if freq == 4 else [1 + 0.1 * math.sin(k) for k in range(12)]
    return [(100 + trend * t) * shape[t % freq] for t in range(n)]


@pytest.mark.parametrize("freq", [4, 12])
def test_seasonal_adjustment_removes_a_pure_season(spark, freq):
    df = series(spark, seasonal(4 * freq, freq))
    got = windows.seasonal_adjust(df, KEY, ["x"], freq)
    assert values(got, "x_sa_ok") == [True] * (4 * freq)
    adjusted = values(got)
    assert adjusted == pytest.approx([adjusted[0]] * len(adjusted))
    # The factors average 1.
    factors = [x / a for x, a in zip(values(df), adjusted)]
    assert sum(factors[:freq]) / freq == pytest.approx(1.0)


@pytest.mark.parametrize("bad", [[1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6, 7, 0, 9], [1, 2, 3, 4, None, 6, 7, 8, 9]])
def test_seasonal_adjustment_falls_back(spark, bad):
    got = windows.seasonal_adjust(series(spark, bad), KEY, ["x"], 4)
    assert values(got) == [None if v is None else float(v) for v in bad]
    assert set(values(got, "x_sa_ok")) == {False}


@pytest.mark.parametrize("freq", [4, 12])
def test_filters_remove_a_pure_season(spark, freq):
    df = series(spark, seasonal(4 * freq, freq)).unionByName(series(spark, seasonal(2 * freq, freq), "b", start=3 * freq))
    got = windows.seasonal_adjust(df, KEY, ["x"], freq, method="filters")
    assert set(values(got, "x_sa_ok")) == {True}
    level = 100 * sum(seasonal(freq, freq)) / freq / 100
    assert values(got) == pytest.approx([level] * (6 * freq), rel=1e-9)


@pytest.mark.parametrize("freq", [4, 12])
def test_filters_follow_a_moving_season(spark, freq):
    # The season swings from one shape to its opposite: one factor per sub-period is wrong at both ends.
    n = 16 * freq
    shape = [math.sin(2 * math.pi * (k + 0.5) / freq) for k in range(freq)]
    smooth = [100 + 0.5 * t * 4 / freq for t in range(n)]
    df = series(spark, [m * (1 + 0.3 * (1 - 2 * t / n) * shape[t % freq]) for t, m in enumerate(smooth)])
    worst, inside = {}, {}
    for method in ("classical", "filters"):
        got = values(windows.seasonal_adjust(df, KEY, ["x"], freq, method=method))
        errors = [abs(g / m - 1) for g, m in zip(got, smooth)]
        worst[method], inside[method] = max(errors), max(errors[5 * freq : -5 * freq])
    assert worst["classical"] > 0.2 and inside["classical"] > 0.06
    # At the ends the means by sub-period reach back more than forth, so they trail a season that keeps moving.
    assert worst["filters"] < 0.5 * worst["classical"]
    assert inside["filters"] < 0.2 * inside["classical"]


def test_filters_draw_extremes_in(spark):
    plain = seasonal(40, 4)
    spiked = [x * (1.5 if t == 18 else 1.0) for t, x in enumerate(plain)]
    found = {m: values(windows.seasonal_adjust(series(spark, spiked), KEY, ["x"], 4, method=m)) for m in ("classical", "filters")}
    level = sum(plain[:4]) / 4
    # The same quarter of the other years keeps its level; the spike stays in its own quarter.
    others = [t for t in range(40) if t % 4 == 2 and abs(t - 18) > 4]
    error = {m: max(abs(v[t] / level - 1) for t in others) for m, v in found.items()}
    assert error["filters"] < 0.5 * error["classical"]
    assert found["filters"][18] > 1.3 * level


@pytest.mark.parametrize("bad", [[1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 6, 7, 0, 9], [1, 2, 3, 4, None, 6, 7, 8, 9]])
def test_filters_fall_back(spark, bad):
    got = windows.seasonal_adjust(series(spark, bad), KEY, ["x"], 4, method="filters")
    assert values(got) == [None if v is None else float(v) for v in bad]
    assert set(values(got, "x_sa_ok")) == {False}
    with pytest.raises(ValueError):
        windows.seasonal_adjust(series(spark, bad), KEY, ["x"], 4, method="other")


def test_trend_filters():
    # Published weights of the 5- and 13-term filters.
    assert henderson(2) == pytest.approx([-0.0734, 0.2937, 0.5594, 0.2937, -0.0734], abs=1e-4)
    assert henderson(6)[6:] == pytest.approx([0.24006, 0.21434, 0.14736, 0.06549, 0.0, -0.02786, -0.01935], abs=1e-5)
    for half in (2, 6):
        filters = trend_weights(half)
        assert all(sum(f) == pytest.approx(1.0) and len(f) == 2 * half + 1 for f in filters)
        assert filters[0] == filters[-1][::-1]
        # The middle filter keeps cubics.
        assert sum(w * j**2 for j, w in enumerate(filters[half], -half)) == pytest.approx(0.0, abs=1e-12)
    # The last point's 13-term filter with the usual noise.
    assert trend_weights(6)[-1][:7] == pytest.approx([-0.09186, -0.05811, 0.01202, 0.11977, 0.24390, 0.35315, 0.42113], abs=1e-4)


def test_zscore_and_constant_series(spark):
    df = series(spark, [1, 2, 3]).unionByName(series(spark, [5, 5], "b"))
    assert values(aggregate.zscore(df, KEY, "x"), "z") == [-1.0, 0.0, 1.0, None, None]


def test_binned_density_is_near_the_exact_one(spark):
    data = {"a": [100 * math.sin(7 * k) + k % 13 for k in range(2000)], "b": [3.0] * 3, "c": [None, 4.0], "d": [None]}
    rows = functools.reduce(lambda x, y: x.unionByName(y), [series(spark, v, e) for e, v in data.items()])
    exact = {(r["e"], r["point"]): r for r in aggregate.kernel_density(rows, KEY, "x").collect()}
    for refine in (4, 16):
        binned = {(r["e"], r["point"]): r for r in aggregate.binned_density(rows, KEY, "x", refine=refine).collect()}
        assert binned.keys() == exact.keys()
        for (e, point), r in binned.items():
            known = [v for v in data[e] if v is not None]
            span = exact[e, 63]["x"] - exact[e, 0]["x"]
            h = (span - (max(known) - min(known))) / 6
            bound = (span / (63 * refine)) ** 2 / (8 * h**3 * math.sqrt(2 * math.pi))
            assert r["x"] == pytest.approx(exact[e, point]["x"])
            assert abs(r["density"] - exact[e, point]["density"]) <= bound + 1e-12


def test_kernel_density_integrates_to_one(spark):
    df = series(spark, [1, 2, 2, 3, 5, 8, 13, 4, 4, 6])
    got = aggregate.kernel_density(df, KEY, "x", 200).orderBy("point").collect()
    step = got[1]["x"] - got[0]["x"]
    assert sum(r["density"] for r in got) * step == pytest.approx(1.0, abs=0.01)


def test_histogram_counts_every_row(spark):
    df = series(spark, list(range(100)) + [None]).unionByName(series(spark, [3, 3, 3], "b"))
    got = aggregate.histogram(df, KEY, "x", 7)
    assert {r["e"]: r["n"] for r in got.groupBy("e").agg(F.sum("n").alias("n")).collect()} == {"a": 100, "b": 3}
    assert got.agg(F.max("bin")).first()[0] == 6


def test_balance(spark):
    df = series(spark, [1, 2, 3]).unionByName(series(spark, [1, 2, 3], "b").where("period_idx <> 1"))
    assert {r["e"]: r["gap_free"] for r in aggregate.balance(df, KEY).collect()} == {"a": True, "b": False}


def test_weighted_totals_and_national_row(spark):
    panel = spark.createDataFrame([(1, 0, 10.0), (2, 0, 20.0), (3, 0, 30.0), (3, 1, None)], "entity int, period_idx int, value double")
    people = spark.createDataFrame([(1, "n", 1), (2, "n", 3), (3, "s", 4)], "entity int, region string, population int")
    dimension = aggregate.shares(people, "entity", "population")
    got = {(r["region"], r["period_idx"]): r["value"] for r in aggregate.weighted_total(panel, dimension, "region").collect()}
    assert got[("n", 0)] == pytest.approx(10 / 8 + 20 * 3 / 8) and got[("s", 0)] == pytest.approx(15)
    assert got[("s", 1)] is None
    mean = aggregate.national_row(panel.where("period_idx = 0"), dimension).first()["value"]
    total = aggregate.national_row(panel.where("period_idx = 0"), dimension, mode="sum").first()["value"]
    assert total == pytest.approx((10 + 60 + 120) / 8) and mean == pytest.approx(total / 3)


def test_null_safe_join(spark, rows):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "p"), (2, "q")], "k int, b string")
    assert rows(joins.null_safe_join(a, b, ["k"]), "k", "a", "b") == [(None, "y", "p")]
    assert joins.null_safe_join(a, b, ["k"], "full").count() == 3


def test_natural_join_needs_a_common_column(spark):
    with pytest.raises(ValueError):
        joins.natural_join(spark.range(1), spark.range(1).toDF("other"))


def test_fold_full_equals_the_chain_of_full_joins(spark, rows):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "b", 3.0), (3, "c", 4.0)], "k int, name string, v double")
    folded = joins.fold_full(long, ["k"], "name", "v", ["a", "b", "c"])
    chain = None
    for n in "abc":
        part = long.where(F.col("name") == n).select("k", F.col("v").alias(n))
        chain = part if chain is None else chain.join(part, "k", "full")
    assert rows(folded) == rows(chain.select("k", "a", "b", "c"))


def test_split_and_list_cells(spark, rows):
    df = spark.createDataFrame([("a-b-c",), ("d",)], "x string")
    assert rows(reshape.split_column(df, "x", ["p", "q"], "-", merge_rest=True)) == [("a", "b-c"), ("d", None)]
    assert rows(reshape.split_column(df, "x", ["p", "q"], "-")) == [("a", "b"), ("d", None)]
    cells = spark.createDataFrame([(1, "Chiapas, Oaxaca,  , Puebla")], "id int, s string")
    assert rows(reshape.split_rows(cells, "s"), "s") == [("Chiapas",), ("Oaxaca",), ("Puebla",)]


def test_pivot_and_unpivot_are_inverse(spark, rows):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 4.0)], "k int, a double, b double")
    long = reshape.to_long(df, ["k"], ["a", "b"], "name", "v")
    assert rows(reshape.to_wide(long, ["k"], "name", "v", ["a", "b"])) == rows(df)


def test_parallel_arrays_to_rows(spark, rows):
    df = spark.createDataFrame([(1, ["a", "b"], [0.1, None])], "k int, term array<string>, beta array<double>")
    assert rows(reshape.tidy_vectors(df, ["k"], ["term", "beta"])) == [(1, 0, "a", 0.1), (1, 1, "b", None)]


def test_selection_helpers(spark, rows):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["gdp_total", "gdp_primary", "dev_temp", "temp"])
    assert selection.names_like(df, prefix="gdp") == ["gdp_total", "gdp_primary"]
    assert selection.names_like(df, suffix="temp", exclude=["temp"]) == ["dev_temp"]
    assert selection.any_of(df, ["temp", "zzz"]) == ["temp"]
    with pytest.raises(ValueError):
        selection.all_of(df, ["zzz"])
    assert selection.drop_unless(df, False, ["temp", "zzz"]).columns == df.columns[:3]
    with pytest.raises(ValueError):
        selection.with_level(df, "x", ["gdp_total"])


def test_complete_cases_drops_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, s string")
    assert selection.complete_cases(df).count() == 1
    assert selection.complete_cases(df, ["s"]).count() == 3


def test_spline_goes_through_its_knots_and_keeps_lines(spark):
    df = series(spark, [10, 20, 30, 40], start=8)
    got = spline_to_months(df, KEY, "x", "m").orderBy("period_idx").collect()
    assert [r["period_idx"] for r in got] == list(range(24, 36))
    assert [r["m"] for r in got] == pytest.approx([10 + 10 / 3 * (i - 1) for i in range(12)])
    bent = spline_to_months(series(spark, [1, 4, 2, 8]), KEY, "x", "m").orderBy("period_idx").collect()
    assert [bent[i]["m"] for i in (1, 4, 7, 10)] == pytest.approx([1, 4, 2, 8])


def test_spline_bridges_gaps_and_single_points(spark):
    bridged = spline_to_months(series(spark, [1, None, 3]), KEY, "x", "m").orderBy("period_idx").collect()
    assert bridged[4]["m"] == pytest.approx(2.0)
    single = spline_to_months(series(spark, [5]), KEY, "x", "m").collect()
    assert [r["m"] for r in single] == [5.0] * 3


def test_spline_with_cubic_ends(spark):
    # Any cubic comes back, over gaps and beyond the outer knots too; three knots give a parabola, two a line.
    cubic = lambda t: 2 - 3 * t + 0.5 * t**2 - 0.25 * t**3
    for n, curve in ((9, cubic), (4, cubic), (3, lambda t: 1 + t - 2 * t**2), (2, lambda t: 4 - t), (1, lambda t: 7.0)):
        knots = [curve(float(q)) if n < 9 or q not in (1, 6) else None for q in range(n)]
        got = spline_to_months(series(spark, knots), KEY, "x", "m", ends="cubic").orderBy("period_idx").collect()
        assert [r["m"] for r in got] == pytest.approx([curve((m - 1) / 3) for m in range(3 * n)], rel=1e-9, abs=1e-9)
    with pytest.raises(ValueError):
        spline_to_months(series(spark, [1]), KEY, "x", "m", ends="other")


def test_interleave_labels_every_other_row(spark):
    df = spark.createDataFrame([("t", "a", "1", "(2)"), ("t", "b", "3", "(4)")], "g string, v string, est string, se string")
    got = reshape.interleave(df, ["g"], "est", "se", "v", [F.col("v")]).orderBy("row").collect()
    assert [(r["v"], r["cell"]) for r in got] == [("a", "1"), (None, "(2)"), ("b", "3"), (None, "(4)")]


def test_two_values_for_one_cell_are_an_error(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "id string, name string, value double")
    with pytest.raises(Exception, match="more than one value"):
        reshape.to_wide(df, ["id"], "name", "value", ["x"]).collect()


def test_numbered_rows(spark):
    from panelloom.operators.ranking import numbered

    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS v")
    got = numbered(df, ["g"], [F.col("v").desc()]).collect()
    assert all(r.row == (999 - r.v) // 3 + 1 for r in got) and len(got) == 1000
