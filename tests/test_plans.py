import datetime as dt

import pytest

from panelloom.plans import climate, events, macro, panel, views


def test_extreme_flags(spark):
    cases = [("winter", 0.03), ("winter", -0.03), ("winter", 0.0), ("winter", None), ("summer", 0.02), ("summer", -0.02), ("spring", None)]
    df = spark.createDataFrame(cases, "season string, d double")
    got = climate.extreme_season_flags(df, "d", 0.02).collect()
    columns = ("all_seasons", "h_winter", "h_summer", "c_winter")
    assert [tuple(r[c] for c in columns) for r in got] == [
        (1, 1, 0, None),  # hot winter: the cold flag is missing
        (1, None, 0, 1),
        (0, 0, 0, 0),
        (None, None, 0, None),
        (1, 0, 1, 0),
        (1, 0, None, 0),
        (None, 0, 0, 0),
    ]


def index_setup(spark):
    values = spark.createDataFrame([(1, 0, 10.005), (2, 0, 20.0), (3, 0, 0.125), (3, 1, 1.0)], "entity int, period_idx int, value double")
    people = spark.createDataFrame([(1, "n", 0.25), (2, "n", 0.25), (3, "s", 0.5)], "entity int, region string, weight double")
    return values, people


def test_weighted_index_rounds_weighs_and_adds_the_nation(spark):
    values, people = index_setup(spark)
    got = {(r["region"], r["period_idx"]): r["value"] for r in climate.weighted_index(values, people, "region").collect()}
    # 0.125 rounds to the even 0.12.
    assert got[("s", 0)] == pytest.approx(0.12 * 0.5)
    assert got[("national", 0)] == pytest.approx((got[("n", 0)] + got[("s", 0)]) / 3)
    proper = climate.weighted_index(values, people, "region", national="sum").where("is_total AND period_idx = 0").first()
    assert proper["value"] == pytest.approx(3 * got[("national", 0)])
    assert got[("n", 0)] == pytest.approx(7.5, abs=0.01) and ("n", 1) not in got


def test_weighted_index_without_weights_and_centred(spark):
    values, people = index_setup(spark)
    plain = climate.weighted_index(values, people, "region", weighted=False, places=None)
    assert plain.where("region = 'n'").first()["value"] == pytest.approx(30.005)
    centred = climate.weighted_index(values, people, "region", centred=True, places=None).where("region = 's'").collect()
    assert sum(r["value"] for r in centred) == pytest.approx(0.0)


def monthly(spark, values, start):
    rows = [("a", start + i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "region string, period_idx int, x double")


def test_constant_series_has_zero_anomalies(spark):
    df = monthly(spark, [3.3] * 60, 24000)
    got = climate.all_norms(df, ["region"], ["x"], [1, 2], 24036, 24059).collect()
    assert len(got) == 16
    assert {(r["deviation_x"], r["pos_dev_x"], r["neg_dev_x"]) for r in got} == {(0.0, 0.0, 0.0)}


def test_anomaly_is_scaled_by_the_norm_length(spark):
    df = monthly(spark, range(60), 24000)
    got = {r["norm_years"]: r for r in climate.all_norms(df, ["region"], ["x"], [1, 3], 24057, 24059).collect()}
    # The quarter's mean is 58; the norms lag it by half a window.
    assert got[1]["deviation_x"] == pytest.approx(2 / 2 * 5.5) and got[3]["deviation_x"] == pytest.approx(2 / 4 * 17.5)
    assert got[1]["season"] == "autumn" and got[1]["sub_period"] == 4


def test_monthly_norms(spark):
    got = climate.all_norms(monthly(spark, range(30), 24000), ["region"], ["x"], [1], 24020, 24029, freq=12)
    assert got.count() == 10
    assert got.where("period_idx = 24023").first()["season"] == "winter"


def test_range_that_starts_in_a_quarter_keeps_part_of_it(spark):
    df = monthly(spark, range(12), 24000)
    got = {r["period_idx"]: r["x"] for r in climate.observed_panel(df, ["region"], ["x"], 24002, 24008).collect()}
    assert got == {8000: 2.0, 8001: 4.0, 8002: 7.0}


def test_price_panel_is_strict_and_renamed(spark):
    rows = [("a", 24000 + m, c, 1.0 + m) for m in range(6) for c in ("general", "alimentos") if (m, c) != (4, "alimentos")]
    rows += [("a", 24000, "other", 9.0)]
    df = spark.createDataFrame(rows, "entity string, period_idx int, category string, value double")
    got = macro.price_panel(df, {"general": "headline", "alimentos": "food"}, 24000, 24005, adjusted=False)
    assert got.columns == ["entity", "period_idx", "headline", "food"]
    assert {r["period_idx"]: (r["headline"], r["food"]) for r in got.collect()} == {8000: (2.0, 2.0), 8001: (5.0, None)}


def test_national_per_capita_parses_quarters(spark):
    rows = [(f"{y}/{q}", 100.0 * q) for y in (2001, 2002, 2003) for q in (1, 2, 3, 4)] + [("note", None)]
    national = spark.createDataFrame(rows, "quarter string, total double")
    people = spark.createDataFrame([(50,)], "population int")
    got = macro.national_per_capita(national, people, ["total"], "national").orderBy("period_idx").collect()
    assert len(got) == 12 and got[0]["period_idx"] == 8004
    assert [r["total"] for r in got] == pytest.approx([5.0] * 12)


def test_estimation_panel(spark):
    rows = [("a", 8015, 1.0, False), ("a", 8016, None, False), ("national", 8015, 2.0, True)]
    df = spark.createDataFrame(rows, "region string, period_idx int, x double, is_total boolean")
    got = panel.estimation_panel(df, ["x"]).collect()
    assert [(r["region"], r["date"]) for r in got] == [("a", dt.date(2003, 12, 1))]


def test_event_panel_conforms_and_completes(spark):
    main = spark.createDataFrame(
        [(1, "x", "flood", 24000, 10.0), (2, "y", "flood", 24000, 30.0), (3, "z", "fire", 24001, 5.0), (4, "w", "quake", 24001, 99.0)],
        "event_id int, location string, event_group string, period_idx int, impact double",
    )
    places = spark.createDataFrame([(1, "x", "Distrito Federal, Oaxaca"), (2, "y", "Oaxaca"), (3, "z", ""), (4, "w", "Oaxaca")], "event_id int, location string, states string")
    dimension = spark.createDataFrame([("ciudad de mexico", "centre"), ("oaxaca", "south")], "entity string, region string")
    aliases = spark.createDataFrame([("distrito.federal", "ciudad de mexico")], "alias_slug string, entity string")
    got = events.event_panel(main, places, dimension, "region", ["flood", "fire"], aliases, 24000, 24011)
    assert got.count() == 8
    first = {r["region"]: (r["flood"], r["fire"]) for r in got.where("period_idx = 8000").collect()}
    assert first == {"centre": (10.0, None), "south": (20.0, None)}


def test_views_keep_every_cell(spark):
    rows = [(30, "pos_dev_temp", o, h, 1.0 + h, 0.5, "**" if h else None) for o in ("gdp_total", "food") for h in (0, 1)]
    rows += [(30, "deviation_temp", "food", 0, 9.0, 9.0, None)]
    df = spark.createDataFrame(rows, "norm_years int, shock string, outcome string, horizon int, estimate double, se double, signif string")
    got = views.response_layout(df, ["norm_years"], 1, ["pos_dev_temp"]).orderBy("outcome", "line").collect()
    assert [(r["part"], r["label"], r["h0"], r["h1"]) for r in got] == [
        ("prices", "food", "1.00", "2.00 **"), ("prices", None, "(0.500)", "(0.500)"),
        ("output", "gdp_total", "1.00", "2.00 **"), ("output", None, "(0.500)", "(0.500)"),
    ]


def test_summary_puts_the_nation_first(spark):
    df = spark.createDataFrame([("b", 1.0), ("b", 3.0), ("a", 2.0), ("national", 5.0)], "region string, x double")
    got = views.summary_table(df, {"x": ("Anomalies", 4)}).orderBy("row").collect()
    assert [(r["title"], r["region"], r["mean"]) for r in got] == [
        ("Anomalies", "national", "5.0000"), (None, "a", "2.0000"), (None, "b", "2.0000")
    ]
    assert got[1]["stdv"] is None
