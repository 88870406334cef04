import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelloom import config
from panelloom.functions import calendar as cal
from panelloom.functions import names, numbers
from panelloom.operators import aggregate


def one(spark, column, **values):
    """Value of an expression on one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_config_is_checked():
    cfg = config.PanelConfig()
    assert cfg.horizon == 8
    assert cfg.path("/out/", "panel") == cfg.path("/out", "panel")
    assert cfg.path("/out", "panel").startswith("/out/panel/source=grid/freq=4/level=7/")
    with pytest.raises(ValueError):
        config.PanelConfig(level=5)
    with pytest.raises(ValueError):
        config.PanelConfig(start=date(2020, 1, 1), end=date(2019, 1, 1))


def test_critical_values():
    assert [config.critical_value(a) for a in (0.1, 0.05, 0.01)] == [1.645, 1.96, 2.576]
    for bad in (0.2, 5, "x", None):
        with pytest.raises(ValueError):
            config.critical_value(bad)


def test_rate_lags():
    assert config.rate_lag("q", 12) == 3
    assert config.rate_lag("q", 12, monthly_q_lag=4) == 4
    assert config.rate_lag("y", 4) == 4
    with pytest.raises(ValueError):
        config.rate_lag("m", 4)


def test_signed_parts_keep_null(spark, rows):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,), (None,)], "x double")
    got = df.select("x", numbers.positive_part(F.col("x")), numbers.negative_part(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0, 1.0), (0.0, 0.0, 0.0), (2.0, 2.0, 0.0), (None, None, None)]
    total = df.select((numbers.positive_part(F.col("x")) + numbers.negative_part(F.col("x")) - F.abs("x")).alias("d"))
    assert {r["d"] for r in total.collect()} == {0.0, None}


@pytest.mark.parametrize("x,places,expected", [(1.005, 2, 1.01), (-1.5, 0, -1.0), (2.4449, 2, 2.44), (0.125, 2, 0.13)])
def test_round_places(spark, x, places, expected):
    assert one(spark, numbers.round_places(F.col("x"), places), x=x) == expected


def test_round_places_ignores_the_last_bits(spark):
    tie = 200841.76875
    below = math.nextafter(tie, 0)
    assert one(spark, numbers.round_places(F.col("x"), 4), x=tie) == one(spark, numbers.round_places(F.col("x"), 4), x=below)


def test_logs_and_ratios_of_bad_values(spark):
    assert one(spark, numbers.log_or_null(F.col("x")), x=0.0) is None
    assert one(spark, numbers.log_or_null(F.col("x")), x=-3.0) is None
    assert one(spark, numbers.ratio(F.col("x"), F.lit(0.0)), x=1.0) is None
    assert one(spark, numbers.to_number(F.col("x")), x=" 1.5 ") == 1.5
    assert one(spark, numbers.to_number(F.col("x")), x="N/E") is None
    assert one(spark, numbers.nan_to_null(F.col("x")), x=float("nan")) is None


def test_stars_at_the_cutoffs(spark):
    t = F.col("t")
    marks = {v: one(spark, numbers.stars(t, config.LONG_RUN_CUTOFFS, ""), t=v) for v in (1.645, 1.7, -2.0, 2.4)}
    assert marks == {1.645: "", 1.7: "*", -2.0: "**", 2.4: "***"}
    assert one(spark, numbers.stars(t, config.PROJECTION_CUTOFFS), t=1.0) is None
    assert one(spark, numbers.stars(t, config.PROJECTION_CUTOFFS), t=2.4) == "**"


def test_strict_and_skipping_means(spark):
    months = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, None)], "e string, period_idx int, x double")
    assert aggregate.to_quarters(months, ["e"], ["x"]).first()["x"] == 1.5
    assert aggregate.to_quarters(months, ["e"], ["x"], strict_mean=True).first()["x"] is None


def test_sum_or_zero(spark):
    empty = spark.createDataFrame([("a", None)], "e string, x double")
    got = empty.groupBy("e").agg(aggregate.sum_or_zero(F.col("x")).alias("z"), F.avg("x").alias("m")).first()
    assert (got["z"], got["m"]) == (0.0, None)


def test_quartiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "e string, x double")
    got = aggregate.describe_by(df, ["e"], "x").first()
    assert (got["p25"], got["p50"], got["p75"]) == (1.75, 2.5, 3.25)


@pytest.mark.parametrize("text,expected", [("2003 Q4", 8015), ("2003Q4", 8015), ("2003/1", 8012), ("2003-2", 8013), ("2003/5", None), ("x", None), (None, None)])
def test_parse_quarter(spark, text, expected):
    assert one(spark, cal.parse_quarter(F.col("t").cast("string")), t=text) == expected


@pytest.mark.parametrize("text,expected", [("1901-01", 22812), ("2024-12", 24299), ("2024-13", None), ("2024", None)])
def test_parse_month(spark, text, expected):
    assert one(spark, cal.parse_month(F.col("t")), t=text) == expected


def test_calendar_round_trip(spark):
    day = F.lit(date(2003, 12, 17))
    assert one(spark, cal.period_start(cal.month_index(day), 12)) == date(2003, 12, 1)
    assert one(spark, cal.period_start(cal.quarter_index(day), 4)) == date(2003, 10, 1)
    assert one(spark, cal.quarter_end_month(cal.quarter_index(day))) == date(2003, 12, 1)
    assert one(spark, cal.quarter_label(cal.quarter_index(day))) == "2003 Q4"
    assert one(spark, cal.month_to_quarter_index(cal.month_index(day))) == cal.index_of(2003, 4, 4)


def test_seasons_differ_by_frequency(spark):
    by_month = {m: one(spark, cal.season(F.col("m"), 12), m=m) for m in (12, 1, 3, 8, 11, 13)}
    assert by_month == {12: "winter", 1: "winter", 3: "spring", 8: "summer", 11: "autumn", 13: None}
    assert one(spark, cal.season(F.col("q"), 4), q=4) == "autumn"
    assert one(spark, cal.season(F.col("q"), 4), q=1) == "winter"


def test_names(spark):
    assert one(spark, names.slug(F.col("t")), t="Área Met. de la Cd. de México") == "area.met.de.la.cd.de.mexico"
    assert one(spark, names.slug(F.col("t")), t="Tlaxcala") == "tlaxcala"
    assert one(spark, names.squish(F.col("t")), t="  a \t b\n c ") == "a b c"
    assert one(spark, names.repair_mojibake(F.col("t")), t="MichoacÃ¡n y LeÃ³n, Ã\u0081rea") == "Michoacán y León, Área"
    assert one(spark, names.repair_mojibake(F.col("t")), t="México") == "México"
    assert one(spark, names.strip_code_prefix(F.col("t")), t="09 Ciudad de México") == "Ciudad de México"
    assert one(spark, names.sentence_case(F.col("t")), t="pRIMARY sector") == "Primary sector"
    assert one(spark, names.title_case(F.col("t")), t="baja california SUR") == "Baja California Sur"
    assert one(spark, names.extract_label(F.col("t"), ["Total", "primarias"]), t="Actividades primarias") == "primarias"
    assert one(spark, names.extract_label(F.col("t"), ["Total"]), t="none") is None
    assert names.slug_text("Población total (1)") == "poblacion_total_1"


def test_headers_stay_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Año", "ano", "Área %"])
    assert names.clean_headers(df).columns == ["ano", "ano_2", "area"]


def test_conform_is_exact(spark, rows):
    aliases = spark.createDataFrame(
        [("mexico", "estado de mexico"), ("ciudad.de.mexico", "ciudad de mexico")], "alias_slug string, entity string"
    )
    df = spark.createDataFrame([("México",), ("Ciudad de México",), ("Nuevo México",)], "name string")
    assert rows(names.conform(df, "name", aliases), "entity") == [
        ("ciudad de mexico",), ("estado de mexico",), ("nuevo.mexico",)
    ]
